"""Folders of files as a Python data source: a planned scan with pushed-down predicates, and a sink with a commit.

``spark.read.format("folder").load(root)`` lists names and sizes, hidden names included: (path, name, ext, size).  Each
folder directly below the root is walked in a task; bytes are read later, spread by size.  Predicates on extension, name and
size are options (exts, prefix, leastBytes, mostBytes) and are applied while listing: filters that Spark pushes into a
Python source stay in force for every other use of the same DataFrame, so this source takes none.

``df.write.format("folder")`` takes (name, content).  Tasks write below a staging folder; the commit renames the files of
the attempts that count, and an abort, or the end of a commit, removes the staging folder with all other attempts.
"""

from __future__ import annotations

import math
import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from framefold.session import work_partitions

LISTED = "path string, name string, ext string, size long"
STAGING = ".staging-"
FOLDER_GROUPS = 256  # tasks of a listing at most
TASK_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
RENAMES = 16  # at a time


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if not re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, root = fs.FileSystem.from_uri(re.sub(r"^([a-zA-Z][a-zA-Z0-9+.-]+):/(?!/)", r"\1:///", path))
    return system, root.rstrip("/")


def extension(name: str) -> str:
    return posixpath.splitext(name)[1][1:].lower()


# ---------------------------------------------------------------- scan

@dataclass
class Folders(InputPartition):
    """Folders to walk, and whether their own files alone are meant."""

    paths: list[str]
    flat: bool


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.exts = set(filter(None, options.get("exts", "").split(",")))
        self.prefix = options.get("prefix", "")
        self.least, self.most = int(options.get("leastbytes", 0)), int(options.get("mostbytes", 1 << 62))

    def wanted(self, name: str, size: int) -> bool:
        return name.startswith(self.prefix) and self.least <= size <= self.most and (not self.exts or extension(name) in self.exts)

    def partitions(self) -> list[InputPartition]:
        system, root = file_system(self.path)
        below = sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and not x.base_name.startswith(STAGING))
        groups = min(len(below), FOLDER_GROUPS)
        return [Folders([root], True), *(Folders(below[i::groups], False) for i in range(groups))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, root = file_system(self.path)
        prefix = self.path.rstrip("/")
        for folder in partition.paths:
            rows = []
            for found in system.get_file_info(fs.FileSelector(folder, recursive=not partition.flat)):
                if found.type == fs.FileType.File:
                    name = found.path[len(root) + 1:]
                    if self.wanted(name, found.size):
                        rows.append({"path": f"{prefix}/{name}", "name": name, "ext": extension(name), "size": found.size})
            for low in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[low:low + 10_000], pa.schema(
                    [("path", pa.string()), ("name", pa.string()), ("ext", pa.string()), ("size", pa.int64())]))


# ---------------------------------------------------------------- sink

@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.job = f"{STAGING}{uuid.uuid4().hex}"
        system, root = file_system(self.path)
        system.create_dir(f"{root}/{self.job}", recursive=True)  # tasks do not make it again once an abort has removed it

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, root = file_system(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=False)
        made: set[str] = set()
        for batch in iterator:
            for name, content in zip(batch["name"], batch["content"]):
                target = posixpath.normpath(f"{folder}/{name.as_py()}")
                if not target.startswith(f"{folder}/"):
                    raise ValueError(f"a name outside of the folder: {name.as_py()!r}")
                parent = folder
                for step in posixpath.dirname(target)[len(folder) + 1:].split("/"):
                    parent = posixpath.join(parent, step)
                    if step and parent not in made:
                        system.create_dir(parent, recursive=False)  # nor is what an abort has removed made again here
                        made.add(parent)
                with system.open_output_stream(target, compression=None) as out:
                    out.write(content.as_py() or b"")
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        with ThreadPoolExecutor(RENAMES) as pool:
            for message in filter(None, messages):
                found = system.get_file_info(fs.FileSelector(message.folder, recursive=True, allow_not_found=True))
                names = [x.path[len(message.folder) + 1:] for x in found if x.type == fs.FileType.File]
                for parent in {posixpath.dirname(name) for name in names} - {""}:
                    system.create_dir(f"{root}/{parent}", recursive=True)
                list(pool.map(lambda name, folder=message.folder: system.move(f"{folder}/{name}", f"{root}/{name}"), names))
        self.abort(messages)

    def abort(self, messages: list[Attempt | None]) -> None:
        system, root = file_system(self.path)
        for wait in (0.0, 0.1, 0.5, 2.0, None):
            try:
                if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
                    system.delete_dir(f"{root}/{self.job}")
                return
            except OSError:  # a task that has not stopped yet wrote meanwhile
                if wait is None:
                    raise
                time.sleep(wait)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options))


# ---------------------------------------------------------------- frames

def list_files(spark: SparkSession, root: str, exts: list[str] | None = None, prefix: str = "", least_bytes: int = 0,
               most_bytes: int | None = None) -> DataFrame:
    """LISTED for the files below ``root`` with one of the extensions (all, if none is given), name prefix and size."""
    spark.dataSource.register(FolderSource)
    options = {"exts": ",".join(exts or []), "prefix": prefix, "leastBytes": str(least_bytes)}
    if most_bytes is not None:
        options["mostBytes"] = str(most_bytes)
    return spark.read.format("folder").options(**options).load(root)


def with_content(listed: DataFrame) -> DataFrame:
    """Adds ``content``.  Files are dealt by name over tasks of about TASK_BYTES; a task holds a few files at a time."""
    total = listed.agg(F.sum("size")).first()[0] or 0
    tasks = max(work_partitions(listed.sparkSession), math.ceil(total / TASK_BYTES))
    schema = listed.schema.add("content", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, size = 0, [], 0
            for i, path in enumerate(batch["path"].to_pylist()):
                system, place = file_system(path)
                with system.open_input_stream(place, compression=None) as stream:
                    held.append(stream.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(low, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*part.schema.names, "content"])
                    low, held, size = i + 1, [], 0

    return listed.repartition(tasks, F.xxhash64("path")).mapInArrow(run, schema)


def write_files(exported: DataFrame, root: str) -> None:
    """K6: (name, content) as files below ``root``, all or none."""
    exported.sparkSession.dataSource.register(FolderSource)
    exported.select("name", "content").write.format("folder").mode("append").save(root)
