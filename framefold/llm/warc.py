"""WARC archives as a PySpark Python data source (format ``warc``), and their revisit records.

Writing: every task writes one file, a gzip member per record behind a ``warcinfo`` record; the driver then commits a
manifest of the files whose tasks succeeded, so what a lost or repeated attempt left behind is never read.  Each write has a
manifest of its own, so an append adds files; an overwrite's manifest names those it replaces, whose files are then removed.
A folder without manifests, as other tools write it, is read as all its ``*.warc.gz`` files; the first append takes these over.

Reading: the driver plans partitions over parts of files (small ones together; a manifest holds a member's offset every
PARTITION_BYTES), takes over comparisons with the record type and with header fields, and each task parses a record's headers
first: only wanted records have their block inflated.  Others are skipped unread by the member's length, which the writer leaves in
the gzip header (the ``sl`` extra field); without it, or with several records in a member, they are inflated without keeping
them.  Files are opened by pyarrow's file systems, so the path may be local, shared or remote.

Rows of both directions are ``SCHEMA``; a response's payload is what follows its HTTP header, without undoing transfer or content
encodings, and ``payload_bytes`` is its length if the record does not say.  Filters on
``warc_type``, ``record_id``, ``target_uri``, ``payload_digest`` and ``refers_to`` are pushed down with
``spark.sql.python.filterPushdown.enabled``.  Option ``payload`` = "false" leaves the payload column null.

Cases: a null html is an empty payload; a null url is left out; rows with null page_id get a record id made of their
digest, come back with null page_id, and are plain responses; repeated page_ids of one payload: one row is the response and the
others of that page_id are responses too, since a record does not refer to itself; very long payloads are one record each, held
by one task at a time; no rows give a manifest without records; a folder that is missing raises; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage)

from ..session import materialize, shared_dir
from .common import table

SCHEMA = "warc_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
FIELDS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
          "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "_manifest-"
OWN_FILE = re.compile(r"pages-[0-9a-f]{32}\.warc\.gz")  # read only if a manifest names it
PARTITION_BYTES = 32 << 20
CHUNK = 1 << 18
LEAST_BYTES = 0  # payloads of at least so many bytes are written once


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def clean(value: str | None) -> str | None:
    """Header values have no line ends."""
    return None if value is None else " ".join(value.split())


def page_record(row: dict) -> bytes:
    kind, payload = row["warc_type"], row["payload"] or b""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE), ("WARC-Target-URI", clean(row["target_uri"])),
        ("WARC-Payload-Digest", row["payload_digest"]), ("WARC-Payload-Bytes", str(row["payload_bytes"])),
        ("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(fields, head if kind == "revisit" else head + payload)


class Records:
    """Headers of the records in part of a file, from a member's offset to another; ``block`` gives the last one's content."""

    def __init__(self, stream, start: int, end: int):
        self.stream, self.end = stream, end
        self.seek(start)

    def seek(self, to: int) -> None:
        self.stream.seek(to)
        self.at, self.left = to, b""  # end of what was read, and what of it is not used yet

    def fill(self) -> bool:
        data = self.stream.read(CHUNK)
        self.at += len(data)
        self.left += data
        return bool(data)

    def __iter__(self) -> Iterator[dict[str, str]]:
        while self.at - len(self.left) < self.end:
            while len(self.left) < 24 and self.fill():
                pass
            if not self.left:
                return
            length = member_length(self.left)
            stop = length and self.at - len(self.left) + length
            self.member, self.seen = zlib.decompressobj(31), b""
            while (head := self.headers()) is not None:
                self.rest = int(head["content-length"])
                yield head
                if stop:
                    break
                self.block(keep=False)
            if stop:
                self.skip(stop)

    def skip(self, to: int) -> None:
        unused = self.at - to
        if unused < 0:
            self.seek(to)
        elif unused < len(self.left):
            self.left = self.left[len(self.left) - unused:]

    def more(self, most: int = 1 << 16) -> bytes:
        """Up to ``most`` further bytes of the member; nothing at its end."""
        while not self.member.eof:
            out = self.member.decompress(self.left, most)
            self.left = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if out:
                return out
            if not self.left and not self.member.eof and not self.fill():
                raise EOFError("a gzip member is cut off")
        return b""

    def headers(self) -> dict[str, str] | None:
        """Fields of the member's next record by lower-case name; None if there is no other."""
        while b"\r\n\r\n" not in self.seen:
            part = self.more(4096)
            if not part:
                if self.seen:
                    raise ValueError("a WARC record has no end of its headers")
                return None
            self.seen = (self.seen + part).lstrip(b"\r\n")
        head, _, self.seen = self.seen.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}

    def block(self, keep: bool = True) -> bytes:
        """What is left of the record's content, and the line ends behind it off the way."""
        parts = []
        while self.rest:
            part = self.seen or self.more(1 << 20)
            if not part:
                raise EOFError("a WARC block is shorter than its Content-Length")
            used, self.seen = part[:self.rest], part[self.rest:]
            self.rest -= len(used)
            if keep:
                parts.append(used)
        self.seen = self.seen.lstrip(b"\r\n")
        return b"".join(parts)


def member_length(start: bytes) -> int | None:
    """Length of the gzip member that starts so, if its ``sl`` field tells."""
    if len(start) < 24 or not start[3] & 4 or start[12:16] != b"sl\x08\x00":
        return None
    return struct.unpack_from("<I", start, 16)[0] or None


@dataclass
class Parts(InputPartition):
    parts: list[tuple[str, int, int]]  # file name, first and last + 1 byte


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    splits: list[int]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = FIELDS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, EqualTo):
                self.wanted.append((name, {f.value}))
            elif name and isinstance(f, In):
                self.wanted.append((name, set(f.value)))
            elif name and isinstance(f, IsNotNull):
                self.wanted.append((name, set()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        parts = []
        for name, (size, splits) in archive_files(*file_system(self.path))[0].items():
            ends = [*splits, size]
            parts += [(name, start, end) for start, end in zip([0, *splits], ends) if end > start]
        out: list[list] = []
        room = 0
        for part in sorted(parts, key=lambda x: (x[1] - x[2], x)):
            size = part[2] - part[1]
            if size > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(part)
            room -= size
        return [Parts(x) for x in out] or [Parts([])]

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        system, root = file_system(self.path)
        rows, size = [], 0
        for name, start, end in partition.parts:
            with system.open_input_file(f"{root}/{name}") as stream:
                records = Records(stream, start, end)
                for head in records:
                    if any(k not in head or (v and head[k] not in v) for k, v in self.wanted):
                        continue
                    payload, length = None, head.get("warc-payload-bytes")
                    if self.payload and head.get("warc-type") == "response":
                        payload = records.block().partition(b"\r\n\r\n")[2]
                        size += len(payload)
                        length = len(payload) if length is None else length
                    rows.append((*(head.get(k) for k in FIELDS.values()), None if length is None else int(length), payload))
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield self.batch(rows)
                        rows, size = [], 0
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kind, record_id, uri, digest, refers, length, payload = zip(*rows) if rows else [()] * 7
        text = pa.string()
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, text), pa.array(record_id, text), pa.array(uri, text), pa.array(digest, text), pa.array(length, pa.int64()), pa.array(refers, text), pa.array(payload, pa.binary())],
            ["warc_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"])


def archive_files(system, root: str) -> tuple[dict[str, tuple[int, list[int]]], list[str]]:
    """Files of a folder by name, each with its size and offsets to split it at, and the names of its manifests.

    Without a manifest all archives count that are not left over from writes of this source.
    """
    from pyarrow import fs

    found = {f.path.removeprefix(root).lstrip("/"): f.size for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File}
    names = sorted(n for n in found if n.startswith(MANIFEST))
    if not names:
        return {n: (size, []) for n, size in found.items() if n.endswith(".warc.gz") and not OWN_FILE.fullmatch(n.rsplit("/", 1)[-1])}, []
    manifests = {}
    for name in names:
        with system.open_input_stream(f"{root}/{name}") as f:
            manifests[name] = json.loads(f.read())
    gone = {old for m in manifests.values() for old in m["replaces"]}
    files = {name: (size, splits) for n, m in manifests.items() if n not in gone for name, size, splits in m["files"]}
    return files, [n for n in names if n not in gone]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name, size, splits = f"pages-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            for data in self.members(info, iterator):
                if size - splits[-1] >= PARTITION_BYTES:
                    splits.append(size)
                out.write(data)
                size += len(data)
        return Written(name, size, splits[1:])

    @staticmethod
    def members(info: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield zipped(info)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for row in batch.slice(low, 256).to_pylist():
                    yield zipped(page_record(row))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        before, manifests = archive_files(system, root)
        files = [[m.name, m.size, m.splits] for m in messages if m]
        if not manifests and not self.overwrite:  # archives of other tools stay part of the folder
            files += [[name, size, splits] for name, (size, splits) in before.items()]
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps({"replaces": manifests if self.overwrite else [], "files": files}).encode())
        if self.overwrite:
            for name in before:
                system.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        """Files that no manifest names are not read; those of finished tasks are removed."""
        system, root = file_system(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.name}")


def zipped(data: bytes) -> bytes:
    """A gzip member whose header has its compressed and plain length, if 32 bits can hold them."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    trailer = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    total = 24 + len(body) + len(trailer)
    if max(total, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + trailer
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + trailer


class WarcSource(DataSource):
    """``spark.dataSource.register(WarcSource)``, then ``spark.read.format("warc").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


@F.pandas_udf(T.StringType())
def base32_sha1(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: base64.b32encode(hashlib.sha1(x or b"").digest()).decode())


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def page_of(record_id: Column) -> Column:
    found = F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(found != "", found.cast("long"))


def page_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Rows of SCHEMA for page_id, url, html.

    Of equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a response, the others revisit it.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    source = source.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    kept = source.where(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes))
    same = kept.groupBy("sha", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    same = materialize(same.select("sha", "size", "response"))
    # the response's id reaches a page only where it is another page's
    known = source.join(same, ["sha", "size"], "left").withColumn("response", F.when(F.col("response") != F.col("page_id"), F.col("response")))
    again = F.col("response").isNotNull()
    return known.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), "sha", F.lit(">"))).alias("record_id"),
        F.col("url").alias("target_uri"), F.concat(F.lit("sha1:"), base32_sha1("payload")).alias("payload_digest"),
        F.col("size").alias("payload_bytes"), urn(F.col("response")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"))


def write_archives(records: DataFrame, path: str, mode: str = "append") -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode(mode).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(page_records(table(spark, sf_dir, "pages")), path)
    found = read_archives(spark, path).where(F.col("warc_type").isin("response", "revisit"))
    stored = F.col("warc_type") == "response"
    return found.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(stored, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, base32_sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))
