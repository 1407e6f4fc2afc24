"""What the operators of this folder share: words, stable numbers, table reads."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split`` splits at exactly these six characters."""
    data = utf8(text)
    return (data.translate(LOWER) if lower else data).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of splitmix64 on uint64; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that follow from ``salt``."""
    start = np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15 & 0xFFFF_FFFF)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, kept for one task and emptied when ``limit`` words are held."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_WHITE = np.zeros(256, bool)
_WHITE[[ord(c) for c in SPACES]] = True
_powers = seeds(64, 11)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, as ``words`` finds them, from its bytes at once: a factor for each place in a word."""
    global _powers
    x = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~_WHITE[x])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    sizes = np.diff(np.append(first, len(at)))
    longest = int(sizes.max())
    if longest > len(_powers):
        _powers = seeds(2 * longest, 11)
    place = np.arange(len(at)) - np.repeat(first, sizes)
    sums = np.add.reduceat((x[at].astype(np.uint64) + np.uint64(1)) * _powers[place], first)
    return mix(sums + sizes.astype(np.uint64))


def rolling(hashes: np.ndarray, size: int, salt: int = 7) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, seed in enumerate(seeds(size, salt)):
        out += hashes[i:i + n] * seed
    return mix(out)


def id_bucket(column: Column, buckets: int) -> Column:
    """crc32 of the number as text, modulo ``buckets``; null stays null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def crc_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """At most about ``per_class`` labelled documents of each class with their text, and the classes' sizes.

    Rows are chosen by a hash of the id, so the choice is the same in every run.  The chosen ids (two classes
    times ``per_class``, plus a few) are broadcast; that bound does not grow with the tables.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    if where is not None:
        known = known.where(where)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, text string, label int"), {}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("choice")), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(place < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sizes
