"""Fill-in-middle: texts cut at line ends into prefix, middle and suffix, which are written in another order.

The ends of a text's lines are a Roaring-style set of code point offsets: containers of 2**16 offsets each, stored as a
sorted array, a bitmap or runs, whichever is smallest, and the number of offsets before each container.  The offset
after k lines is the set's k-th member: a search over the cumulative cardinalities finds the container, and a select inside
it the member.  A text of any length is held once, with a set that is never larger than 8 KB per 2**16 code points.

Which lines the cuts fall on, and the form, follow from the SHA-256 of ``seed:doc_id``; so a document is cut alike in every
run and partition.  Texts that contain a marker stay plain, hence markers occur once each in a changed text and
``restore`` splits there, in Spark's own functions.

Cases: a null text is an empty one, and empty texts stay plain; a null doc_id counts as no digits; rows that repeat a doc_id
are cut at the same hash, each by its own number of lines, so equal rows give equal results; very long texts and very
long lines are taken whole; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

SEED = 7
RATE = 100  # per cent of the texts that are changed
SPM_SHARE = 50  # per cent of the changed texts whose suffix comes first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CONTAINER = 1 << 16
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, i: int) -> int:
        return int(self.low[i])


class BitmapContainer:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(CONTAINER, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.before, i, "right")) - 1
        word = int(self.words[at])
        for _ in range(i - int(self.before[at])):
            word &= word - 1  # drops the lowest set bit
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    def __init__(self, low: np.ndarray, heads: np.ndarray):
        self.starts = low[heads]
        self.before = heads

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.before, i, "right")) - 1
        return int(self.starts[at]) + i - int(self.before[at])


class BoundarySet:
    """A sorted set of offsets with ``select``."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        self.before = first  # members before each container
        self.base = high[first] << 16
        self.containers = [self._container((offsets[a:b] & (CONTAINER - 1)).astype(np.uint16))
                           for a, b in zip(first, [*first[1:], len(offsets)])]
        self.size = len(offsets)

    @staticmethod
    def _container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
        heads = np.flatnonzero(np.concatenate([[True], np.diff(low) != 1]))
        sizes = {"array": 2 * len(low), "bitmap": CONTAINER // 8, "run": 4 * len(heads)}
        kind = min(sizes, key=sizes.__getitem__)
        if kind == "array":
            return ArrayContainer(low)
        return BitmapContainer(low) if kind == "bitmap" else RunContainer(low, heads)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.base[at]) + self.containers[at].select(k - int(self.before[at]))


def line_bounds(text: str) -> BoundarySet:
    """Code point offsets where lines begin or end: 0 and the end of each of the n lines, so n + 1 members."""
    data = np.frombuffer(utf8(text), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if len(data) != len(text):
        ends = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
    last = [] if not text or text[-1] == "\n" else [len(text)]
    return BoundarySet(np.concatenate([[0], ends, last]).astype(np.int64))


def transform(doc_id: int | None, text: str | None, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    bounds = line_bounds(text)
    n = bounds.size - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = bounds.select(first), bounds.select(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: RESULT, where ``output`` is the transformed text.  No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                rows = [transform(i, t, seed, rate, spm_share) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
                n, form, before, between, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()),
                     pa.array(between, pa.int64()), pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, RESULT)


def restore(form: Column, output: Column) -> Column:
    """The text that a transformed text came from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
            .when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


ORACLE = """with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as g,
        regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as lines from documents),
h as (select doc_id, text, lines, len(lines)::BIGINT as n, ('0x' || substring(g, 1, 8))::BIGINT as h1,
        ('0x' || substring(g, 9, 8))::BIGINT as h2, ('0x' || substring(g, 17, 8))::BIGINT as h3, ('0x' || substring(g, 25, 8))::BIGINT as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
             when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
p as (select *, coalesce(array_to_string(lines[1:a], ''), '') as pre, coalesce(array_to_string(lines[a + 1:b], ''), '') as mid,
        coalesce(array_to_string(lines[b + 1:n], ''), '') as suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars,
    case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
        else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256
from p"""
