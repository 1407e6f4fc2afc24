"""Substring deduplication: FM-indexes over wavelet matrices, searched backwards by streamed text.

A window is ``LENGTH`` consecutive words.  A word goes if a window covers it whose word sequence also starts earlier (in
a smaller doc_id, or further left in the same document).

1. Documents with one word sequence are one class: only the first is looked at, the others are covered by it entirely.
2. Each window names its anchor, the leftmost run of ``GRAM`` words with the smallest hash in it.  Equal windows have
   equal anchors, so a window whose anchor occurs once in the corpus is unique.  Spark counts the anchors.
3. The windows of a repeated anchor that lie next to each other form a segment, and the anchor's hash names the shard.
   Segments of equal words are collapsed to the earliest; the later ones are repeated as a whole.  Anchors with more than
   ``HOT`` occurrences (a passage that much of the corpus shares) are cut into single windows keyed by their own
   words, so that no shard grows with the frequency of a passage.
4. A shard's segments are indexed: suffix array, Burrows-Wheeler transform, and a wavelet matrix of packed bits with rank
   directories.  The segments are then streamed from right to left, all in step: the interval of the last 20 words is
   shortened by one word at its right end (to the neighbours with at least 19 words in common) and extended by one
   word at its left by two rank queries a level.  These are the matching statistics up to 20; a window is reported if
   the smallest origin in its interval is not its own.
5. Reported windows go back to their documents.

Cases: a null or empty text has no words; a text of fewer words than a window loses none; rows with null doc_id are
left as they are and do not count as occurrences; of rows that repeat a doc_id with different texts one (the smallest
digest) is the document and the others are left as they are; equal rows get equal results; very long texts are taken whole,
in runs of at most ``RUN`` windows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, work_partitions
from .common import rolling, table, utf8, word_hashes, words

LENGTH = 20
GRAM = 6
HOT = 2048
RUN = 64  # windows of one segment at most
SHARD_WORDS = 100_000
ALL_ONES = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


class WaveletMatrix:
    """Rank queries over integers below 2**levels: one row of packed bits and one rank directory per level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.n = levels, len(values)
        self.bits, self.before, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(int(self.n - ones.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of symbols[i] before ends[i]."""
        start, end = np.zeros(len(ends), np.int64), ends
        for i in range(self.levels):
            one = ((symbols >> (self.levels - 1 - i)) & 1).astype(bool)
            a, b = self._ones(i, start), self._ones(i, end)
            start = np.where(one, self.zeros[i] + a, start - a)
            end = np.where(one, self.zeros[i] + b, end - b)
        return end - start

    def _ones(self, i: int, at: np.ndarray) -> np.ndarray:
        block, offset = at >> 6, (at & 63).astype(np.uint64)
        mask = ~(ALL_ONES << offset)
        return self.before[i][block] + np.bitwise_count(self.bits[i][block] & mask)


def ranks_of(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
    out = np.empty(len(keys), np.int64)
    out[order] = new
    return out


class FmIndex:
    """Segments of words (each a run of integers from 1 on) with a separator after each."""

    def __init__(self, segments: list[np.ndarray], length: int = LENGTH):
        count = len(segments)
        sizes = np.array([len(s) for s in segments])
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        real = np.ones(n, bool)
        real[ends] = False
        text[real] = np.concatenate(segments)
        self.starts = ends - sizes
        self.text = text
        order_key = text + count - 1  # separators differ, and all are smaller than any word
        order_key[ends] = np.arange(count)
        rank = {1: ranks_of(order_key)}
        width = 1
        while width < max(length, int(sizes.max()) + 1):
            r = rank[width]
            after = np.concatenate([r[width:], np.full(min(width, n), -1)])[:n]
            rank[2 * width] = ranks_of(r * (n + 1) + after + 1)
            width *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank[width]] = np.arange(n)
        self.suffixes = suffixes
        symbols = int(text.max()) + 1
        self.matrix = WaveletMatrix(text[suffixes - 1], max(1, (symbols - 1).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.shared = self._bounds(rank, length - 1)
        self.equal = self._bounds(rank, length)

    def _bounds(self, rank: dict[int, np.ndarray], depth: int) -> np.ndarray:
        """Group number of each row of the index; rows of one group have ``depth`` first words in common."""
        same, at, n = np.ones(len(self.suffixes) - 1, bool), 0, len(self.suffixes)
        for width in sorted(rank, reverse=True):
            if at + width <= depth:
                r = np.concatenate([rank[width], np.full(at + 1, -1)])
                place = np.minimum(self.suffixes + at, n)
                own = np.where(place < n, r[place], -1 - self.suffixes)
                same &= own[1:] == own[:-1]
                at += width
        return np.concatenate([[0], np.cumsum(~same)])

    def earliest(self, queries: list[np.ndarray], origins: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
        """For each query segment and each of its windows the smallest origin among the window's occurrences.

        ``origins`` has a number for each position of the indexed text; queries consist of indexed words.  Windows
        without an occurrence get the largest int64.
        """
        none = np.iinfo(np.int64).max
        heads = np.flatnonzero(np.concatenate([[True], self.shared[1:] != self.shared[:-1]]))
        tails = np.append(heads[1:], len(self.shared))
        first = np.flatnonzero(np.concatenate([[True], self.equal[1:] != self.equal[:-1]]))
        smallest = np.minimum.reduceat(origins[self.suffixes], first)
        sizes = np.array([len(q) for q in queries])
        width = int(sizes.max())
        right = np.zeros((len(queries), width), np.int64)  # column 0 is the last word
        for i, q in enumerate(queries):
            right[i, :len(q)] = q[::-1]
        found = np.full((len(queries), width), none)
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.text))
        for step in range(width):
            on = np.flatnonzero((sizes > step) & (high > low))
            if not len(on):
                break
            a, b = low[on], high[on]
            if step >= length:  # forget the word at the right end
                group = self.shared[a]
                a, b = heads[group], tails[group]
            word = right[on, step]
            base = self.smaller[word]
            both = self.matrix.rank(np.concatenate([word, word]), np.concatenate([a, b]))
            low[on], high[on] = base + both[:len(on)], base + both[len(on):]
            if step >= length - 1:
                hit = on[high[on] > low[on]]
                found[hit, step] = smallest[self.equal[low[hit]]]
        return [found[i, length - 1:size][::-1] for i, size in enumerate(sizes)]


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of every run of ``size`` values, by runs of doubled length."""
    n, width = len(values) - size + 1, 1
    while 2 * width <= size:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[:n], values[size - width:size - width + n])


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash, the first window and the last + 1; at most RUN windows a run."""
    if len(hashes) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0, int)
    least = _sliding(rolling(hashes, GRAM), LENGTH - GRAM + 1, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least))
    if (last - first).max() > RUN:
        first = np.concatenate([np.arange(f, e, RUN) for f, e in zip(first, last)])
        last = np.append(first[1:], len(least))
    return least[first].view(np.int64), first, last


def anchor_places(hashes: np.ndarray) -> np.ndarray:
    """Anchor hashes of a document, once for each place where one lies.

    A place is an anchor's if its value is the smallest of a window around it, hence the largest of these windows' smallest.
    """
    if len(hashes) < LENGTH:
        return np.zeros(0, np.int64)
    grams, size = rolling(hashes, GRAM), LENGTH - GRAM + 1
    least = _sliding(grams, size, np.minimum)
    edge = np.zeros(size - 1, np.uint64)
    around = _sliding(np.concatenate([edge, least, edge]), size, np.maximum)
    return grams[grams == around].view(np.int64)


def digest(data: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with the text compressed, as it is to be shuffled."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for low in range(0, whole.num_rows, 1000):
            batch = whole.slice(low, 1000)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([pack(utf8(t)) for t in batch["text"].to_pylist()], pa.binary())], ["doc_id", "packed"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 1000):
            batch = whole.slice(low, 1000)
            n, sha, one, two, found = [], [], [], [], []
            for text in batch["text"].to_pylist():
                own = words(text)
                joined = b" ".join(own)
                a, b = digest(joined)
                n.append(len(own))
                sha.append(hashlib.sha256(joined).hexdigest())
                one.append(a)
                two.append(b)
                anchor, times = np.unique(anchor_places(word_hashes(utf8(text))), return_counts=True)
                found.append(np.repeat(anchor, np.minimum(times, 2)))  # twice if the document repeats it itself
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(sha), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "sha", "high", "low", "anchors"])


SKETCH = "doc_id long, n_words long, sha string, high long, low long, anchors array<long>"
SEGMENTS = "doc_id long, packed binary, start int, windows int, shard_key long, alone boolean, high long, low long, words binary"
KINDS = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their repeated anchors, the hot ones among them and their digest, to rows of three kinds:

    the text (compressed); segments with their words and the digest of those; segments equal to an earlier one of the document.
    """
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for low in range(0, whole.num_rows, 100):
            batch = whole.slice(low, 100)
            rows: list[tuple] = []
            for doc_id, packed, repeated, hot, high, low64 in zip(*(batch[c].to_pylist() for c in ("doc_id", "packed", "repeated", "hot", "high", "low"))):
                data = unpack(packed)
                own = data.split()
                if digest(b" ".join(own)) != (high, low64):  # another row of this doc_id
                    continue
                rows.append((doc_id, packed) + (None,) * 7)
                repeated, hot, seen = set(repeated), set(hot), set()
                for key, first, last in zip(*(x.tolist() for x in anchors(word_hashes(data)))):
                    if key not in repeated:
                        continue
                    alone = key in hot
                    step = 1 if alone else last - first
                    for start in range(first, last, step):
                        part = b" ".join(own[start:start + step + LENGTH - 1])
                        if part in seen:
                            rows.append((doc_id, None, start, step) + (None,) * 5)
                            continue
                        seen.add(part)
                        rows.append((doc_id, None, start, step, key, alone, *digest(part), part))
            columns = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], ["doc_id", "packed", "start", "windows", "shard_key", "alone", "high", "low", "words"])


def shard_repeats(doc_ids: list[int], starts: list[int], texts: list[bytes]) -> list[bytes]:
    """For each segment of a shard one byte per window: 1 if the window's words also start earlier."""
    split = [t.split() for t in texts]
    numbers: dict[bytes, int] = {}
    segments = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in s]) for s in split]
    index = FmIndex(segments)
    n = len(index.text)
    owner = np.repeat(np.arange(len(segments)), [len(s) + 1 for s in segments])
    place = np.arange(n) - index.starts[owner] + np.array(starts)[owner]
    order = np.lexsort((place, np.array(doc_ids)[owner]))
    origins = np.empty(n, np.int64)
    # positions of one document and place are one origin, whichever segment they come from
    doc, at = np.array(doc_ids)[owner][order], place[order]
    origins[order] = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))])
    out: list[bytes] = []
    for low in range(0, len(segments), 4096):
        part = segments[low:low + 4096]
        for i, found in enumerate(index.earliest(part, origins), low):
            own = origins[index.starts[i]:index.starts[i] + len(found)]
            out.append((found < own).astype(np.uint8).tobytes())
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by shard: one index per shard, closed earlier if it exceeds a few times the planned size."""
    def done(rows: list[tuple]) -> pa.RecordBatch:
        doc_ids, starts, texts = ([r[i] for r in rows] for i in (0, 1, 2))
        flags = shard_repeats(doc_ids, starts, texts)
        hit = [i for i, f in enumerate(flags) if 1 in f]
        return pa.RecordBatch.from_arrays(
            [pa.array([doc_ids[i] for i in hit], pa.int64()), pa.array([starts[i] for i in hit], pa.int32()), pa.array([flags[i] for i in hit], pa.binary())],
            ["doc_id", "start", "flags"])

    now, rows = None, []
    for batch in batches:
        for shard, doc_id, start, text in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "start", "words"))):
            if shard != now and rows:
                yield done(rows)
                rows = []
            now = shard
            rows.append((doc_id, start, text))
    if rows:
        yield done(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated windows: words removed, digest and text of what is kept."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        removed, sha, kept = [], [], []
        for packed, runs in zip(batch["packed"].to_pylist(), batch["runs"].to_pylist()):
            own = unpack(packed).split()
            step = np.zeros(len(own) + 1, np.int32)
            for run in runs:
                at = run["start"] + np.flatnonzero(np.frombuffer(run["flags"], np.uint8))
                step[at] += 1
                np.subtract.at(step, at + LENGTH, 1)
            keep = np.cumsum(step[:-1]) == 0
            joined = b" ".join([w for w, k in zip(own, keep.tolist()) if k])
            removed.append(len(own) - int(keep.sum()))
            sha.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "removed", "cut_sha", "kept_text"])


def repeated_anchors(sketch: DataFrame, heads: DataFrame) -> DataFrame:
    """Documents with the anchors that occur twice or more in the corpus, and the hot ones among these.

    ``heads`` (doc_id, high, low, n) are the documents that count, and in how many equal rows of ``sketch`` each stands.
    """
    rows = sketch.select("doc_id", "high", "low", "anchors")
    single = rows.join(heads.where("n = 1"), ["doc_id", "high", "low"], "left_semi").select("doc_id", "anchors")
    again = heads.where("n > 1")
    if not again.isEmpty():
        once = rows.join(again, ["doc_id", "high", "low"], "left_semi").groupBy("doc_id").agg(F.first("anchors").alias("anchors"))
        single = single.unionByName(once)
    marked = single.select("doc_id", F.explode("anchors").alias("anchor"))
    counts = marked.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialize(counts.select("anchor", (F.col("n") > HOT).alias("is_hot")))
    known = marked.join(counts, "anchor").groupBy("doc_id").agg(
        F.collect_set("anchor").alias("repeated"), F.collect_set(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot"))
    return known


def repeated_runs(segments: DataFrame) -> DataFrame:
    """(doc_id, start, flags) of segments with repeated windows, from rows of SEGMENTS without texts."""
    cores = work_partitions(segments.sparkSession)
    own = segments.where("high is not null")
    total = own.where("not alone").agg(F.sum(F.col("windows") + LENGTH - 1)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))
    distinct = own.groupBy("high", "low").agg(
        F.min(F.struct("doc_id", "start")).alias("at"), F.count("*").alias("n"), F.first("windows").alias("windows"),
        F.first("shard_key").alias("shard_key"), F.first("alone").alias("alone"), F.first("words").alias("words"))
    distinct = materialize(distinct.select("high", "low", "at.doc_id", "at.start", "n", "windows", "shard_key", "alone", "words"))
    dealt = distinct.where("not alone").select(F.pmod(F.xxhash64("shard_key"), F.lit(shards)).alias("shard"), "doc_id", "start", "words")
    dealt = dealt.repartition(max(cores, min(shards, 20 * cores)), "shard").sortWithinPartitions("shard", "doc_id", "start")
    searched = dealt.mapInArrow(_search, "doc_id long, start int, flags binary")
    first = distinct.where("n > 1").select("high", "low", F.col("doc_id").alias("first_id"), F.col("start").alias("first_start"))
    again = own.select("high", "low", "doc_id", "start", "windows").join(first, ["high", "low"]).where("doc_id <> first_id or start <> first_start")
    covered = again.select("doc_id", "start", "windows").union(segments.where("high is null and windows is not null").select("doc_id", "start", "windows"))
    return searched.union(covered.select("doc_id", "start", F.expr("cast(repeat(char(1), windows) as binary)").alias("flags")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and kept_text where a text loses words."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialize(source.mapInArrow(_sketch, SKETCH))
    long_enough = sketch.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= LENGTH)).select("doc_id", "high", "low")
    classes = long_enough.groupBy("high", "low").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    copies = materialize(classes.where("n > 1").select("high", "low", "first_id"))
    heads = long_enough.join(copies, ["high", "low"], "left").where("coalesce(first_id, doc_id) = doc_id")
    heads = heads.groupBy("doc_id", "high", "low").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.min(F.struct("high", "low", "n")).alias("s"))
    heads = materialize(heads.select("doc_id", "s.*"))
    known = repeated_anchors(sketch, heads).join(heads.select("doc_id", "high", "low"), "doc_id")
    texts = source.where("doc_id is not null").mapInArrow(_packed, "doc_id long, packed binary")
    segments = materialize(texts.join(known, "doc_id").mapInArrow(_segments, SEGMENTS))
    runs = repeated_runs(segments.where("packed is null").drop("packed"))
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "flags")).alias("runs"))
    cut = segments.where("packed is not null").select("doc_id", "packed").join(runs, "doc_id").mapInArrow(_cut, "doc_id long, removed long, cut_sha string, kept_text string")
    cut = cut.join(heads.select("doc_id", "high", "low"), "doc_id")
    all_rows = sketch.drop("anchors").join(copies, ["high", "low"], "left").join(cut, ["doc_id", "high", "low"], "left")
    gone = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    return all_rows.select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")
