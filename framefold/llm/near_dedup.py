"""MinHash near-duplicates with sequential Bayesian verification.

1. Every whole text becomes the set of its word shingles (64-bit hashes), a digest of the set, 256 min-hashes (16 bits of
   each are kept) and 32 band keys of five full min-hashes each.  Sets with one digest are one class; the smallest id
   represents it, so copies cost nothing further on.
2. Representatives that share a band key are candidates.  A bucket's members are compared with its smallest
   member (a star, never all pairs): signatures are matched in batches of 32, and with a uniform prior the similarity's
   posterior after m of n matches is Beta(m + 1, n - m + 1).  Candidates whose posterior leaves less than ``MISS`` for
   ``LOOSE`` or more go on to the bucket's next star; the others form loose families (connected components).
3. A family is verified inside tasks: pairs of different components are matched in batches again, pruned as soon as
   P(similarity >= threshold) < ``MISS``, and the survivors are compared on their full sets, the likeliest first.
   A pair whose members are connected already is skipped, so a task emits at most a spanning forest.  Families above
   ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles are dealt over pairs of blocks.
4. Components of the confirmed links, each named by its smallest doc_id.

A pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6 and is pruned with at most MISS per
batch.  Cost inside one family is (members outside its main component) x (members) signature comparisons.

Cases: null or empty texts and texts without words have an empty set and are linked with nothing; a text with fewer words
than a shingle has is one shingle; rows with null doc_id are returned with null component_id and kept; rows that
repeat a doc_id each get a row, linked through all texts of that id; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, work_partitions
from .common import WordHashes, mix, rolling, seeds, table, words
from .components import components

WORDS = 5
PERCENT = 80
BANDS, ROWS, HASHES, BATCH = 32, 5, 256, 32
MISS = 1e-6
LOOSE = 0.4
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
STARS = 4  # star rounds with pruning; what is left after them joins its bucket's family unpruned
SEEDS = seeds(HASHES, 11)
BAND_SEEDS = seeds(ROWS, 13)


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = hashes.of(words(text, lower=True))
    if not len(found):
        return found
    return np.unique(rolling(found, min(size, len(found)), size))


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES minima over a non-empty set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):
        np.minimum(out, (found[None, at:at + 256] * SEEDS[:, None]).min(1), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    used = mix(minima[:BANDS * ROWS].reshape(BANDS, ROWS))
    return mix((used * BAND_SEEDS).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For n = BATCH, 2 BATCH, ...: fewest matches m that leave P(similarity >= threshold | m of n) >= miss.

    The posterior's upper tail is the probability of at most m successes in n + 1 trials at ``threshold``.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return out


def matches(one: np.ndarray, many: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``many`` that survive every batch against ``one``, and their matches over all hashes."""
    at, count = np.arange(len(many)), np.zeros(len(many), np.int64)
    for step, need in enumerate(least):
        part = slice(step * BATCH, (step + 1) * BATCH)
        count = count + (many[at, part] == one[part]).sum(1)
        stay = count >= need
        at, count = at[stay], count[stay]
        if not len(at):
            break
    return at, count


def confirmed(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def family_links(ids: list[int], blocks: list[int], signatures: np.ndarray, sets: list[np.ndarray], least: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar enough in one family or pair of blocks: a spanning forest.

    With two different blocks only pairs across them are looked at.
    """
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    block, links = np.array(blocks), []
    across = len(set(blocks)) > 1
    for i in range(1, len(ids)):
        many = np.arange(i)
        many = many[(100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])) & ((block[:i] != block[i]) | (not across))]
        at, count = matches(signatures[i], signatures[many], least)
        for k in many[at[np.argsort(-count, kind="stable")]].tolist():
            if root(i) != root(k) and confirmed(sets[i], sets[k], percent):
                parent[root(i)] = root(k)
                links.append((ids[k], ids[i]))
    return links


def short(minima: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum, mixed first: a minimum over many shingles begins with zeros, whatever the shingles are."""
    return (mix(minima) >> np.uint64(48)).astype(np.uint16)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                n, high, low64, bands, signs = [], [], [], [], []
                for text in batch["text"].to_pylist():
                    found = shingles(text, size, hashes)
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    n.append(len(found))
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low64.append(int.from_bytes(digest[8:], "little", signed=True))
                    minima = signature(found) if len(found) else None
                    bands.append(None if minima is None else band_keys(minima).view(np.int64))
                    signs.append(None if minima is None else short(minima).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low64, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                    ["doc_id", "n_shingles", "high", "low", "bands", "signature"])

    return run


SKETCH = "doc_id long, n_shingles long, high long, low long, bands array<long>, signature binary"


def _loose(least: list[int]):
    """Marks candidate pairs whose similarity may be LOOSE or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sign_a", "sign_b"))
            same = (one == two).reshape(-1, HASHES // BATCH, BATCH).sum(2).cumsum(1)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array((same >= np.array(least)).all(1))], ["a", "b", "loose"])

    return run


def _families(members: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of stars in every bucket: loosely similar members and the member they were compared with; and the
    signatures (rep, signature) of documents that share a bucket with another, so that later joins move only these."""
    least = least_matches(LOOSE)
    keys = materialize(members)
    found = []
    for turn in range(STARS + 1):
        firsts = keys.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
        pairs = materialize(keys.join(materialize(firsts), "key").where("rep <> a").select("key", "a", F.col("rep").alias("b")))
        if turn == 0:
            busy = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
            signs = materialize(heads.select("rep", "signature").join(materialize(busy), "rep"))
        stars = pairs.select("a", "b").distinct()
        if turn == STARS:
            found.append(stars)
            break
        stars = materialize(stars)
        if stars.isEmpty():
            found = found or [stars]
            break
        known = materialize(
            stars.join(signs.select(F.col("rep").alias("b"), F.col("signature").alias("sign_b")), "b")
            .join(signs.select(F.col("rep").alias("a"), F.col("signature").alias("sign_a")), "a")
            .mapInArrow(_loose(least), "a long, b long, loose boolean"))
        found.append(known.where("loose").select("a", "b"))
        far = known.where("not loose").select("a", "b")
        keys = materialize(pairs.join(far, ["a", "b"]).select("key", F.col("b").alias("rep")))
    return reduce(DataFrame.union, found), signs


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t, size, hashes).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["family"], batch["blocks"], batch["signature"], pa.array(found, pa.binary())], ["rep", "family", "blocks", "signature", "shingles"])

    return run


def _verify(least: list[int], percent: int):
    """Rows sorted by (family, one, two); emits links of each such group."""
    def links(rows: list[dict]) -> list[tuple[int, int]]:
        signs = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint16).reshape(-1, HASHES)
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        return family_links([r["rep"] for r in rows], [r["block"] for r in rows], signs, sets, least, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                now = row["family"], row["one"], row["two"]
                if now != key:
                    out += links(rows) if len(rows) > 1 else []
                    key, rows = now, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = links(rows) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialize(source.mapInArrow(_sketch(size), SKETCH))
    usable = sketch.where("doc_id is not null and n_shingles > 0")
    copies = materialize(usable.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("high", "low", "rep"))
    named = usable.join(copies, ["high", "low"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    classes = materialize(named.select("doc_id", "n_shingles", "rep"))
    heads = named.where("rep = doc_id").select("rep", "high", "low", "n_shingles", "bands", "signature")
    if not classes.where("rep = doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        heads = heads.dropDuplicates(["rep", "high", "low"])  # rows that repeat a doc_id; without any, nothing wide is shuffled
    heads = materialize(heads)
    families, signs = _families(heads.select(F.explode("bands").alias("key"), "rep"), heads)
    family = components(families).withColumnRenamed("root", "family").withColumnRenamed("node", "rep")
    family = materialize(family.join(heads.select("rep", "n_shingles"), "rep"))
    wide = family.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    family = materialize(family.join(materialize(wide), "family").select("rep", "family", "blocks"))
    texts = source.withColumnRenamed("doc_id", "rep").where("rep is not null")
    sets = family.join(signs.select("rep", "signature"), "rep").join(texts, "rep")
    sets = sets.mapInArrow(_sets(size), "rep long, family long, blocks int, signature binary, shingles binary")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(other))
    dealt = dealt.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "blocks")
    dealt = dealt.repartition(work_partitions(spark), "family", "one", "two").sortWithinPartitions("family", "one", "two", "rep")
    links = materialize(dealt.mapInArrow(_verify(least_matches(percent / 100), percent), "a long, b long"))
    repeated = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    found = components(links.union(repeated)).withColumnRenamed("node", "rep").withColumnRenamed("root", "component_id")
    linked = classes.join(found, "rep", "left").select("doc_id", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = sketch.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
