"""Ranked lexical search: MaxScore with bounds of term pairs, over an inverted index in shards.

A term's weight follows from the number of documents that hold it, its impact in a document from its occurrences and the
document's length; a document's score sums the impacts of the query's terms (``search`` has the formulas).

1. ``build_index`` inverts every document.  A task closes a shard after ``SHARD_BYTES`` of text or ``SHARD_DOCS`` documents
   and writes one row per term with its postings, and one row with the shard's ids and lengths.  Nothing is shuffled.
2. Spark joins the postings with the queries' terms and sums up the documents that hold each of them.
3. The distinct terms of a query are paired, frequent ones with frequent ones.  ``pair_lists`` stores for each shard and
   pair the intersection list, its joint maximum impact and its largest joint impacts; single terms have a row without list.
   The k-th largest joint impact of a pair over all shards is a score that k documents reach, so a query starts with the
   largest of these as its threshold.
4. A shard answers a query by MaxScore over pairs.  What a pair can add is the joint maximum for documents on its
   list, and the larger of both maxima for all others, which is at most the sum of the maxima.  The pairs whose bounds sum up to less than
   the threshold are not essential: documents with nothing else are never looked at.  The candidates of the other pairs are
   scored, and the rest is added pair by pair from the largest bound down; before each pair those go that can't reach
   the threshold any more, first by the sum of bounds, then by their own place on or off the list.  If all pairs together
   fall short, the shard is skipped.  Documents that tie with the threshold stay, so the result is exact.
5. Each shard returns at most k rows per query; they are ranked in salted parts and then once more.

Queries are taken in blocks of about ``BLOCK_ROWS`` (query, term) rows, which is what the driver holds and the tasks get.

Cases: documents without a term, null and empty texts among them, don't count and are never found; rows with null doc_id are
no documents; rows that repeat a doc_id are documents of their own, and may be listed each; very long texts are indexed
whole, a shard for themselves if need be; queries without terms, or with null text, have no rows; equal query rows are one query, rows that share an id
and differ in text are each ranked from 1; equal scores go by ascending doc_id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, work_partitions
from .common import LOWER, table, utf8

TOP = 20
SHARD_BYTES = 16_000_000
SHARD_DOCS = 1 << 16
BLOCK_ROWS = 200_000
SHARDS_PER_TASK = 4
TERM_BYTES = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))  # ASCII beside letters and digits parts terms

INDEX = "shard long, term string, df long, tokens long, docs binary, tfs binary"
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
PAIRS = "shard long, a string, b string, docs binary, most long, top array<long>"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return utf8(text).translate(TERM_BYTES).split()


# ---------------------------------------------------------------- index

def _pieces(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: ``values`` cut at ``bounds``."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _shard_rows(shard: int, ids: list[int], lengths: list[int], numbers: dict[bytes, int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "term", "df", "tokens", "docs", "tfs"]
    about = [shard], [None], [sum(n > 0 for n in lengths)], [sum(lengths)], [np.array(ids, np.int64).tobytes()], [np.array(lengths, np.int64).tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(about, KINDS)], names)
    if not numbers:
        return
    key = np.concatenate(found) * SHARD_DOCS + np.repeat(np.arange(len(ids)), lengths)
    key, tf = np.unique(key, return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(numbers) + 1) * SHARD_DOCS)
    count = len(numbers)
    columns = (pa.array(np.full(count, shard), pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for t in numbers], pa.string()),
               pa.array(np.diff(bounds), pa.int64()), pa.nulls(count, pa.int64()),
               _pieces((key % SHARD_DOCS).astype(np.uint16), bounds), _pieces(tf.astype(np.uint32), bounds))
    batch = pa.RecordBatch.from_arrays(list(columns), names)
    for low in range(0, count, 10_000):
        yield batch.slice(low, 10_000)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    ids, lengths, numbers, found, size = [], [], defaultdict(int), [], 0
    numbers.default_factory = numbers.__len__
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            own = np.fromiter(map(numbers.__getitem__, terms(text)), np.int64)
            ids.append(doc_id)
            lengths.append(len(own))
            found.append(own)
            size += len(text or "")
            if size >= SHARD_BYTES or len(ids) == SHARD_DOCS:
                yield from _shard_rows(shard, ids, lengths, numbers, found)
                shard, ids, lengths, found, size = shard + 1, [], [], [], 0
                numbers.clear()
    if ids:
        yield from _shard_rows(shard, ids, lengths, numbers, found)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """INDEX, written: rows with a term have its postings in the shard, the row without one has ids and lengths.

    Shards are numbered by task, and only one attempt of a task is committed, so the table names each shard once.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(source.where("doc_id is not null").mapInArrow(_invert, INDEX))


# ---------------------------------------------------------------- one shard

class Shard:
    """Postings of one shard with the impacts that the collection's totals give."""

    def __init__(self, rows: pa.Table, weights: dict[str, int], documents: int, tokens: int):
        self.postings: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        raw = dict(zip(rows["term"].to_pylist(), zip(rows["docs"].to_pylist(), rows["tfs"].to_pylist())))
        ids, lengths = raw.pop(None)
        self.ids = np.frombuffer(ids, np.int64)
        norm = 12 * (100 - 25 + (25 * np.frombuffer(lengths, np.int64) * documents) // tokens)
        for term, (docs, tfs) in raw.items():
            at, tf = np.frombuffer(docs, np.uint16), np.frombuffer(tfs, np.uint32).astype(np.int64)
            self.postings[term] = at, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + norm[at]))

    def intersection(self, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
        """Documents of both terms, and the sums of both impacts."""
        (short, left), (long, right) = sorted((self.postings[a], self.postings[b]), key=lambda p: len(p[0]))
        at = np.minimum(np.searchsorted(long, short), len(long) - 1)
        both = long[at] == short
        return short[both], left[both] + right[at[both]]

    def pair_rows(self, pairs: list[tuple[str, str | None]], top: int) -> Iterator[tuple[str, str | None, bytes | None, int, list[int]]]:
        for a, b in pairs:
            if a in self.postings and (b is None or b in self.postings):
                docs, joint = self.postings[a] if b is None else self.intersection(a, b)
                if len(docs):
                    largest = np.sort(joint)[::-1][:top]
                    yield a, b, None if b is None else docs.tobytes(), int(largest[0]), largest.tolist()

    def answer(self, query: list[tuple[tuple[str, int], ...]], lists: dict[tuple[str, str], tuple[np.ndarray, int]],
               most: dict[str, int], least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the shard's best documents; ``query`` has pairs of (term, times), ``least`` is a score to reach."""
        units = []  # (bound, bound off the list, bound on it, list, postings with their times)
        for pair in query:
            here = [(term, times) for term, times in pair if term in self.postings]
            if not here:
                continue
            single = max(times * most[term] for term, times in here)
            on, listed = 0, None
            if len(here) == 2 and (here[0][0], here[1][0]) in lists:
                listed, joint = lists[here[0][0], here[1][0]]
                on = joint + sum((times - 1) * most[term] for term, times in here)
            units.append((max(single, on), single, on, listed, [(*self.postings[term], times) for term, times in here]))
        units.sort(key=lambda u: u[0])
        upto = np.cumsum([0] + [u[0] for u in units]).tolist()  # upto[i]: what the first i can add together
        if upto[-1] < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        split = next(i for i, total in enumerate(upto) if total >= least) - 1  # those before can't reach it alone
        score = np.zeros(len(self.ids), np.int64)
        for *_, parts in units[split:]:
            for docs, impacts, times in parts:
                score[docs] += times * impacts
        found = np.flatnonzero(score)
        for i in range(split - 1, -1, -1):
            if len(found) >= top:
                least = max(least, int(np.partition(score[found], -top)[-top]))
            _, off, on, listed, parts = units[i]
            found = found[score[found] + upto[i + 1] >= least]
            if listed is not None:
                place = np.minimum(np.searchsorted(listed, found), len(listed) - 1)
                found = found[score[found] + np.where(listed[place] == found, on, off) + upto[i] >= least]
            for docs, impacts, times in parts:
                place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                hit = docs[place] == found
                score[found[hit]] += times * impacts[place[hit]]
        found = found[score[found] >= least]
        best = found[np.lexsort((self.ids[found], -score[found]))[:top]]
        return self.ids[best], score[best]


# ---------------------------------------------------------------- search

def _pair_lists(weights: dict[str, int], documents: int, tokens: int, pairs: list[tuple[str, str | None]], top: int):
    def run(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        found = list(Shard(rows, weights, documents, tokens).pair_rows(pairs, top))
        columns = list(zip(*found)) if found else [()] * 5
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array([shard] * len(found), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                    names=["shard", "a", "b", "docs", "most", "top"])

    return run


def _answers(weights: dict[str, int], documents: int, tokens: int, queries: list[list[tuple[tuple[str, int], ...]]], least: list[int], top: int):
    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        numbers, ids, scores = [], [], []
        if rows.num_rows and pairs.num_rows:
            shard = Shard(rows, weights, documents, tokens)
            lists, most = {}, {}
            for a, b, docs, joint in zip(*(pairs[c].to_pylist() for c in ("a", "b", "docs", "most"))):
                if b is None:
                    most[a] = joint
                else:
                    lists[a, b] = np.frombuffer(docs, np.uint16), joint
            for number, query in enumerate(queries):
                found, score = shard.answer(query, lists, most, least[number], top)
                numbers.append(np.full(len(found), number))
                ids.append(found)
                scores.append(score)
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in (numbers, ids, scores)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return run


def _first(rows: DataFrame, by: list[str], salt: Column, order: list[Column], count: int, name: str) -> DataFrame:
    """The first ``count`` rows of each group with their number: ranked in salted parts, then once more."""
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(work_partitions(rows.sparkSession))))
    inside = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    left = salted.withColumn("_place", inside).where(F.col("_place") <= count).drop("_place", "_salt")
    return left.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= count)


def _paired(asked: list[tuple[str, int, int]]) -> list[tuple[tuple[str, int], ...]]:
    """Distinct terms (term, times, weight) in pairs by weight, the names of each pair in order; an odd one stays alone."""
    ranked = [(term, times) for term, times, _ in sorted(asked, key=lambda t: (t[2], t[0]))]
    return [tuple(sorted(ranked[i:i + 2])) for i in range(0, len(ranked), 2)]


def _block(index: DataFrame, asked: DataFrame, documents: int, tokens: int, tasks: int, top: int) -> DataFrame:
    """(query_key, doc_id, score) of one block of (query_key, term, times): each shard's candidates for the ranking."""
    spark = index.sparkSession
    words = asked.select("term").distinct()
    counts = index.join(F.broadcast(words), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    rows = asked.join(counts, "term").select("query_key", "term", "times", weight.cast("long").alias("weight")).collect()
    by_query: dict[str, list[tuple[str, int, int]]] = {}
    for r in rows:
        by_query.setdefault(r["query_key"], []).append((r["term"], r["times"], r["weight"]))
    keys = sorted(by_query)
    queries = [_paired(by_query[k]) for k in keys]
    weights = {r["term"]: r["weight"] for r in rows}
    double = sorted({(p[0][0], p[1][0]) for q in queries for p in q if len(p) == 2})
    pairs = [*double, *((term, None) for term in sorted(weights))]

    held = index.join(F.broadcast(words), "term", "left_semi").unionByName(index.where("term is null"))
    held = held.select("shard", "term", "docs", "tfs").repartition(tasks, "shard")
    lists = materialize(held.groupBy("shard").applyInArrow(_pair_lists(weights, documents, tokens, pairs, top), PAIRS))
    largest = lists.select("shard", "a", "b", F.explode("top").alias("joint"))
    reached = _first(largest, ["a", "b"], F.xxhash64("shard", "joint"), [F.desc("joint")], top, "place").where(F.col("place") == top)
    sure = {(r["a"], r["b"]): r["joint"] for r in reached.select("a", "b", "joint").collect()}
    least = [max([1] + [sure.get((p[0][0], p[1][0]), 0) for p in q if len(p) == 2]
                 + [times * sure.get((term, None), 0) for p in q for term, times in p]) for q in queries]

    given = lists.select("shard", "a", "b", "docs", "most").repartition(tasks, "shard")
    found = held.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(
        _answers(weights, documents, tokens, queries, least, top), "query long, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(keys)), "query long, query_key string")
    return found.join(F.broadcast(names), "query").select("query_key", "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of ``build_index`` for each query with a score above 0.

    With N documents that have terms, L terms in them and n in one, a term in df documents weighs
    floor(1000 ln((2N + 2) / (2df + 1))) and its tf occurrences score weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L.
    """
    @F.arrow_udf("array<string>")
    def terms_of(texts: pa.Array) -> pa.Array:
        return pa.array([[t.decode("utf-8", "surrogatepass") for t in terms(text)] for text in texts.to_pylist()], pa.list_(pa.string()))

    asked = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("none")), F.col("text")), 256)
    asked = asked.select("item_id", key.alias("query_key"), F.explode(terms_of("text")).alias("term"))
    asked = materialize(asked.groupBy("item_id", "query_key", "term").agg(F.count("*").alias("times")))
    size = asked.count()
    totals = index.where("term is null").agg(F.sum("df"), F.sum("tokens"), F.count("*")).first()
    documents, tokens, shards = (x or 0 for x in totals)
    blocks = math.ceil(size / BLOCK_ROWS)
    tasks = max(work_partitions(index.sparkSession), math.ceil(shards / SHARDS_PER_TASK))
    out = None
    for number in range(blocks if documents else 0):
        own = asked.where(F.pmod(F.xxhash64("query_key"), F.lit(blocks)) == number)
        found = _block(index, own.select("query_key", "term", "times"), documents, tokens, tasks, top)
        found = materialize(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    items = asked.select("item_id", "query_key").distinct()
    if out is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    ranked = _first(out, ["query_key"], F.xxhash64("doc_id"), [F.desc("score"), F.asc("doc_id")], top, "rank")
    return ranked.join(items, "query_key").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""with words as (select doc_id, unnest({SPLIT}) as term from documents),
tfs as (select doc_id, term, count(*)::BIGINT as tf from words group by all),
lens as (select doc_id, sum(tf)::BIGINT as n from tfs group by doc_id),
total as (select count(*)::BIGINT as nd, sum(n)::BIGINT as l from lens),
dfs as (select term, count(*)::BIGINT as df from tfs group by term),
asked as (select item_id, term, count(*)::BIGINT as times from (select item_id, unnest({SPLIT}) as term from benchmark) group by all),
scored as (select a.item_id, t.doc_id, sum(a.times * floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1)))::BIGINT
        * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (100 - 25 + ((25 * n * nd) // l)))))::BIGINT as score
    from asked a join tfs t using (term) join dfs using (term) join lens using (doc_id), total group by 1, 2)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::INT as rank
    from scored where score > 0) where rank <= 20"""
