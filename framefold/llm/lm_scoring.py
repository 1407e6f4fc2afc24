"""LM scoring: complete-document log-probabilities under a unigram base and a gated recurrent model.

Training documents are those whose crc32(doc_id as text) mod 7 is not 2.  Spark counts every word of them; the
``VOCABULARY`` most frequent words, the end, and ``BUCKETS`` buckets of other words (by their last letters and
punctuation) are the symbols of the recurrent model, whose output biases start from the counts.  Its weights are
trained in ``ROUNDS`` rounds by truncated backpropagation (gru.py): in each round every task trains a copy on its documents
of that round, and copies are averaged by the tokens they saw.  The rounds split all training documents by a hash of the id, so
each is learned from once.

The probability of a word outside the vocabulary is that of its bucket times (c + 1) / (N_bucket + V_bucket + 1).

Texts are read and cut into words once.  Documents are taken in chunks, which are written with their distinct words and their
documents as numbers of these words (compressed); the words meet their counts and symbols in a join and come back to the chunk, those
that meet in one task as a few rows, so no count table is broadcast and no word is sorted a second time.  That gives every document's base score and its sequence of symbols, from which all rounds
learn and which the trained model scores.  Tasks are planned by the number of chunks.

Cases: a null or empty text is the end alone; rows with null doc_id are scored but not learned from, ``held_out`` is
null; repeated rows count as often as they occur; without training documents all counts and train_tokens are 0 and
the base is log10(1 / 1) per token; very long texts are learned from and scored whole, in a chunk of their own if need be; words of equal
frequency are ordered by their bytes; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, one_thread_per_task, work_partitions
from . import gru
from .byte_bpe import chunks, pack, unpack
from .common import id_bucket, table, words

FOLDS, HELD_OUT = 7, 2
VOCABULARY, BUCKETS = 2047, 64
ROUNDS = 2
LEARN_TOKENS = 1_000_000  # a task trains on so many tokens at a time, up to twice as many at its end
BLOCK = 4096
CHUNKS_PER_TASK = 4
TEXTS = 2**31 - 1  # place of a chunk's documents, after its words
ANSWERS = 250_000  # words whose counts and symbols a task gathers at a time
ROW_ANSWERS = 4096  # of these in a row at most, so that rows are no large objects
SCORED_TOKENS = 4_000_000  # a task scores documents of about so many tokens together
END_WORDS = b".,;:!?"


def bucket_of(word: bytes) -> int:
    """Class of a word outside the vocabulary: its last two letters, and whether and how it ends in punctuation."""
    stem = word.rstrip(END_WORDS)
    ending = 0 if len(stem) == len(word) else 1 if word[-1:] == b"," else 2 if word[-1:] == b"." else 3
    return ending * (BUCKETS // 4) + zlib.crc32(stem[-2:]) % (BUCKETS // 4)


def in_training(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


def in_round(doc_id: int, turn: int) -> bool:
    return zlib.crc32(f"round {doc_id}".encode()) % ROUNDS == turn


CHUNKS = "chunk long, place int, word binary, n long, data binary"
KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())


def numbered_words(texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
    """The words of each text as numbers, and the distinct words in order of appearance."""
    numbers: defaultdict[bytes, int] = defaultdict(int)
    numbers.default_factory = numbers.__len__
    places = [np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)) for found in (words(t, lower=True) for t in texts)]
    return places, list(numbers)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHUNKS: a chunk's distinct words, numbered in their order, with their occurrences in training documents, and then its documents."""
    names = ["chunk", "place", "word", "n", "data"]
    for chunk, ids, texts in chunks(batches):
        places, order = numbered_words(texts)
        learned = [p for p, i in zip(places, ids) if in_training(i)]
        n = np.bincount(np.concatenate(learned) if learned else np.zeros(0, np.int64), minlength=len(order))
        found = pa.array(order, pa.binary())
        place = pc.array_sort_indices(found)  # rows in order of words are small and sort fast
        found, n = found.take(place), n[place.to_numpy()]
        place = place.cast(pa.int32())
        for low in range(0, len(order), 20_000):
            size = min(20_000, len(order) - low)
            columns = pa.repeat(pa.scalar(chunk, pa.int64()), size), place.slice(low, size), found.slice(low, size), pa.array(n[low:low + size], pa.int64()), pa.nulls(size, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns), names)
        sink = pa.BufferOutputStream()
        offsets = pa.array(np.cumsum([0] + [len(x) for x in places]), pa.int64())
        every = np.concatenate(places) if places else np.zeros(0, np.int32)
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.LargeListArray.from_arrays(offsets, pa.array(every, pa.int32()))], ["doc_id", "places"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        columns = [chunk], [TEXTS], [None], [0], [pack(sink.getvalue().to_pybytes())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names)


class Symbols:
    """Vocabulary words, the end and the buckets of other words, numbered by falling counts."""

    def __init__(self, vocabulary: dict[bytes, int], end: int, buckets: list[int]):
        entries = [*((n, 0, w) for w, n in vocabulary.items()), (end, 1, b""), *((n, 2, bytes([i])) for i, n in enumerate(buckets))]
        entries.sort(key=lambda e: (-e[0], e[1:]))
        self.counts = np.array([n for n, _, _ in entries], float)
        self.number = {w: i for i, (_, kind, w) in enumerate(entries) if kind == 0}
        self.end = next(i for i, (_, kind, _) in enumerate(entries) if kind == 1)
        of_bucket = {w[0]: i for i, (_, kind, w) in enumerate(entries) if kind == 2}
        self.bucket = np.array([of_bucket[i] for i in range(len(buckets))], np.int64)
        self.bounds = gru.class_bounds(self.counts)


class Known(dict):
    """Symbols of words, kept for one task and emptied when ``limit`` words are held."""

    def __init__(self, symbols: Symbols, limit: int = 500_000):
        super().__init__()
        self.symbols, self.limit = symbols, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self.symbols.number.get(word)
        value = self[word] = int(self.symbols.bucket[bucket_of(word)]) if found is None else found
        return value


def _learn(symbols: Symbols, params: np.ndarray, turn: int):
    """Trains on a task's documents of this round, given as DOCUMENTS or as texts; emits the weights, times the tokens seen, in blocks."""
    known = Known(symbols)

    def of_text(text: str | None) -> np.ndarray:
        found = words(text, lower=True)
        return np.fromiter((*map(known.__getitem__, found), symbols.end), SYMBOL, len(found) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer(params, symbols.bounds)
        ready, held, size, total = [], [], 0, 0
        for batch in batches:
            given = "symbols" in batch.schema.names
            for doc_id, one in zip(batch["doc_id"].to_pylist(), batch["symbols" if given else "text"]):
                if not in_training(doc_id) or not in_round(doc_id, turn):
                    continue
                held.append(np.frombuffer(one.as_buffer(), SYMBOL).copy() if given else of_text(one.as_py()))
                size += len(held[-1])
                if size >= LEARN_TOKENS:  # what came before can go, so that the last pass is never a small one
                    if ready:
                        trainer.learn(ready, symbols.end)
                    ready, held, size, total = held, [], 0, total + size
        if ready or held:
            trainer.learn(ready + held, symbols.end)
            total += size
        if not total:
            return
        data = gru.flat(trainer.p)
        parts = [data[i:i + BLOCK].astype(np.float64) * total for i in range(0, len(data), BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), hash((total, turn)) % 32, np.int32)), pa.array(np.full(len(parts), total)), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["block", "salt", "tokens", "data"])

    return run


WEIGHTS = "block int, salt int, tokens long, data binary"


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows of one (block, salt), which arrive together."""
    now, tokens, total = None, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([tokens]), pa.array([total.tobytes()], pa.binary())], ["block", "salt", "tokens", "data"])

    for batch in batches:
        for block, salt, n, data in zip(*(batch[c].to_pylist() for c in ("block", "salt", "tokens", "data"))):
            if now != (block, salt):
                if now is not None:
                    yield row()
                now, tokens, total = (block, salt), 0, 0.0
            tokens, total = tokens + n, total + np.frombuffer(data)
    if now is not None:
        yield row()


def averaged(trained: DataFrame) -> np.ndarray | None:
    """Mean weights by tokens, summed over salts first; one row per block reaches the driver."""
    parts = work_partitions(trained.sparkSession)
    some = trained.repartition(parts, "block", "salt").sortWithinPartitions("block", "salt").mapInArrow(_sum_blocks, WEIGHTS)
    whole = some.withColumn("salt", F.lit(0)).repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_sum_blocks, WEIGHTS)
    rows = sorted(whole.collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["data"]) / r["tokens"] for r in rows]) if rows else None


SYMBOL = np.uint16
ANSWER = np.dtype([("place", np.int32), ("n", np.int64), ("symbol", np.int32)])
ANSWERED = "chunk long, place int, data binary"


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANSWERED: the ANSWERs (place, n, symbol) that a task has for a chunk, in as few rows as may be."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= ANSWERS:
            yield _gathered(held)
            held, size = [], 0
    if held:
        yield _gathered(held)


def _gathered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    chunk = np.concatenate([b["chunk"].to_numpy() for b in held])
    answers = np.empty(len(chunk), ANSWER)
    for name in ANSWER.names:
        answers[name] = np.concatenate([b[name].to_numpy() for b in held])
    order = np.argsort(chunk, kind="stable")
    chunk = chunk[order]
    first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    inside = np.arange(len(chunk)) - np.repeat(first, np.diff(np.append(first, len(chunk))))
    first = np.flatnonzero(inside % ROW_ANSWERS == 0)
    offsets = np.append(first, len(chunk)).astype(np.int64) * ANSWER.itemsize
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(answers[order].view(np.uint8))])
    return pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(np.zeros(len(first), np.int32)), data.cast(pa.binary())], ["chunk", "place", "data"])


def _in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ANSWERED sorted by (chunk, place), as _documents takes them: a row for each place, in order, then the chunk's documents.

    Equal chunks bring equal answers; of these no more are held than twice those of one, or 4 ANSWERS, and one row.
    """
    now, parts, size, limit = None, [], 0, 0
    for batch in batches:
        for chunk, place, data in zip(batch["chunk"].to_pylist(), batch["place"].to_pylist(), batch["data"]):
            if chunk != now:
                now, parts, size, limit = chunk, [], 0, 4 * ANSWERS
            if place != TEXTS:
                parts.append(np.frombuffer(data.as_buffer(), ANSWER))
                size += len(parts[-1])
                if size > limit:
                    parts = [_distinct(parts)]
                    size, limit = len(parts[0]), max(4 * ANSWERS, 2 * len(parts[0]))
                continue
            if parts:
                answers, parts = _distinct(parts), []
                yield _rows(chunk, answers, pa.nulls(len(answers), pa.binary()))
            yield _rows(chunk, np.array([(TEXTS, 0, -1)], ANSWER), pa.array([data.as_py()], pa.binary()))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Answers by place, one for each."""
    answers = np.concatenate(parts)
    return answers[np.unique(answers["place"], return_index=True)[1]]


def _rows(chunk: int, answers: np.ndarray, data: pa.Array) -> pa.RecordBatch:
    columns = [np.full(len(answers), chunk), *(answers[name].copy() for name in ANSWER.names)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), data], ["chunk", *ANSWER.names, "data"])


DOCUMENTS = "doc_id long, n_tokens long, n_known long, base_score double, extra double, symbols binary"


def _documents(symbols: Symbols, tokens: int, distinct: int, end_count: int, others: np.ndarray):
    """Rows sorted by (chunk, place): counts and symbols of the chunk's words, then its documents, as often as there are equal chunks.

    ``others`` has the words of each bucket and how many of them differ; ``extra`` is what the words outside the vocabulary add
    to the probability of their buckets.
    """
    share = np.full(len(symbols.counts), np.nan)
    share[symbols.bucket] = np.log10(others.sum(1) + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, counts, kinds = None, -1, [], []
        for batch in batches:
            chunk, place, n, symbol = (batch[c].to_numpy() for c in ("chunk", "place", "n", "symbol"))
            edges = (np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist()
            for low, high in zip([0, *edges], [*edges, len(chunk)] if len(chunk) else []):
                if chunk[low] != now:
                    now, last, counts, kinds = chunk[low], -1, [], []
                own = place[low:high]
                new = (own != np.concatenate([[last], own[:-1]])) & (own != TEXTS)  # a copy of the chunk repeats its places
                last = own[-1]
                counts.append(n[low:high][new])
                kinds.append(symbol[low:high][new])
                for at in (low + np.flatnonzero(own == TEXTS)).tolist():
                    yield of_chunk(np.concatenate(counts), np.concatenate(kinds), unpack(batch["data"][at].as_py()))

    def of_chunk(counts: np.ndarray, kinds: np.ndarray, data: bytes) -> pa.RecordBatch:
        rows = pa.ipc.open_stream(data).read_all().combine_chunks()
        ids, lists = rows["doc_id"].combine_chunks(), rows["places"].combine_chunks()
        ends, numbers = lists.offsets.to_numpy(), lists.values.to_numpy()
        if int(numbers.max(initial=-1)) + 1 != len(counts):
            raise RuntimeError("a chunk's words and its documents do not belong together")
        base_of = np.append(np.log10(counts + 1.0), np.log10(end_count + 1.0)) - np.log10(tokens + distinct + 1.0)
        known = np.append(counts > 0, end_count > 0).astype(np.int64)
        extra = np.append(np.where(np.isnan(share[kinds]), 0.0, np.log10(counts + 1.0) - share[kinds]), 0.0)
        symbol = np.append(kinds, symbols.end).astype(SYMBOL)
        every = np.insert(numbers, ends[1:], len(counts))  # each document's end
        starts = ends[:-1] + np.arange(len(ids))
        sizes = np.diff(ends) + 1
        offsets = np.append(starts, len(every)) * SYMBOL(0).itemsize
        sequences = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(symbol[every])])
        columns = [ids, pa.array(sizes, pa.int64()), pa.array(np.add.reduceat(known[every], starts)), pa.array(np.add.reduceat(base_of[every], starts)),
                   pa.array(np.add.reduceat(extra[every], starts)), sequences.cast(pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "extra", "symbols"])

    return run


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(symbols: Symbols, params: np.ndarray):
    """Rows of DOCUMENTS with the model's score, documents of about SCORED_TOKENS tokens at a time; equal ones of these are scored once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.shaped(params, symbols.bounds)
        for batch in batches:
            turn = np.cumsum(batch["n_tokens"].to_numpy()) // SCORED_TOKENS
            edges = (np.flatnonzero(np.diff(turn)) + 1).tolist()
            for low, high in zip([0, *edges], [*edges, batch.num_rows] if batch.num_rows else []):
                yield scored(p, batch.slice(low, high - low))

    def scored(p: dict, rows: pa.RecordBatch) -> pa.RecordBatch:
        distinct = rows["symbols"].dictionary_encode()
        likely = gru.log_likelihoods(p, symbols.bounds, [np.frombuffer(x.as_buffer(), SYMBOL) for x in distinct.dictionary], symbols.end) / np.log(10)
        columns = [rows[c] for c in ("doc_id", "n_tokens", "n_known", "base_score")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(likely[distinct.indices.to_numpy()] + rows["extra"].to_numpy())], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    one_thread_per_task(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = materialize(source.mapInArrow(_chunked, CHUNKS))
    asked = cut.where("word is not null").select("chunk", "place", "word", "n")
    all_counts = materialize(asked.groupBy("word").agg(F.sum("n").alias("c")))
    counts = all_counts.where("c > 0")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    trained: Column = id_bucket(F.col("doc_id"), FOLDS) != HELD_OUT
    ends = source.where(trained).count()
    tokens, distinct = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    top = {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(VOCABULARY).collect()}

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for word, c in zip(batch["word"].to_pylist(), batch["c"].to_pylist()):
                if word not in top:
                    place = bucket_of(word)
                    n[place] += c
                    v[place] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(n), pa.array(v)], ["bucket", "n", "v"])

    rest = counts.mapInArrow(buckets, "bucket long, n long, v long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    others = np.zeros((BUCKETS, 2), np.int64)
    for r in rest:
        others[r["bucket"]] = r["n"], r["v"]
    symbols = Symbols(top, ends, others[:, 0].tolist())

    def with_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(symbols, 0)
        for batch in batches:
            found = np.fromiter(map(known.__missing__, batch["word"].to_pylist()), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["word"], batch["c"], pa.array(found)], ["word", "c", "symbol"])

    texts = cut.where(F.col("place") == TEXTS).select("chunk", "place", "data")
    parts = max(work_partitions(spark), math.ceil(texts.count() / CHUNKS_PER_TASK))
    answered = asked.select("chunk", "place", "word").join(all_counts.mapInArrow(with_symbols, "word binary, c long, symbol int"), "word")
    both = answered.select("chunk", "place", F.col("c").alias("n"), "symbol").mapInArrow(_by_chunk, ANSWERED).union(texts)
    both = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "place")
    of_places = _documents(symbols, tokens, distinct, ends, others)
    documents = materialize(both.mapInArrow(lambda batches: of_places(_in_place(batches)), DOCUMENTS))
    params = gru.flat(gru.fresh(symbols.counts))
    for turn in range(ROUNDS):
        mean = averaged(documents.where(trained).select("doc_id", "symbols").mapInArrow(_learn(symbols, params, turn), WEIGHTS))
        params = params if mean is None else mean.astype(np.float32)
    scored = documents.mapInArrow(_score(symbols, params), RESULT)
    held_out = id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
