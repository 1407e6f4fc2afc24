"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Every line with a word is one position of the chain; its features are ratios of the line alone (symbols, capitals,
digits, distinct words, words equal to their neighbour, ...) and of its place in the document (equal to an earlier
line, share of words inside repeated 8-word windows).  Viterbi decoding gives each line a label; the share of the
document's words that lie in content lines decides: at least ``LEAST_CONTENT`` is kept.  A document is rejected
beforehand if it fails the base rules (fewer than 20 words, or over 30 % of words in repeated 8-word windows).

The field is trained by its exact conditional likelihood (forward-backward) on at most about ``PER_CLASS`` labelled
documents of each quality, chosen by a hash of the id: lines of good documents count as content, lines of bad ones as
boilerplate.  A training document of more lines is cut into consecutive sequences of ``TRAIN_LINES`` lines, all of which are
used; decoding always takes whole texts.

Cases: a null or empty text has no words, so it fails the base rules; lines without a word are no positions; without
labels of both kinds the base rules alone decide; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, rolling, table, utf8

PER_CLASS = 3072
TRAIN_LINES = 32
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent
LEAST_CONTENT = 0.5
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
BLANKS = b" \t\n\x0b\x0c\r"
N_FEATURES = 14
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


@dataclass
class Marks:
    """What the rules need of one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    line_words: list[int] = field(default_factory=list)
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, N_FEATURES)))

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated_words(hashes: np.ndarray) -> np.ndarray:
    """Marks words that lie in a window of WINDOW words found twice or more, the first one included."""
    n = len(hashes)
    windows = rolling(hashes, WINDOW)
    if len(windows) < 2:
        return np.zeros(n, bool)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int32)
    step[:len(windows)] += twice
    step[WINDOW:WINDOW + len(windows)] -= twice
    return np.cumsum(step[:n]) > 0


def marks(text: str | None) -> Marks:
    data = utf8(text)
    found = data.split()
    n = len(found)
    blanks = len(data) - len(data.translate(None, BLANKS))
    out = Marks(n, (len(text) if text else 0) - blanks, len(data) - len(data.translate(None, SYMBOLS)), 0, 0)
    if not n:
        return out
    covered = repeated_words(np.fromiter(map(hash, found), np.int64, n).view(np.uint64))
    out.n_repeat_words = int(covered.sum())
    sums = np.concatenate([[0], np.cumsum(covered)])
    seen: set[bytes] = set()
    rows, at = [], 0
    for line in data.split(b"\n"):
        own = line.split()
        k = len(own)
        if not k:
            continue
        again = line in seen
        out.n_dup_lines += again
        seen.add(line)
        size = len(line)
        rows.append((
            1.0, again, k < 5, min(1.0, k / 50), len(set(own)) / k, sum(map(operator.eq, own, own[1:])) / k,
            float(sums[at + k] - sums[at]) / k, min(2.0, (size - len(line.translate(None, SYMBOLS))) / k),
            (size - len(line.translate(None, CAPITALS))) / size, (size - len(line.translate(None, DIGITS))) / size,
            own[-1][-1:] in b".!?", min(2.0, line.count(b"!") / k), min(2.0, size / k / 10), line.count(b"|") / k,
        ))
        out.line_words.append(k)
        at += k
    out.features = np.array(rows, float)
    return out


@dataclass
class Field:
    """Weights of the two labels (0 boilerplate, 1 content) and of the steps between them."""

    unary: np.ndarray  # N_FEATURES x 2
    steps: np.ndarray  # 2 x 2

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest label sequence; ties go to content."""
        n = len(features)
        local = features @ self.unary
        back = np.zeros((n, 2), np.int8)
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = local[0].tolist()
        for i, (x, y) in enumerate(local.tolist()[1:], 1):
            a0, a1, b0, b1 = a + s00, b + s10, a + s01, b + s11
            back[i] = a1 >= a0, b1 >= b0
            a, b = max(a0, a1) + x, max(b0, b1) + y
        labels = np.zeros(n, np.int8)
        labels[-1] = b >= a
        for i in range(n - 1, 0, -1):
            labels[i - 1] = back[i, labels[i]]
        return labels


def fit_field(sequences: list[np.ndarray], labels: list[np.ndarray], decay: float = 1.0, rounds: int = 150) -> Field:
    """Maximises the conditional likelihood with forward-backward over all sequences at once (Adam steps)."""
    count, longest = len(sequences), max(map(len, sequences))
    x, y, real = np.zeros((count, longest, N_FEATURES)), np.zeros((count, longest), int), np.zeros((count, longest), bool)
    for i, (s, lab) in enumerate(zip(sequences, labels)):
        x[i, :len(s)], y[i, :len(s)], real[i, :len(s)] = s, lab, True
    pairs = real[:, 1:]
    truth = np.stack([(y == v) & real for v in (0, 1)], 2).astype(float)
    want_steps = np.array([[((y[:, :-1] == u) & (y[:, 1:] == v) & pairs).sum() for v in (0, 1)] for u in (0, 1)], float)
    flat = x.reshape(-1, N_FEATURES)
    want = flat.T @ truth.reshape(-1, 2)
    theta = np.zeros(N_FEATURES * 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        unary, steps = theta[:-4].reshape(N_FEATURES, 2), theta[-4:].reshape(2, 2)
        local = (flat @ unary).reshape(count, longest, 2)
        ahead = np.zeros((count, longest, 2))
        ahead[:, 0] = local[:, 0]
        for t in range(1, longest):
            into = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + local[:, t]
            ahead[:, t] = np.where(real[:, t, None], into, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros((count, longest, 2))
        got_steps = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            after = local[:, t + 1] + behind[:, t + 1]
            joint = ahead[:, t, :, None] + steps[None] + after[:, None, :] - total[:, None, None]
            got_steps += np.exp(np.minimum(joint, 0))[pairs[:, t]].sum(0)
            out = np.stack([np.logaddexp(steps[u, 0] + after[:, 0], steps[u, 1] + after[:, 1]) for u in (0, 1)], 1)
            behind[:, t] = np.where(pairs[:, t, None], out, 0)
        share = np.exp(np.minimum(ahead + behind - total[:, None, None], 0)) * real[:, :, None]
        gradient = np.concatenate([(want - flat.T @ share.reshape(-1, 2)).ravel(), (want_steps - got_steps).ravel()]) - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient * gradient
        theta = theta + 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(theta[:-4].reshape(N_FEATURES, 2), theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Field | None:
    sample, sizes = labelled(docs, labels, label, per_class)
    if len(sizes) < 2:
        return None

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [marks(t).features.astype(np.float32).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(rows, pa.binary())], ["doc_id", "label", "lines"])

    rows = sample.mapInArrow(lines, "doc_id long, label int, lines binary").toArrow().sort_by("doc_id")
    whole = [(np.frombuffer(b, np.float32).reshape(-1, N_FEATURES).astype(float), y) for b, y in zip(rows["lines"].to_pylist(), rows["label"].to_pylist()) if b]
    found = [(s[low:low + TRAIN_LINES], y) for s, y in whole for low in range(0, len(s), TRAIN_LINES)]
    if len({y for _, y in found}) < 2:
        return None
    return fit_field([s for s, _ in found], [np.full(len(s), y) for s, y in found])


def verdict(model: Field | None, found: Marks) -> tuple[float, bool]:
    """Content share (1 without a model) and whether the document is kept."""
    if not found.n_words:
        return 0.0, False
    share = 1.0 if model is None else float(np.dot(model.decode(found.features), found.line_words)) / found.n_words
    return share, not found.base_failed and share >= LEAST_CONTENT


def rules_column(model: Field | None, text: Column) -> Column:
    """Struct of RESULT for each whole text."""

    @F.pandas_udf(RESULT)
    def rules(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts.tolist():
            found = marks(t)
            share, kept = verdict(model, found)
            rows.append((found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words, found.base_failed, kept, share))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    return rules(text)


def quality_rules(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, rules_column(model, F.col(text_col)).alias("_r")).select(id_col, "_r.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))
