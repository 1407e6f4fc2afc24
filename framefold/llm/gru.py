"""Gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried over.

P(s | state) = P(class of s) P(s | class of s).  Symbols are numbered by falling frequency and a class is a range of
numbers; classes have about equal shares of the square roots of the frequencies, so frequent symbols are in small classes
and the softmax of a position takes few terms on the average.
Sequences run in step, each with its own state, which starts at zero at a document's begin and is carried
from one window of ``STEPS`` symbols to the next; gradients stop at the window's begin.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASSES, STEPS = 16, 40, 32
RATE = 0.01
OUTPUTS = 16_384  # positions whose softmax is taken at a time
LANES = 256  # documents that are scored in step
SAFE = 75.0  # exponentials of numbers up to this, and their sums, stay in the range of 32 bits


def class_bounds(counts: np.ndarray) -> np.ndarray:
    """First symbol of each class, and the number of symbols."""
    share = np.sqrt(counts + 0.5)
    kind = ((np.cumsum(share) - share / 2) / share.sum() * CLASSES).astype(np.int64)
    return np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(counts)]])


def sizes(bounds: np.ndarray) -> dict[str, tuple]:
    classes, symbols = len(bounds) - 1, int(bounds[-1])
    return {"inputs": (symbols, 3 * HIDDEN), "recur": (HIDDEN, 3 * HIDDEN), "classes": (HIDDEN, classes), "class_bias": (classes,),
            "words": (symbols, HIDDEN), "word_bias": (symbols,)}


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in params.values()])


def shaped(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in sizes(bounds).items():
        n = int(np.prod(shape))
        out[name] = data[at:at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def fresh(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights, and biases that make the untrained model the unigram model of ``counts``."""
    random, bounds = np.random.default_rng(1), class_bounds(counts)
    out = {k: (random.standard_normal(s) * 0.1).astype(np.float32) for k, s in sizes(bounds).items()}
    smooth = counts + 0.5
    by_class = np.add.reduceat(smooth, bounds[:-1])
    out["class_bias"] = np.log(by_class / smooth.sum()).astype(np.float32)
    out["word_bias"] = np.log(smooth / np.repeat(by_class, np.diff(bounds))).astype(np.float32)
    out["classes"] *= 0.1
    out["words"] *= 0.1
    return out


def run(p: dict, inputs: np.ndarray, state: np.ndarray, starts: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
    """States after each of the T columns of ``inputs`` (rows x T), as T x rows x HIDDEN; ``keep`` gets what the way back needs.

    Update, reset and new part of a step lie behind each other (3 x rows x HIDDEN), so a step is a few operations on long
    lines, and what a symbol gives to a part is fetched as one piece.
    """
    rows, steps = inputs.shape
    kind = p["recur"].dtype.type
    one = kind(1)
    table, recur = _by_part(p["inputs"]), _by_part(p["recur"])
    for x in (table, recur):  # a sigmoid is 1 / (1 + exp(-x))
        np.negative(x[:2], out=x[:2])
    columns, begun = np.ascontiguousarray(inputs.T), _begun(starts, steps)
    states = np.empty((steps, rows, HIDDEN), kind)
    u, given, new = np.empty((3, rows, HIDDEN), kind), np.empty((3, rows, HIDDEN), kind), np.empty((rows, HIDDEN), kind)
    if keep is not None:
        keep.update({name: np.empty((steps, *x.shape), kind) for name, x in (("parts", u), ("new", new), ("before", state))})
    with np.errstate(over="ignore"):  # to infinity, which gives 0
        for t in range(steps):
            if begun[t] is not None:
                state = state.copy()
                state[begun[t]] = 0
            if keep is not None:
                u, new = keep["parts"][t], keep["new"][t]
                keep["before"][t] = state
            np.matmul(state, recur, out=u)
            np.take(table, columns[t], axis=1, out=given, mode="clip")
            gates = u[:2]
            gates += given[:2]
            np.exp(gates, out=gates)
            gates += one
            np.divide(one, gates, out=gates)
            np.multiply(u[2], gates[1], out=new)
            new += given[2]
            np.tanh(new, out=new)
            state = np.subtract(state, new, out=states[t])
            state *= gates[0]
            state += new
    return states


def _by_part(weights: np.ndarray) -> np.ndarray:
    """Weights (n x 3 HIDDEN) as 3 x n x HIDDEN, copied."""
    return weights.reshape(len(weights), 3, HIDDEN).transpose(1, 0, 2).copy()


def _begun(starts: np.ndarray | None, steps: int) -> list[np.ndarray | None]:
    """The rows whose document begins at each step, None where none does."""
    if starts is None or not starts.any():
        return [None] * steps
    step, row = np.nonzero(starts.T)
    ends = np.searchsorted(step, np.arange(steps + 1)).tolist()
    return [row[low:high] if low < high else None for low, high in zip(ends, ends[1:])]


def _softmax(weights: np.ndarray, bias: np.ndarray, safe: bool, states: np.ndarray, place: np.ndarray, at: np.ndarray, share: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities of ``place`` among the rows of ``weights`` for each row of ``states``, and all probabilities if asked for."""
    logits = weights @ states.T
    logits += bias[:, None]
    if not safe:
        logits -= logits.max(0)
    own = logits[place, at]
    np.exp(logits, out=logits)
    total = logits.sum(0)
    own -= np.log(total)
    if not share:
        return own, None
    logits *= 1 / total
    return own, logits


def _scaled(weights: np.ndarray, bias: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bool]]:
    """The bias less the largest of its class, and whether a class's exponentials stay in the range of numbers.

    States are within -1 and 1, so weights bound the logits; only where they may be too large the largest logit has to be found.
    """
    sizes = np.diff(np.append(first, len(bias)))
    bias = bias - np.repeat(np.maximum.reduceat(bias, first), sizes)
    return bias, (np.maximum.reduceat(np.abs(weights).sum(1), first) < SAFE).tolist()


def outputs(p: dict, bounds: np.ndarray, states: np.ndarray, targets: np.ndarray, gradient: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of targets (n) given states (n x HIDDEN), and the loss's gradient by the states."""
    kind = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint8), np.diff(bounds))[targets]
    order = np.argsort(kind, kind="stable")
    kind, targets, at = kind[order], targets[order], np.arange(len(targets))
    states = np.take(states, order, axis=0)
    classes, learn = np.ascontiguousarray(p["classes"].T), gradient is not None
    bias, safe = _scaled(classes, p["class_bias"], np.zeros(1, np.int64))
    found, share = _softmax(classes, bias, safe[0], states, kind, at, learn)
    back = None
    if learn:
        share[kind, at] -= 1
        gradient["classes"] += (share @ states).T
        gradient["class_bias"] += share.sum(1)
        back = share.T @ classes
    ends = np.cumsum(np.bincount(kind, minlength=len(bounds) - 1))
    bias, safe = _scaled(p["words"], p["word_bias"], bounds[:-1])
    for c, (low, high) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        if low == high or bounds[c + 1] - bounds[c] == 1:  # the only symbol of its class is certain
            continue
        part, mine, place = slice(bounds[c], bounds[c + 1]), states[low:high], targets[low:high] - bounds[c]
        own, share = _softmax(p["words"][part], bias[part], safe[c], mine, place, at[:high - low], learn)
        found[low:high] += own
        if learn:
            share[place, at[:high - low]] -= 1
            gradient["words"][part] += share @ mine
            gradient["word_bias"][part] += share.sum(1)
            back[low:high] += share.T @ p["words"][part]
    result = np.empty_like(found)
    result[order] = found
    if back is None:
        return result, None
    place = np.empty_like(order)
    place[order] = at
    return result, np.take(back, place, axis=0)


def backward(p: dict, inputs: np.ndarray, starts: np.ndarray, kept: dict, back: np.ndarray, gradient: dict) -> None:
    """Gradients of one window; ``back`` is (T x rows x HIDDEN).  All factors that do not depend on what comes back are taken at once."""
    steps, rows, _ = back.shape
    update, reset, un = (kept["parts"][:, i] for i in range(3))
    new, before = kept["new"], kept["before"]
    factors = np.empty((4, steps, rows, HIDDEN), back.dtype)  # of update, reset, new as the recurrent weights see it, new
    stay, by_new = 1 - update, factors[3]
    np.multiply(new, new, out=by_new)
    np.subtract(1, by_new, out=by_new)
    by_new *= stay
    np.subtract(before, new, out=factors[0])
    factors[0] *= update
    factors[0] *= stay
    np.multiply(by_new, reset, out=factors[2])
    np.subtract(1, reset, out=factors[1])
    factors[1] *= factors[2]
    factors[1] *= un
    later, recur = np.zeros((rows, HIDDEN), back.dtype), _by_part(p["recur"]).transpose(0, 2, 1).copy()
    sums, begun = np.empty((3, rows, HIDDEN), back.dtype), _begun(starts, steps)
    for t in range(steps - 1, -1, -1):  # factors become gradients
        d = later
        d += back[t]
        by = factors[:, t]
        by *= d
        d *= update[t]
        for x in np.matmul(by[:3], recur, out=sums):
            d += x
        if begun[t] is not None:
            d[begun[t]] = 0
    factors = factors.reshape(4, steps * rows, HIDDEN)
    gradient["recur"] += np.concatenate(before.reshape(-1, HIDDEN).T @ factors[:3], 1)
    symbol = inputs.T.ravel().astype(np.uint16)  # sixteen bits are sorted by radix
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    for i, part in enumerate((0, 1, 3)):
        by = np.take(factors[part], order, axis=0)
        pairs = by.view(np.result_type(by, np.complex64))  # as complex numbers two neighbours are added at once
        gradient["inputs"][symbol[first], i * HIDDEN:(i + 1) * HIDDEN] += np.add.reduceat(pairs, first, axis=0).view(by.dtype)


class Trainer:
    """One task's copy of the model: Adam steps on windows of many lanes at once."""

    def __init__(self, params: np.ndarray, bounds: np.ndarray, rate: float = RATE):
        self.p, self.bounds, self.rate = shaped(params, bounds), bounds, rate
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.turn = 0

    def learn(self, documents: list[np.ndarray], end: int) -> None:
        """One pass over documents of symbols, each closed by ``end``, laid end to end on the lanes."""
        targets = np.concatenate(documents).astype(np.int64, copy=False)
        starts = np.zeros(len(targets), bool)
        starts[np.concatenate([[0], np.cumsum([len(d) for d in documents])[:-1]])] = True
        inputs = np.concatenate([[end], targets[:-1]])
        inputs[starts] = end
        lanes = int(np.clip(len(targets) // (STEPS * 150), 8, 256))
        width = -(-len(targets) // lanes)
        fill = lanes * width - len(targets)
        real = np.concatenate([np.ones(len(targets), bool), np.zeros(fill, bool)]).reshape(lanes, width)
        targets, inputs = (np.concatenate([x, np.full(fill, end)]).reshape(lanes, width) for x in (targets, inputs))
        starts = np.concatenate([starts, np.zeros(fill, bool)]).reshape(lanes, width)
        state = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, width, STEPS):
            part = slice(at, at + STEPS)
            state = self.window(inputs[:, part], targets[:, part], starts[:, part], real[:, part], state)

    def window(self, inputs, targets, starts, real, state) -> np.ndarray:
        kept: dict = {}
        states = run(self.p, inputs, state, starts, kept)
        gradient = {k: np.zeros_like(v) for k, v in self.p.items()}
        use = real.T.ravel()
        if use.all():
            _, back = outputs(self.p, self.bounds, states.reshape(-1, HIDDEN), targets.T.ravel(), gradient)
        else:
            back = np.zeros((len(use), HIDDEN), np.float32)
            _, back[use] = outputs(self.p, self.bounds, states.reshape(-1, HIDDEN)[use], targets.T.ravel()[use], gradient)
        backward(self.p, inputs, starts, kept, back.reshape(states.shape), gradient)
        self.step(gradient, max(1, int(use.sum())))
        return states[-1]

    def step(self, gradient: dict, n: int) -> None:
        self.turn += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in gradient.values())) / n
        scale = np.float32(1 / n * min(1.0, 1.0 / max(norm, 1e-12)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn))
        for k, g in gradient.items():
            g *= scale
            self.mean[k] += np.float32(0.1) * (g - self.mean[k])
            self.square[k] += np.float32(0.01) * (g * g - self.square[k])
            self.p[k] -= rate * self.mean[k] / (np.sqrt(self.square[k]) + np.float32(1e-7))


def _dealt(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt over at most LANES lanes of about equal length: their order lane by lane, longest lane first, and the lanes' lengths."""
    lanes = [(0, i) for i in range(min(LANES, len(lengths)))]
    held: list[list[int]] = [[] for _ in lanes]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, lane = lanes[0]
        held[lane].append(i)
        heapq.heapreplace(lanes, (size + int(lengths[i]), lane))
    lanes.sort(reverse=True)
    return np.array([i for _, lane in lanes for i in held[lane]], np.int64), np.array([size for size, _ in lanes], np.int64)


def log_likelihoods(p: dict, bounds: np.ndarray, documents: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-probability of each whole document (symbols closed by ``end``), laid end to end on lanes that run in step.

    States wait until ``OUTPUTS`` of them can go through the softmax together, so that the few lanes that are left after
    many windows cost no more per symbol than all of them at the start.
    """
    out = np.zeros(len(documents))
    if not len(documents):
        return out
    sizes = np.array([len(d) for d in documents])
    order, lengths = _dealt(sizes)
    everything = np.concatenate([documents[i] for i in order])
    owner = np.repeat(order, sizes[order])
    first = np.zeros(len(everything) + 1, bool)
    first[np.concatenate([[0], np.cumsum(sizes[order])[:-1]])] = True
    lanes = np.concatenate([[0], np.cumsum(lengths)])
    state = np.zeros((len(lengths), HIDDEN), np.float32)
    previous = np.full(len(lengths), end)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> None:
        states, targets, owners = waiting[0] if len(waiting) == 1 else (np.concatenate(x) for x in zip(*waiting))
        for at in range(0, len(targets), OUTPUTS):
            part = slice(at, at + OUTPUTS)
            found, _ = outputs(p, bounds, states[part], targets[part])
            out[:] += np.bincount(owners[part], found, len(out))
        waiting.clear()

    for at in range(0, int(lengths.max(initial=0)), STEPS):
        active = int((lengths > at).sum())
        steps = min(STEPS, int(lengths[0]) - at)
        place = lanes[:active, None] + at + np.arange(steps)
        real = place < lanes[1:active + 1, None]
        place = np.minimum(place, len(everything) - 1)
        targets = np.where(real, everything[place], end).astype(np.int64, copy=False)
        starts = first[place] & real
        inputs = np.concatenate([previous[:active, None], targets[:, :-1]], 1)
        inputs[starts] = end
        states = run(p, inputs, state[:active], starts)
        state, previous = states[-1], targets[:, -1]
        use, states = real.T.ravel(), states.reshape(-1, HIDDEN)
        owners, targets = owner[place.T.ravel()], targets.T.ravel()
        waiting.append((states, targets, owners) if use.all() else (states[use], targets[use], owners[use]))
        held += int(use.sum())
        if held >= OUTPUTS:
            flush()
            held = 0
    if waiting:
        flush()
    return out
