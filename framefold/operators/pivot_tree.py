"""Two levels of pivots for exact nearest-neighbour joins.

Rows of a stratum of n candidates go to the nearest of about sqrt(n / block) top pivots, which makes a node, and inside the
node to the nearest of its own pivots, which makes a leaf.  A row is a pivot of its node when its hash falls into one of
``block`` classes, so leaves hold about ``block`` candidates at every size of the table and their number follows n.  Only
the top pivots and their radii (the square root of the number of leaves) travel with the tasks; the pivots of a node meet its
rows by a shuffle.

The distance that a query finds in its own leaf bounds the rest.  The bound opens nodes by pivot, radius and largest norm.
Nodes are dealt over groups of at most about GROUP_BYTES of vectors, and a query travels once to each group that holds an
open node; inside, the bound is tried on each block, and the blocks that stay open are compared.  So what travels follows
queries times groups, however little the bounds prune, and never queries times blocks.  Comparison streams through sorted
rows: candidates, excluded pairs, then any number of queries, so a task holds one block or group and one batch.  Excluded
pairs go to where the excluded candidate is, once for each salt of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefold.functions import vectors
from framefold.session import materialize, spread_work, work_partitions

TASK_ROWS = 131_072  # rows that a task is planned for
BLOCKS_PER_SALT = 16  # queries that meet one copy of a block, in blocks
GROUP_BYTES = 32 << 20  # vectors of the candidates that a task of the sweep holds
ROUNDING = 1e-6
ASKS, OFFERS = 2, 1  # roles of a row, added up

RESULT = "hash string, peer string, distance double"
_SETTLED = ("layer int, cell int, node string, leaf string, role int, hash string, key string, spread double, radius double, "
            "norm double, vector array<float>")
_VISIT = "node string, leaf string, block int, hash string, key string, vector array<float>"
_BLOCK = ["node", "leaf", "block"]


# ---------------------------------------------------------------- batches

def matrix(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list<float> column as a matrix, and which rows are usable; the others are zero, so at distance 1."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
    whole = lengths == dim
    out = np.zeros((len(lists), dim), dtype=dtype)
    if whole.any():
        values = lists.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False)
        out[whole] = values.reshape(-1, dim)
    usable = whole & np.isfinite(out).all(axis=1)
    out[~usable] = 0.0
    return out, usable


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Consecutive rows with equal ``names`` of batches sorted by these, cut at batch ends; True where a group begins."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for name in names:
            column = batch.column(name)
            change[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        heads = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(heads, [*heads[1:], n]):
            yield a > 0 or [batch.column(name)[0].as_py() for name in names] != last, batch.slice(a, b - a)
        last = [batch.column(name)[n - 1].as_py() for name in names]


def _only(batch: pa.RecordBatch, kinds: np.ndarray, kind: int) -> pa.RecordBatch:
    return batch if (kinds == kind).all() else batch.filter(pa.array(kinds == kind))


def may_hold(dots: np.ndarray, q_norm: np.ndarray, p_norm: np.ndarray, radius: np.ndarray, norm: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which cells (columns) can hold a candidate at least as near to a query (row) as its bound.

    For x in the cell with pivot p: q.x <= q.p + |q| r, and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 with
    |q - x| >= |q - p| - r.  Both hold for any norms; the smaller one is used.
    """
    q = q_norm[:, None]
    reach = radius * (1 + 1e-9) + 1e-9
    gap = np.sqrt(np.maximum(0.0, q * q + p_norm * p_norm - 2 * dots))
    apart = np.maximum(0.0, gap - reach - 1e-7)
    top = np.minimum(dots + q * reach, (q * q + norm * norm - apart * apart) / 2)
    return (top + 1e-9 > 0) & (1 - top <= bound[:, None] + ROUNDING)


# ---------------------------------------------------------------- level 1: top pivots in the tasks

def _place(pivots: np.ndarray):
    """Arrow UDF: the nearest of the first 2**layer pivots; -1 for a vector that is not usable."""
    dim = pivots.shape[1]
    half = 0.5 * (pivots ** 2).sum(axis=1)

    @F.arrow_udf("int")
    def place(column: pa.Array, layers: pa.Array) -> pa.Array:
        v, usable = matrix(column, dim)
        layer = layers.to_numpy(zero_copy_only=False)
        cell = np.full(len(v), -1, np.int32)
        for depth in np.unique(layer):
            count, rows = 1 << int(depth), np.flatnonzero(usable & (layer == depth))
            cell[rows] = (v[rows] @ pivots[:count].T - half[:count]).argmax(axis=1)
        return pa.array(cell, pa.int32())

    return place


def _open_cells(pivots: np.ndarray, spreads: dict[tuple[int, int], tuple[float, float]]):
    """Arrow UDF: the nodes of its layer that a query with this bound has to look into."""
    dim = pivots.shape[1]
    p_norm = np.sqrt((pivots ** 2).sum(axis=1))

    @F.arrow_udf("array<int>")
    def open_cells(column: pa.Array, layers: pa.Array, bounds: pa.Array) -> pa.Array:
        v, _ = matrix(column, dim)
        layer, bound = layers.to_numpy(zero_copy_only=False), bounds.to_numpy(zero_copy_only=False)
        norms = np.sqrt((v ** 2).sum(axis=1))
        cells = [np.zeros(0, np.int32)] * len(v)
        for depth in np.unique(layer):
            held = sorted(cell for at, cell in spreads if at == depth)
            if not held:
                continue
            radius, norm = np.array([spreads[int(depth), cell] for cell in held]).T
            rows, held = np.flatnonzero(layer == depth), np.array(held, np.int32)
            mask = may_hold(v[rows] @ pivots[held].T, norms[rows], p_norm[held], radius, norm, bound[rows])
            for row, hit in zip(rows, mask):
                cells[row] = held[hit]
        ends = np.cumsum([0] + [len(c) for c in cells]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells) if cells else [], pa.int32()))

    return open_cells


def _open_groups(pivots: np.ndarray, spreads: dict[tuple[int, int], tuple[float, float]], groups: int, parts: int):
    """Arrow UDF: the groups that hold a node that a query with this bound has to look into; nodes are dealt as in ``PivotTree.sweep``."""
    dim = pivots.shape[1]
    p_norm = np.sqrt((pivots ** 2).sum(axis=1))

    @F.arrow_udf("array<int>")
    def open_groups(column: pa.Array, layers: pa.Array, bounds: pa.Array, turns: pa.Array) -> pa.Array:
        v, _ = matrix(column, dim)
        layer, bound, turn = (x.to_numpy(zero_copy_only=False) for x in (layers, bounds, turns))
        norms = np.sqrt((v ** 2).sum(axis=1))
        found = [np.zeros((2, 0), np.int64)]
        for depth in np.unique(layer):
            held = np.array(sorted(cell for at, cell in spreads if at == depth), np.int64)
            if not len(held):
                continue
            radius, norm = np.array([spreads[int(depth), int(cell)] for cell in held]).T
            holds = np.zeros((len(held), groups), np.float32)
            for part in range(min(parts, groups)):
                holds[np.arange(len(held)), (held * parts + part) % groups] = 1
            rows = np.flatnonzero(layer == depth)
            mask = may_hold(v[rows] @ pivots[held].T, norms[rows], p_norm[held], radius, norm, bound[rows])
            row, group = np.nonzero(mask.astype(np.float32) @ holds)
            found.append(np.stack([rows[row], (group + turn[rows[row]]) % groups]))
        row, group = np.concatenate(found, axis=1)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(v) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(group[order].astype(np.int32)))

    return open_groups


# ---------------------------------------------------------------- level 2: a node's pivots meet its rows

def _settle(pivots: np.ndarray):
    """Rows sorted by (node, salt, kind): the node's pivots, then its rows, which get their leaf.

    The leaf of the top pivot itself has no name.
    """
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points = [], []
        for new, part in runs(batches, ["node", "salt"]):
            top = pivots[part["cell"][0].as_py()]
            if new:
                names, points = [""], [top[None, :]]
            kinds = part["kind"].to_numpy()
            heads, rows = _only(part, kinds, 0), _only(part, kinds, 1)
            if heads.num_rows:
                names += heads["hash"].to_pylist()
                points.append(matrix(heads["vector"], dim)[0])
            if not rows.num_rows:
                continue
            inner = np.concatenate(points)
            points = [inner]
            v, _ = matrix(rows["vector"], dim)
            leaf = (v @ inner.T - 0.5 * (inner ** 2).sum(axis=1)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [rows["layer"], rows["cell"], rows["node"], pa.array(names, pa.string()).take(pa.array(leaf)), rows["role"], rows["hash"], rows["key"],
                 pa.array(np.sqrt(((v - top) ** 2).sum(axis=1))), pa.array(np.sqrt(((v - inner[leaf]) ** 2).sum(axis=1))),
                 pa.array(np.sqrt((v ** 2).sum(axis=1))), rows["vector"]],
                names=["layer", "cell", "node", "leaf", "role", "hash", "key", "spread", "radius", "norm", "vector"])

    return run


def _route(pivots: np.ndarray):
    """Rows sorted by (node, salt, kind): the node's leaves, then queries with a bound; one row per block to be visited."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready = None
        for new, part in runs(batches, ["node", "salt"]):
            if new:
                held, ready = [], None
            kinds = part["kind"].to_numpy()
            heads, rows = _only(part, kinds, 0), _only(part, kinds, 1)
            if heads.num_rows:
                held.append(heads)
            if not rows.num_rows or not held:
                continue
            if ready is None:
                leaves = pa.Table.from_batches(held)
                inner, _ = matrix(leaves["vector"], dim)
                unnamed = pc.equal(leaves["leaf"], "").to_numpy()
                inner[unnamed] = pivots[part["cell"][0].as_py()]
                ready = (leaves["leaf"].combine_chunks(), leaves["block"].to_numpy(), inner, np.sqrt((inner ** 2).sum(axis=1)),
                         leaves["radius"].to_numpy(), leaves["norm"].to_numpy())
            names, blocks, inner, p_norm, radius, norm = ready
            v, _ = matrix(rows["vector"], dim)
            mask = may_hold(v @ inner.T, np.sqrt((v ** 2).sum(axis=1)), p_norm, radius, norm, rows["bound"].to_numpy())
            row, leaf = np.nonzero(mask)
            row, leaf = np.repeat(row, blocks[leaf]), np.repeat(leaf, blocks[leaf])
            block = np.arange(len(leaf)) - np.searchsorted(row * len(names) + leaf, row * len(names) + leaf)
            own = pc.equal(rows["home"], rows["node"]).to_numpy(zero_copy_only=False)[row]
            at_home = pc.index_in(rows["leaf"], value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[row] == leaf
            seen = own & at_home & (rows["block"].fill_null(-1).to_numpy(zero_copy_only=False)[row] == block)
            row, leaf, block = row[~seen], leaf[~seen], block[~seen]
            for low in range(0, len(row), 10_000):
                some = rows.take(pa.array(row[low:low + 10_000]))
                yield pa.RecordBatch.from_arrays(
                    [some["node"], names.take(pa.array(leaf[low:low + 10_000])), pa.array(block[low:low + 10_000], pa.int32()),
                     some["hash"], some["key"], some["vector"]], names=["node", "leaf", "block", "hash", "key", "vector"])

    return run


# ---------------------------------------------------------------- comparison

def nearest_rows(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray,
                 same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Column and rounded distance of the nearest allowed column of each row; infinite when none is allowed.

    The product is taken in float32.  Its error is below dim * 2^-24 * |q| |c|, so every column that could be the
    nearest after rounding is within twice that of the best one; only those few are computed again in double.
    Columns are in hash order, so the first of equal distances is the smallest hash.  Where everything is at
    distance 1 the first allowed column is taken.  ``same`` marks the cells of equal strata.
    """
    sims = q @ c.T
    sims[rows, cols] = -np.inf
    if same is not None:
        sims[~same] = -np.inf
    best = sims.max(axis=1)
    allowed = np.isfinite(best)
    error = q.shape[1] * 2.0 ** -23 * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
    floor = np.where(allowed, np.minimum(best, 1.0) - 2 * error - 2 * ROUNDING, np.inf)
    r, k = np.nonzero(sims >= floor[:, None])
    exact = np.einsum("ij,ij->i", q[r].astype(np.float64), c[k].astype(np.float64))
    d = np.round(np.clip(1.0 - exact, 0.0, 1.0), 6)
    order = np.lexsort((k, d, r))
    r, k, d = r[order], k[order], d[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, dtype=int)
    at, dist = np.zeros(len(q), dtype=np.int64), np.full(len(q), np.inf)
    at[r[first]], dist[r[first]] = k[first], d[first]
    far = dist == 1.0
    at[far] = np.isfinite(sims[far]).argmax(axis=1)
    return at, dist


class Block:
    """Candidates of one block in hash order, and the pairs that are excluded from it."""

    def __init__(self, candidates: pa.Table, pairs: pa.Table | None, dim: int):
        rows = candidates.sort_by("hash")
        self.hashes = rows["hash"].combine_chunks()
        self.strata = pc.unique(rows["key"].combine_chunks())
        self.stratum = pc.index_in(rows["key"].combine_chunks(), value_set=self.strata).to_numpy(zero_copy_only=False)
        self.points, _ = matrix(rows["vector"], dim, np.float32)
        if pairs is not None:
            place = pc.index_in(pairs["peer"].combine_chunks(), value_set=self.hashes)
            self.asking = pairs["hash"].combine_chunks().filter(place.is_valid())
            self.banned = place.drop_null().to_numpy()
        else:
            self.asking, self.banned = None, None

    def best(self, queries: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
        q, _ = matrix(queries["vector"], dim, np.float32)
        own = pc.index_in(queries["hash"], value_set=self.hashes)
        rows, cols = [np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))], [own.drop_null().to_numpy()]
        if self.asking is not None:
            names, inverse = np.unique(queries["hash"].to_numpy(zero_copy_only=False), return_inverse=True)
            asked = pc.index_in(self.asking, value_set=pa.array(names, pa.string()))
            pair_of = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
            number = asked.drop_null().to_numpy()
            order = np.argsort(inverse, kind="stable")  # rows of one hash; as a rule one
            first, last = np.searchsorted(inverse[order], number), np.searchsorted(inverse[order], number, "right")
            rows.append(order[np.concatenate([np.arange(a, b) for a, b in zip(first, last)]).astype(np.int64)] if len(number) else number)
            cols.append(np.repeat(self.banned[pair_of], last - first))
        rows, cols = np.concatenate(rows).astype(np.int64), np.concatenate(cols).astype(np.int64)
        asked_of = pc.index_in(queries["key"], value_set=self.strata).fill_null(-1).to_numpy(zero_copy_only=False)
        mixed = len(self.strata) > 1 or (asked_of != 0).any()
        parts, step = [], max(1, 4_000_000 // len(self.points))
        for start in range(0, len(q), step):
            inside = (rows >= start) & (rows < start + step)
            same = asked_of[start:start + step, None] == self.stratum[None, :] if mixed else None
            parts.append(nearest_rows(q[start:start + step], self.points, rows[inside] - start, cols[inside], same))
        return tuple(np.concatenate(part) for part in zip(*parts))


def _compare(dim: int):
    """Rows sorted by (node, leaf, block, salt, kind): candidates, excluded pairs, queries; the best peer of each query row.

    Packs (their node begins with '#') hold whole strata.  In leaves, peers at distance 1 are left to the fallback: the
    smallest hash among them may be in a block that need not be visited.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: dict[int, list[pa.RecordBatch]] = {}
        block = None
        for new, part in runs(batches, [*_BLOCK, "salt"]):
            if new:
                given, block = {0: [], 1: []}, None
            kinds = part["kind"].to_numpy()
            for kind in (0, 1):
                some = _only(part, kinds, kind)
                if some.num_rows:
                    given[kind].append(some)
            queries = _only(part, kinds, 2)
            if not queries.num_rows or not given[0]:
                continue
            if block is None:
                block = Block(pa.Table.from_batches(given[0]), pa.Table.from_batches(given[1]) if given[1] else None, dim)
                given = {0: given[0], 1: []}
            at, dist = block.best(queries, dim)
            keep = np.isfinite(dist) if part["node"][0].as_py()[0] == "#" else dist < 1.0
            yield pa.RecordBatch.from_arrays(
                [queries["hash"].filter(pa.array(keep)), block.hashes.take(pa.array(at[keep])), pa.array(dist[keep])], names=["hash", "peer", "distance"])

    return run


class Group:
    """Candidates of a group in the order of their blocks, inside by hash, and the pairs that are excluded from it.

    A block is bounded by the mean of its rows, which serves as well as a pivot and needs no other group's rows.
    """

    def __init__(self, candidates: pa.Table, pairs: pa.Table | None, dim: int):
        rows = candidates.sort_by([("node", "ascending"), ("leaf", "ascending"), ("block", "ascending"), ("hash", "ascending")])
        self.hashes = rows["hash"].combine_chunks()
        self.rank = np.empty(len(self.hashes), np.int64)
        self.rank[pc.sort_indices(self.hashes).to_numpy()] = np.arange(len(self.hashes))
        self.points, _ = matrix(rows["vector"], dim, np.float32)
        codes = [rows[name].combine_chunks().dictionary_encode().indices.to_numpy() for name in ("node", "leaf")]
        codes.append(rows["block"].to_numpy())
        self.starts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in codes], axis=0)])
        self.ends = np.r_[self.starts[1:], len(self.hashes)]
        self.strata = pc.unique(rows["key"].combine_chunks())
        self.stratum = pc.index_in(rows["key"].combine_chunks(), value_set=self.strata).to_numpy(zero_copy_only=False)[self.starts]
        sizes = self.ends - self.starts
        exact = self.points.astype(np.float64)
        self.middle = np.add.reduceat(exact, self.starts) / sizes[:, None]
        self.radius = np.sqrt(np.maximum.reduceat(((exact - np.repeat(self.middle, sizes, axis=0)) ** 2).sum(axis=1), self.starts))
        self.norm = np.sqrt(np.maximum.reduceat((exact ** 2).sum(axis=1), self.starts))
        self.asking, self.banned = pa.array([], pa.string()), np.zeros(0, np.int64)
        if pairs is not None:
            place = pc.index_in(pairs["peer"].combine_chunks(), value_set=self.hashes)
            self.asking = pairs["hash"].combine_chunks().filter(place.is_valid())
            self.banned = place.drop_null().to_numpy()

    def _forbidden(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) that must not be matched, in the order of candidates: themselves and the excluded ones."""
        own = pc.index_in(names, value_set=self.hashes)
        rows, cols = [np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))], [own.drop_null().to_numpy()]
        if len(self.asking):
            distinct, inverse = np.unique(names.to_numpy(zero_copy_only=False), return_inverse=True)
            asked = pc.index_in(self.asking, value_set=pa.array(distinct, pa.string()))
            number, banned = asked.drop_null().to_numpy(), self.banned[asked.is_valid().to_numpy(zero_copy_only=False)]
            order = np.argsort(inverse, kind="stable")  # rows of one hash; as a rule one
            first, last = np.searchsorted(inverse[order], number), np.searchsorted(inverse[order], number, "right")
            rows += [order[a:b] for a, b in zip(first, last)]
            cols.append(np.repeat(banned, last - first))
        rows, cols = np.concatenate(rows).astype(np.int64), np.concatenate(cols).astype(np.int64)
        order = np.argsort(cols, kind="stable")
        return rows[order], cols[order]

    def best(self, queries: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and distance of the nearest allowed candidate of each query in the blocks that its bound leaves open."""
        exact, _ = matrix(queries["vector"], dim)
        q = exact.astype(np.float32)
        asked = pc.index_in(queries["key"], value_set=self.strata).fill_null(-1).to_numpy(zero_copy_only=False)
        mask = may_hold(exact @ self.middle.T, np.sqrt((exact ** 2).sum(axis=1)), np.sqrt((self.middle ** 2).sum(axis=1)),
                        self.radius, self.norm, queries["bound"].to_numpy()) & (asked[:, None] == self.stratum[None, :])
        rows, cols = self._forbidden(queries["hash"])
        at, dist = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
        for block in np.flatnonzero(mask.any(axis=0)):
            low, high = self.starts[block], self.ends[block]
            a, b = np.searchsorted(cols, [low, high])
            open_rows = np.flatnonzero(mask[:, block])
            step = max(1, 4_000_000 // (high - low))
            for start in range(0, len(open_rows), step):
                some = open_rows[start:start + step]
                place = np.searchsorted(some, rows[a:b])
                here = np.flatnonzero(some[np.minimum(place, len(some) - 1)] == rows[a:b])
                near, d = nearest_rows(q[some], self.points[low:high], place[here], cols[a:b][here] - low)
                near = near + low
                better = (d < dist[some]) | ((d == dist[some]) & np.isfinite(d) & (self.rank[near] < self.rank[at[some]]))
                at[some[better]], dist[some[better]] = near[better], d[better]
        return at, dist


def _sweep(dim: int):
    """Rows sorted by (group, salt, kind): candidates, excluded pairs, queries with a bound; the best peer of each query row.

    Peers at distance 1 are left to the fallback.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: dict[int, list[pa.RecordBatch]] = {}
        held = None
        for new, part in runs(batches, ["group", "salt"]):
            if new:
                given, held = {0: [], 1: []}, None
            kinds = part["kind"].to_numpy()
            for kind in (0, 1):
                some = _only(part, kinds, kind)
                if some.num_rows:
                    given[kind].append(some)
            queries = _only(part, kinds, 2)
            if not queries.num_rows or not (held or given[0]):
                continue
            if held is None:
                held = Group(pa.Table.from_batches(given[0]), pa.Table.from_batches(given[1]) if given[1] else None, dim)
                given = {0: [], 1: []}
            at, dist = held.best(queries, dim)
            keep = pa.array(dist < 1.0)
            yield pa.RecordBatch.from_arrays(
                [queries["hash"].filter(keep), held.hashes.take(pa.array(at)).filter(keep), pa.array(dist).filter(keep)], names=["hash", "peer", "distance"])

    return run


def block_rows(df: DataFrame, kind: int, salts: Column | None = None, salt: Column | None = None) -> DataFrame:
    """Rows for ``_compare``: copied to all ``salts``, or dealt to one."""
    dealt = F.lit(0) if salt is None else salt.cast("int")
    place = dealt if salts is None else F.explode(F.sequence(F.lit(0), salts - 1))
    kinds = {"peer": "string", "key": "string", "vector": "array<float>"}
    rest = [F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    return df.select(*_BLOCK, place.alias("salt"), F.lit(kind).alias("kind"), "hash", *rest)


def compare(parts: list[DataFrame], dim: int, tasks: int) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = [*_BLOCK, "salt"]
    return out.repartition(tasks, *order).sortWithinPartitions(*order, "kind").mapInArrow(_compare(dim), RESULT)


def compare_all(queries: DataFrame, candidates: pa.Table, excluded: pa.Table | None, dim: int) -> DataFrame:
    """Queries (hash, key, vector) against candidates of a proven size, which every task gets whole; strata stay apart."""
    held = queries.sparkSession.sparkContext.broadcast((candidates, excluded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, pairs = held.value
        blocks: dict[str, Block] = {}
        for batch in batches:
            for key in pc.unique(batch["key"]).to_pylist():
                if key not in blocks:
                    stratum = given.filter(pc.equal(given["key"], key))
                    blocks[key] = Block(stratum, pairs, dim) if stratum.num_rows else None
                if blocks[key] is None:
                    continue
                some = batch.filter(pc.equal(batch["key"], key))
                at, dist = blocks[key].best(some, dim)
                keep = pa.array(np.isfinite(dist))
                yield pa.RecordBatch.from_arrays(
                    [some["hash"].filter(keep), blocks[key].hashes.take(pa.array(at).filter(keep)), pa.array(dist).filter(keep)], names=["hash", "peer", "distance"])

    return spread_work(queries, "hash").mapInArrow(run, RESULT)


def packed(rows: DataFrame, packs: int) -> DataFrame:
    """Rows of small strata, whole strata dealt into packs."""
    pack = F.concat(F.lit("#"), F.pmod(F.xxhash64("key"), F.lit(packs)))
    return rows.select(pack.alias("node"), F.lit("").alias("leaf"), F.lit(0).alias("block"), "hash", "key", "vector")


# ---------------------------------------------------------------- the tree

class PivotTree:
    """Settled rows and leaves of the candidates (hash, key, vector, layer), and of the queries that ask for them.

    ``queries`` None: the candidates themselves.  A stratum's ``layer`` gives its top pivots, 2**layer.
    """

    def __init__(self, candidates: DataFrame, queries: DataFrame | None, pivots: np.ndarray, block: int, rows: int):
        self.block, self.pivots, self.dim = block, pivots, pivots.shape[1]
        self.tasks = max(work_partitions(candidates.sparkSession), math.ceil(rows / TASK_ROWS))
        self.salts = math.ceil(2 * self.tasks / len(pivots))
        place = _place(pivots)

        def placed(df: DataFrame, role: int, kind: int) -> DataFrame:
            at = df.withColumn("cell", place("vector", "layer")).where("cell >= 0")
            return at.select("layer", "cell", self._node("cell"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), "hash", "key", "vector")

        def dealt(df: DataFrame) -> DataFrame:
            return df.withColumn("salt", F.pmod(F.xxhash64("hash", F.lit("salt")), F.lit(self.salts)).cast("int"))

        usable = candidates.where(~vectors.needs_vector(F.col("vector"), self.dim))
        inner = self._to_all_salts(placed(usable.where(self._is_pivot()), OFFERS, 0))
        if queries is None:
            everyone = dealt(placed(candidates, OFFERS + ASKS, 1))
        else:
            everyone = dealt(placed(candidates, OFFERS, 1)).unionByName(dealt(placed(queries, ASKS, 1)))
        stream = inner.unionByName(everyone).repartition(self.tasks, "node", "salt").sortWithinPartitions("node", "salt", "kind")
        self.settled = materialize(stream.mapInArrow(_settle(pivots), _SETTLED))

        offers, asks = F.col("role").bitwiseAND(OFFERS) > 0, F.col("role").bitwiseAND(ASKS) > 0
        self.offering, self.asking = self.settled.where(offers), self.settled.where(asks)
        leaves = self.settled.groupBy("layer", "cell", "node", "leaf").agg(
            F.count_if(offers).alias("n"), F.count_if(asks).alias("asked"),
            *(F.max(F.when(offers, F.col(c))).alias(c) for c in ("spread", "radius", "norm")))
        blocks = F.ceil(F.col("n") / block).cast("int")
        salts = F.ceil(F.col("asked") / (F.greatest(blocks, F.lit(1)) * BLOCKS_PER_SALT * block))
        self.leaves = materialize(leaves.withColumn("blocks", blocks).withColumn("salts", F.greatest(salts, F.lit(1)).cast("int")))
        found = self.leaves.where("n > 0").groupBy("layer", "cell").agg(F.max("spread").alias("spread"), F.max("norm").alias("norm")).collect()
        self.spreads = {(r["layer"], r["cell"]): (r["spread"], r["norm"]) for r in found}

    @staticmethod
    def _node(cell: str) -> Column:
        return F.concat(F.col(cell), F.lit("/"), F.col("key")).alias("node")

    def _is_pivot(self) -> Column:
        return F.pmod(F.xxhash64("hash"), F.lit(self.block)) == 0

    def _to_all_salts(self, df: DataFrame) -> DataFrame:
        return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))

    def _at_home(self, rows: DataFrame, turn: str) -> DataFrame:
        """Rows with their leaf's blocks and salts, and the block that is theirs; NULL where the leaf offers nothing."""
        sizes = self.leaves.select("node", "leaf", "blocks", "salts")
        own = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("hash", F.lit(turn)), F.col("blocks")).cast("int"))
        return rows.join(sizes, ["node", "leaf"]).withColumn("block", own)

    def blocks(self) -> DataFrame:
        """Candidates with their place (node, leaf, block)."""
        return self._at_home(self.offering, "offers").select(*_BLOCK, "salts", "hash", "key", "vector")

    def seeds(self) -> DataFrame:
        """Queries with the block of their own leaf that they look at first."""
        return self._at_home(self.asking, "asks")

    def seed_parts(self, excluded: DataFrame | None) -> list[DataFrame]:
        """Rows for ``compare`` that give every query a first distance."""
        asked = self.seeds().where("block is not null")
        salt = F.pmod(F.xxhash64("hash", F.lit("seed")), F.col("salts"))
        out = [block_rows(self.blocks(), 0, F.col("salts")), block_rows(asked, 2, salt=salt)]
        return out if excluded is None else [*out, block_rows(excluded, 1, F.col("salts"))]

    def visits(self, seeds: DataFrame) -> DataFrame:
        """One row for each query and block that may hold something at least as near as the query's seed: what the bounds leave
        open at most, for tests and trials.  Without structure that is queries times blocks, so the search does not list it."""
        bounds = seeds.select("hash", F.col("distance").alias("bound"))
        asked = self.seeds().join(bounds, "hash", "left").withColumn("bound", F.coalesce("bound", F.lit(1.0)))
        cells = _open_cells(self.pivots, self.spreads)("vector", "layer", "bound")
        routed = asked.select("layer", F.explode(cells).alias("cell"), F.col("node").alias("home"), "leaf", "block", "bound", "hash", "key", "vector")
        routed = routed.select(self._node("cell"), "cell", "home", "leaf", "block", "bound", F.lit(None).cast("double").alias("radius"),
                               F.lit(None).cast("double").alias("norm"), "hash", "key", "vector", F.lit(1).alias("kind"),
                               F.pmod(F.xxhash64("hash", F.lit("route")), F.lit(self.salts)).cast("int").alias("salt"))
        points = self.offering.where(self._is_pivot()).select("node", F.col("hash").alias("leaf"), "vector")
        held = self.leaves.where("n > 0").join(points.dropDuplicates(["node", "leaf"]), ["node", "leaf"], "left")
        held = held.select("node", "cell", F.lit("").alias("home"), "leaf", F.col("blocks").alias("block"), F.lit(0.0).alias("bound"),
                           "radius", "norm", F.lit("").alias("hash"), F.lit("").alias("key"), "vector", F.lit(0).alias("kind"))
        stream = self._to_all_salts(held).unionByName(routed)
        return stream.repartition(self.tasks, "node", "salt").sortWithinPartitions("node", "salt", "kind").mapInArrow(_route(self.pivots), _VISIT)

    def sweep(self, seeds: DataFrame, excluded: DataFrame | None) -> DataFrame:
        """Nearest peer of every query among all that its seed leaves open: queries times groups, candidates times salts.

        There are as many groups as candidates ask for (GROUP_BYTES each), more if that makes fewer rows travel for the same
        number of tasks.
        """
        nodes = self.leaves.groupBy("node").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))
        offers, largest, asks = nodes.agg(F.sum("n"), F.max("n"), F.sum("asked")).first()
        if not offers or not asks:
            return seeds.limit(0)
        groups = max(math.ceil(offers * self.dim * 4 / GROUP_BYTES), min(self.tasks, round(math.sqrt(self.tasks * offers / asks))))
        parts = min(groups, math.ceil(4 * groups * largest / offers))  # a node's share of a group is a quarter of it at most
        salts = math.ceil(self.tasks / groups)

        def group(node: Column, leaf: Column, block: Column) -> Column:
            cell, key = F.substring_index(node, "/", 1).cast("int"), F.substr(node, F.instr(node, "/") + 1)
            return F.pmod(F.pmod(F.xxhash64(key), F.lit(groups)) + cell * parts + F.pmod(F.xxhash64(leaf, block), F.lit(parts)), F.lit(groups)).cast("int")

        place = group(F.col("node"), F.col("leaf"), F.col("block"))
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
        none = {"node": "string", "leaf": "string", "block": "int", "key": "string", "peer": "string", "bound": "double", "vector": "array<float>"}

        def shown(df: DataFrame, kind: int, *at: Column) -> DataFrame:
            rest = [F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in none.items()]
            return df.select(*at, F.lit(kind).alias("kind"), "hash", *rest)

        bounds = seeds.select("hash", F.col("distance").alias("bound"))
        asked = self.asking.join(bounds, "hash", "left").withColumn("bound", F.coalesce("bound", F.lit(1.0)))
        turn = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")
        opened = _open_groups(self.pivots, self.spreads, groups, parts)("vector", "layer", "bound", turn)
        routed = asked.select(F.explode(opened).alias("group"), F.pmod(F.xxhash64("hash", F.lit("sweep")), F.lit(salts)).cast("int").alias("salt"), "hash", "key", "bound", "vector")
        stream = shown(self.blocks(), 0, place.alias("group"), every).unionByName(shown(routed, 2, F.col("group"), F.col("salt")))
        if excluded is not None:
            stream = stream.unionByName(shown(excluded, 1, place.alias("group"), every))
        stream = stream.repartitionById(groups * salts, F.col("group") * salts + F.col("salt"))
        return stream.sortWithinPartitions("group", "salt", "kind").mapInArrow(_sweep(self.dim), RESULT)


def choose_pivots(candidates: DataFrame, count: int, dim: int) -> np.ndarray:
    """``count`` usable vectors in a fixed pseudo-random order: a bounded top-k."""
    usable = candidates.filter(~vectors.needs_vector(F.col("vector"), dim) & F.forall("vector", vectors.finite))
    rows = usable.orderBy(F.xxhash64("hash"), "hash").limit(count).select("vector").collect()
    return np.array([r["vector"] for r in rows], dtype=float).reshape(-1, dim)


def search(tree: PivotTree, seeds: DataFrame, excluded: DataFrame | None) -> DataFrame:
    return seeds.unionByName(tree.sweep(seeds, excluded))
