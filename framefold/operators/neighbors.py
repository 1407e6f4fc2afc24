"""Exact nearest neighbours with exclusion rules.

``nearest`` is an exact k = 1 join that never lists pairs.  Small strata are packed together and compared whole; larger
ones go through a tree of pivots (``pivot_tree``) whose leaves hold about ``block_rows`` rows at every size of the table.  Each
task compares streamed queries with one block by a numpy matrix product and returns a single row per query and
block; the rows are merged by ``min``.

Ties go to the smaller hash.  Distances are double arithmetic rounded to 6 digits, clamped to [0, 1]; vectors
that are missing, not finite or of a wrong length are at distance 1 from everything.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefold.functions import vectors
from framefold.operators import pivot_tree
from framefold.session import hot_keys, materialize, materialize_counted, one_thread_per_task, spread_join, work_partitions

BLOCK_ROWS = 2048  # candidates that a task compares with at a time
MAX_BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 8 << 20  # candidates, or excluded pairs, that every task may get whole
PAIR_BYTES = 48


# ---------------------------------------------------------------- one query against the whole catalog

def _distance_to(catalog: DataFrame, query: Column) -> Column:
    """Distance of each row's vector to ``query``, a constant or a scalar subquery.  That one vector is fetched and goes with the function."""
    one_thread_per_task(catalog.sparkSession)
    return vectors.distance_to(F.col("vector"), catalog.sparkSession.range(1).select(query.alias("q")).first()["q"])


def beam(catalog: DataFrame, query: Column) -> DataFrame:
    """Distance of every vector to one query vector, nearest first.  ``query`` may be a scalar subquery."""
    return catalog.select("hash", F.round(_distance_to(catalog, query), 6).alias("distance")).orderBy("distance", "hash")


def closest(catalog: DataFrame, query: Column) -> DataFrame:
    """The nearest image of a free vector; partial argmin per task, no sort.  Empty catalog: one NULL row."""
    near = F.struct(F.round(F.col("distance"), 6).alias("distance"), F.col("hash"))
    return (catalog.select("hash", _distance_to(catalog, query).alias("distance")).agg(F.min(near).alias("near"))
            .select(F.col("near.hash").alias("hash"), F.col("near.distance").alias("distance")))


def labelled_distances(catalog: DataFrame, base: str, query: Column) -> DataFrame:
    """One base against many, as labelled text."""
    others = catalog.filter(F.col("hash") != base)
    return others.select("hash", F.concat(F.lit(f"{base}-"), F.col("hash"), F.format_string(" = %.4f", _distance_to(catalog, query)))
                         .alias("label"))


# ---------------------------------------------------------------- helpers of the join

def _smallest_hashes(df: DataFrame, by: list[str], depth: int) -> DataFrame:
    """The ``depth`` smallest hashes of every group: ranked inside salted parts of the group first, so that a hot group is
    never sorted in one task, then among the parts' survivors."""
    def limited(part: DataFrame, keys: list) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
        return part.withColumn("_rank", rank).filter(F.col("_rank") <= depth).drop("_rank")

    salted = df.withColumn("_salt", F.pmod(F.xxhash64("hash"), F.lit(work_partitions(df.sparkSession))))
    return limited(limited(salted, [*by, "_salt"]).drop("_salt"), by)


def _with_digest(df: DataFrame) -> DataFrame:
    """Adds 128 bits that follow from the vector, so that no vector is a grouping key."""
    return df.withColumn("high", F.xxhash64("vector")).withColumn("low", F.xxhash64(F.lit("vector"), "vector"))


def _without_spare_copies(candidates: DataFrame, depth: int) -> DataFrame:
    """Keep the ``depth`` smallest hashes of each set of equal vectors in a stratum.

    All copies are equally far from a query, and the query takes the smallest hash it may have: with b exclusions
    that is among the b + 2 smallest.  So nothing is lost, and a third of the collection being one picture does
    not make its cell quadratic.  Only digests are ranked; the vectors move once, to meet what is kept.
    """
    digests = _with_digest(candidates).select("hash", "key", "high", "low")
    kept = _smallest_hashes(digests, ["key", "high", "low"], depth).select("hash", "key").distinct()
    return candidates.join(kept, ["hash", "key"], "left_semi")


def _strata(q: DataFrame | None, c: DataFrame) -> DataFrame:
    """(key, rows, c, copies): rows of the larger side, candidates, and the most candidates with one vector."""
    same = _with_digest(c.select("key", "vector")).groupBy("key", "high", "low").agg(F.count("*").alias("n"))
    sizes = same.groupBy("key").agg(F.sum("n").alias("c"), F.max("n").alias("copies"))
    if q is None:
        return sizes.select("key", F.col("c").alias("rows"), "c", "copies")
    asked = q.groupBy("key").agg(F.count("*").alias("q"))
    joined = sizes.join(asked, "key", "full_outer").fillna(0, ["c", "copies", "q"])
    return joined.select("key", F.greatest("c", "q").alias("rows"), "c", "copies")


def _smallest_allowed(unresolved: DataFrame, candidates: DataFrame, exclusions: DataFrame | None) -> DataFrame:
    """Peer at distance 1 for queries (hash, key) with nothing nearer: the smallest hash that is not excluded.

    The candidates of a stratum are numbered in hash order, as far as exclusions can reach: a query with b exclusions
    finds its peer among the first b + 2.  Each exclusion takes a number away, and the first that is left is the peer's.
    """
    own = unresolved.select("hash", F.col("hash").alias("peer"))
    taken = own if exclusions is None else own.unionByName(
        exclusions.select("hash", "peer").join(own.select("hash"), "hash", "left_semi")).distinct()
    most = 1 if exclusions is None else taken.groupBy("hash").count().agg(F.max("count")).first()[0] or 1
    strata = unresolved.select("key").distinct()
    heads = _smallest_hashes(candidates.select("key", "hash"), ["key"], most + 1).join(strata, "key", "left_semi")
    heads = materialize(heads.select("key", F.col("hash").alias("peer"), F.row_number().over(Window.partitionBy("key").orderBy("hash")).alias("number")))
    gone = taken.join(heads, "peer").join(unresolved.select("hash", "key"), ["hash", "key"]).select("hash", "number").distinct()
    place = F.row_number().over(Window.partitionBy("hash").orderBy("number"))
    first = (gone.withColumn("place", place).groupBy("hash")
             .agg(F.coalesce(F.min(F.when(F.col("number") != F.col("place"), F.col("place"))), F.count("*") + 1).alias("number")))
    slot = F.concat_ws("/", F.coalesce("number", F.lit(1)).cast("string"), F.col("key"))
    asked = unresolved.select("hash", "key").join(first, "hash", "left").select("hash", slot.alias("slot"))
    offered = heads.select(F.concat_ws("/", F.col("number").cast("string"), F.col("key")).alias("slot"), "peer")
    return spread_join(asked, offered, "slot", "hash", "inner").select("hash", "peer", F.lit(1.0).alias("distance"))


# ---------------------------------------------------------------- the join

def nearest(queries: DataFrame, candidates: DataFrame | None = None, *, within: str | None = None,
            exclusions: DataFrame | None = None, block_rows: int | None = None, dim: int | None = None,
            broadcast_bytes: int | None = None) -> DataFrame:
    """Nearest candidate of every query: (hash, peer, distance).  Queries without one are absent.

    Without ``candidates`` the queries are joined with themselves.  ``within`` names a column that must be equal
    on both sides.  ``exclusions`` has (hash, peer) pairs that must not be matched; a query is never its own peer.
    Each pair travels to the block of its peer, so a caller with hubs restricts them first (``stratum_exclusions``).

    ``dim`` is the vector length the table is meant to have; only if it is not given, the candidates' most common
    one.  Candidates and exclusions of at most ``broadcast_bytes`` (BROADCAST_BYTES) each go to all tasks and are compared whole, in one pass over
    the queries.  ``block_rows`` is the number of candidates a task compares at a time; strata of at most so many rows are packed
    into blocks by a hash of their key and compared whole, larger ones go through the pivots.  Inputs are read a few
    times; give tables, not long derivations.
    """
    one_thread_per_task(queries.sparkSession)
    block = block_rows or BLOCK_ROWS
    keyed = F.col(within).cast("string") if within else F.lit("")
    q = queries.select("hash", F.coalesce(keyed, F.lit("")).alias("key"), "vector")
    # Aliased, so that a self-join has columns of its own on the candidate side.
    c = (queries if candidates is None else candidates).select(
        F.col("hash").alias("hash"), F.coalesce(keyed, F.lit("")).alias("key"), F.col("vector").alias("vector"))
    if dim is None:  # counted per length; NULL vectors have size -1 or NULL and never set it
        lengths = c.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("len")).count()
        dim = lengths.agg(F.max_by("len", F.struct("count", "len"))).first()[0] or 1

    whole = _small_sides(c, exclusions, dim, broadcast_bytes)
    if whole is not None:
        return pivot_tree.compare_all(q, *whole, dim)

    layer = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("c"), F.lit(1)) / block) / 2)).cast("int")
    sizes = _strata(None if candidates is None else q, c).withColumn("layer", F.when(F.col("rows") > block, layer))
    if within:
        sizes = materialize(sizes)
    small, large = F.col("layer").isNull(), F.col("layer").isNotNull()
    n_small, n_large, n_rows, n_candidates, depth, copies = sizes.agg(
        F.sum(F.when(small, F.col("rows"))), F.count(F.when(large, 1)), F.sum(F.when(large, F.col("rows"))),
        F.sum(F.when(large, F.col("c"))), F.max("layer"), F.max(F.when(large, F.col("copies")))).first()

    if not n_large:
        if not n_small:
            return q.limit(0).select("hash", F.col("hash").alias("peer"), F.lit(1.0).alias("distance"))
        packs = math.ceil(n_small / block)
        parts = _pack_parts(q, c, packs, exclusions)
        return pivot_tree.compare(parts, dim, max(work_partitions(q.sparkSession), math.ceil(n_small / pivot_tree.TASK_ROWS)))

    if within:
        q, c = (_with_layer(x, sizes, n_large) for x in (q, c))
    else:
        q, c = (x.withColumn("layer", F.lit(depth).cast("int")) for x in (q, c))
    q_large, c_large = q.where(large), c.where(large)
    pivots = pivot_tree.choose_pivots(c_large, 1 << depth, dim) if n_candidates else np.zeros((0, dim))
    packs = _pack_parts(q.where(small), c.where(small), math.ceil(n_small / block), exclusions) if n_small else []
    tasks = max(work_partitions(q.sparkSession), math.ceil(((n_small or 0) + n_rows) / pivot_tree.TASK_ROWS))
    if len(pivots) < 1 << depth:  # fewer usable vectors than pivots: one of them is enough to have cells
        q_large, c_large = (x.withColumn("layer", F.lit(0)) for x in (q_large, c_large))
        pivots = pivots[:1]
    tree, excluded, found = None, None, None
    if len(pivots):
        kept = c_large
        if copies > 2:  # with b exclusions, b + 2 copies are all that a query can ever pick from
            most = 0 if exclusions is None else exclusions.groupBy("hash").count().agg(F.max("count")).first()[0] or 0
            kept = _without_spare_copies(c_large, most + 2) if copies > most + 2 else c_large
        alone = candidates is None and kept is c_large
        tree = pivot_tree.PivotTree(kept, None if alone else q_large, pivots, block, n_rows)
        if exclusions is not None:
            placed = tree.blocks().select(F.col("hash").alias("peer"), "node", "leaf", "block", "salts")
            excluded = materialize(spread_join(exclusions.select("hash", "peer"), placed, "peer", "hash", "inner"))
    first = packs + (tree.seed_parts(excluded) if tree else [])
    if first:
        found = materialize(pivot_tree.compare(first, dim, tasks))
    answered = None
    if tree:
        found, answered = materialize_counted(_merge(pivot_tree.search(tree, found, excluded)))
    if candidates is None and answered == n_rows + (n_small or 0):
        return found
    unresolved = q_large.select("hash", "key") if found is None else q_large.select("hash", "key").join(found, "hash", "left_anti")
    unresolved, left = materialize_counted(unresolved)
    if not left:
        return found
    rest = _smallest_allowed(unresolved, c_large, exclusions)
    return rest if found is None else found.unionByName(rest)


def _small_sides(c: DataFrame, exclusions: DataFrame | None, dim: int, limit: int | None) -> tuple[pa.Table, pa.Table | None] | None:
    """Candidates and excluded pairs, if each fits into ``limit`` bytes.  One row more than would fit is fetched at most."""
    def fetched(df: DataFrame, row_bytes: int) -> pa.Table | None:
        rows = df.limit(limit // row_bytes + 1).toArrow()
        return rows if rows.num_rows <= limit // row_bytes and rows.nbytes <= limit else None

    limit = BROADCAST_BYTES if limit is None else limit
    if limit <= 0:
        return None
    candidates = fetched(c, 4 * dim + PAIR_BYTES)
    if candidates is None or exclusions is None:
        return None if candidates is None else (candidates, None)
    pairs = fetched(exclusions.select("hash", "peer"), PAIR_BYTES)
    return None if pairs is None else (candidates, pairs)


def _with_layer(df: DataFrame, sizes: DataFrame, n_large: int) -> DataFrame:
    """Adds the stratum's layer, NULL for small strata; the list of large ones is broadcast only when it is short."""
    known = sizes.where("layer is not null").select("key", "layer")
    if n_large <= MAX_BROADCAST_ROWS:
        return df.join(F.broadcast(known), "key", "left").select(*df.columns, "layer")
    return spread_join(df, known, "key", "hash").select(*df.columns, "layer")


def _pack_parts(q: DataFrame, c: DataFrame, packs: int, exclusions: DataFrame | None) -> list[DataFrame]:
    """Rows for ``pivot_tree.compare`` that answer small strata."""
    offered = pivot_tree.packed(c, packs)
    parts = [pivot_tree.block_rows(offered, 0), pivot_tree.block_rows(pivot_tree.packed(q, packs), 2)]
    if exclusions is not None:
        places = offered.select(F.col("hash").alias("peer"), "node", "leaf", "block")
        parts.append(pivot_tree.block_rows(spread_join(exclusions.select("hash", "peer"), places, "peer", "hash", "inner"), 1))
    return parts


def _merge(results: DataFrame) -> DataFrame:
    near = F.min(F.struct("distance", "peer")).alias("near")
    return (results.groupBy("hash").agg(near)
            .select("hash", F.col("near.peer").alias("peer"), F.col("near.distance").alias("distance")))


# ---------------------------------------------------------------- review partner and friends

def stratum_exclusions(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends have the same history size; only these can exclude a partner.

    This bounds the list per image: m entries need m more images of the stratum with at least m edges each, so
    m is at most the square root of the number of edges, whatever the degree of a hub.
    """
    sizes = catalog.select("hash", F.col("hist_len").alias("_left"))
    peers = catalog.select(F.col("hash").alias("peer"), F.col("hist_len").alias("_right"))
    with_left = spread_join(edges.select("hash", "peer"), sizes, "hash", "peer", "inner")
    return (spread_join(with_left, peers, "peer", "hash", "inner", hot=hot_keys(edges, "peer"))
            .filter(F.col("_left") == F.col("_right")).select("hash", "peer"))


def review_partners(catalog: DataFrame, edges: DataFrame, queries: DataFrame | None = None, block_rows: int | None = None,
                    dim: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """Nearest image of the same history size that was not compared yet; NULL when there is none.

    ``queries`` (hash) limits whose partner is searched; by default everybody's.
    """
    if queries is None:
        asked, candidates = catalog, None
    else:
        asked = materialize(catalog.join(queries.select("hash").distinct(), "hash", "left_semi"))
        candidates, edges = catalog, edges.join(asked.select("hash"), "hash", "left_semi")
    found = None
    if dim is not None:
        rows = (catalog, asked)
        c, q = (x.select("hash", F.coalesce(F.col("hist_len").cast("string"), F.lit("")).alias("key"), "vector") for x in rows)
        whole = _small_sides(c, edges, dim, broadcast_bytes)
        found = None if whole is None else pivot_tree.compare_all(q, *whole, dim)
    if found is None:
        exclusions = materialize(stratum_exclusions(catalog, edges))
        found = nearest(asked, candidates, within="hist_len", exclusions=exclusions, block_rows=block_rows, dim=dim, broadcast_bytes=broadcast_bytes)
    return (asked.select(F.col("hash").alias("hash_x"))
            .join(found.select(F.col("hash").alias("hash_x"), F.col("peer").alias("hash_y"), "distance"),
                  "hash_x", "left"))


def partner_of(catalog: DataFrame, edges: DataFrame, hash_x: str) -> DataFrame:
    """J3 for a single image: one scan of its stratum with a combined argmin; no row when the image is unknown."""
    x = catalog.filter(F.col("hash") == hash_x)
    seen = edges.filter(F.col("hash") == hash_x).select(F.col("peer").alias("hash")).distinct()
    stratum = (catalog.filter(F.col("hash") != hash_x)
               .filter(F.col("hist_len") == x.select("hist_len").scalar())
               .join(seen, "hash", "left_anti"))
    near = (closest(stratum, x.select("vector").scalar())
            .select(F.lit(hash_x).alias("hash_x"), F.col("hash").alias("hash_y"), "distance"))
    return near.join(x.select(F.col("hash").alias("hash_x")), "hash_x", "left_semi")


def head_partners(catalog: DataFrame, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """J3 for ``heads`` (hash), at most one per history size: (hash_x, hash_y, distance), NULL where there is no partner.

    Every image meets the one head of its stratum, so the search is linear; distances are reduced where they are computed.
    """
    asked = materialize(catalog.join(heads.select("hash"), "hash", "left_semi")
                        .select(F.col("hash").alias("hash_x"), "hist_len", F.col("vector").alias("_q")))
    met = spread_join(catalog.select("hash", "hist_len", "vector"), asked, "hist_len", "hash", "inner").filter(F.col("hash") != F.col("hash_x"))
    seen = edges.select(F.col("hash").alias("hash_x"), F.col("peer").alias("hash")).join(asked.select("hash_x"), "hash_x", "left_semi")
    near = F.struct(F.round(vectors.distance(F.col("vector"), F.col("_q")), 6).alias("distance"), F.col("hash"))
    best = met.join(seen, ["hash_x", "hash"], "left_anti").groupBy("hash_x").agg(F.min(near).alias("near"))
    return asked.select("hash_x").join(best, "hash_x", "left").select("hash_x", F.col("near.hash").alias("hash_y"), F.col("near.distance").alias("distance"))


def unseen(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop proposed pairs (hash, peer) that were compared before."""
    return pairs.join(edges.select("hash", "peer"), ["hash", "peer"], "left_anti")


def nearest_neighbors(catalog: DataFrame, block_rows: int | None = None, dim: int | None = None,
                      broadcast_bytes: int | None = None) -> DataFrame:
    """For each image its nearest other."""
    return nearest(catalog, block_rows=block_rows, dim=dim, broadcast_bytes=broadcast_bytes)


def neighbor_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """J6: "old -> new" where the nearest distance moved by at least 0.0001, else the distance alone.

    Without a new neighbour there is nothing to report; an image without an old value counts as distance 1.
    """
    before = old.select("hash", F.col("distance").alias("_old"))
    was = F.coalesce("_old", F.lit(1.0))
    return (new.join(before, "hash", "left")
            .withColumn("moved", F.abs(F.col("distance") - was) >= 1e-4)
            .select("hash", "peer", "moved",
                    F.when(F.col("moved"), F.format_string("%.4f → %.4f", was, "distance"))
                    .otherwise(F.format_string("%.4f", "distance")).alias("message")))


def next_after_delete(catalog: DataFrame, deleted: DataFrame, block_rows: int | None = None, dim: int | None = None,
                      broadcast_bytes: int | None = None) -> DataFrame:
    """For each deleted row (hash, vector) the nearest survivor."""
    survivors = catalog.join(deleted.select("hash"), "hash", "left_anti")
    return nearest(deleted, survivors, block_rows=block_rows, dim=dim, broadcast_bytes=broadcast_bytes)
