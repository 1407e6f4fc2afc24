import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framefold.functions import vectors
from framefold.operators import neighbors, pivot_tree
from framefold.session import materialize

N, D = 400, 8


@pytest.fixture(autouse=True)
def through_pivots(monkeypatch):
    """Small tables would be broadcast whole; the tests of that path undo this."""
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 0)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, D))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[17]
    x[60:200] = x[60]              # a third of the collection is one picture
    x[40], x[41, 0], x[50, 3] = 0, np.nan, np.nan
    x = x.astype("float32")
    strata = np.where(rng.random(N) < 0.4, 0, rng.integers(0, 4, N))
    names = [f"h{i:04d}" for i in rng.permutation(N)]
    seen = {(i, int(j)) for i in range(N) for j in rng.integers(0, N, 5)}
    return x, strata, names, seen


def brute(data, queries, candidates, keyed, seen):
    x, strata, names, _ = data
    out = {}
    for i in queries:
        options = []
        for j in candidates:
            if i == j or (keyed and strata[i] != strata[j]) or (i, j) in seen:
                continue
            d = 1 - float(x[i].astype(float) @ x[j].astype(float))
            options.append((1.0 if np.isnan(d) else round(min(1.0, max(0.0, d)), 6), names[j]))
        if options:
            out[names[i]] = min(options)
    return out


def frame(spark, data, rows):
    x, strata, names, _ = data
    return spark.createDataFrame([(names[i], int(strata[i]), [float(v) for v in x[i]]) for i in rows],
                                 "hash string, hist_len long, vector array<float>")


def edges(spark, data):
    return spark.createDataFrame([(data[2][a], data[2][b]) for a, b in data[3]], "hash string, peer string")


def found(df):
    rows = df.collect()
    assert len({r.hash for r in rows}) == len(rows)
    return {r.hash: (round(r.distance, 6), r.peer) for r in rows}


@pytest.mark.parametrize("block_rows", [2048, 100])
def test_keyed_self_join(spark, data, block_rows):
    got = neighbors.nearest(frame(spark, data, range(N)), within="hist_len", exclusions=edges(spark, data),
                            block_rows=block_rows)
    assert found(got) == brute(data, range(N), range(N), True, data[3])


@pytest.mark.parametrize("block_rows", [2048, 64])
def test_all_pairs(spark, data, block_rows):
    assert found(neighbors.nearest(frame(spark, data, range(N)), block_rows=block_rows)) == brute(
        data, range(N), range(N), False, set())


@pytest.mark.parametrize("block_rows", [2048, 64])
@pytest.mark.parametrize("keyed", [False, True])
def test_two_sets(spark, data, block_rows, keyed):
    q, c = range(0, 90), range(70, N)
    options = {"within": "hist_len", "exclusions": edges(spark, data)} if keyed else {}
    got = neighbors.nearest(frame(spark, data, q), frame(spark, data, c).repartition(5), block_rows=block_rows, **options)
    assert found(got) == brute(data, q, c, keyed, data[3] if keyed else set())


@pytest.mark.parametrize("keyed", [False, True])
def test_small_candidates_are_broadcast(spark, data, monkeypatch, keyed):
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(pivot_tree, "compare", None)
    options = {"within": "hist_len", "exclusions": edges(spark, data)} if keyed else {}
    q, c = range(0, 90), range(70, N)
    seen = data[3] if keyed else set()
    assert found(neighbors.nearest(frame(spark, data, q), frame(spark, data, c).repartition(5), dim=D, **options)) == brute(data, q, c, keyed, seen)
    assert found(neighbors.nearest(frame(spark, data, range(N)), dim=D, **options)) == brute(data, range(N), range(N), keyed, seen)
    catalog = frame(spark, data, range(N))
    rows = neighbors.review_partners(catalog, edges(spark, data), dim=D).collect()
    assert {r.hash_x: (r.distance, r.hash_y) for r in rows if r.hash_y} == brute(data, range(N), range(N), True, data[3])


def test_what_does_not_fit_is_not_broadcast(spark, data):
    c, pairs = frame(spark, data, range(N)).withColumn("key", F.lit("")), edges(spark, data)
    fits = N * (4 * D + neighbors.PAIR_BYTES)
    assert neighbors._small_sides(c, None, D, fits)[0].num_rows == N
    assert neighbors._small_sides(c, None, D, fits - 1) is None
    assert neighbors._small_sides(c, pairs, D, fits) is None  # more pairs than fit
    assert neighbors._small_sides(c, pairs, D, 1 << 20)[1].num_rows == len(data[3])


def clustered(spark, n, dim=8):
    """``n`` vectors around n / 500 centres."""
    noise = [((F.rand(i + 1) - 0.5) * 0.05) for i in range(dim)]
    middle = [F.cos(F.pmod(F.xxhash64(F.col("id") % max(1, n // 500), F.lit(i)), F.lit(10_000)) / 10_000 * 3.14159) for i in range(dim)]
    raw = spark.range(n).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("hash"), F.array(*[a + b for a, b in zip(middle, noise)]).alias("v"))
    return raw.select("hash", F.lit("").alias("key"), vectors.normalize(F.col("v").cast("array<float>")).alias("vector"))


def test_leaves_follow_the_table(spark):
    """Leaves grow like the rows and stay small; compared pairs grow at most like the power 1.5."""
    block, leaves, pairs = 128, [], []
    sizes = (10_000, 100_000, 1_000_000)
    for n in sizes:
        depth = math.ceil(math.log2(n / block) / 2)
        rows = materialize(clustered(spark, n)).withColumn("layer", F.lit(depth))
        tree = pivot_tree.PivotTree(rows, None, pivot_tree.choose_pivots(rows, 1 << depth, 8), block, n)
        assert len(tree.pivots) <= 2 * math.sqrt(n / block) + 1
        leaves.append(tree.leaves.count())
        assert tree.leaves.agg(F.sum("n")).first()[0] == n
        asked = tree.seeds().where(F.pmod(F.xxhash64("hash"), F.lit(n // 2_000)) == 0)  # a share of the queries, to be scaled up
        seeds = materialize(pivot_tree.compare([pivot_tree.block_rows(tree.blocks(), 0), pivot_tree.block_rows(asked, 2)], 8, 8))
        tree.seeds = lambda asked=asked: asked
        visits = tree.visits(seeds).groupBy("node", "leaf", "block").agg(F.count("*").alias("v"))
        held = tree.blocks().groupBy("node", "leaf", "block").agg(F.count("*").alias("c"))
        pairs.append((visits.join(held, ["node", "leaf", "block"]).agg(F.sum(F.col("v") * F.col("c"))).first()[0] + 2_000 * block) * (n / asked.count()))
    for i in (0, 1):
        assert 5 < leaves[i + 1] / leaves[i] < 20, leaves
        assert math.log10(pairs[i + 1] / pairs[i]) < 1.5, pairs


def test_a_hub_of_exclusions(spark, monkeypatch):
    """100,000 exclusions of one image, and no array of hashes in the plans of the comparison."""
    n = 3_000
    catalog = clustered(spark, n).withColumn("hist_len", F.lit(1).cast("long"))
    hub = "000000000"
    pairs = spark.range(100_000).select(F.lit(hub).alias("hash"), F.lpad((F.col("id") + 1).cast("string"), 9, "0").alias("peer")).where(F.col("peer") != "000002500")
    plans = []
    compared = pivot_tree.compare

    def watched(*args):
        out = compared(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().schema().simpleString() + out._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(pivot_tree, "compare", watched)
    rows = {r.hash: r.peer for r in neighbors.nearest(materialize(catalog), within="hist_len", exclusions=pairs, block_rows=256, dim=8).collect()}
    assert rows[hub] == "000002500" and len(rows) == n
    assert plans and not any("array<string>" in p or "banned" in p for p in plans)


def test_one_overlong_vector_does_not_set_the_dimension(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [1.0, 0.0, 0.0]), ("d", None)]
    df = spark.createDataFrame(rows, "hash string, vector array<float>")
    assert found(neighbors.nearest(df)) == {"a": (0.2, "b"), "b": (0.2, "a"), "c": (1.0, "a"), "d": (1.0, "a")}


def test_hot_copies_are_limited_before_the_shuffle(spark, data):
    rows = frame(spark, data, range(N)).withColumn("key", F.lit(""))
    plan = neighbors._without_spare_copies(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_salted_layout_join(spark, data, monkeypatch):
    monkeypatch.setattr(neighbors, "MAX_BROADCAST_ROWS", 0)
    got = neighbors.nearest(frame(spark, data, range(N)), within="hist_len", block_rows=150)
    assert found(got) == brute(data, range(N), range(N), True, set())


def test_everything_at_distance_one(spark):
    axes = spark.createDataFrame([(f"n{i:02d}", [float(i == j) for j in range(40)]) for i in range(40)],
                                 "hash string, vector array<float>")
    want = {f"n{i:02d}": (1.0, "n00" if i else "n01") for i in range(40)}
    assert found(neighbors.nearest(axes)) == want
    assert found(neighbors.nearest(axes, block_rows=10)) == want
    blank = axes.withColumn("vector", F.lit(None).cast("array<float>"))
    assert found(neighbors.nearest(blank, block_rows=10)) == want


def test_vectors_that_are_not_finite(spark):
    """They are at distance 1 from everything and take nobody's place, in all forms alike."""
    inf = float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [inf, 0.0]), ("d", [float("nan"), 1.0]), ("e", [0.0, -inf]), ("f", None)]
    df = spark.createDataFrame(rows, "hash string, vector array<float>")
    want = {"a": (0.2, "b"), "b": (0.2, "a"), "c": (1.0, "a"), "d": (1.0, "a"), "e": (1.0, "a"), "f": (1.0, "a")}
    assert found(neighbors.nearest(df)) == want and found(neighbors.nearest(df, block_rows=2)) == want
    for name, (distance, _) in want.items():
        query = df.filter(F.col("hash") == name).select("vector").scalar()
        got = neighbors.closest(df.filter(F.col("hash") != name), query).first()
        assert round(got.distance, 6) == distance


def test_a_block_visited_by_all_is_dealt_over_salts(spark, data, monkeypatch):
    monkeypatch.setattr(pivot_tree, "BLOCKS_PER_SALT", 0.2)
    assert found(neighbors.nearest(frame(spark, data, range(N)), block_rows=64)) == brute(data, range(N), range(N), False, set())


def test_alone_has_no_neighbour(spark):
    lone = spark.createDataFrame([("a", [1.0])], "hash string, vector array<float>")
    assert neighbors.nearest(lone).count() == 0
    assert neighbors.nearest(lone.limit(0)).count() == 0


def test_review_partners_and_single_form_agree(spark, data):
    catalog, seen = frame(spark, data, range(N)), edges(spark, data)
    want = brute(data, range(N), range(N), True, data[3])
    rows = neighbors.review_partners(catalog, seen).collect()
    assert len(rows) == N
    assert {r.hash_x: (r.distance, r.hash_y) for r in rows if r.hash_y} == want
    for i in (0, 60, 41, 40):
        name = data[2][i]
        r = neighbors.partner_of(catalog, seen, name).first()
        assert (r.hash_x, r.distance, r.hash_y) == (name, *want[name])
    assert neighbors.partner_of(catalog, seen, "nobody").count() == 0
    asked = catalog.limit(7).select("hash")
    some = {r.hash_x: (r.distance, r.hash_y) for r in neighbors.review_partners(catalog, seen, asked).collect()}
    assert some == {k: want[k] for k in some} and len(some) == 7


def test_partner_is_in_the_beam(spark, data):
    catalog = frame(spark, data, range(N))
    x = data[2][3]
    beam = {r.hash: r.distance for r in neighbors.beam(
        catalog, catalog.filter(F.col("hash") == x).select("vector").scalar()).collect()}
    partner = neighbors.partner_of(catalog, edges(spark, data), x).first()
    assert len(beam) == N and beam[partner.hash_y] == partner.distance


def test_beam_is_sorted_with_ties_by_hash(spark):
    catalog = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])],
                                    "hash string, vector array<float>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    assert [tuple(r) for r in neighbors.beam(catalog, query).collect()] == [("a", 0.0), ("b", 0.0), ("c", 1.0)]
    assert tuple(neighbors.closest(catalog, query).first()) == ("a", 0.0)
    assert tuple(neighbors.closest(catalog.limit(0), query).first()) == (None, None)


def test_drift(spark):
    old = spark.createDataFrame([("a", "x", 0.1), ("b", "x", 0.2)], "hash string, peer string, distance double")
    new = spark.createDataFrame([("a", "y", 0.10005), ("b", "y", 0.5), ("c", "y", 0.25)],
                                "hash string, peer string, distance double")
    got = {r.hash: r.message for r in neighbors.neighbor_drift(old, new).collect()}
    assert got == {"a": "0.1001", "b": "0.2000 → 0.5000", "c": "1.0000 → 0.2500"}


def test_next_after_delete_may_be_the_survivor(spark):
    catalog = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.8, 0.6]), ("z", [0.0, 1.0])],
                                    "hash string, vector array<float>")
    deleted = catalog.filter("hash = 'x'")
    assert found(neighbors.next_after_delete(catalog, deleted)) == {"x": (0.2, "y")}


def test_without_structure_queries_travel_once_to_a_group(spark, monkeypatch):
    """Random directions, where the bounds prune next to nothing: what is shuffled follows rows times groups, not rows times blocks."""
    def counted(dim):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([""]), pa.array([float(batch.num_rows)])], names=["hash", "peer", "distance"])
        return run

    monkeypatch.setattr(pivot_tree, "_sweep", counted)
    block, dim, rng = 32, 16, np.random.default_rng(2)
    for n in (1_000, 4_000):
        x = rng.normal(size=(n, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        depth = math.ceil(math.log2(n / block) / 2)
        rows = materialize(spark.createDataFrame([(f"{i:05d}", "", v.tolist(), depth) for i, v in enumerate(x)], "hash string, key string, vector array<float>, layer int"))
        tree = pivot_tree.PivotTree(rows, None, pivot_tree.choose_pivots(rows, 1 << depth, dim), block, n)
        seeds = materialize(pivot_tree.compare(tree.seed_parts(None), dim, 8))
        travelled = pivot_tree.search(tree, seeds, None).where("hash = ''").agg(F.sum("distance")).first()[0]
        assert travelled <= n * 2 * (math.sqrt(tree.tasks) + 1)
        assert tree.visits(seeds).count() > n * n / block / 4  # what was listed with vectors before


@pytest.mark.parametrize("group_rows", [10, 60])
def test_many_groups(spark, data, monkeypatch, group_rows):
    monkeypatch.setattr(pivot_tree, "GROUP_BYTES", group_rows * 4 * D)
    pairs = edges(spark, data)
    for keyed in (False, True):
        got = neighbors.nearest(frame(spark, data, range(N)), within="hist_len" if keyed else None, exclusions=pairs, block_rows=20)
        assert found(got) == brute(data, range(N), range(N), keyed, data[3])
    few = neighbors.nearest(frame(spark, data, range(7)), frame(spark, data, range(7, N)), exclusions=pairs, block_rows=20)
    assert found(few) == brute(data, range(7), range(7, N), False, data[3])
