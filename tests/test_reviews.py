import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framefold import schemas
from framefold.operators import chunkstore, quality, reviews, snapshot
from framefold.sources import catalog as source
from framefold.sources import snapshots
from framefold.streaming import microbatch
from tests.test_functions import python_hash

START = datetime(2024, 1, 1)
NAMES = [f"{i:016d}" for i in range(30)]


def make_catalog(spark):
    rows = [(h, 0, 0, START, 0, [1.0, float(i)]) for i, h in enumerate(NAMES)]
    return spark.createDataFrame(rows, schemas.CATALOG)


def make_events(seed, n, hub=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (NAMES[0] if hub and rng.random() < 0.4 else rng.choice(NAMES)), rng.choice(NAMES)
        action = rng.choices(["confirm", "delete_left", "delete_right", "orient"], [20, 0.3, 0.3, 4])[0]
        if action != "confirm" and NAMES[0] in (x, y):
            action = "confirm"
        rows.append((i, START + timedelta(minutes=rng.randrange(1, 5000)), action, x, y, rng.choice([0, 90, 180, 270]),
                     rng.choice([0, 1, 2])))
    return rows


def simulate(rows):
    """Event by event over plain dictionaries."""
    last = {h: START for h in NAMES}
    modes = {h: (0, 0) for h in NAMES}
    peers = {h: set() for h in NAMES}
    gone = set()
    for event_id, ts, action, x, y, rot, flip in sorted(rows, key=lambda r: (r[1], r[0])):
        if action == "confirm" and x != y:
            last[x] = last[y] = ts
            peers[x].add(y)
            peers[y].add(x)
        elif action == "orient":
            modes[x] = (rot, flip)
        elif action in ("delete_left", "delete_right"):
            dead, kept = (x, y) if action == "delete_left" else (y, x)
            gone.add(dead)
            last[kept] = ts
    alive = [h for h in NAMES if h not in gone]
    return ({(h, *modes[h], last[h], len(peers[h])) for h in alive}, {(h, p) for h in alive for p in peers[h]})


def state(catalog, edges):
    return ({tuple(r) for r in catalog.select("hash", "rotatemode", "flipmode", "lastview", "hist_len").collect()},
            {tuple(r) for r in edges.select("hash", "peer").collect()})


@pytest.mark.parametrize("hub", [False, True])
def test_fold_equals_event_by_event(spark, hub):
    rows = make_events(5, 300, hub)
    events = spark.createDataFrame(rows, schemas.REVIEWS)
    edges = spark.createDataFrame([], schemas.EDGES)
    catalog, edges = reviews.apply_events(make_catalog(spark), edges, events)
    assert state(catalog, edges) == simulate(rows)
    again = reviews.apply_events(catalog, edges, events)
    assert state(*again) == state(catalog, edges)


def test_two_batches_equal_one(spark):
    rows = sorted(make_events(6, 200), key=lambda r: (r[1], r[0]))
    rows = [r for r in rows if not r[2].startswith("delete")]
    edges = spark.createDataFrame([], schemas.EDGES)
    state_ = (make_catalog(spark), edges)
    for part in (rows[:120], rows[120:]):
        state_ = reviews.apply_events(*state_, spark.createDataFrame(part, schemas.REVIEWS))
    assert state(*state_) == simulate(rows)


def test_history_text_and_stored_rows(spark):
    rows = make_events(7, 200)
    edges = reviews.confirm_edges(spark.createDataFrame(rows, schemas.REVIEWS))
    peers = {}
    for h, p in {(r.hash, r.peer) for r in edges.collect()}:
        peers.setdefault(h, []).append(p)
    got = {r["hash"]: r.history for r in source.history_text(edges).collect()}
    assert got == {h: "".join(sorted(p)) for h, p in peers.items()}
    catalog = make_catalog(spark)
    stored = source.to_stored_rows(catalog, edges)
    back, back_edges = source.from_stored_rows(stored)
    assert {(r["hash"], tuple(r.vector), r.lastview) for r in back.collect()} == {
        (r["hash"], tuple(r.vector), r.lastview) for r in catalog.collect()}
    assert state(back, back_edges)[1] == {(h, p) for h in peers for p in peers[h]}


def test_snapshot_joins(spark):
    catalog = make_catalog(spark)
    one = catalog.filter(F.col("hash") == NAMES[0])
    new = one.withColumn("hash", F.lit("n" * 16)).withColumn("flipmode", F.lit(2))
    grown = snapshot.insert_rows(catalog, new.unionByName(new).unionByName(one.withColumn("flipmode", F.lit(1))))
    assert grown.count() == 31 and grown.filter("flipmode = 1").count() == 0
    updates = spark.createDataFrame([(NAMES[1], 90, None), ("unknown", 180, 1)], "hash string, rotatemode int, flipmode int")
    changed = snapshot.update_rows(catalog, updates)
    assert changed.filter("rotatemode = 90 and flipmode = 0").count() == 1 and changed.count() == 30
    with pytest.raises(ValueError):
        snapshot.update_rows(catalog, updates.withColumnRenamed("flipmode", "hash; drop"))
    assert snapshot.delete_rows(catalog, updates).count() == 29


def test_quality_reports(spark):
    a, b, c = "a" * 16, "b" * 16, "c" * 16
    edges = spark.createDataFrame([(a, b), (b, a), (a, c), (a, "d" * 16)], schemas.EDGES)
    catalog = spark.createDataFrame([(a, [1.0, 2.0]), (b, [1.0]), (c, None)], "hash string, vector array<float>")
    assert {tuple(r) for r in quality.dangling_edges(edges, catalog).collect()} == {(a, "d" * 16)}
    assert {tuple(r) for r in quality.one_sided_edges(edges).collect()} == {(a, c), (a, "d" * 16)}
    assert {tuple(r) for r in quality.bad_vectors(catalog, 2).collect()} == {(b, 1), (c, 0)}
    texts = spark.createDataFrame([(a, a + b), (b, a + "b"), (c, "o" * 16), ("n", "a" * 15 + "\n"), ("e", "")],
                                  "hash string, history string")
    assert {tuple(r) for r in quality.bad_history(texts).collect()} == {(b, 17, True), (c, 16, False), ("n", 16, False)}
    assert quality.capacity(catalog, 5).first()["over"] is False
    assert quality.capacity(catalog, -9998).first()["over"] is True
    other = spark.createDataFrame([(b,), ("x" * 16,)], "hash string")
    got = {r.side: (r.missing, r.sample) for r in quality.reconcile(catalog, other, sample=1).collect()}
    assert got == {"left": (2, a), "right": (1, "x" * 16)}
    same = {r.side: (r.missing, r.sample) for r in quality.reconcile(catalog, catalog).collect()}
    assert same == {"left": (0, ""), "right": (0, "")}


def test_review_step(spark):
    rows = [(h, 0, 0, START + timedelta(minutes=i), 0, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i, h in enumerate(NAMES)]
    catalog = spark.createDataFrame(rows, schemas.CATALOG)
    edges = spark.createDataFrame([(NAMES[1], NAMES[3])], schemas.EDGES)
    readable = catalog.filter(F.col("hash") != NAMES[0])
    step, lost = reviews.review_step(catalog, edges, readable, "s", 20, "2024-01-02 00:00:00")
    assert [r["hash"] for r in lost.collect()] == [NAMES[0]]
    row = step.collect()
    assert len(row) == 1 and row[0].hash_x in (NAMES[1], NAMES[2])
    assert row[0].hash_y == (NAMES[5] if row[0].hash_x == NAMES[1] else NAMES[4]) and row[0].distance == 0.0
    assert row[0].status == "29/29 (9) [24 hours ago] 0.0000"
    nothing, _ = reviews.review_step(catalog.limit(5), edges, readable, "s", 20, "2024-01-02 00:00:00")
    assert nothing.count() == 0


def test_streamed_fold_equals_batch_fold(spark, tmp_path):
    rows = [r for r in make_events(8, 120) if not r[2].startswith("delete")]
    root, inbox = str(tmp_path / "snap"), tmp_path / "in"
    snapshots.write_version(make_catalog(spark), spark.createDataFrame([], schemas.EDGES), root, 0)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for part in (ordered[:60], ordered[60:]):
        spark.createDataFrame(part, schemas.REVIEWS).coalesce(1).write.mode("append").parquet(str(inbox))
    stream = spark.readStream.schema(schemas.REVIEWS).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    fold = microbatch.fold_reviews(root)
    done = stream.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True).start()
    done.awaitTermination(120)
    assert done.exception() is None
    assert state(*snapshots.read_version(spark, root, 2)) == simulate(rows)
    fold(spark.createDataFrame(ordered[60:], schemas.REVIEWS), 1)
    assert state(*snapshots.read_version(spark, root, 2)) == simulate(rows)


def test_a_small_batch_rewrites_its_buckets_alone(spark, tmp_path):
    """Reviews of images in 1 % of the buckets: 1 % of the buckets get new files, and the rest is taken over by name."""
    letters = "0123456789abcdefghijkmnpqrstuvxz"
    names = [a + b + f"{i:014d}" for a in letters for b in letters[:16] for i in range(2)]  # 512 buckets
    catalog = spark.createDataFrame([(h, 0, 0, START, int(h != names[0]), [1.0]) for h in names], schemas.CATALOG)
    root = str(tmp_path / "snap")
    edges = spark.createDataFrame([(h, names[0]) for h in names[1:]], schemas.EDGES)
    snapshots.write_version(catalog, edges, root, 0)
    touched = [names[0], names[2], names[4], names[6], names[8]]
    at = START + timedelta(hours=1)
    events = [(0, at, "confirm", touched[0], touched[1], 0, 0), (1, at, "delete_left", touched[2], touched[3], 0, 0),
              (2, at, "orient", touched[4], None, 90, 1)]
    events.append((3, at, "delete_right", names[9], names[8], 0, 0))  # empties no bucket: names[9] stays in it
    events = spark.createDataFrame(events, schemas.REVIEWS)
    calls = []
    fold = microbatch.fold_reviews(root, recycle=lambda gone: calls.append({r["hash"] for r in gone.collect()}))
    for _ in range(2):
        fold(events, 0)
    assert calls == [{touched[2], names[8]}] * 2
    written = {p.name for p in (tmp_path / "snap" / "v00000001" / "catalog").iterdir() if p.name.startswith("bucket=")}
    assert written == {f"bucket={h[:2]}" for h in touched} and len(written) * 100 < 512
    assert state(*snapshots.read_version(spark, root, 1)) == state(*reviews.apply_events(catalog, edges, events))
    some, _ = snapshots.read_version(spark, root, 1, {touched[0][:2]})
    assert {r["hash"] for r in some.select("hash").collect()} == {h for h in names if h[:2] == touched[0][:2]}
    both = [(4, at, "delete_left", names[0], names[1], 0, 0), (5, at, "delete_left", names[1], names[2], 0, 0)]
    microbatch.fold_reviews(root)(spark.createDataFrame(both, schemas.REVIEWS), 1)
    left, left_edges = snapshots.read_version(spark, root, 2)
    assert left.filter(F.col("hash").startswith(names[0][:2])).count() == 0  # an emptied bucket is gone
    assert left.count() == len(names) - 4 and left_edges.filter(F.col("hash") == names[1]).count() == 0


def test_deleted_images_are_recycled_and_turned_ones_embedded_again(spark, tmp_path):
    bodies = [b"body number %d, long enough" % i for i in range(3)]
    names = [python_hash(b) for b in bodies]
    chunks = chunkstore.encrypt_chunks(spark.createDataFrame([(h, bytearray(b)) for h, b in zip(names, bodies)], "hash string, content binary"))
    root = str(tmp_path / "snap")
    snapshots.write_version(spark.createDataFrame([(h, 0, 0, START, 0, [1.0]) for h in names], schemas.CATALOG), spark.createDataFrame([], schemas.EDGES), root, 0)
    at = datetime(2024, 5, 6, 7, 8, 9)
    events = spark.createDataFrame([(0, at, "delete_left", names[0], names[1], 0, 0), (1, at, "orient", names[2], None, 90, 0),
                                    (2, at, "orient", names[1], None, 0, 0)], schemas.REVIEWS)
    asked = []

    def reembed(turned):
        asked.extend(tuple(r) for r in turned.collect())
        return turned.select("hash", F.array(F.lit(9.0).cast("float")).alias("vector"))

    microbatch.fold_reviews(root, reembed, microbatch.recycle_into(lambda s: chunks, str(tmp_path / "gone")))(events, 0)
    assert asked == [(names[2], 90, 0)]  # names[1] was turned to what it is
    rows = {r["hash"]: (r.rotatemode, r.vector) for r in snapshots.read_version(spark, root, 1)[0].collect()}
    assert rows == {names[1]: (0, [1.0]), names[2]: (90, [9.0])}
    kept = spark.read.parquet(str(tmp_path / "gone")).collect()
    assert [(r.name, bytes(r.content)) for r in kept] == [(f"2024-05-06/070809.{names[0]}.xxx", bodies[0])]


def test_review_step_tries_the_next_stratum(spark):
    """An image alone in its stratum is passed over; one without a vector is neither drawn nor offered."""
    now = datetime(2024, 1, 1)
    rows = [("alone", 0, 0, now, 7, [1.0, 0.0]), ("blank", 0, 0, now, 1, None)]
    rows += [(f"h{i:02d}", 0, 0, now + timedelta(days=1 + i), 1, [1.0, 0.0]) for i in range(38)]
    catalog = spark.createDataFrame(rows, "hash string, rotatemode int, flipmode int, lastview timestamp_ntz, hist_len long, vector array<float>")
    none = spark.createDataFrame([], "hash string, peer string")
    for seed in ("a", "b", "c", "d"):
        row = reviews.review_step(catalog, none, catalog.select("hash"), seed, 1000, "2024-06-01 00:00:00")[0].first()
        assert row.hash_x.startswith("h") and row.hash_y.startswith("h") and row.distance == 0
    lonely = catalog.filter("hash = 'alone'").unionByName(catalog.filter("hist_len = 1").limit(9).withColumn("vector", F.lit(None).cast("array<float>")))
    empty = reviews.review_step(lonely, none, lonely.select("hash"), "a", 1000, "2024-06-01 00:00:00")[0]
    assert all(r.hash_y is None for r in empty.collect())


def test_a_streamed_import_decides_every_file(spark, tmp_path):
    """150 files in one batch: 150 outcomes, and the same again when the batch is repeated."""
    root = str(tmp_path / "import")
    catalog = spark.createDataFrame([("0" * 16, 0, 0, datetime(2024, 1, 1), 0, [1.0])], schemas.CATALOG)
    snapshots.write_version(catalog, spark.createDataFrame([], schemas.EDGES), root, 0)
    bodies = [b"payload number %04d" % i for i in range(150)]
    files = [(f"raw/{i}", i, f"f{i}", bytearray(b), True) for i, b in enumerate(bodies)]
    batch = spark.createDataFrame(files, "path string, scan int, stem string, payload binary, decodable boolean")
    status = lambda s: s.createDataFrame([], "hash string, chunk_ok boolean")
    step = microbatch.import_batches(root, status, 500, lambda df: df)
    for _ in range(2):
        step(batch, 0)
        path = snapshots.version_path(root, 1)
        rows = snapshots.read_version(spark, root, 1)[0].collect()
        assert {r["hash"] for r in rows} == {"0" * 16, *map(python_hash, bodies)} and len(rows) == 151
        assert len({r.lastview for r in rows if r["hash"] != "0" * 16}) == 150
        assert {r.outcome for r in spark.read.parquet(f"{path}/log").collect()} == {"added"}
        assert spark.read.parquet(f"{path}/summary").first().added == 150
        assert {bytes(r.content) for r in chunkstore.decrypt_chunks(spark.read.parquet(f"{path}/chunks")).collect()} == set(bodies)
        assert spark.read.parquet(f"{path}/commit").count() == 1
