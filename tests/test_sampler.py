import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framefold.operators import sampler, stats

START = datetime(2024, 1, 1)


def catalog(spark, rows):
    return spark.createDataFrame(rows, "hash string, lastview timestamp_ntz, hist_len long")


def make(n, spread, seed=3):
    rng = random.Random(seed)
    return [(hashlib.md5(str(i).encode()).hexdigest()[:16], START + timedelta(seconds=rng.randrange(spread)),
             rng.choice([0, 0, 0, 1, 2, 5])) for i in range(n)]


@pytest.mark.parametrize("n,spread", [(1000, 10 ** 7), (1000, 3), (1000, 1), (95, 50)])
def test_oldest_tenth_is_exact(spark, n, spread):
    rows = make(n, spread)
    want = {h for h, *_ in sorted(rows, key=lambda r: (r[1], r[0]))[: n // 10]}
    got = [r.hash for r in sampler.oldest_tenth(catalog(spark, rows)).collect()]
    assert len(got) == n // 10 and set(got) == want


def test_under_ten_rows_gives_none(spark):
    nine = catalog(spark, make(9, 100))
    assert sampler.oldest_tenth(nine).count() == 0
    assert sampler.queue_head(nine, "s").count() == 0
    assert sampler.oldest_tenth(nine.limit(0)).count() == 0


def draw(h, tag=""):
    return hashlib.md5(f"{h}seed{tag}".encode()).hexdigest()


def test_picks_and_head(spark):
    rows = make(600, 1000)
    df = catalog(spark, rows)
    oldest = sorted(rows, key=lambda r: (r[1], r[0]))[:60]
    picks = {}
    for h, _, size in oldest:
        if size not in picks or draw(h) < draw(picks[size]):
            picks[size] = h
    got = {r.hist_len: r.hash for r in sampler.stratum_picks(sampler.oldest_tenth(df), "seed").collect()}
    assert got == picks
    assert sampler.queue_head(df, "seed").first()["hash"] == min(picks.values(), key=lambda h: draw(h, "outer"))


def test_legacy_policies(spark):
    rows = make(100, 1000)
    df = catalog(spark, rows)
    assert sampler.least_scored(df).first()["hash"] == min(rows, key=lambda r: (r[2], r[1], r[0]))[0]
    distances = spark.createDataFrame([(r[0], 0.5 - i / 1000) for i, r in enumerate(rows)], "hash string, distance double")
    assert sampler.closest_pair(distances).first()["hash"] == rows[-1][0]
    checks = df.withColumnRenamed("lastview", "lastcheck")
    assert sampler.stalest_checked(checks).first()["hash"] == min(rows, key=lambda r: (r[1], r[0]))[0]
    seen = {80: 0, 100: 0}
    for i in range(6):
        r = sampler.mixed_pick(df, distances, f"s{i}").collect()
        assert len(r) == 1
        limit = int(hashlib.md5(f"s{i}".encode()).hexdigest()[:8], 16) % 100
        assert r[0]["draw"] == limit
        want = sampler.least_scored(df) if limit < 80 else sampler.closest_pair(distances)
        assert r[0]["hash"] == want.first()["hash"]
        seen[80 if limit < 80 else 100] += 1


def test_counts_on_an_empty_catalog(spark):
    empty = catalog(spark, make(1, 1)).limit(0)
    assert str(stats.oldest_view(empty).first()[0]) == "1980-01-01 00:00:00"
    assert str(stats.oldest_view_before(empty).first()[0]) == "1980-01-01 00:00:00"
    assert stats.min_history(empty).first()[0] is None
    assert stats.min_history_count(empty).first()[0] == 0
    assert stats.row_count(empty).first()[0] == 0
    assert stats.status(empty, 5, "2024-01-01 00:00:00").first()[0] == "0/0 (-5)"


def test_status_line(spark):
    df = catalog(spark, [("a", START, 0), ("b", START, 0), ("c", START, 2)])
    assert stats.status(df, 5, "2024-01-03 12:00:00").first()[0] == "2/3 (-2)"
    picks = spark.createDataFrame([("c", 0.25), ("a", None)], "hash string, distance double")
    lines = {r.hash: r.status for r in stats.status(df, 1, "2024-01-03 12:00:00", picks).collect()}
    assert lines == {"c": "2/3 (2) [3 days ago] 0.2500", "a": "2/3 (2) [3 days ago]"}


def test_summaries(spark):
    d = spark.createDataFrame([("s", True, 0.1), ("s", True, 0.3), ("s", False, 0.9), ("t", False, None)],
                              "setting string, same boolean, distance double")
    assert tuple(stats.distance_summary(d).first()) == (0.1, 0.9, 0.433333, 3, 1)
    got = {r.setting: (r.sim_avg, r.nosim_avg, r.separation) for r in stats.separation(d).collect()}
    assert got == {"s": (0.2, 0.9, 0.7), "t": (None, None, None)}
    log = spark.createDataFrame([("added",), ("found",), ("found",)], "outcome string")
    assert tuple(stats.outcome_counts(log).first()) == (1, 2, 0)
