"""Which image to look at next.

Random order is the order of md5(hash, seed, tag), so a draw can be repeated and checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefold.functions import clock
from framefold.functions.hashing import seeded_draw
from framefold.operators import neighbors

BUCKETS = 1 << 16  # counters that reach the driver in one pass


def rank_cutoff(catalog: DataFrame, k: Callable[[int], int]) -> tuple[int, str] | None:
    """(lastview micros, hash) of row number ``k(rows)`` in (lastview, hash) order, without sorting the table.

    Each pass counts rows in BUCKETS parts of the range that still holds row k, so the driver sees at most as many
    counters; the range narrows by that factor per pass, down to one row or one instant.  Inside one instant the search
    goes on over hash prefixes.
    """
    micros = clock.micros_of(F.col("lastview"))
    low, high, size, total = catalog.agg(F.min(micros), F.max(micros), F.count("lastview"), F.count("*")).first()
    left, prefix = k(total), ""
    if left < 1 or size < left:
        return None
    while True:
        here = (catalog.filter(F.col("lastview").between(clock.ts_of_micros(F.lit(low)), clock.ts_of_micros(F.lit(high))))
                .select(micros.alias("t"), "hash"))
        if prefix:
            here = here.filter(F.col("hash").startswith(prefix))
        if size == 1:
            row = here.first()
            return row["t"], row["hash"]
        if low < high:
            width = (high - low) // BUCKETS + 1
            bucket: Column = F.call_function("div", F.col("t") - F.lit(low), F.lit(width))
        else:
            bucket = F.substring("hash", 1, len(prefix) + 2)
        counts = sorted((r[0], r[1]) for r in here.groupBy(bucket.alias("b")).count().collect())
        for value, size in counts:
            if left <= size:
                break
            left -= size
        if low < high:
            low, high = low + value * width, min(high, low + (value + 1) * width - 1)
        elif value == prefix:
            return low, value
        else:
            prefix = value


def oldest_tenth(catalog: DataFrame) -> DataFrame:
    """The count // 10 rows seen longest ago (none below 10 rows); ties by hash.  A filter, not a sort."""
    cut = rank_cutoff(catalog, lambda rows: rows // 10)
    if cut is None:
        return catalog.limit(0)
    at = clock.ts_of_micros(F.lit(cut[0]))
    return catalog.filter((F.col("lastview") < at) | ((F.col("lastview") == at) & (F.col("hash") <= cut[1])))


def stratum_picks(rows: DataFrame, seed: str) -> DataFrame:
    """One random row per history size.  An argmin aggregate, so a hot stratum is combined before the shuffle."""
    draw = F.struct(seeded_draw(F.col("hash"), seed).alias("draw"), "hash")
    return rows.groupBy("hist_len").agg(F.min(draw).alias("pick")).select("hist_len", F.col("pick.hash").alias("hash"))


def queue_head(catalog: DataFrame, seed: str) -> DataFrame:
    """One of the stratum picks of the oldest tenth; uniform over strata, not over rows."""
    picks = stratum_picks(oldest_tenth(catalog), seed)
    draw = F.struct(seeded_draw(F.col("hash"), seed, "outer").alias("draw"), "hash")
    return (picks.agg(F.min(draw).alias("pick")).filter(F.col("pick").isNotNull())
            .select(F.col("pick.hash").alias("hash")))


def stalest_checked(checks: DataFrame) -> DataFrame:
    """T4: smallest ``lastcheck``."""
    return checks.select("hash", "lastcheck").orderBy("lastcheck", "hash").limit(1)


def least_scored(catalog: DataFrame) -> DataFrame:
    """T5: lowest score (history size), then oldest view."""
    return catalog.select("hash", F.col("hist_len").alias("score"), "lastview").orderBy(
        "score", "lastview", "hash").limit(1)


def closest_pair(distances: DataFrame) -> DataFrame:
    """The image with the globally smallest stored distance."""
    return distances.select("hash", "distance").orderBy("distance", "hash").limit(1)


def mixed_pick(catalog: DataFrame, distances: DataFrame, seed: str) -> DataFrame:
    """80 % T5, 20 % T6.  The draw is a column of the seed, so both branches stay declarative."""
    draw = F.pmod(F.conv(F.substring(F.md5(F.lit(seed)), 1, 8), 16, 10).cast("long"), F.lit(100))
    scored = least_scored(catalog).select(draw.alias("draw"), "hash").filter("draw < 80")
    paired = closest_pair(distances).select(draw.alias("draw"), "hash").filter("draw >= 80")
    return scored.unionByName(paired)


def next_x(catalog: DataFrame, seed: str, same: str | None = None, deleted: DataFrame | None = None,
           block_rows: int | None = None, dim: int | None = None) -> DataFrame:
    """The same image again, the neighbour of what was deleted, or a fresh draw."""
    if same is not None:
        return catalog.filter(F.col("hash") == same).select("hash")
    if deleted is not None:
        return neighbors.next_after_delete(catalog, deleted, block_rows, dim).select(F.col("peer").alias("hash")).distinct()
    return queue_head(catalog, seed)
