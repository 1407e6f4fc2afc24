"""Counts and summaries of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold import schemas
from framefold.functions import text


def row_count(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("images"))


def oldest_view(catalog: DataFrame) -> DataFrame:
    """A2: oldest view time; an empty catalog gives 1980-01-01."""
    default = F.lit(schemas.DEFAULT_LAST_VIEW).cast("timestamp_ntz")
    return catalog.agg(F.coalesce(F.min("lastview"), default).alias("lastview"))


def oldest_view_before(catalog: DataFrame) -> DataFrame:
    """A2, older form: one second before the oldest view."""
    default = F.lit(schemas.DEFAULT_LAST_VIEW).cast("timestamp_ntz")
    second = F.expr("interval '1' second")
    return catalog.agg(F.coalesce(F.min("lastview") - second, default).alias("lastview"))


def min_history(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.min("hist_len").alias("min_history"))


def min_history_count(catalog: DataFrame) -> DataFrame:
    """A4 in one pass: counts per history size are small, the smallest size is picked from them."""
    sizes = catalog.groupBy("hist_len").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.min_by("n", "hist_len"), F.lit(0)).alias("images"))


def overview(catalog: DataFrame) -> DataFrame:
    """A1, A2, A3 and A4 from one scan, one row."""
    sizes = catalog.groupBy("hist_len").agg(F.count("*").alias("n"), F.min("lastview").alias("oldest"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("images"),
        F.min("oldest").alias("lastview"),
        F.min("hist_len").alias("min_history"),
        F.coalesce(F.min_by("n", "hist_len"), F.lit(0)).alias("min_history_images"),
    )


def status(catalog: DataFrame, max_images: int, now: str, picks: DataFrame | None = None) -> DataFrame:
    """A8: "min-history count/total (total - budget) [age ago] distance".

    ``picks`` has (hash, distance, ...) of the images on show; each row gets its line with age and distance.
    Without it the line has only the counts.  The totals are scalar subqueries over a single summary row.
    """
    summary = overview(catalog).select("images", "min_history_images")
    counts = F.format_string("%d/%d (%d)", F.col("least"), F.col("total"), F.col("total") - F.lit(max_images))
    if picks is None:
        return (summary.select(F.col("images").alias("total"), F.col("min_history_images").alias("least"))
                .select(counts.alias("status")))
    shown = picks.join(catalog.select("hash", "lastview"), "hash")
    gap = F.expr(f"timestamp_ntz'{now}'") - F.col("lastview")
    seconds = sum((F.extract(F.lit(unit), gap).cast("double") * length
                   for unit, length in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))), F.lit(0.0))
    return (shown
            .withColumn("total", summary.select("images").scalar())
            .withColumn("least", summary.select("min_history_images").scalar())
            .select(*picks.columns, F.concat(counts, F.lit(" ["), text.age_text(seconds), F.lit(" ago]"),
                                     F.when(F.col("distance").isNotNull(), F.format_string(" %.4f", "distance"))
                                     .otherwise(F.lit(""))).alias("status")))


def outcome_counts(log: DataFrame) -> DataFrame:
    """A5: added / found / bad, zero when absent."""
    return log.agg(*[F.count_if(F.col("outcome") == name).alias(name) for name in ("added", "found", "bad")])


def distance_summary(distances: DataFrame) -> DataFrame:
    """Min / max / avg over the compared rows; a NULL distance counts as skipped."""
    return distances.agg(
        F.round(F.min("distance"), 6).alias("min_distance"),
        F.round(F.max("distance"), 6).alias("max_distance"),
        F.round(F.avg("distance"), 6).alias("avg_distance"),
        F.count("distance").alias("compared"),
        F.count_if(F.col("distance").isNull()).alias("skipped"),
    )


def separation(distances: DataFrame) -> DataFrame:
    """Per setting the mean distance of same and of other images, and how far they are apart."""
    similar = F.avg(F.when(F.col("same"), F.col("distance")))
    other = F.avg(F.when(~F.col("same"), F.col("distance")))
    return distances.groupBy("setting").agg(
        F.round(similar, 4).alias("sim_avg"),
        F.round(other, 4).alias("nosim_avg"),
        F.round(other - similar, 4).alias("separation"),
    )
