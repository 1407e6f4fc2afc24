"""The review log and its fold into the next catalog snapshot.

Events: (event_id, ts, action, hash_x, hash_y, rotatemode, flipmode) with action ``confirm``, ``delete_left``,
``delete_right`` or ``orient``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefold.functions import vectors
from framefold.functions.hashing import seeded_draw
from framefold.operators import neighbors, sampler, snapshot, stats
from framefold.session import materialize, spread_join

# (hash, rotatemode, flipmode) to (hash, vector) of the turned pixels
Reembed = Callable[[DataFrame], DataFrame]


def confirm_edges(events: DataFrame) -> DataFrame:
    """Both directions of every confirmed pair with the latest time; an image is no peer of itself.

    Each event row is turned into two by explode (one scan, no union of two reads) and repeated pairs are
    combined before the shuffle.  The pair is tested after the explode: pushed below it, the test would compute
    derived hashes a second time.
    """
    confirmed = events.filter(F.col("action") == "confirm")
    both = F.array(F.struct(F.col("hash_x").alias("hash"), F.col("hash_y").alias("peer")),
                   F.struct(F.col("hash_y").alias("hash"), F.col("hash_x").alias("peer")))
    return (confirmed.select("ts", F.explode(both).alias("e")).select("e.hash", "e.peer", "ts")
            .filter(F.col("hash") != F.col("peer"))
            .groupBy("hash", "peer").agg(F.max("ts").alias("ts")))


def fold_confirms(events: DataFrame) -> DataFrame:
    """Per image the last confirm time and the number of distinct peers."""
    return confirm_edges(events).groupBy("hash").agg(F.max("ts").alias("lastview"), F.count("*").alias("hist_len"))


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Set insert, on edges."""
    return edges.select("hash", "peer").unionByName(new.select("hash", "peer")).distinct()


def image_changes(events: DataFrame) -> DataFrame:
    """E1-E3 without the edges, in one scan and one combined aggregate per image.

    ``lastview`` is the last confirm of the image or the last time it survived a deletion, ``deleted_at`` its
    first deletion, ``turned`` the latest orientation.
    """
    action = F.col("action")
    confirmed = (action == "confirm") & (F.col("hash_x") != F.col("hash_y"))

    def side(hash_: str, viewed, deleted, turned) -> Column:
        return F.struct(F.col(hash_).alias("hash"), viewed.alias("viewed"), deleted.alias("deleted"),
                        turned.alias("turned"))

    left = side("hash_x", confirmed | (action == "delete_right"), action == "delete_left", action == "orient")
    right = side("hash_y", confirmed | (action == "delete_left"), action == "delete_right", F.lit(False))
    sides = (events.select("ts", "event_id", "rotatemode", "flipmode", F.explode(F.array(left, right)).alias("s"))
             .select("ts", "event_id", "rotatemode", "flipmode", "s.*")
             .filter(F.col("viewed") | F.col("deleted") | F.col("turned")))
    return sides.groupBy("hash").agg(
        F.max(F.when(F.col("viewed"), F.col("ts"))).alias("lastview"),
        F.min(F.when(F.col("deleted"), F.col("ts"))).alias("deleted_at"),
        F.max(F.when(F.col("turned"), F.struct("ts", "event_id", "rotatemode", "flipmode"))).alias("turned"))


def tombstones(events: DataFrame) -> DataFrame:
    """Deleted hashes with the time of their first deletion."""
    deletions = events.filter(F.col("action").isin("delete_left", "delete_right"))
    return image_changes(deletions).filter(F.col("deleted_at").isNotNull()).select("hash", "deleted_at")


def survivor_views(events: DataFrame) -> DataFrame:
    """The side that stayed was viewed; no history edge comes from a deletion."""
    deletions = events.filter(F.col("action").isin("delete_left", "delete_right"))
    return image_changes(deletions).filter(F.col("lastview").isNotNull()).select("hash", "lastview")


def orientations(events: DataFrame) -> DataFrame:
    """The latest orientation per image."""
    return (image_changes(events.filter(F.col("action") == "orient"))
            .select("hash", "turned.rotatemode", "turned.flipmode"))


def next_catalog(catalog: DataFrame, merged: DataFrame, events: DataFrame, reembed: Reembed | None = None) -> DataFrame:
    """E6, rows: deleted images leave; the rest gets view times, orientations and recounted history sizes.

    ``merged`` has the old and new edges.  With ``reembed`` a turned image gets the vector of its turned pixels (M5).
    """
    changes = image_changes(events)
    sizes = merged.groupBy("hash").agg(F.count("*").alias("_size"))
    joined = (catalog.withColumnRenamed("lastview", "_seen")
              .withColumnRenamed("rotatemode", "_rotate").withColumnRenamed("flipmode", "_flip")
              .join(changes, "hash", "left").filter(F.col("deleted_at").isNull())
              .join(sizes, "hash", "left"))
    out = (joined.withColumn("lastview", F.greatest("lastview", "_seen"))
           .withColumn("rotatemode", F.coalesce("turned.rotatemode", "_rotate"))
           .withColumn("flipmode", F.coalesce("turned.flipmode", "_flip"))
           .withColumn("hist_len", F.coalesce("_size", "hist_len")))
    if reembed is None:
        return out.select(*catalog.columns)
    moved = ~(F.col("rotatemode").eqNullSafe(F.col("_rotate")) & F.col("flipmode").eqNullSafe(F.col("_flip")))
    turned = materialize(out.filter(moved).select("hash", "rotatemode", "flipmode"))
    fresh = reembed(turned).select("hash", F.col("vector").alias("_fresh"))
    return out.join(fresh, "hash", "left").withColumn("vector", F.coalesce("_fresh", "vector")).select(*catalog.columns)


def next_edges(catalog: DataFrame, merged: DataFrame, events: DataFrame) -> DataFrame:
    """E6, history: old and new edges of the images that stay.

    A deleted image takes its own edges along; edges that point to it stay, and V3 reports them.
    """
    staying = catalog.select("hash").join(tombstones(events), "hash", "left_anti")
    return spread_join(merged, staying, "hash", "peer", "left_semi")


def apply_events(catalog: DataFrame, edges: DataFrame, events: DataFrame, reembed: Reembed | None = None) -> tuple[DataFrame, DataFrame]:
    """Catalog + events -> next (catalog, edges).  Edges are merged once, for both.

    Applying the same batch again changes nothing; batches are applied in order of time.
    """
    merged = materialize(merge_edges(edges, confirm_edges(events)))
    return next_catalog(catalog, merged, events, reembed), next_edges(catalog, merged, events)


def review_step(catalog: DataFrame, edges: DataFrame, readable: DataFrame, seed: str, max_images: int,
                now: str) -> tuple[DataFrame, DataFrame]:
    """E5: one step for the drawn image: (hash_x, hash_y, distance, status), and the tombstone list.

    Of the strata's picks the first in draw order that has a partner is shown; if none has, the first keeps NULL.  The
    partners of all picks come from one pass.
    Rows whose payload cannot be read are listed for deletion and neither drawn nor offered; nothing is deleted
    here.  Rows without a usable vector (``snapshot`` and J9 fill them in) are neither drawn nor offered either.
    """
    lost = catalog.select("hash").join(readable.select("hash"), "hash", "left_anti")
    seen = catalog.filter(~vectors.needs_vector(F.col("vector"), F.size("vector")))
    usable = materialize(seen.join(readable.select("hash"), "hash", "left_semi"))
    heads = sampler.stratum_picks(sampler.oldest_tenth(usable), seed)
    partners = neighbors.head_partners(usable, edges, heads)
    turn = F.struct(F.col("hash_y").isNull(), seeded_draw(F.col("hash_x"), seed, "outer"), "hash_x", "hash_y", "distance")
    chosen = partners.agg(F.min(turn).alias("first")).filter(F.col("first").isNotNull()).select("first.hash_x", "first.hash_y", "first.distance")
    step = stats.status(usable, max_images, now, chosen.withColumnRenamed("hash_x", "hash"))
    return step.withColumnRenamed("hash", "hash_x"), lost


def partners_after_delete(catalog: DataFrame, edges: DataFrame, deleted: DataFrame, block_rows: int | None = None,
                          dim: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """E4 after deletions: the neighbour of each deleted image becomes X and gets its own partner."""
    nearest = materialize(neighbors.next_after_delete(catalog, deleted, block_rows, dim, broadcast_bytes))
    chosen = nearest.select(F.col("hash").alias("deleted"), F.col("peer").alias("hash_x"))
    survivors = snapshot.delete_rows(catalog, deleted)
    partner = neighbors.review_partners(survivors, edges, chosen.select(F.col("hash_x").alias("hash")), block_rows, dim, broadcast_bytes)
    return spread_join(chosen, partner, "hash_x", "deleted")
