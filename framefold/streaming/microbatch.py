"""Micro-batch wrappers: the batch operators called from Structured Streaming's foreachBatch.

Every batch reads version ``batch_id`` of a snapshot directory and writes version ``batch_id + 1`` (``snapshots``).  The
version read is never changed, so a repeated batch overwrites its target with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.operators import chunkstore, ingest, reviews
from framefold.sources import snapshots


def fold_reviews(root: str, reembed: reviews.Reembed | None = None,
                 recycle: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a batch of review events becomes the next snapshot.

    Only the buckets of images that the batch names are read and written.  ``reembed`` gives turned images their new
    vector (E3); ``recycle`` gets (hash, deleted_at) of deleted images once the version is complete (``soft_delete``).
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            touched = snapshots.touched_buckets(batch)
            catalog, edges = snapshots.read_version(batch.sparkSession, root, batch_id, touched)
            snapshots.write_version(*reviews.apply_events(catalog, edges, batch, reembed), root, batch_id + 1, touched=touched)
            if recycle is not None:
                recycle(reviews.tombstones(batch))
        finally:
            batch.unpersist()

    return run


def import_batches(root: str, chunk_status: Callable[[SparkSession], DataFrame], max_images: int,
                   prepare: Callable[[DataFrame], DataFrame], embed: ingest.Embed | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a batch of files is imported (I2); known content is found again, so replays are safe.

    ``prepare`` adds stem, payload and decodable (S5, M1); ``chunk_status`` gives (hash, chunk_ok); ``embed`` makes vectors
    from (hash, content).  Every file of the batch gets an outcome.  The version holds the import's log, its summary and
    the stored payloads as encrypted chunks; the catalog gets the added rows, no other row is written again.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        catalog, _ = snapshots.read_version(spark, root, batch_id)
        files = prepare(batch)
        result = ingest.import_files(files, catalog, chunk_status(spark), max_images)
        payloads = ingest.payloads_to_store(files, result.chunks)
        rows = ingest.with_vectors(result.added, payloads, embed).select(*catalog.columns)
        fresh = rows.join(catalog.select("hash"), "hash", "left_anti")
        snapshots.write_version(fresh, None, root, batch_id + 1, adds=True, log=result.log, summary=result.summary,
                                chunks=chunkstore.encrypt_chunks(payloads))

    return run


def recycle_into(main: Callable[[SparkSession], DataFrame], path: str) -> Callable[[DataFrame], None]:
    """``recycle`` for ``fold_reviews``: readable chunks of deleted images are kept as dated files' rows (K5)."""
    def run(deleted: DataFrame) -> None:
        chunks = main(deleted.sparkSession).join(deleted.select("hash"), "hash", "left_semi")
        recycled, _ = chunkstore.soft_delete(chunks, chunkstore.decrypt_chunks(chunks), deleted.select("hash", F.col("deleted_at")))
        chunkstore.write_recycled(recycled, path)

    return run
