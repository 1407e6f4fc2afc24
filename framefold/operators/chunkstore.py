"""Encrypted, content-addressed payloads.

A chunk is nonce (12) + cipher + tag (16) of AES-256-GCM under a key derived from its own hash, which is the
layout Spark's aes_encrypt writes.  Only the key derivation runs in Python, once per row, in Arrow batches.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import posixpath
import time
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framefold import schemas
from framefold.functions import media, text
from framefold.functions.hashing import content_hash
from framefold.session import materialize, spread_work, work_partitions

# Fixed values of the stored format.
KEY_SALT = b"{mex}"
KEY_ROUNDS = 100_000
KEY_BYTES = 32
PBKDF2, SHA256 = 34, 8  # numbers of libgcrypt
KEY_WAVES = 8  # tasks a core where keys are derived, at least
LEGACY_SUFFIX = "{mzx}"
LEGACY_IV = "E1D994E6E6433934330ACC9E7D669716"
MIN_CHUNK_BYTES = 17
MIN_FILE_BYTES = 16


def key_derivation() -> Callable[..., bytes]:
    """PBKDF2-HMAC-SHA256 of the stored format: by nettle or libgcrypt, the quicker one this machine has, if it agrees; else by hashlib.

    OpenSSL 3, which hashlib calls, copies its contexts in every round; that takes longer than the hashing itself.  Of the
    libraries nettle does least besides the hashing.
    """
    def plain(password: bytes, rounds: int = KEY_ROUNDS) -> bytes:
        return hashlib.pbkdf2_hmac("sha256", password, KEY_SALT, rounds, KEY_BYTES)

    def nettle() -> Callable[..., bytes]:
        derive = ctypes.CDLL("libnettle.so.8").nettle_pbkdf2_hmac_sha256
        derive.restype, derive.argtypes = None, [ctypes.c_size_t, ctypes.c_char_p, ctypes.c_uint, ctypes.c_size_t, ctypes.c_char_p, ctypes.c_size_t, ctypes.c_char_p]

        def quick(password: bytes, rounds: int = KEY_ROUNDS) -> bytes:
            key = ctypes.create_string_buffer(KEY_BYTES)
            derive(len(password), password, rounds, len(KEY_SALT), KEY_SALT, KEY_BYTES, key)
            return key.raw

        return quick

    def gcrypt() -> Callable[..., bytes]:
        library = ctypes.CDLL("libgcrypt.so.20")
        library.gcry_check_version(None)  # which also sets it up
        derive = library.gcry_kdf_derive
        derive.argtypes = [ctypes.c_char_p, ctypes.c_size_t, ctypes.c_int, ctypes.c_int, ctypes.c_char_p, ctypes.c_size_t, ctypes.c_ulong, ctypes.c_size_t, ctypes.c_char_p]

        def quick(password: bytes, rounds: int = KEY_ROUNDS) -> bytes:
            key = ctypes.create_string_buffer(KEY_BYTES)
            refused = derive(password, len(password), PBKDF2, SHA256, KEY_SALT, len(KEY_SALT), rounds, KEY_BYTES, key)
            return plain(password, rounds) if refused else key.raw

        return quick

    def seconds(derive: Callable[..., bytes]) -> float:
        taken = []
        for _ in range(3):
            start = time.thread_time()
            derive(b"some password", 200)
            taken.append(time.thread_time() - start)
        return min(taken)

    found = []
    for library in (nettle, gcrypt):
        with suppress(OSError, AttributeError):
            found.append(library())
    if found:
        key = plain(b"some password", 2)
        found = [derive for derive in found if derive(b"some password", 2) == key]
    return min(found, key=seconds) if found else plain


@F.arrow_udf(T.BinaryType())
def chunk_key(password: pa.Array) -> pa.Array:
    """PBKDF2-HMAC-SHA256 of each password; equal passwords of a batch are derived once."""
    distinct = password.dictionary_encode()
    derive = key_derivation()
    keys = [None if p is None else derive(p.encode()) for p in distinct.dictionary.to_pylist()]
    return pa.array(keys, pa.binary()).take(distinct.indices)


def encrypt(content: Column, key: Column) -> Column:
    return F.aes_encrypt(content, key, F.lit("GCM"))


def decrypt(content: Column, key: Column) -> Column:
    """A wrong key, a bad tag or too few bytes give NULL."""
    return F.try_aes_decrypt(content, key, F.lit("GCM"))


def decrypt_legacy(content: Column, password: Column) -> Column:
    """AES-256-CBC under SHA-256 of the password and a fixed suffix, with a fixed IV."""
    ascii_password = F.regexp_replace(F.concat(password, F.lit(LEGACY_SUFFIX)), r"[^\x00-\x7F]", "?")
    key = F.unhex(F.sha2(ascii_password.cast("binary"), 256))
    return F.try_aes_decrypt(F.concat(F.unhex(F.lit(LEGACY_IV)), content), key, F.lit("CBC"), F.lit("PKCS"))


def encrypt_legacy(content: Column, password: Column) -> Column:
    """The inverse.  Spark writes the IV in front; the old format leaves it out."""
    ascii_password = F.regexp_replace(F.concat(password, F.lit(LEGACY_SUFFIX)), r"[^\x00-\x7F]", "?")
    key = F.unhex(F.sha2(ascii_password.cast("binary"), 256))
    sealed = F.aes_encrypt(content, key, F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit(LEGACY_IV)))
    return F.substring(sealed, 17, 2147483647)


def with_keys(rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` with the key of each hash as ``key``.

    A derivation takes longer than all else that happens to a row.  So keys that an earlier step derived, as a column of
    ``rows`` or in ``keys`` (hash, key), are taken over, and only missing ones are derived, where the rows are.
    """
    if keys is not None:
        rows = rows.join(keys.select("hash", "key").dropDuplicates(["hash"]), "hash", "left")
    if "key" not in rows.columns:
        return rows.withColumn("key", chunk_key("hash"))
    return rows.withColumn("key", F.coalesce("key", chunk_key(F.when(F.col("key").isNull(), F.col("hash")))))


def _spread_keyed(rows: DataFrame) -> DataFrame:
    """(hash, content, key); rows without keys are spread over all cores first."""
    if "key" in rows.columns:
        return with_keys(rows.select("hash", "content", "key"))
    return with_keys(spread_work(rows.select("hash", "content"), "hash", KEY_WAVES))


def encrypt_chunks(payloads: DataFrame, keep_key: bool = False) -> DataFrame:
    """(hash, content) with plain content to chunks; with ``keep_key`` their keys go along, for later steps."""
    sealed = encrypt(F.col("content"), F.col("key")).alias("content")
    return _spread_keyed(payloads).select("hash", sealed, *(["key"] if keep_key else []))


def decrypt_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks to (hash, content); NULL content where the key or the bytes are wrong."""
    return _spread_keyed(chunks).select("hash", decrypt(F.col("content"), F.col("key")).alias("content"))


def _verified(plain: Column) -> Column:
    """Payload only if it is long enough and hashes to its own name."""
    good = (F.length(plain) >= MIN_CHUNK_BYTES) & (content_hash(plain) == F.col("hash"))
    return F.when(good, plain)


def _checked(tree: DataFrame, rank: int) -> DataFrame:
    """(hash, rank, content) with the plain content of chunks that verify, checked where they are read."""
    plain = decrypt(F.col("content"), F.col("key"))
    keyed = with_keys(tree.select("hash", "content", *(c for c in tree.columns if c == "key")))
    return keyed.select("hash", F.lit(rank).alias("rank"), plain.alias("content")).withColumn("content", _verified(F.col("content")))


def failures(main: DataFrame, backup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, whole) with the number of main copies that verify, and the hashes of either tree that have none.

    Both are narrow and written: verification reads the bytes where they lie and ships a count.
    """
    return _judged(_checked(main, 0), backup)


def _judged(checked: DataFrame, backup: DataFrame) -> tuple[DataFrame, DataFrame]:
    verdicts = materialize(checked.groupBy("hash").agg(F.count("content").alias("whole")))
    known = verdicts.select("hash").unionByName(backup.select("hash")).distinct()
    return verdicts, materialize(known.join(verdicts.filter("whole > 0"), "hash", "left_anti"))


def rescued(backup: DataFrame, failed: DataFrame) -> DataFrame:
    """(hash, content) of each failed hash, from a backup that verifies; NULL where none does.

    Only the shards (at most 1,024) that hold a failed hash are read, if the backup knows its shards, and only the
    bytes of failed hashes are decrypted and shuffled.
    """
    rows = backup
    if "h0" in backup.columns:
        shards = [r["s"] for r in failed.select(F.substring("hash", 1, 2).alias("s")).distinct().collect()]
        rows = backup.filter(F.concat("h0", "h1").isin(shards)) if shards else backup.limit(0)
    held = _checked(rows.join(failed, "hash", "left_semi"), 1).filter(F.col("content").isNotNull())
    one = held.groupBy("hash").agg(F.first("content").alias("content"))
    return failed.join(one, "hash", "left")


def read_verified(main: DataFrame, backup: DataFrame) -> DataFrame:
    """(hash, content, healed, status), one row per hash: a main copy that verifies, else a backup, else NULL.

    ``status`` is ok, healable (only a backup verifies) or lost.  A hash may have several rows in either tree, as
    after a second write or a repair: any that verifies counts.  Verdicts come first; then main copies go straight into
    the result, so that of these only repeated ones are shuffled.  If the rows bring their keys (``with_keys``), main is
    decrypted once more for that; else what verified is written, for deriving keys again costs far more.
    """
    checked = _checked(main, 0) if "key" in main.columns else materialize(_checked(main, 0))
    verdicts, failed = _judged(checked, backup)
    repeated = verdicts.filter("whole > 1").select("hash")
    whole = checked.filter(F.col("content").isNotNull()).select("hash", "content")
    if not repeated.isEmpty():
        again = whole.join(repeated, "hash", "left_semi").groupBy("hash").agg(F.first("content").alias("content"))
        whole = whole.join(repeated, "hash", "left_anti").unionByName(again)
    good = whole.select("hash", "content", F.lit(False).alias("healed"), F.lit("ok").alias("status"))
    found = F.col("content").isNotNull()
    return good.unionByName(rescued(backup, failed).select("hash", "content", found.alias("healed"), F.when(found, "healable").otherwise("lost").alias("status")))


def audit(main: DataFrame, backup: DataFrame) -> DataFrame:
    """C3.  Chunks are verified where they are read; only (hash, verdict) is shuffled, each hash counts once."""
    rows = _checked(main, 0).unionByName(_checked(backup, 1))
    facts = rows.select("hash", F.struct(F.col("content").isNull().alias("bad"), "rank").alias("best"))
    best = facts.groupBy("hash").agg(F.min("best").alias("best"))
    status = F.when(F.col("best.bad"), "lost").when(F.col("best.rank") == 0, "ok").otherwise("healable")
    return best.groupBy(status.alias("status")).agg(F.count("*").alias("chunks"))


def heal(main: DataFrame, backup: DataFrame, main_path: str, backup_path: str) -> None:
    """Chunks of which only the backup verifies are written to both trees again, as a batch of their own."""
    _, failed = failures(main, backup)
    write_chunks(encrypt_chunks(rescued(backup, failed).filter(F.col("content").isNotNull())), main_path, backup_path)


def sharded(chunks: DataFrame) -> DataFrame:
    """K7: shard columns from the first two characters of the hash."""
    return chunks.withColumn("h0", F.substring("hash", 1, 1)).withColumn("h1", F.substring("hash", 2, 1))


def write_chunks(chunks: DataFrame, main: str, backup: str, files_per_shard: int | None = None) -> None:
    """K4: the same chunks to both trees; Spark's commit protocol makes each write all or nothing.

    The chunks are encrypted once: the backup is written from what the main tree now holds.  Of two rows with
    the same hash a reader takes any that verifies.  Each of the 1,024 shards is written by ``files_per_shard``
    tasks; by default the work is spread as wide as any other shuffle.
    """
    spark = chunks.sparkSession
    files_per_shard = files_per_shard or max(1, work_partitions(spark) // 1024)
    parts = sharded(chunks).withColumn("_part", F.pmod(F.xxhash64("hash"), F.lit(files_per_shard)))
    batch = f"{main.rstrip('/')}/batch={_batch_name()}"
    parts.repartition("h0", "h1", "_part").drop("_part").write.partitionBy("h0", "h1").parquet(batch)
    copied = sharded(spark.read.schema(schemas.CHUNKS).parquet(batch).select("hash", "content"))
    target = f"{backup.rstrip('/')}/{posixpath.basename(batch)}"
    copied.write.partitionBy("h0", "h1").parquet(target)


def _batch_name() -> str:
    return os.urandom(8).hex()


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    schema = T.StructType(schemas.CHUNKS.fields + [T.StructField(n, T.StringType()) for n in ("batch", "h0", "h1")])
    return spark.read.schema(schema).parquet(root).select("hash", "content", "h0", "h1")


def read_chunks_of(spark: SparkSession, root: str, hash_: str) -> DataFrame:
    """One hash: partition pruning leaves a single shard to read."""
    return read_chunks(spark, root).filter((F.col("h0") == hash_[0]) & (F.col("h1") == hash_[1])
                                           & (F.col("hash") == hash_)).select("hash", "content")


def soft_delete(chunks: DataFrame, readable: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: (recycled rows, remaining chunks).

    ``deletes`` has (hash, deleted_at), ``readable`` the plain payloads.  An unreadable chunk is removed without
    a recycled copy; of several deletions of a hash the first counts.
    """
    deletes = deletes.groupBy("hash").agg(F.min("deleted_at").alias("deleted_at"))
    taken = readable.filter(F.col("content").isNotNull()).join(deletes, "hash")
    ext = media.file_type(F.col("content"))
    recycled = taken.select(F.to_date("deleted_at").alias("deleted_on"), "deleted_at", "hash", ext.alias("ext"),
                            text.dated_name(F.col("deleted_at"), F.col("hash"), ext).alias("name"), "content")
    return recycled, chunks.join(deletes.select("hash"), "hash", "left_anti")


def write_recycled(recycled: DataFrame, path: str) -> None:
    recycled.write.mode("append").partitionBy("deleted_on").parquet(path)


def export_plan(selection: DataFrame, readable: DataFrame, now: str) -> DataFrame:
    """K6: (hash, name, content) of the selected hashes; a hash selected again gets a counter in its name.

    Repeats are counted before the payload is joined, so the bytes of a hash are shuffled once.
    """
    at = F.expr(f"timestamp_ntz'{now}'")
    times = selection.groupBy("hash").agg(F.count("*").alias("_times"))
    chosen = times.join(readable.filter(F.col("content").isNotNull()).select("hash", "content"), "hash")
    ext = media.file_type(F.col("content"))
    named = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))))
    return named.select("hash", text.dated_name(at, F.col("hash"), ext, F.col("_copy")).alias("name"), "content")
