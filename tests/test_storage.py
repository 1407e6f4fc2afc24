import ctypes
import hashlib
import os
import struct
import uuid
import zlib
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framefold.operators import chunkstore, ingest, pixels
from framefold.plans.queries import QUERIES
from framefold.session import materialize
from framefold.sources import files, folder
from tests.test_functions import python_hash


def payloads(spark, bodies):
    return spark.createDataFrame([(python_hash(b), bytearray(b)) for b in bodies], "hash string, content binary")


def test_key_is_pbkdf2(spark):
    df = spark.createDataFrame([("abc",), (None,), ("abc",)], "p string").coalesce(1)
    want = hashlib.pbkdf2_hmac("sha256", b"abc", b"{mex}", 100_000, 32)
    got = [r[0] and bytes(r[0]) for r in df.select(chunkstore.chunk_key("p")).collect()]
    assert got == [want, None, want]


def test_encryption_round_trip(spark):
    bodies = [b"", b"Secret data", b"z" * 5000]
    chunks = chunkstore.encrypt_chunks(payloads(spark, bodies))
    rows = chunks.collect()
    assert sorted(len(r.content) for r in rows) == sorted(len(b) + 28 for b in bodies)
    assert {bytes(r.content) for r in chunkstore.decrypt_chunks(chunks).collect()} == set(bodies)
    wrong = chunks.withColumn("hash", F.concat(F.substring("hash", 1, 15), F.lit("!")))
    assert [r.content for r in chunkstore.decrypt_chunks(wrong).collect()] == [None] * 3
    short = chunks.withColumn("content", F.substring("content", 1, 20))
    assert [r.content for r in chunkstore.decrypt_chunks(short).collect()] == [None] * 3


def test_legacy_round_trip(spark):
    df = payloads(spark, [b"old payload of some length", b"y" * 64])
    sealed = df.withColumn("s", chunkstore.encrypt_legacy(F.col("content"), F.lit("né")))
    assert sealed.filter(F.length("s") % 16 != 0).count() == 0
    back = sealed.select("content", chunkstore.decrypt_legacy(F.col("s"), F.lit("né")).alias("b"),
                         chunkstore.decrypt_legacy(F.col("s"), F.lit("other")).alias("w")).collect()
    assert all(r.b == r.content and r.w != r.content for r in back)


def test_verified_read_heals_from_backup(spark):
    bodies = [bytes([65 + i]) * 40 for i in range(5)] + [b"s" * 16]
    chunks = chunkstore.encrypt_chunks(payloads(spark, bodies)).cache()
    h = [python_hash(b) for b in bodies]
    cut = F.substring(F.col("content"), F.lit(1), F.length("content") - 1)
    main = chunks.filter(F.col("hash") != h[2]).withColumn("content", F.when(F.col("hash").isin(h[1], h[3]), cut).otherwise(F.col("content")))
    backup = chunks.filter(F.col("hash") != h[0]).withColumn("content", F.when(F.col("hash") == h[3], cut).otherwise(F.col("content")))
    swapped = chunks.filter(F.col("hash") == h[4]).select(F.lit(h[3]).alias("hash"), "content")
    got = {r["hash"]: (r.status, r.healed, r.content and bytes(r.content))
           for r in chunkstore.read_verified(main, backup).collect()}
    assert got == {h[0]: ("ok", False, bodies[0]), h[1]: ("healable", True, bodies[1]),
                   h[2]: ("healable", True, bodies[2]), h[3]: ("lost", False, None), h[4]: ("ok", False, bodies[4]),
                   h[5]: ("lost", False, None)}
    assert chunkstore.read_verified(swapped, backup.limit(0)).first().status == "lost"
    report = {r.status: r.chunks for r in chunkstore.audit(main, backup).collect()}
    assert report == {"ok": 2, "healable": 2, "lost": 2}


def test_chunk_trees(spark, tmp_path):
    bodies = [bytes([i]) * 50 for i in range(20)]
    main, backup = str(tmp_path / "main"), str(tmp_path / "backup")
    chunkstore.write_chunks(chunkstore.encrypt_chunks(payloads(spark, bodies)), main, backup)
    a = {(r["hash"], bytes(r.content)) for r in chunkstore.read_chunks(spark, main).collect()}
    b = {(r["hash"], bytes(r.content)) for r in chunkstore.read_chunks(spark, backup).collect()}
    assert a == b and len(a) == 20
    h = python_hash(bodies[3])
    one = chunkstore.read_chunks_of(spark, main, h)
    assert "PartitionFilters: [isnotnull(h0" in one._jdf.queryExecution().toString()
    assert [r["hash"] for r in one.collect()] == [h]
    status = chunkstore.read_verified(chunkstore.read_chunks(spark, main), chunkstore.read_chunks(spark, backup))
    assert status.filter("status = 'ok'").count() == 20


def test_soft_delete_and_export(spark, tmp_path):
    bodies = [b"\xff\xd8\xff" + b"a" * 40, b"plain text that is long enough", b"kept" * 10]
    df = payloads(spark, bodies)
    h = [python_hash(b) for b in bodies]
    gone = spark.createDataFrame([(h[0], datetime(2024, 5, 6, 7, 8, 9)), (h[1], datetime(2024, 5, 6, 7, 8, 9))],
                                 "hash string, deleted_at timestamp_ntz")
    recycled, left = chunkstore.soft_delete(df, df, gone)
    assert {r.name for r in recycled.collect()} == {f"2024-05-06/070809.{h[0]}.jpg", f"2024-05-06/070809.{h[1]}.xxx"}
    assert [r["hash"] for r in left.collect()] == [h[2]]
    chunkstore.write_recycled(recycled, str(tmp_path / "recycled"))
    assert os.path.isdir(tmp_path / "recycled" / "deleted_on=2024-05-06")
    twice = spark.createDataFrame([(h[0],), (h[0],), ("unknown",)], "hash string")
    plan = chunkstore.export_plan(twice, df, "2024-01-02 03:04:05")
    names = sorted(r.name for r in plan.collect())
    assert names == [f"2024-01-02/030405.{h[0]}(1).jpg", f"2024-01-02/030405.{h[0]}.jpg"]
    folder.write_files(plan, str(tmp_path / "out"))
    assert (tmp_path / "out" / names[1]).read_bytes() == bodies[0]


def png(rgb: np.ndarray) -> bytes:
    """Minimal PNG writer for the fixtures."""
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = rgb.shape[:2]
    rows = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))
    return (b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def picture(seed, h=40, w=60):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def test_folder_scan_payloads_and_import(spark, tmp_path):
    root = tmp_path / "raw"
    (root / "b" / "deep").mkdir(parents=True)
    (root / "a").mkdir()
    image = png(picture(1))
    (root / "z.png").write_bytes(image)
    (root / "a" / "copy.png").write_bytes(image)
    (root / "b" / "junk.jpg").write_bytes(b"\xff\xd8\xff" + b"junk" * 10)
    (root / "b" / "deep" / "other.png").write_bytes(png(picture(2)))
    (root / "b" / "tiny.png").write_bytes(b"x" * 15)
    old, new = b"legacy bytes of a file", b"current bytes of a file"
    key = hashlib.pbkdf2_hmac("sha256", b"i5pg09v5ek3krrra", b"{mex}", 100_000, 32)
    one = spark.range(1).select(
        chunkstore.encrypt_legacy(F.lit(bytearray(old)), F.lit("name")).alias("l"),
        chunkstore.encrypt(F.lit(bytearray(new)), F.lit(bytearray(key))).alias("m")).first()
    (root / "b" / "name").write_bytes(one.l)
    (root / "a" / "name.mzx").write_bytes(one.l)
    (root / "a" / "wrong.mzx").write_bytes(one.l[:-1])
    (root / "a" / "120000.i5pg09v5ek3krrra.mex").write_bytes(one.m)
    (root / "a" / "i5pg09v5ek3krrra.MEX").write_bytes(one.m)
    (root / "a" / "j5pg09v5ek3krrra.mex").write_bytes(one.m)

    scanned = files.scan_folder(spark, str(root))
    order = [r.name for r in scanned.orderBy("scan").select("scan.name").collect()]
    assert order[0] == "z.png" and order[1:6] == sorted(o for o in order if o.startswith("a/"))[:5]
    assert [o.split("/")[0] for o in order[1:]] == sorted(o.split("/")[0] for o in order[1:])
    read = files.read_payloads(scanned)
    got = {r.name: r.payload and bytes(r.payload) for r in read.select("scan.name", "payload").collect()}
    assert got["b/name"] == old and got["a/name.mzx"] == old and got["a/wrong.mzx"] is None
    assert got["a/120000.i5pg09v5ek3krrra.mex"] == new and got["a/i5pg09v5ek3krrra.MEX"] == new
    assert got["a/j5pg09v5ek3krrra.mex"] is None and got["b/tiny.png"] is None and got["z.png"] == image

    decoded = pixels.decode_folder(spark, str(root)).select(F.regexp_replace("path", "^file:/+", "/").alias("p"), "decodable")
    ready = (read.withColumn("p", F.regexp_replace("path", "^file:/+", "/")).join(decoded, "p", "left").drop("p"))
    none = spark.createDataFrame([], "hash string, lastview timestamp_ntz, chunk_ok boolean")
    run = ingest.import_files(ready, none, none, 100)
    log = {os.path.basename(r.path): r.outcome for r in run.log.collect()}
    assert log["z.png"] == "added" and log["copy.png"] == "found" and log["other.png"] == "added"
    assert log["junk.jpg"] == "bad" and log["tiny.png"] == "bad" and log["name.mzx"] == "bad"


def test_folder_scan_lists_hidden_names_and_takes_predicates(spark, tmp_path):
    for name in ("top.txt", ".hidden", "_also.txt", "sub/.deep/_x.TXT", "sub/y.png", "other/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 3)
    listed = folder.list_files(spark, str(tmp_path))
    assert {r.name for r in listed.collect()} == {"top.txt", ".hidden", "_also.txt", "sub/.deep/_x.TXT", "sub/y.png", "other/z.txt"}
    assert {r.name for r in folder.list_files(spark, f"file:{tmp_path}/").collect()} == {r.name for r in listed.collect()}
    some = folder.list_files(spark, str(tmp_path), exts=["txt", "png"], prefix="sub/", least_bytes=30)
    assert [r.name for r in some.collect()] == ["sub/.deep/_x.TXT"]
    assert [r.name for r in folder.list_files(spark, str(tmp_path), most_bytes=30).filter("ext = 'png'").collect()] == ["sub/y.png"]
    rows = {r.name: bytes(r.content) for r in folder.with_content(listed).collect()}
    assert rows == {n: n.encode() * 3 for n in rows} and len(rows) == 6
    empty = tmp_path / "empty"
    empty.mkdir()
    assert folder.with_content(folder.list_files(spark, str(empty))).count() == 0


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 200, 1, 8).select(F.concat(F.lit("d/"), F.col("id"), F.lit(".bin")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    root = tmp_path / "out"
    broken = rows.withColumn("content", F.when(F.col("name") == "d/150.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception):
        folder.write_files(broken, str(root))
    assert not root.exists() or list(root.iterdir()) == []
    folder.write_files(rows, str(root))
    assert {p.name: p.read_bytes() for p in (root / "d").iterdir()} == {f"{i}.bin": str(i).encode() for i in range(200)}
    assert [p.name for p in root.iterdir()] == ["d"]
    with pytest.raises(Exception):
        folder.write_files(rows.select(F.lit("../escaped").alias("name"), "content"), str(root))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and [p.name for p in root.iterdir()] == ["d"]


def test_a_task_that_outlives_the_abort_leaves_nothing(tmp_path):
    writer = folder.FolderWriter({"path": str(tmp_path / "out")})

    def batches():
        yield pa.RecordBatch.from_pydict({"name": ["a/b/1.bin", "a/2.bin", "3.bin"], "content": [b"x", b"y", None]})
        writer.abort([])
        yield pa.RecordBatch.from_pydict({"name": ["c/d/4.bin"], "content": [b"z"]})

    with pytest.raises(OSError):
        writer.write(batches())
    assert list((tmp_path / "out").iterdir()) == []


def frame(spark, pictures):
    rows = [(k, p.shape[0], p.shape[1], 3, bytearray(pixels._data(p))) for k, p in pictures.items()]
    return spark.createDataFrame(rows, pixels.PIXELS)


def test_orientation(spark):
    p = picture(3, 4, 6)
    df = frame(spark, {"x": p})
    for flip in (0, 1, 2):
        for rotate in (0, 90, 180, 270):
            r = pixels.orient_images(df.withColumn("rotatemode", F.lit(rotate)).withColumn("flipmode", F.lit(flip))).first()
            want = p[:, ::-1] if flip == 1 else p[::-1] if flip == 2 else p
            for _ in range(rotate // 90):
                want = np.stack([[want[want.shape[0] - 1 - j, i] for j in range(want.shape[0])]
                                 for i in range(want.shape[1])])
            assert (pixels._rgb(r.data, r.height, r.width, 3) == want).all()


def test_decoded_png_has_the_right_pixels(spark, tmp_path):
    p = picture(4)
    (tmp_path / "p.png").write_bytes(png(p))
    r = pixels.decode_folder(spark, str(tmp_path)).first()
    assert r.decodable and (pixels._rgb(r.data, r.height, r.width, r.nChannels) == p).all()


def mean_model():
    return lambda batch: np.stack([batch.mean(axis=(2, 3)), batch.std(axis=(2, 3))], axis=1)


def test_embedding(spark):
    flat = np.zeros((64, 96, 3), np.uint8)
    flat[:, :, 0] = 255
    df = frame(spark, {"flat": flat, "noise": picture(5, 96, 64)})
    rows = {r["hash"]: np.array(r.vector) for r in pixels.embed_images(df, mean_model, short_side=32, dim=8).collect()}
    want = (np.array([1.0, 0.0, 0.0]) - pixels.MEAN) / pixels.STD
    assert np.allclose(rows["flat"], np.r_[want / np.linalg.norm(want), np.zeros(5)], atol=1e-4)
    assert np.isclose(np.linalg.norm(rows["noise"]), 1, atol=1e-6)
    assert pixels.model_input(flat, 32).shape == (3, 32, 48)
    cut = pixels.embed_images(df, mean_model, short_side=32, dim=2).first().vector
    assert len(cut) == 2


def test_resize_box_is_a_part_of_the_whole():
    p = picture(6, 37, 53)
    whole = pixels.resize(p, 90, 120)
    assert np.allclose(pixels.resize(p, 90, 120, (10, 20, 30, 40)), whole[10:40, 20:60])
    assert np.allclose(pixels.resize(p, 37, 53), p)


def test_pixel_difference(spark):
    a, b = np.full((20, 20, 3), 100, np.uint8), np.full((30, 20, 3), 100, np.uint8)
    b[:15] = 200
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "hash_x string, hash_y string")
    got = {r.hash_y: r for r in pixels.pixel_difference(pairs, frame(spark, {"a": a, "b": b}), grid=60).collect()}
    assert got["a"].changed == 0.0 and abs(got["b"].changed - 0.5) < 0.05
    shown = pixels._rgb(got["b"].data, 30, 20, 3)
    assert (got["b"].height, got["b"].width) == (30, 20) and (shown[0] == 255).all() and (shown[-1] == 20).all()


def test_backfill_reorient_and_drift(spark):
    pics = {f"h{i}": picture(i, 32 + i, 48) for i in range(12)}
    images = frame(spark, pics)
    made = pixels.embed_images(images, mean_model, short_side=32, dim=4)
    full = made.select("hash", F.lit(0).alias("rotatemode"), F.lit(0).alias("flipmode"),
                       F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("lastview"),
                       F.lit(0).cast("long").alias("hist_len"), "vector").cache()
    holes = full.withColumn("vector", F.when(F.col("hash") > "h5", F.col("vector")))
    filled = pixels.backfill(holes, images, mean_model, 4, short_side=32)
    assert filled.exceptAll(full).isEmpty() and filled.count() == 12
    drift = pixels.vector_drift(holes, images, mean_model, 4, "s", count=50, short_side=32)
    d = {r["hash"]: r.distance for r in drift.collect()}
    assert len(d) == 12 and all((v is None) == (h <= "h5") for h, v in d.items())
    assert max(v for v in d.values() if v is not None) < 1e-6
    modes = spark.createDataFrame([("h1", 90, 2)], "hash string, rotatemode int, flipmode int")
    done = {r["hash"]: r for r in pixels.reorient(full, images, modes, mean_model, 4, short_side=32).collect()}
    assert (done["h1"].rotatemode, done["h1"].flipmode) == (90, 2) and done["h2"].rotatemode == 0 and len(done) == 12


def test_a_hash_counts_once_after_rewrites_and_repairs(spark, tmp_path):
    """Two chunks written twice, one of them damaged in main and healed from the backup, one lost and written anew."""
    bodies = [b"first body of some bytes", b"second body of some bytes", b"third body, lost at first"]
    plain = spark.createDataFrame([(python_hash(b), bytearray(b)) for b in bodies], "hash string, content binary")
    good = chunkstore.encrypt_chunks(plain).cache()
    broken = good.withColumn("content", F.substring(F.col("content"), F.lit(1), F.length("content") - 1))
    third = F.col("hash") == python_hash(bodies[2])
    main, backup = str(tmp_path / "main"), str(tmp_path / "backup")
    chunkstore.write_chunks(broken, main, backup)
    chunkstore.write_chunks(good.filter(~third), main, backup)

    def counts():
        trees = chunkstore.read_chunks(spark, main), chunkstore.read_chunks(spark, backup)
        assert chunkstore.read_verified(*trees).count() == 3
        return {r.status: r.chunks for r in chunkstore.audit(*trees).collect()}

    assert counts() == {"ok": 2, "lost": 1}
    chunkstore.write_chunks(good.filter(third), main, backup)
    assert counts() == {"ok": 3}
    assert {bytes(r.content) for r in chunkstore.read_verified(broken, good).filter("healed").collect()} == set(bodies)
    chunkstore.heal(broken, good, main, backup)
    assert counts() == {"ok": 3}


def test_whole_main_copies_are_not_shuffled(spark, tmp_path):
    """Only failed hashes' bytes pass an exchange, and only their shards of the backup are read."""
    bodies = [b"some bytes of payload %03d" % i for i in range(40)]
    main, backup = str(tmp_path / "main"), str(tmp_path / "backup")
    chunkstore.write_chunks(chunkstore.encrypt_chunks(payloads(spark, bodies)), main, backup)
    bad = python_hash(bodies[7])
    trees = chunkstore.read_chunks(spark, main).filter(F.col("hash") != bad), chunkstore.read_chunks(spark, backup)
    read = chunkstore.read_verified(*trees)
    whole, rescue = (str(read._jdf.queryExecution().optimizedPlan().children().apply(i)) for i in (0, 1))
    assert not any(node in whole for node in ("Join", "Aggregate", "Repartition"))  # read, decrypted, passed on
    assert f"IN ({bad[:2]})" in rescue or f"= {bad[:2]})" in rescue, rescue
    rows = {r["hash"]: (r.status, bytes(r.content)) for r in read.collect()}
    assert rows == {python_hash(b): ("healable" if python_hash(b) == bad else "ok", b) for b in bodies}


def test_audit_shuffles_no_content(spark):
    rows = spark.createDataFrame([("a" * 16, bytearray(b"x" * 40))], "hash string, content binary")
    plan = chunkstore.audit(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") >= 2
    for node in plan.split("Exchange")[1:]:
        assert "content" not in node.split("\n")[1]


@pytest.mark.parametrize("name", ["chunk_audit", "verified_read", "import_commit"])
def test_a_query_derives_each_key_once(spark, tmp_path, monkeypatch, name):
    """The derivation is what these queries take long for; it was done again for each read of a chunk."""
    log, data = tmp_path / "derived", str(tmp_path / "data")
    log.mkdir()

    @F.arrow_udf("binary")
    def watched(password: pa.Array) -> pa.Array:
        names = password.to_pylist()
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(n for n in names if n))
        return pa.array([None if n is None else hashlib.sha256(n.encode()).digest() for n in names], pa.binary())

    monkeypatch.setattr(chunkstore, "chunk_key", watched)
    docs = spark.range(60).selectExpr("id as doc_id", "concat('some text of document ', id div 2) as text", "if(id % 3 = 0, 'en', 'de') as lang")
    docs.write.parquet(f"{data}/documents.parquet")
    docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as quality", "cast(doc_id % 2 as int) as toxic").write.parquet(f"{data}/labels.parquet")
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(f"{data}/events.parquet")
    assert QUERIES[name](spark, data).collect()
    derived = [line for file in log.iterdir() for line in file.read_text().split()]
    assert derived and len(derived) == len(set(derived))


def test_keys_that_come_along_are_completed(spark):
    bodies = [b"some bytes of payload %03d" % i for i in range(4)]
    chunks = materialize(chunkstore.encrypt_chunks(payloads(spark, bodies), keep_key=True))
    some = chunks.filter(F.col("hash") != python_hash(bodies[2])).select("hash", "key")
    for keys in (some, some.unionByName(some), None):
        tree = chunkstore.with_keys(chunks.drop("key"), keys)
        read = {r["hash"]: (r.status, bytes(r.content)) for r in chunkstore.read_verified(tree, chunks.limit(0)).collect()}
        assert read == {python_hash(b): ("ok", b) for b in bodies}
    nameless = chunks.drop("key").unionByName(spark.createDataFrame([(None, bytearray(b"x" * 40))], "hash string, content binary"))
    assert {r.status: r.chunks for r in chunkstore.audit(chunkstore.with_keys(nameless, some), nameless).collect()} == {"ok": 4, "lost": 1}


def test_pictures_leave_their_batch_a_few_at_a_time(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"hash": [str(i) for i in range(200)], "data": [b"x"] * 200})
    copied, columns = [], pixels._columns
    monkeypatch.setattr(pixels, "_columns", lambda part, names: copied.append(part.num_rows) or columns(part, names))
    rows = list(pixels._pictures(iter([batch, batch.slice(0, 0), batch.slice(10, 3)]), ["hash", "data"]))
    assert [r[0] for r in rows] == [*map(str, range(200)), "10", "11", "12"]
    assert max(copied) <= 64


def bitmap(p, from_top=False, gap=b"", size=None):
    """24-bit bitmap file of RGB pixels; with ``gap`` the pixels begin later, and ``size`` is what the head says of the file."""
    lines = [r[:, ::-1].tobytes() + b"\0" * (-3 * p.shape[1] % 4) for r in (p if from_top else p[::-1])]
    size = 54 + len(gap) + sum(map(len, lines)) if size is None else size
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", size, 0, 54 + len(gap), 40, p.shape[1], -len(p) if from_top else len(p), 1, 24, 0, 0, 0, 0, 0, 0)
    return head + gap + b"".join(lines)


def test_bitmaps_are_decoded_in_tasks_as_the_image_source_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pixels, "IMAGES_AT_A_TIME", 2)
    a, b = picture(1, 5, 7), picture(2, 4, 4)
    files = {"up.bmp": bitmap(a), "sub/down 1%.bmp": bitmap(a, True), "gap.bmp": bitmap(b, gap=b"12345678"), "é#x.png": png(b), "p.png": png(a), "cut.bmp": bitmap(a)[:60],
             "head.bmp": b"BM", "size.bmp": bitmap(a, size=0), "junk": b"text", "gif": b"GIF89a", "empty.bmp": b"", ".hidden.bmp": bitmap(a), "_part/x.bmp": bitmap(a), "k=1/_y=2/z.bmp": bitmap(b)}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    image = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
    for name in ("cut.bmp", "head.bmp", "size.bmp", "gif"):  # these the image source may refuse by an error
        try:
            image.load(str(tmp_path / name)).collect()
        except Exception:
            (tmp_path / name).unlink()
    want = {r.origin: (r.height, r.width, r.nChannels, bytes(r.data)) if r.height > 0 else None for r in image.load(str(tmp_path)).select("image.*").collect()}
    loads = []
    load = pixels._by_image_source
    monkeypatch.setattr(pixels, "_by_image_source", lambda spark, listed, n: loads.append({os.path.basename(r.path) for r in listed.collect()}) or load(spark, listed, n))
    rows = pixels.decode_folder(spark, str(tmp_path)).collect()
    assert {r.path: (r.height, r.width, r.nChannels, bytes(r.data)) if r.decodable else None for r in rows} == want and len(rows) == len(want)
    assert len(want) >= 7 and sum(x is not None for x in want.values()) == 6
    assert not loads[0] & {"up.bmp", "down 1%.bmp", "z.bmp", "junk"} and {"p.png", "gap.bmp"} <= loads[0]


def test_keys_are_the_same_by_either_library(monkeypatch):
    """OpenSSL's contexts take as long as the hashing; where libgcrypt is at hand hashlib only proves that both agree."""
    passwords, rounds, plain = ["", "abc", "i5pg09v5ek3krrra", "ä€\0b", "x" * 200], [], hashlib.pbkdf2_hmac
    want = [plain("sha256", p.encode(), b"{mex}", 500, 32) for p in passwords]
    monkeypatch.setattr(hashlib, "pbkdf2_hmac", lambda kind, p, salt, n, size: rounds.append(n) or plain(kind, p, salt, n, size))
    derive = chunkstore.key_derivation()
    assert [derive(p.encode(), 500) for p in passwords] == want
    try:
        ctypes.CDLL("libgcrypt.so.20")
    except OSError:
        assert rounds == [500] * len(passwords)
    else:
        assert rounds[0] == 2 and len(rounds) <= 2  # the empty password is refused by some versions
    monkeypatch.setattr(ctypes, "CDLL", lambda name: (_ for _ in ()).throw(OSError(name)))
    rounds.clear()
    derive = chunkstore.key_derivation()
    assert [derive(p.encode(), 500) for p in passwords] == want and rounds == [500] * len(passwords)


def test_keys_are_derived_by_the_quicker_library(monkeypatch):
    """Of the libraries that give the right key the quicker one derives, whichever that is; one that gives another is left."""
    load, plain, asked = ctypes.CDLL, hashlib.pbkdf2_hmac, []

    class Nettle:
        def __init__(self, slow, wrong):
            def derive(size, password, rounds, salt_size, salt, length, key):
                asked.append(rounds)
                sum(range(slow))
                made = plain("sha256", password[:size], salt[:salt_size], rounds + wrong, length)
                ctypes.memmove(key, made, length)

            self.nettle_pbkdf2_hmac_sha256 = type("Function", (), {"__call__": lambda self, *a: derive(*a)})()

    class Gcrypt:
        def __init__(self):
            def derive(password, size, kind, digest, salt, salt_size, rounds, length, key):
                sum(range(20_000))
                ctypes.memmove(key, plain("sha256", password[:size], salt[:salt_size], rounds, length), length)
                return 0

            self.gcry_check_version = lambda version: None
            self.gcry_kdf_derive = type("Function", (), {"__call__": lambda self, *a: derive(*a)})()

    want = plain("sha256", b"a\0b", b"{mex}", 700, 32)
    for slow, wrong, chosen in ((0, 0, True), (200_000, 0, False), (0, 1, False)):
        monkeypatch.setattr(ctypes, "CDLL", lambda name: Nettle(slow, wrong) if "nettle" in name else Gcrypt())
        derive = chunkstore.key_derivation()
        assert derive(b"a\0b", 700) == want
        assert (700 in asked) == chosen
        asked.clear()
    monkeypatch.setattr(ctypes, "CDLL", load)
    for password in ("", "abc", "ä€\0b", "x" * 200):
        assert chunkstore.key_derivation()(password.encode(), 300) == plain("sha256", password.encode(), b"{mex}", 300, 32)


def test_keys_are_derived_in_several_tasks_a_core(spark):
    """With a task or three a core a slow one held up the query while the others were done."""
    bodies = [b"payload %04d of some length" % i for i in range(400)]
    keyed = chunkstore._spread_keyed(payloads(spark, bodies))
    assert keyed.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
