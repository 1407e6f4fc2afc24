import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from framefold.functions import clock, hashing, history, media, text, vectors
from framefold.operators import cards


def one(df):
    return df.first()[0]


def python_hash(data: bytes) -> str:
    number = int.from_bytes(hashlib.sha256(data).digest()[:10], "big")
    return "".join(hashing.HASH_ALPHABET[(number >> (5 * i)) & 31] for i in range(15, -1, -1))


def test_content_hash_known_answers(spark):
    data = [b"test data", b"deterministic", b"", b"\x00" * 1000] + [bytes([i]) * i for i in range(60)]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "x binary")
    assert [r[0] for r in df.select(hashing.content_hash(F.col("x"))).collect()] == [python_hash(d) for d in data]
    assert python_hash(b"test data") == "i5pg09v5ek3krrra"
    assert python_hash(b"deterministic") == "1ensqf3dxh2ssepa"


def test_valid_hash(spark):
    cases = {"i5pg09v5ek3krrra": True, "I5pg09v5ek3krrra": False, "i5pg09v5ek3krrr": False, "i5pg09v5ek3krrraa": False,
             "i5pg09v5ek3krrr\n": False, "i5pg09v5ek3krrra\n": False, "lowyi5pg09v5ek3k": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert [r[0] for r in df.select(hashing.is_valid_hash(F.col("h"))).collect()] == list(cases.values())


def test_history_round_trip(spark):
    a, b = "a" * 16, "b" * 16
    df = spark.createDataFrame([(b + a + b,), ("",), (a + "x",)], "h string")
    peers = history.split_history(F.col("h"))
    rows = df.select(peers, history.join_history(peers), history.history_size(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [([a, b], a + b, 3), ([], "", 0), ([a], a, 1)]


def test_distance_rules(spark):
    nan = float("nan")
    cases = [([1.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 1.0),
             ([nan, 0.0], [1.0, 0.0], 1.0), ([1.0, nan], [1.0, 0.0], 1.0), ([0.6, 0.8], [1.0, 0.0], 0.4),
             ([2.0, 0.0], [2.0, 0.0], 0.0)]
    df = spark.createDataFrame([(x, y) for x, y, _ in cases], "x array<float>, y array<float>")
    got = [r[0] for r in df.select(vectors.distance(F.col("x"), F.col("y"))).collect()]
    assert np.allclose(got, [d for *_, d in cases], atol=1e-6)


def test_normalize_and_fit(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    got = [r[0] for r in df.select(vectors.normalize(F.col("v"))).collect()]
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] == [0.0, 0.0] and math.isnan(got[2][0]) and got[2][1] == 1.0
    fitted = [r[0] for r in df.limit(1).select(vectors.fit_dim(F.col("v"), 4)).collect()]
    assert fitted == [[3.0, 4.0, 0.0, 0.0]]
    assert df.limit(1).select(vectors.fit_dim(F.col("v"), 1)).first()[0] == [3.0]


def test_needs_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([float("nan"), 2.0],), ([1.0],), ([],), (None,), ([1.0, float("nan")],)],
                               "v array<float>")
    assert [r[0] for r in df.select(vectors.needs_vector(F.col("v"), 2)).collect()] == [False, True, True, True, True, False]


def test_vector_bytes(spark):
    rows = [([1.0, -2.5],), ([],), (None,), ([3.25],)]
    df = spark.createDataFrame(rows, "v array<float>").coalesce(1)
    stored = df.select(vectors.vector_to_bytes("v").alias("b"), "v")
    got = stored.select("b", vectors.bytes_to_vector("b").alias("back"), "v").collect()
    for r in got:
        assert r.back == r.v
        assert (r.b is None) == (r.v is None)
        if r.v is not None:
            assert bytes(r.b) == np.array(r.v, "<f4").tobytes()
    ragged = spark.createDataFrame([(bytearray(b"12345"),)], "b binary")
    assert one(ragged.select(vectors.bytes_to_vector("b"))) is None


def test_age_text(spark):
    cases = {0: "0 seconds", 59.5: "60 seconds", 60: "1 minute", 119: "2 minute", 120: "2 minutes", 3600: "1 hour",
             7200: "2 hours", 86400: "1 day", 1.6 * 86400: "2 day", 2.5 * 86400: "3 days", 172800: "2 days"}
    df = spark.createDataFrame([(float(s),) for s in cases], "s double")
    assert [r[0] for r in df.select(text.age_text(F.col("s"))).collect()] == list(cases.values())


def test_size_text(spark):
    cases = {0: "0 b", 1023: "1023 b", 1024: "1.0 Kb", 1536: "1.5 Kb", 1048575: "1024.0 Kb", 1048576: "1.0000 Mb",
             5 * 1048576 // 2: "2.5000 Mb"}
    df = spark.createDataFrame([(n,) for n in cases], "n long")
    assert [r[0] for r in df.select(text.size_text(F.col("n"))).collect()] == list(cases.values())


def test_distance_key(spark):
    cases = [(0.0, "0000h"), (0.00005, "0000h"), (0.00015, "0002h"), (1.0, "9999h"), (0.12344, "1234h"), (-1.0, "0000h")]
    df = spark.createDataFrame([(d,) for d, _ in cases], "d double")
    assert [r[0] for r in df.select(text.distance_key(F.lit("h"), F.col("d"))).collect()] == [k for _, k in cases]


def test_names(spark):
    df = spark.createDataFrame([("x/120000.i5pg09v5ek3krrra.MEX",), ("x/plain",), ("a.b/c.d.jpg",)], "p string")
    rows = df.select(text.file_stem(F.col("p")).alias("stem"), text.file_ext(F.col("p")).alias("ext"))
    rows = rows.select("stem", "ext", text.recycled_hash(F.col("stem")).alias("h")).collect()
    assert [tuple(r) for r in rows] == [("120000.i5pg09v5ek3krrra", "MEX", "i5pg09v5ek3krrra"), ("plain", "", ""),
                                        ("c.d", "jpg", "")]
    at = F.expr("timestamp_ntz'2024-01-02 03:04:05'")
    named = spark.range(1).select(text.dated_name(at, F.lit("n"), F.lit("jpg")),
                                  text.dated_name(at, F.lit("n"), F.lit(""), F.lit(2)),
                                  text.chunk_path(F.lit("AB" + "c" * 14), "root/"))
    assert tuple(named.first()) == ("2024-01-02/030405.n.jpg", "2024-01-02/030405.n(2)",
                                    "root/a/b/ab" + "c" * 14 + ".mex")


def test_ticks(spark):
    df = spark.createDataFrame([(638396640001234567,), (0,), (621355968000000000 - 15,)], "t long")
    back = df.select(clock.ticks_to_ts(F.col("t")).alias("ts")).select("ts", clock.ts_to_ticks(F.col("ts"))).collect()
    assert str(back[0][0]) == "2024-01-01 00:00:00.123456" and back[0][1] == 638396640001234560
    assert back[1][0].year == 1 and back[1][1] == 0
    assert back[2][1] == 621355968000000000 - 10


def test_file_types(spark):
    cases = {b"\xff\xd8\xff\xe0aaaa": "jpg", b"\x89PNG\r\n": "png", b"GIF89a": "gif", b"BM1234": "bmp",
             b"RIFF0000WEBP": "webp", b"RIFF0000WAVE": "xxx", b"II*\x00": "tiff", b"MM\x00*": "tiff",
             b"0000ftypisom": "mp4", b"": "xxx", b"abc": "xxx"}
    df = spark.createDataFrame([(bytearray(k),) for k in cases] + [(None,)], "c binary")
    rows = df.select(media.file_type(F.col("c")), media.is_video(F.col("c"))).collect()
    assert [r[0] for r in rows] == list(cases.values()) + ["xxx"]
    assert [r[1] for r in rows] == [v == "mp4" for v in cases.values()] + [False]


def test_capture_date(spark):
    names = ["iptc_date", "iptc_time", "exif_digitized", "exif_original", "exif_datetime", "xmp"]
    cases = [
        ((None,) * 6, None),
        (("20240105", None, None, None, None, None), "2024-01-05 00:00:00"),
        (("20240105", "101112+0200", None, None, None, None), "2024-01-05 10:11:12"),
        (("20240105", "bad", "2024:02:01 00:00:00", None, None, None), "2024-02-01 00:00:00"),
        ((None, None, "2024:02:30 00:00:00", "2024:02:03 04:05:06", "2020:01:01 00:00:00", None), "2024-02-03 04:05:06"),
        ((None, None, None, None, "2020:01:01 00:00:01", "a 2019-05-06T07:08:09Z b"), "2019-05-06 07:08:09"),
        ((None, None, None, None, None, "2019-13-06T07:08:09Z 2018-01-02T03:04:05+01:00"), "2018-01-02 03:04:05"),
        ((None, None, None, None, None, "2018-01-02T03:04:05"), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], ", ".join(f"{n} string" for n in names))
    got = [r[0] for r in df.select(media.capture_date({n: F.col(n) for n in names})).collect()]
    assert [None if g is None else str(g) for g in got] == [d for _, d in cases]


def test_meta_summary(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (None, None, None, None), (10 ** 9, 10 ** 9, 10 ** 9, 1)],
                               "e long, p long, c long, x long")
    got = [r[0] for r in df.select(media.meta_summary(*[F.col(c) for c in "epcx"])).collect()]
    assert got == ["E:1 P:2 C:3 X:4", "", "E:1000000000 P:1000000000 C:10"]


def test_model_size(spark):
    df = spark.createDataFrame([(640, 480), (100, 100), (4000, 100)], "w int, h int")
    got = [tuple(r[0]) for r in df.select(media.model_size(F.col("w"), F.col("h"))).collect()]
    assert got == [(512, 384, 512, 384), (384, 384, 384, 384), (15360, 384, 1024, 384)]


def test_card(spark):
    df = spark.createDataFrame([("abcdefgh", "jpg", 3, 2048, 640, 480, 172800.0, "2024-01-02", "E:1"),
                                ("abcdefgh", "png", 0, 10, 1, 1, 1.0, None, None)],
                               "hash string, ext string, hist_len long, size long, width int, height int, "
                               "age_seconds double, taken string, meta string")
    df = df.withColumn("taken", F.col("taken").cast("timestamp_ntz"))
    got = [r.label for r in cards.catalog_cards(df).collect()]
    assert got == ["abcd.jpg [3]\n2.0 Kb  (640x480)\n 2 days ago  [2024-01-02] E:1",
                   "abcd.png\n10 b  (1x1)\n 1 seconds ago  "]


def test_distances_to_one_vector_equal_the_plain_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[0.6, 0.8], [1.0, 0.0], [-1.0, 0.0], [2.0, 3.0], [nan, 1.0], [inf, 1.0], [-inf, 1.0], [inf, -inf], [None, 1.0], [0.6], [0.6, 0.8, 0.1], [], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id int, v array<float>").repartition(3)
    for query in ([0.6, 0.8], [0.0, 0.0], [nan, 1.0], [1.0, inf], [None, 1.0], [1.0], [], None):
        q = F.lit(None).cast("array<double>") if query is None else F.array(*map(F.lit, query)).cast("array<double>")
        got = df.select("id", F.round(vectors.distance_to(F.col("v"), query), 6).alias("a"), F.round(vectors.distance(F.col("v"), q), 6).alias("b")).collect()
        assert [r for r in got if r.a != r.b] == [] and len(got) == len(rows)
