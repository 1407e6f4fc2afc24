import base64
import gzip
import hashlib
import os
import uuid

import pytest

from framefold.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(1, "http://a/1", "aa"), (2, "http://a/2", "aa"), (3, None, "é\r\n\r\nWARC/1.1"), (4, "v\nx", None), (5, "u", "aa"), (None, "u", "aa"), (6, "u", ""), (7, "u", "x" * 3_000_000), (8, "u", "b"), (8, "u", "b")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, payload string, size int").repartition(3)
    warc.write_archives(warc.page_records(pages), path)
    return path


def test_round_trip(spark, archive):
    found = warc.read_archives(spark, archive).where("warc_type <> 'warcinfo'").collect()
    want = []
    for page, url, html in ROWS:
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        refers = max(same) if page is not None and max(same) != page else None
        want.append((f"<urn:page:{page}>" if page is not None else None, refers and f"<urn:page:{refers}>", len((html or "").encode()), "sha1:" + digest(html), None if refers else (html or "").encode(), url and " ".join(url.split())))
    got = [(r["record_id"] if "page" in r["record_id"] else None, r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"] and bytes(r["payload"]) if r["payload"] else (None if r["warc_type"] == "revisit" else b""), r["target_uri"]) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_least_bytes(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    kinds = {r["record_id"]: r["warc_type"] for r in warc.page_records(pages, least_bytes=2).collect()}
    assert kinds["<urn:page:1>"] == "revisit" and kinds["<urn:page:4>"] == "response"


def test_pushed_filters(spark, archive):
    plan = warc.read_archives(spark, archive).where("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    reader = warc.WarcReader({"path": archive})
    reader.wanted = [("warc-type", {"revisit"}), ("warc-target-uri", {"http://a/1"})]
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r["record_id"] for r in rows] == ["<urn:page:1>"]
    without = warc.read_archives(spark, archive, payload=False).where("warc_type = 'response'").collect()
    assert without and all(r["payload"] is None for r in without)


def test_files_are_plain_warc(archive):
    folder = archive.removeprefix("file://")
    for name in os.listdir(folder):
        if name.endswith(".warc.gz"):
            data = gzip.open(f"{folder}/{name}").read()
            while data:
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
                assert head.startswith(b"WARC/1.1\r\n")
                size = int(fields[b"Content-Length"])
                assert rest[size:size + 4] == b"\r\n\r\n"
                data = rest[size + 4:]


def test_uncommitted_files_are_not_read(spark, archive):
    folder = archive.removeprefix("file://")
    with open(f"{folder}/pages-lost.warc.gz", "wb") as f:
        f.write(b"left over")
    assert warc.read_archives(spark, archive).where("warc_type <> 'warcinfo'").count() == len(ROWS)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archives(warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read_archives(spark, path).where("warc_type <> 'warcinfo'").count() == 0


def test_a_second_write_adds_and_an_overwrite_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/twice"
    records = lambda i: warc.page_records(spark.createDataFrame([(i, "u", f"page {i}")], "page_id long, url string, html string"))
    ids = lambda: sorted(r["record_id"] for r in warc.read_archives(spark, path).where("warc_type <> 'warcinfo'").collect())
    warc.write_archives(records(1), path)
    warc.write_archives(records(2), path)
    assert ids() == ["<urn:page:1>", "<urn:page:2>"]
    warc.write_archives(records(3), path, "overwrite")
    assert ids() == ["<urn:page:3>"]
    warc.write_archives(records(4), path)
    assert ids() == ["<urn:page:3>", "<urn:page:4>"]


def foreign(i, payload):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:other:{i}>\r\nContent-Length: {len(payload) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_folders_of_other_tools(spark, tmp_path):
    """No manifest, no lengths in gzip headers, a member per record or one for all, a file in a subfolder."""
    folder = tmp_path / "others"
    (folder / "sub").mkdir(parents=True)
    big = os.urandom(700_000)
    with open(folder / "a.warc.gz", "wb") as f:
        for i, payload in enumerate([b"one", big, b""]):
            f.write(gzip.compress(foreign(i, payload)))
    (folder / "sub" / "b.warc.gz").write_bytes(gzip.compress(foreign(3, b"x\r\n") + foreign(4, big) + foreign(5, b"last")))
    path = f"file://{folder}"
    want = {f"<urn:other:{i}>": p for i, p in enumerate([b"one", big, b"", b"x\r\n", big, b"last"])}
    rows = warc.read_archives(spark, path).collect()
    assert {r["record_id"]: bytes(r["payload"]) for r in rows} == want and len(rows) == 6
    assert {r["record_id"]: r["payload_bytes"] for r in rows} == {k: len(v) for k, v in want.items()}
    assert [r["record_id"] for r in warc.read_archives(spark, path).where("record_id = '<urn:other:5>'").collect()] == ["<urn:other:5>"]
    warc.write_archives(warc.page_records(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")), path)
    assert warc.read_archives(spark, path).where("warc_type <> 'warcinfo'").count() == 7


def test_files_are_split_at_members_and_unwanted_ones_are_not_read(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PARTITION_BYTES", 300_000)
    path = f"file://{tmp_path}/split"
    writer = warc.WarcWriter({"path": path}, False)
    fields = ["warc_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"]
    sent = [dict(zip(fields, ("response", f"<urn:page:{i}>", "u", "d", 200_000, None, os.urandom(200_000)))) for i in range(40)]
    import pyarrow as pa

    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(sent)])), None])
    reader = warc.WarcReader({"path": path})
    parts = reader.partitions()
    assert len(parts) > 10
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist() if r["warc_type"] == "response"]
    assert sorted((r["record_id"], r["payload"]) for r in rows) == sorted((r["record_id"], r["payload"]) for r in sent)

    inflated = []
    plain = warc.Records.more
    monkeypatch.setattr(warc.Records, "more", lambda self, most=1 << 16: inflated.append(plain(self, most)) or inflated[-1])
    reader.wanted = [("warc-record-id", {"<urn:page:7>"})]
    found = [r["payload"] for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert found == [sent[7]["payload"]]
    assert sum(map(len, inflated)) < 200_000 + 45 * 5000


def test_a_cut_file_raises(tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(foreign(0, os.urandom(5000)))[:-900])
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    with pytest.raises(EOFError):
        [b for p in reader.partitions() for b in reader.read(p)]
