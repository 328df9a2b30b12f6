import gzip
import hashlib
import io

import pytest

from sentrylake.llm import warc

BIG = "é<p>" * 60


def pages(spark):
    rows = [(5, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (9, None, BIG), (1, "http://c/", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", BIG), (2, "u", BIG)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    got = sorted(map(str, map(tuple, warc.round_trip(df).collect())))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and i != 2
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(map(str, want))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_gzip(spark, tmp_path):
    df, _ = pages(spark)
    path = f"{tmp_path}/w"
    warc.write_pages(df.where("page_id = 5"), path)
    (f,) = tmp_path.glob("w/*.warc.gz")
    data = gzip.decompress(f.read_bytes())
    head, _, rest = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest.endswith(b"\r\n\r\n")
    block = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    assert rest[:block].partition(b"\r\n\r\n")[2] == BIG.encode()


def archive(members):
    return io.BytesIO(b"".join(members))


def records():
    out = []
    for i in range(4):
        body = f"body {i} ".encode() * 5000
        out.append((body, warc.record("response", f"id:{i}", f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)))
    return out


def test_headers_first_and_skipped_payloads():
    r = records()
    decoded = []
    for make in (warc.member, gzip.compress):
        stream = archive([make(x) for _, x in r])
        size = len(stream.getvalue())
        assert [x["payload"] for x in warc.read_archive(stream, size)] == [b for b, _ in r]
        decoded.clear()
        only = [warc.EqualTo(("record_id",), "id:2")]
        got = list(warc.read_archive(stream, size, only, count=decoded.append))
        assert [x["payload"] for x in got] == [r[2][0]] and decoded == [len(r[2][0])]
        decoded.clear()
        assert len(list(warc.read_archive(stream, size, payload=False, count=decoded.append))) == 4 and not decoded


def test_cut_archive_is_an_error():
    data = warc.member(records()[0][1])
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-300]), len(data) - 300))


def test_filters_are_pushed_down(spark, tmp_path):
    df, _ = pages(spark)
    path = f"{tmp_path}/w"
    warc.write_pages(df, path)
    found = warc.read_warc(spark, path).where("record_type = 'revisit' and content_length < 200")
    assert sorted(r.record_id for r in found.collect()) == ["urn:sentrylake:page:5", "urn:sentrylake:page:9"]
    reader = warc.WarcReader({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")])) == [warc.EqualTo(("payload",), b"x")]
    assert len(reader.filters) == 1 and sum(len(p.files) for p in reader.partitions()) >= 1
    heads = warc.read_warc(spark, path, payload=False).where("record_type = 'response'")
    assert {r.payload for r in heads.collect()} == {None}


def test_paths_are_of_the_default_store(spark, tmp_path):
    assert warc.qualified(spark, "/a/b") == warc.qualified(spark, "file:///a/b") == "file:/a/b"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://other/")
    conf.set("fs.viewfs.mounttable.other.link./x", f"file://{tmp_path}")
    try:
        assert warc.qualified(spark, "/x/y") == "viewfs://other/x/y"
    finally:
        conf.set("fs.defaultFS", before)
