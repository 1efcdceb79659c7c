import hashlib

import pytest

from placelink.llm import warc

INNER = "<p>x</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:placelink:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\njunk WARC/1.1\r\n" + "é" * 70


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "40000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_round_trip(spark, small_splits):
    rows = [(k, f"http://h/{k}", f"<html>{k % 40}" + "text " * (k % 97) * 20) for k in range(300)]
    rows += [(9001, None, INNER), (9000, "u v", INNER), (None, "x", INNER), (9002, "x\r\ny", None), (9003, "x", "short"), (9004, "x", "short"), (9005, "x", "x" * 300_000 + "WARC/1.1\r\n"), (9000, "u", INNER), (9006, "x", "")]
    rows += [(9100 + k, "x", f"<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n{k}" + "y" * 120) for k, n in enumerate(("9" * 23, "9" * 5_000, "9" * 18, "-1", "1e9", "٣"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    first = {}
    for ident, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and ident is not None:
            first[body] = min(first.get(body, ident), ident)
    want = []
    for ident, _, html in rows:
        body = (html or "").encode()
        f = first.get(body)
        want.append((ident, len(body), digest(body), "revisit", f) if f is not None and ident != f else (ident, len(body), digest(body), "response", None))
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == sorted(want, key=str)


def test_splits_do_not_change_what_is_read(spark, small_splits):
    rows = [(k, "u", f"{k} WARC/1.1\r\n" + "text " * (k % 50) + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n") for k in range(600)]
    folder = warc.shared_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), folder)
    first = warc.read(spark, folder)  # its candidates are found under these splits
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    assert sorted(r.page_id for r in warc.page_rows(first).collect()) == list(range(600))
    again = warc.page_rows(warc.read(spark, folder)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in again) == [(k, len(html)) for k, _, html in rows]


def test_empty_and_broken(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string, id int")
    assert warc.round_trip(empty).count() == 0
    good = "WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for name, text in (("a.warc", good + "rubbish"), ("b.warc", "rubbish" + good), ("c.warc", good + "WARC/1.1\r\nContent-Length: x\r\n\r\n")):
        (tmp_path / name).write_bytes(text.encode())
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.file[-6:], r.at, r.type, r.payload_bytes) for r in got) == [("a.warc", 0, "resource", 2), ("c.warc", 0, "resource", 2)]
