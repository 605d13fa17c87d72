import hashlib
import io

import pytest
from pyspark.sql import functions as F

from gramlode.llm import warc

BIG = "<html>" + "same words " * 40
ROWS = [(5, "u5", BIG), (2, None, BIG), (9, "u9", BIG), (None, "n", BIG), (2, "again", BIG), (3, "a", "short"), (4, "b", "short"), (6, "c", None), (7, "d", ""), (8, "e", "x" * 300_000), (11, "f\r\nInjected: 1", "é" * 99)]


@pytest.mark.parametrize("split", [64, 1000, 4 << 20])
def test_round_trip(spark, tmp_path, split):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'z' as digest", "'q' as payload")
    files = warc.write_warc(pages.repartition(2), f"file://{tmp_path}/w{split}")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(files, split).collect()]
    want = []
    for i, _, text in ROWS:
        data = (text or "").encode()
        revisit = text == BIG and i != 2
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r.url or "" for r in warc.read_warc(files, split).collect())[0] == ""


def test_false_magic_and_ranges():
    parts = [warc._member(warc.record(i, "u", b"p" * (i * 50), "d", None)) for i in range(20)]
    data = warc.MAGIC + b"junk" + b"".join(parts[:10]) + warc.MAGIC * 3 + b"".join(parts[10:])
    read = lambda at, n: data[at : at + n]
    for size in (1, 7, 100, len(data)):
        got = [warc.parsed(c)["page_id"] for b in range(0, len(data), size) for _, c in warc.members(read, b, min(b + size, len(data)), len(data))]
        assert got == list(range(20))


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(none, f"file://{tmp_path}/none")).count() == 0
