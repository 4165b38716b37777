import base64
import hashlib
import struct

import zstandard
from pyspark.sql import functions as F

from termloom.llm import warc
from termloom.llm.registry import queries


def test_pages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = queries()["op3_warc"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        p = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[p] == r.page_id else ("revisit", first[p]))


def test_odd_rows_round_trip(spark):
    rows = [(1, "http://a/\r\nX: 1 é", "<p>x</p>", 0), (2, None, "<p>x</p>", 0), (3, "u", None, 0), (4, "u", "", 0), (None, "n", "<p>x</p>", 0), (1, "again", "<p>x</p>", 0), (6, "u", "é\r\n\r\n" * 300_000, 0), (7, "u", "<b>" + "q" * 30, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    archives = warc.write_pages(pages)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload) for r in warc.read_pages(archives).collect()), key=str)
    x = b"<p>x</p>"
    want = [(1, "response", None, x), (1, "response", None, x), (2, "revisit", 1, None), (3, "response", None, b""), (4, "revisit", 3, None), (None, "revisit", 1, None), (6, "response", None, ("é\r\n\r\n" * 300_000).encode()), (7, "response", None, ("<b>" + "q" * 30).encode())]
    assert got == sorted(((a, b, c, d and bytearray(d) or (None if d is None else bytearray())) for a, b, c, d in want), key=str)
    short = warc.read_pages(warc.write_pages(pages, min_bytes=9)).collect()
    assert {r.record_type for r in short if r.payload_bytes < 9} == {"response"}
    assert warc.read_pages(warc.write_pages(pages.where(F.lit(False)))).count() == 0


def test_hot_payloads_stay_where_they_are(spark):
    """A third of all pages share a payload, and many pairs share others: the same records whatever the way of the join."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 1500).cast("string"))).alias("html"))
    got = warc.read_pages(warc.write_pages(pages), payloads=False).collect()
    first = {}
    for r in pages.orderBy("page_id").collect():
        first.setdefault(r.html, r.page_id)
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == 3000
    for r in got:
        f = first[html[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if f == r.page_id else ("revisit", f))


def test_archive_layout(tmp_path):
    records = [warc.record(i, f"http://h/{i}", f"<html><body>page {i} {'lorem ipsum ' * (i % 7)}</body></html>".encode() * 3, None, False, "2000-01-01T00:00:00Z") for i in range(500)]
    path = f"file://{tmp_path}/a/x.warc.zst"
    offsets, length = warc.write_archive(path, records, 8192, 1 << 20, 3)
    data = (tmp_path / "a/x.warc.zst").read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and offsets[0] == 8 + size and length == len(data)
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert alone.decompress(data[offsets[41] : offsets[42]]) == records[41]
    assert list(warc.read_archive(path, offsets, length)) == records
    assert len(data) < sum(len(zstandard.compress(r)) for r in records)
