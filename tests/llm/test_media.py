import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from termloom.llm import media
from termloom.llm.registry import queries


def expected(text):
    data = (text or "").encode()
    payload = data + b" " * (-len(data) % 192 if data else 192)
    stored = b"P6\n# bytes %d\n64 %d\n255\n" % (len(data), len(payload) // 192) + payload
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()


def values(r):
    return r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op7_media"](spark, sf).collect()
    assert len(got) == len(docs) and all(values(r) == expected(docs[r.doc_id]) for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(docs[r.doc_id], r.feature) == r.feature


def brute_feature(text):
    """Shape, channel means and the bits of an 8 x 8 average hash, sample by sample with exact fractions."""
    from fractions import Fraction

    data = (text or "").encode()
    data += b" " * (-len(data) % 192 if data else 192)
    rows = len(data) // 192
    means = [Fraction(sum(data[c::3]), rows * 64) for c in range(3)]
    light = [[299 * data[192 * y + 3 * x] + 587 * data[192 * y + 3 * x + 1] + 114 * data[192 * y + 3 * x + 2] for x in range(64)] for y in range(rows)]
    cells = []
    for i in range(8):
        a = min(i * rows // 8, rows - 1)
        b = max((i + 1) * rows // 8, a + 1)
        cells += [Fraction(sum(light[y][x] for y in range(a, b) for x in range(8 * j, 8 * j + 8)), b - a) for j in range(8)]
    bits = "".join("1" if c > sum(cells) / 64 else "0" for c in cells)
    return f"64x{rows};" + ",".join(f"{float(m):.4f}" for m in means) + f";{int(bits, 2):016x}"


def test_features_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op7_media"](spark, sf).collect()
    assert len(got) == len(texts) and all(r.feature == brute_feature(texts[r.doc_id]) for r in got)
    assert all(media.feature(media.from_media(media.to_media(t))[2]) == brute_feature(t) for t in (None, "a", "x" * 5000, "é\n" * 800))


def test_odd_rows(spark):
    texts = [None, "", "x" * 192, "x" * 193, "é" * 400_000, "x" * 192, "\x00\r\nP6"]
    docs = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(texts)), (None, "n", 1), (2, "x" * 192, 1)], "doc_id long, text string, name int")
    folder = media.store_texts(docs, archive_bytes=5000)
    got = media.media_features(media.read_media(spark, folder, rangeBytes=700, batchBytes=300)).collect()
    want = [*((i, *expected(t)) for i, t in enumerate(texts)), (None, *expected("n")), (2, *expected("x" * 192))]
    assert sorted(((r.doc_id, *values(r)) for r in got), key=str) == sorted(want, key=str)
    assert media.media_features(media.read_media(spark, media.store_texts(docs.where(F.lit(False))))).count() == 0


def test_ranges_are_packed(spark):
    """Each byte in one range, and no more tasks than asked for, give or take one for each archive that a range doesn't fill."""
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 90)) for i in range(300)], "doc_id long, text string").repartition(5)
    folder = media.store_texts(docs, archive_bytes=20_000)
    sizes = {r.path: r.bytes for r in spark.read.parquet(f"{folder}/list").collect()}
    for options in ({"rangeBytes": "100"}, {"rangeBytes": "100", "maxPartitions": "3"}, {}):
        parts = media.ArchiveReader({"path": folder, **options}).partitions()
        seen = {}
        for part in parts:
            for r in part.ranges:
                assert r.begin == seen.get(r.path, 0)
                seen[r.path] = r.end
        assert seen == sizes and ("maxPartitions" not in options or len(parts) <= 6)
        assert media.media_features(media.read_media(spark, folder, **options)).count() == 300


def test_one_bad_member_leaves_the_others(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    folder = media.store_texts(docs)
    (path,) = [r.path for r in spark.read.parquet(f"{folder}/list").collect()]
    at = sorted(media.read_media(spark, folder).collect(), key=lambda r: r.offset)
    file = path.removeprefix("file://")
    data = bytearray(open(file, "rb").read())
    data[at[7].offset + 60] ^= 255
    open(file, "wb").write(bytes(data))
    rows = media.read_media(spark, folder, onError="null", retries=1).collect()
    assert [r.name for r in rows if r.error] == [at[7].name] and len(rows) == 40
    with pytest.raises(Exception, match="at "):
        media.read_media(spark, folder, retries=0).collect()


def test_a_failing_read_is_tried_again():
    calls = []

    class Flaky(media.ArchiveReader):
        def member(self, handle, m):
            calls.append(m.header_offset)
            if len(calls) == 2:
                raise OSError("gone")
            return super().member(handle, m)

    import tempfile
    import zipfile

    with tempfile.TemporaryDirectory() as d:
        with zipfile.ZipFile(f"{d}/x.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(4):
                z.writestr(f"{i:06d}-{i}.ppm", media.to_media(f"text {i}"))
        reader = Flaky({"path": d})
        rows = list(reader.members(media.ByteRange(f"file://{d}/x.zip", 0, 1 << 20)))
    assert [r["error"] for r in rows] == [None] * 4 and len(calls) == 5 and calls[1] == calls[2]
