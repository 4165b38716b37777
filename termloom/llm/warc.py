"""WARC archives with a Zstandard dictionary in front, written and read by Spark tasks.

Each task gathers records up to `archive_bytes`, trains a dictionary from them, and writes an archive: a leading skippable frame
(magic 0x184D2A5D) that holds the dictionary, then every record as a frame of its own. Of records with equal payloads the one
with the smallest page_id is the response, the others are revisits that refer to it and carry no body. A table lists the archives
that finished tasks wrote, with the offsets of their records; what a lost or repeated task left behind isn't in it, and reading
starts from that table. Archives lie in the folder that driver and executors share.

Defined results: null html is an empty payload; all rows that share the smallest page_id of a payload are responses; a null page_id
counts as larger than any other; payloads under min_bytes are all responses; null or odd urls are percent-encoded; an empty table
writes no archive and reads as an empty table. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.shared import lean, materialize, scratch, table

MAGIC = 0x184D2A5D
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records bigint, bytes bigint, offsets array<bigint>"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. The page's number goes in a header of its own, as does the length a revisit's payload has."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"" if revisit else HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe='!#$%&()*+,/:;=?@[]~-._')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; raises ValueError where digest or lengths don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != int(fields["X-Payload-Length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("X-Refers-To-Page"), "payload_digest": digest, "payload_bytes": number("X-Payload-Length"), "payload": payload}


def dictionary(records: list[bytes], size: int, sample_bytes: int):
    """A dictionary trained on evenly spaced records, or None where they're too few or too alike to train on."""
    import zstandard

    step = max(1, sum(map(len, records)) // sample_bytes)
    samples = [r[: sample_bytes // 8] for r in records[::step]]
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def write_archive(path: str, records: list[bytes], size: int, sample_bytes: int, level: int) -> tuple[list[int], int]:
    """Offsets of the records and the archive's length. The file appears under its name only when it's whole."""
    import zstandard

    trained = dictionary(records, size, sample_bytes)
    press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    offsets = []
    with store.open_output_stream(at + ".partial", compression=None) as out:
        if trained is not None:
            data = trained.as_bytes()
            out.write(struct.pack("<II", MAGIC, len(data)) + data)
        for r in records:
            offsets.append(out.tell())
            out.write(press.compress(r))
        length = out.tell()
    store.move(at + ".partial", at)
    return offsets, length


def read_archive(path: str, offsets: list[int], length: int) -> Iterator[bytes]:
    """The records of an archive, each read by its own offset."""
    import zstandard

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        trained, head = None, f.read(8)
        if len(head) == 8 and struct.unpack("<II", head)[0] == MAGIC:
            trained = zstandard.ZstdCompressionDict(f.read(struct.unpack("<II", head)[1]))
        expand = zstandard.ZstdDecompressor(dict_data=trained)
        for a, b in zip(offsets, [*offsets[1:], length]):
            f.seek(a)
            yield expand.decompress(f.read(b - a))


def write_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 16 << 20, archive_records: int = 20_000, dict_bytes: int = 32 << 10, sample_bytes: int = 2 << 20, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write an archive per `archive_bytes` of records and return the table of archives."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    long_enough = F.length("payload") >= min_bytes
    again = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again, _ = materialize(again, "repeated")
    # payloads of over a thousandth of all repeated pages, hence under a thousand: their pages stay where they are
    hot = F.col("n") * 1000 > (again.agg(F.sum("n")).first()[0] or 0)
    often = F.broadcast(again.where(hot).select("digest", F.col("first").alias("hot_first")))
    rows = rows.join(often, "digest", "left").withColumn("key", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit(":"), F.xxhash64("page_id", "url").cast("string"))))
    rare = again.where(~hot).select(F.col("digest").alias("key"), F.col("first").alias("rare_first"))
    rows = rows.join(rare, "key", "left").withColumn("first", F.when(long_enough, F.coalesce("hot_first", "rare_first"))).select("page_id", "url", "payload", "first")

    def write(batches):
        task, held, count = TaskContext.get(), [], 0

        def flush():
            nonlocal held, count
            path = f"{folder}/{task.partitionId():05d}-{count:05d}-{task.taskAttemptId()}.warc.zst"
            offsets, length = write_archive(path, held, dict_bytes, sample_bytes, level)
            row = pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [length], "offsets": [offsets]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("offsets", pa.list_(pa.int64()))]))
            held, count = [], count + 1
            return row

        size = 0
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch[k] for k in ("page_id", "url", "payload", "first"))):
                page_id, first = page_id.as_py(), first.as_py()
                held.append(record(page_id, url.as_py(), payload.as_py(), first, first is not None and page_id != first, date))
                size += len(held[-1])
                if size >= archive_bytes or len(held) >= archive_records:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return materialize(rows.mapInArrow(lean(write), MANIFEST), "warc-list")[0]


def read_pages(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the listed archives, checked against its digest; payload is null for revisits, or for all without `payloads`."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    schema = pa.schema([(n, {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])

    def read(batches):
        for batch in batches:
            for a in batch.to_pylist():
                rows, size = [], 0
                for data in read_archive(a["path"], a["offsets"], a["bytes"]):
                    rows.append(parse(data))
                    size += len(data)
                    if not payloads:
                        rows[-1]["payload"] = None
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spread = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.repartition(spread, "path").mapInArrow(lean(read), RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_pages(table(spark, sf_dir, "pages"))
    return read_pages(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, strlen(body) AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31), 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""
