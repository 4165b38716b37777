"""Media columns: pixel maps in ZIP archives, read by a data source that plans byte ranges over the archives' directories.

store_texts() makes each text a binary PPM of 64 pixels a row, its bytes being the samples, and writes archives from Spark tasks.
A table in the archives' folder lists those that finished tasks wrote; a lost task's leavings aren't in it. The data source
`termloom_archive` cuts the listed archives into byte ranges. A range's task reads the archive's central directory, takes the
members that begin in its range, reads each by its own offset, checks its CRC, and tries a failing member again on a fresh handle
without giving up the others. Members leave in Arrow batches of bounded size. With onerror "null" a member that keeps failing
becomes a row with its error, with "fail" (the default) it fails the task.

Defined results: null and empty texts are one row of spaces; repeated rows are members of their own; equal texts give equal
media; an empty table writes no archive and reads as an empty table; columns besides doc_id and text are ignored. One text at a
time is held whole, so a text is limited by a worker's memory alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from termloom.llm.shared import lean, scratch, table

WIDTH, UNIT = 64, 192
LISTING = "path string, bytes bigint, members bigint"
MEMBER = "archive string, offset bigint, name string, media binary, error string"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_media(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    payload = padded(data)
    return b"P6\n# bytes %d\n%d %d\n255\n" % (len(data), WIDTH, len(payload) // UNIT) + payload


def from_media(media: bytes) -> tuple[int, int, bytes]:
    """Length of the text, rows of pixels, and all samples."""
    kind, note, shape, top, samples = media.split(b"\n", 4)
    width, rows = map(int, shape.split())
    if kind != b"P6" or width != WIDTH or top != b"255" or len(samples) != rows * UNIT:
        raise ValueError("not a pixel map that store_texts() wrote")
    return int(note.split()[-1]), rows, samples


def feature(samples: bytes) -> str:
    """Shape, mean of each channel, and an 8 x 8 average hash of the luminance, in whole numbers until the last division."""
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH, 3)
    rows = len(pixels)
    means = pixels.sum((0, 1), dtype=np.int64) / (rows * WIDTH)
    light = (pixels @ np.array([299, 587, 114], np.int32)).reshape(rows, 8, 8).sum(2, dtype=np.int64)
    edges = np.minimum(np.arange(8) * rows // 8, rows - 1)
    ends = np.maximum(np.arange(1, 9) * rows // 8, edges + 1)
    run = np.concatenate([np.zeros((1, 8), np.int64), light.cumsum(0)])
    cells = (run[ends] - run[edges]) / (ends - edges)[:, None]
    bits = (cells > cells.mean()).ravel()
    return f"{WIDTH}x{rows};" + ",".join(f"{m:.4f}" for m in means) + f";{np.packbits(bits).tobytes().hex()}"


def store_texts(docs: DataFrame, archive_bytes: int = 32 << 20, level: int = 3) -> str:
    """Write all texts as media into archives and return their folder."""
    spark = docs.sparkSession
    folder = scratch(spark, "media")

    def write(batches):
        task, count = TaskContext.get(), 0
        held, size = [], 0

        def flush():
            nonlocal count
            path = f"{folder}/archives/{task.partitionId():05d}-{count:05d}-{task.taskAttemptId()}.zip"
            store, at = fs.FileSystem.from_uri(path)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
                for k, (doc_id, media) in enumerate(held):
                    z.writestr(zipfile.ZipInfo(f"{k:06d}-{'' if doc_id is None else doc_id}.ppm"), media, zipfile.ZIP_DEFLATED, level)
            length = store.get_file_info(at).size
            count += 1
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [length], "members": [len(held)]}, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                held.append((doc_id.as_py(), to_media(text.as_py())))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    docs.select("doc_id", "text").mapInArrow(lean(write), LISTING).write.parquet(f"{folder}/list")
    return folder


class ByteRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class Ranges(InputPartition):
    """What one task reads: one range, or several where a range for each task would make too many tasks."""

    def __init__(self, ranges: list[ByteRange]):
        self.ranges = ranges


class ArchiveSource(DataSource):
    """spark.read.format("termloom_archive").option("path", folder): all members of the folder's listed archives."""

    @classmethod
    def name(cls) -> str:
        return "termloom_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 8 << 20)))
        self.most = int(options.get("maxpartitions", options.get("maxPartitions", 20_000)))
        self.batch_bytes = int(options.get("batchbytes", options.get("batchBytes", 4 << 20)))
        self.retries = int(options.get("retries", 3))
        self.onerror = options.get("onerror", options.get("onError", "fail"))

    def partitions(self) -> list[Ranges]:
        import pyarrow.dataset as ds

        store, at = fs.FileSystem.from_uri(f"{self.folder}/list")
        found = ds.dataset(at, filesystem=store, format="parquet").to_table(["path", "bytes"]).to_pylist() if store.get_file_info(at).type != fs.FileType.NotFound else []
        step = max(self.range_bytes, -(-sum(a["bytes"] for a in found) // self.most))  # large ranges, so each directory is read few times
        cuts = [ByteRange(a["path"], k, min(k + step, a["bytes"])) for a in sorted(found, key=lambda a: a["path"]) for k in range(0, a["bytes"], step)]
        parts, size = [], step
        for c in cuts:
            if size + c.end - c.begin > step:
                parts.append(Ranges([]))
                size = 0
            parts[-1].ranges.append(c)
            size += c.end - c.begin
        return parts or [Ranges([])]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for own in part.ranges:
            for row in self.members(own):
                rows.append(row)
                size += len(row["media"] or b"")
                if size >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows or not part.ranges:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())]))

    def open(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        return store.open_input_file(at)

    def members(self, part: ByteRange) -> Iterator[dict]:
        handle = self.open(part.path)
        try:
            with zipfile.ZipFile(handle) as z:
                own = [m for m in z.infolist() if part.begin <= m.header_offset < part.end]
            handle = self.open(part.path) if handle.closed else handle
            for m in own:
                row = {"archive": part.path, "offset": m.header_offset, "name": m.filename, "media": None, "error": None}
                for attempt in range(self.retries + 1):
                    try:
                        row |= {"media": self.member(handle, m), "error": None}
                        break
                    except Exception as e:  # any fault of this member; the others aren't read again
                        row["error"] = f"{type(e).__name__}: {e}"[:500]
                        handle.close()
                        time.sleep(0.05 * attempt)
                        handle = self.open(part.path)
                if row["error"] and self.onerror != "null":
                    raise OSError(f"{part.path} at {m.header_offset}: {row['error']}")
                yield row
        finally:
            handle.close()

    def member(self, handle: io.RawIOBase, m: zipfile.ZipInfo) -> bytes:
        """A member by its offset alone, checked against the directory's length and CRC."""
        handle.seek(m.header_offset)
        head = handle.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        names, extra = struct.unpack("<HH", head[26:30])
        handle.seek(m.header_offset + 30 + names + extra)
        data = handle.read(m.compress_size)
        data = zlib.decompress(data, -15) if m.compress_type == zipfile.ZIP_DEFLATED else data
        if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
            raise ValueError("length or CRC differ from the directory's")
        return data


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    """archive, offset, name, media, error of every member."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("termloom_archive").options(**{k: str(v) for k, v in options.items()}).load(folder)


def media_features(members: DataFrame) -> DataFrame:
    """doc_id, lengths, digests and features from the media read back."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, media in zip(batch["name"].to_pylist(), batch["media"]):
                media = media.as_py()
                if media is None:
                    continue
                n, _, samples = from_media(media)
                doc_id = name[:-4].partition("-")[2]
                rows.append({
                    "doc_id": int(doc_id) if doc_id else None, "n_bytes": n, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]),
                    "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(samples),
                })
            names = [f.split()[0] for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k in names]))

    return members.select("name", "media").mapInArrow(lean(run), FEATURES)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_media(spark, store_texts(table(spark, sf_dir, "documents"))))
