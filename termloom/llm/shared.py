"""Tables and folders that the driver and all executors share.

Long plans and loops cut their lineage by writing a table under the folder that the cluster names in
spark.checkpoint.dir, so a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to Python; Spark's own default, which counts as unset, is 64 MB for each task and worker.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long, so a batch of Spark's default size costs more memory than all else that a worker holds."""
    key, default, own = BATCH
    if spark.conf.get(key) == default:
        spark.conf.set(key, own)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local session that names none, a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='termloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a path from the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path for drop()."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    spark._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of plans that have ended
    return spark.read.schema(df.schema).parquet(path), path


def lean(fn, rows: int | None = 512):
    """fn over Arrow batches for mapInArrow, fed in slices of a few rows, so that few texts are Python objects at a time; when a task
    ends, memory goes back to the system, since idle workers live on beside the executor."""

    def run(batches):
        try:
            yield from fn((b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)) if rows else batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows whose key may be among the keys (same column name): all that are, and few others while keys are under bits / 10.

    A Bloom filter of fixed size, whatever the number of keys, goes to all tasks; its words are or-ed by Spark. It spares wide rows
    the shuffle of an exact join, which is still needed after it.
    """
    spark = rows.sparkSession
    spots = lambda: F.array(*(F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(bits)) for k in range(3)))
    word = keys.where(F.col(key).isNotNull()).select(F.explode(spots()).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    words = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()  # bits / 64 rows at most
    held = np.zeros(bits >> 6, np.uint64)
    held[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(held)

    def probe(batches):
        for batch in batches:
            at = batch["__tl_spots"].flatten().to_numpy().astype(np.uint64).reshape(-1, 3)
            hit = ((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)
            yield batch.filter(pa.array(hit)).drop_columns(["__tl_spots"])

    return rows.withColumn("__tl_spots", spots()).mapInArrow(lean(probe), rows.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
