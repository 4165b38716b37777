"""Written tables that cut the lineage of loops, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; a temporary folder of its own where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='termloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths that this process gave out, by application.
GIVEN: dict[str, list[str]] = {}


def path_of(spark, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/termloom/{name}-{uuid.uuid4().hex}"
    GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark) -> int:
    """Remove what this application wrote to the shared folder, once its results are safe elsewhere; the number of paths removed."""
    paths = GIVEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: a lost executor costs a re-read, a later plan begins here."""
    spark = df.sparkSession
    path = path_of(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
