"""Click edges from a growing log, as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_counts(clicks: DataFrame) -> DataFrame:
    """query, docid, w of a streaming or batch log; state is one count for each edge. Write it in update or complete mode."""
    return clicks.groupBy("query", "docid").agg(F.count(F.lit(1)).cast("double").alias("w"))


def windowed_edge_counts(clicks: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Edges by time window, with state dropped once a window is `late` behind; write it in append mode."""
    return clicks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "query", "docid").agg(F.count(F.lit(1)).cast("double").alias("w"))
