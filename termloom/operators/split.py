"""Splits of a click log by query, and filters of corpus and log against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sample_keys(keys: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n distinct keys (or all), drawn by a seeded hash that any engine can repeat."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return keys.select(key).distinct().orderBy(order, key).limit(n)


def held_out(log: DataFrame, test: DataFrame, key: str = "qid") -> DataFrame:
    return log.join(test, key, "left_semi")


def remaining(log: DataFrame, test: DataFrame, key: str = "qid") -> DataFrame:
    return log.join(test, key, "left_anti")


def clicked_documents(corpus: DataFrame, clicks: DataFrame) -> DataFrame:
    return corpus.join(clicks.select("docid").distinct(), "docid", "left_semi")


def missing_documents(clicks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Clicked docids that the corpus lacks."""
    return clicks.select("docid").distinct().join(corpus.select("docid"), "docid", "left_anti")


def first_clicks(clicks: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The first n clicks of each document in the log's order."""
    return clicks.withColumn("nth", F.row_number().over(W.partitionBy("docid").orderBy(order))).where(F.col("nth") <= n)


def queries_of(clicks: DataFrame, order: str = "line_no") -> DataFrame:
    """docid, queries: a document's queries in the log's order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "query")))
    return clicks.groupBy("docid").agg(F.transform(rows, lambda x: x["query"]).alias("queries"))


def busiest_documents(clicks: DataFrame, corpus: DataFrame, least: int, n: int) -> DataFrame:
    """docid, n_queries of the n documents with most clicks, at least `least`."""
    counts = clicks.groupBy("docid").agg(F.count(F.lit(1)).alias("n_queries")).where(F.col("n_queries") >= least)
    return counts.join(corpus.select("docid"), "docid", "left_semi").orderBy(F.desc("n_queries"), "docid").limit(n)


def queries_per_document(clicks: DataFrame) -> DataFrame:
    """One row: least, most and mean number of queries of a document."""
    per = clicks.groupBy("docid").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.avg("n").alias("n_mean"))
