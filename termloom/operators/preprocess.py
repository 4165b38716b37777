"""Raw text tables to analyzed ones, by the analyzer chain of a mode, with counts of good and bad rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import analyze, join_tokens
from termloom.sources import sinks, tables
from termloom.sources.lineage import written


def analyzed_fields(rows: DataFrame, fields: tuple[str, ...], mode: str) -> DataFrame:
    """rows with each of the fields analyzed and joined by spaces; equal texts are analyzed once."""
    rows = written(rows, "raw")  # read for the texts, then for the rows
    texts = None
    for f in fields:
        own = rows.select(F.coalesce(f, F.lit("")).alias("text"))
        texts = own if texts is None else texts.unionByName(own)
    # long texts are keys of one join by their hashes
    key = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("text"), c).alias("b"))
    distinct = texts.withColumn("key", key(F.col("text"))).dropDuplicates(["key"])
    done = written(analyze(distinct, "key", "text", mode).select("key", join_tokens(F.col("tokens")).alias("analyzed")), "analyzed")
    for f in fields:
        rows = rows.withColumn("key", key(F.coalesce(f, F.lit("")))).join(done, "key").withColumn(f, F.col("analyzed")).drop("key", "analyzed")
    return rows


def preprocess(spark: SparkSession, dataset: str, mode: str, source: str, target: str) -> tuple[int, int]:
    """Analyze the raw table at `source` ("clicks" or "corpus") into tab-separated rows at `target`; the numbers of good and bad lines.

    Lines without four fields are bad. Clicks become qid, query, docid, and those whose query has no tokens are bad too; documents
    become docid, title, body and all stay.
    """
    if dataset not in ("clicks", "corpus"):
        raise ValueError(f"unknown dataset {dataset!r}; clicks or corpus")
    lines = tables.text_lines(spark, source)
    names = tables.CLICKS if dataset == "clicks" else tables.CORPUS
    rows = tables.split_rows(lines, names).drop("url")
    if dataset == "clicks":
        out = analyzed_fields(rows, ("query",), mode).where("query <> ''").select(*tables.ANALYZED_CLICKS)
    else:
        out = analyzed_fields(rows, ("title", "body"), mode).select(*tables.ANALYZED_CORPUS)
    good = written(out, "preprocessed")
    sinks.tab_rows(good, target)
    n = good.count()
    return n, lines.count() - n
