"""Readers of the pipeline's text tables. Columns are text by position; what a reader drops it can count (see `counted`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import strip

CLICKS = ("qid", "query", "docid", "url")
CORPUS = ("docid", "url", "title", "body")
ANALYZED_CORPUS = ("docid", "title", "body")
ANALYZED_CLICKS = ("qid", "query", "docid")
WEIGHT = "docid string, term string, probability double"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, one line a row; bytes that aren't UTF-8 become U+FFFD, gzip is read through."""
    return spark.read.text(path)


def counted(rows: DataFrame, good: Column, name: str) -> tuple[DataFrame, Observation]:
    """rows where good, and an observation that has n_good and n_bad once a result has been computed."""
    seen = Observation(name)
    ok = F.coalesce(good, F.lit(False))
    return rows.observe(seen, F.count_if(ok).alias("n_good"), F.count_if(~ok).alias("n_bad")).where(good), seen


def split_rows(lines: DataFrame, names: tuple[str, ...], keep_line: bool = False) -> DataFrame:
    """Rows of exactly len(names) tab-separated fields; the last field keeps its tabs. Other lines go."""
    parts = F.split("value", "\t", len(names))
    rows = lines.where(F.size(parts) == len(names))
    return rows.select(*(["value"] if keep_line else []), *(F.get(parts, k).alias(n) for k, n in enumerate(names)))


def raw_clicks(spark: SparkSession, path: str) -> DataFrame:
    return split_rows(text_lines(spark, path), CLICKS)


def raw_corpus(spark: SparkSession, path: str) -> DataFrame:
    return split_rows(text_lines(spark, path), CORPUS)


def clicked_ids(spark: SparkSession, path: str) -> DataFrame:
    return raw_clicks(spark, path).select("docid").distinct()


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """docid and the whole line, of lines with a tab."""
    return split_rows(text_lines(spark, path), ("docid", "rest"), keep_line=True).select("docid", "value")


def padded_rows(spark: SparkSession, path: str, names: tuple[str, ...], na_values: tuple[str, ...] = ()) -> DataFrame:
    """Rows of up to len(names) fields, short ones padded with nulls; longer lines go. na_values become nulls."""
    parts = F.split("value", "\t", -1)
    rows = text_lines(spark, path).where((F.size(parts) <= len(names)) & (F.col("value") != ""))
    value = lambda k: F.get(parts, k)
    return rows.select(*(F.when(value(k).isin(*na_values) if na_values else F.lit(False), None).otherwise(value(k)).alias(n) for k, n in enumerate(names)))


def quoted_rows(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """As padded rows, but with double quotes read as quotes."""
    return spark.read.csv(path, sep="\t", quote='"', escape='"', schema=", ".join(f"{n} string" for n in names))


def train_ids(spark: SparkSession, path: str) -> DataFrame:
    qid = strip(F.get(F.split("value", "\t", -1), 0))
    return text_lines(spark, path).select(qid.alias("qid")).where("qid <> ''").distinct()


def click_graph_rows(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """qid, query, docid of rows of three or four fields; any other row is an error, since a shifted column would leak. most: a debug cap."""
    lines = text_lines(spark, path)
    lines = lines.limit(most) if most else lines
    parts = F.split("value", "\t", -1)
    checked = F.when(F.size(parts).isin(3, 4), parts).otherwise(F.raise_error(F.concat(F.lit("neither three nor four fields: "), F.col("value"))))
    return lines.select(checked.alias("p")).select(*(strip(F.get("p", k)).alias(n) for k, n in enumerate(ANALYZED_CLICKS)))


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """docid, contents of JSON lines with id or docid, contents or text; documents without words go."""
    rows = spark.read.schema("id string, docid string, contents string, text string").json(path)
    out = rows.select(F.coalesce("id", "docid").alias("docid"), F.coalesce("contents", "text").alias("contents"))
    return out.where(strip(F.col("contents")) != "")


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark, path).select(strip(F.col("value")).alias("qid")).where("qid <> ''")


def run_files(spark: SparkSession, pattern: str, tokenizer: str) -> DataFrame:
    """variant, qid, query, docid, rank, score of all run files whose name names the tokenizer."""
    rows = spark.read.csv(pattern, sep="\t", header=True, schema="qid string, query string, docno string, rank int, score double, query_toks string")
    variant = F.regexp_extract(F.col("_metadata.file_name"), r"results_test_(.*)\.tsv", 1)
    rows = rows.select(variant.alias("variant"), "qid", "query", F.col("docno").alias("docid"), "rank", "score")
    return rows.where(F.array_contains(F.split("variant", "_"), tokenizer))


def stored_runs(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """variant, qid, query, docid, rank, score of runs as sinks.runs writes them, of the variants whose name names the tokenizer."""
    rows = spark.read.option("basePath", path).csv(path, sep="\t", header=True, schema="qid string, query string, docid string, rank int, score double, variant string")
    rows = rows.select("variant", "qid", "query", "docid", "rank", "score")
    return rows.where(F.array_contains(F.split("variant", "_"), tokenizer)) if tokenizer else rows


def stored_judgements(spark: SparkSession, path: str, part: str = "split") -> DataFrame:
    """split, qid, query, docid as sinks.judgements writes them."""
    return spark.read.option("basePath", path).csv(path, sep="\t", schema=f"qid string, query string, docid string, {part} string").select(part, *ANALYZED_CLICKS)


def stored_contents(raw: Column) -> Column:
    """contents of a stored JSON document; the raw text where it isn't JSON, empty where there's none."""
    return F.coalesce(F.get_json_object(raw, "$.contents"), raw, F.lit(""))


def fetched(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """docid, contents for each of ids (docid), from stored (docid, raw); "" where a document isn't stored."""
    return ids.join(stored, "docid", "left").select("docid", stored_contents(F.col("raw")).alias("contents"))


def weight_rows(spark: SparkSession, path: str) -> DataFrame:
    """docid, term, probability of rows of three fields, or of four with a place in front; headers and other rows go."""
    parts = F.split("value", "\t", -1)
    first = F.get(parts, 0)
    rows = text_lines(spark, path).where(F.size(parts).isin(3, 4))
    at = F.size(parts) - 3
    numbered = first.rlike(r"^\s*-?\d+\s*$") | first.rlike(r"^D\d+$") | (F.size(parts) == 3)
    probability = strip(F.get(parts, at + 2)).try_cast("double")
    return rows.where(numbered).select(strip(F.get(parts, at)).alias("docid"), strip(F.get(parts, at + 1)).alias("term"), probability.alias("probability")).where("probability is not null")


def after_line(lines: DataFrame, number: int, order: str = "line_no") -> DataFrame:
    """Rows after a line already done, to resume a run."""
    return lines.where(F.col(order) > number)
