"""Line dedup with DataFrame functions only, over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by the 128-bit hash of a line's key; it holds, for each key of one batch, in how many of
the batch's documents the key occurs and, if no earlier run knows the key, the document that keeps it. Batches come in falling
order of doc_id, so the largest doc_id holding a key is in the batch that brings the key in: a new batch is merge-anti-joined
with the live runs, its fresh keys get their keeper, keys known before add their count alone, and the batch becomes a run of
level 0. When a level has `fanout` runs they are compacted into one run of the next level. Buckets line up, so joins with runs
and compaction don't shuffle the runs again.

Defined results: null or empty text is one empty line; null doc_ids come before all others and rows of one doc_id count as one
document; repeated rows all get the same decision; an empty table gives an empty result; other columns stay, but for those named n_lines
and n_dropped; a key is judged by its hash, and two
different keys share both 64-bit hashes with a chance of about n * n / 2^129.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.shared import SPACES, materialize, scratch, table

NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs of line hashes; add() batches in falling order of doc_id, then totals()."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{scratch(self.spark, 'r').rpartition('-')[2]}"
        rows.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _live(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """keys: one row (h1, h2, did) for each line of the batch."""
        batch = keys.groupBy("h1", "h2", "did").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.sum("one").alias("n_docs"), F.max("did").alias("keeper"))
        fresh = known = batch
        if live := self._live():
            batch, _ = materialize(batch, "line-batch")
            fresh = batch
            for name in live:
                fresh = fresh.join(self.spark.table(name).where(F.col("keeper").isNotNull()).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            fresh, _ = materialize(fresh, "line-fresh")
            known = batch.join(fresh.select("h1", "h2"), ["h1", "h2"], "left_anti").withColumn("keeper", F.lit(None).cast("bigint"))
            fresh = fresh.unionByName(known)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(fresh))
        self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = self._write(self._merged(self.levels[k]))
                for name in self.levels[k]:
                    self.spark.sql(f"DROP TABLE {name}")
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged bucket by bucket with full outer merge joins; a run has each key once."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select("h1", "h2", F.col("n_docs").alias("more"), F.col("keeper").alias("other"))
            rows = rows.join(more.hint("merge"), ["h1", "h2"], "full")
            rows = rows.select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_docs"), F.greatest("keeper", "other").alias("keeper"))
        return rows

    def totals(self) -> DataFrame:
        """h1, h2, n_docs, keeper over all batches."""
        return self._merged(self._live())

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Drop the runs' tables."""
        for name in self._live():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with text cut to the lines that stay, n_lines (before) and n_dropped.

    A key of at least min_chars code points that at least min_docs documents hold keeps its lines in the largest doc_id only.
    """
    spark = docs.sparkSession
    did, th = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    lines = docs.select(did.alias("did"), th.alias("th"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    keys = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "did", "th", "pos")
    keys, _ = materialize(keys, "line-keys")
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(keys.agg(F.percentile_approx("did", shares)).first()[0] or [])) if shares else []
    edges = [NO_ID, *(int(c) for c in cuts), None]
    with LineRuns(spark, fanout=fanout) as runs:
        for low, high in reversed(list(zip(edges, edges[1:]))):
            runs.add(keys.where((F.col("did") >= low) & (F.lit(True) if high is None else F.col("did") < high)))
        common, _ = materialize(runs.totals().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "line-common")
    cut = keys.join(common, ["h1", "h2"]).where(F.col("did") != F.col("keeper"))
    cut = cut.groupBy("did", "th").agg(F.collect_set("pos").alias("__tl_cut")).select(F.col("did").alias("__tl_did"), F.col("th").alias("__tl_th"), "__tl_cut")
    marked = docs.withColumns({"__tl_k": did, "__tl_t": th}).join(cut, (F.col("__tl_k") == F.col("__tl_did")) & (F.col("__tl_t") == F.col("__tl_th")), "left")
    parts = split_lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("__tl_cut"))
    kept = F.when(F.col("__tl_cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__tl_parts", i)), "\n"))
    marked = marked.withColumns({"__tl_parts": parts, "n_lines": F.size(parts).cast("bigint")})
    return marked.withColumns({"text": kept, "n_dropped": F.coalesce(F.size("__tl_cut"), F.lit(0)).cast("bigint")}).drop("__tl_k", "__tl_t", "__tl_did", "__tl_th", "__tl_cut", "__tl_parts")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
