"""Writers. Spark's commit protocol makes each a whole table or none, so a rerun overwrites and never appends twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.sources.lineage import written


def lines(df: DataFrame, path: str, column: str = "value") -> None:
    """A column's values verbatim."""
    df.select(column).write.mode("overwrite").text(path)


def tab_rows(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", escape="", emptyValue="")


def json_corpus(df: DataFrame, path: str) -> None:
    """id and contents as JSON lines, characters unescaped."""
    df.select(F.col("docid").cast("string").alias("id"), "contents").write.mode("overwrite").json(path)


def index(postings: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Postings sorted by term inside files dealt by term, a folder for each value of `by` (an index variant)."""
    keys = [*by, "term"]
    writer = postings.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def variant_indexes(wide: DataFrame, names: list[str], path: str) -> None:
    """What `index` writes of several variants, from one row (docid, term, tfs) for each posting: it's dealt by term once for all."""
    dealt = written(wide.repartition("term").sortWithinPartitions("term"), "dealt")
    for i, name in enumerate(names):
        dealt.select("docid", "term", F.col("tfs")[i].alias("tf")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/variant={name}")


def split_ids(df: DataFrame, path: str) -> None:
    df.select(F.col("qid").cast("string").alias("qid")).orderBy("qid").write.mode("overwrite").text(path)


def judgements(df: DataFrame, path: str, part: str = "split") -> None:
    """qid, query, docid without a header, a folder for each value of `part`."""
    df.select("qid", "query", "docid", part).write.mode("overwrite").partitionBy(part).csv(path, sep="\t")


def runs(df: DataFrame, path: str) -> None:
    """qid, query, docid, rank, score under a header, a folder for each variant."""
    df.select("qid", "query", "docid", "rank", "score", "variant").write.mode("overwrite").partitionBy("variant").csv(path, sep="\t", header=True)


def weights(df: DataFrame, path: str, decimals: int = 10, placeholder: bool = False) -> None:
    """docid, term and the probability in fixed decimals; a probability that prints as zero stays, as a zero. placeholder: -1 in front."""
    value = F.format_string(f"%.{decimals}f", "probability").alias("probability")
    cols = [F.lit("-1").alias("traversal_idx")] if placeholder else []
    tab_rows(df.select(*cols, F.col("docid").alias("doc_id"), "term", value), path, header=not placeholder)


def sorted_weights(df: DataFrame, path: str) -> None:
    """Weights in traversal order: files sorted inside and among themselves."""
    rows = df.select("traversal_idx", F.col("docid").alias("doc_id"), "term", "probability")
    tab_rows(rows.repartitionByRange("traversal_idx").sortWithinPartitions("traversal_idx", "term"), path, header=True)


def results(df: DataFrame, path: str) -> None:
    """A small table of metrics or tests as one file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)
