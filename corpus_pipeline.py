"""A training corpus from `documents`, stage by stage. Each stage reads the table that the stage before it wrote.

Every stage works on all rows its predecessor kept, and all but the last return the columns of documents:

1. toxicity      documents that the classifier rejects go; clean ones stay untouched
2. line_dedup    lines that at least three documents share stay in one of them
3. near_dups     of each group of similar documents the row with the smallest doc_id stays
4. source_mix    whole documents, drawn to the sources' target words and dealt to shuffled shards; a document that is taken twice gives two rows
5. bpe           token counts and the hashes of ids and decoded text, a row for each row of the mixture
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm import bpe, jaccard, lines, mixing, toxicity
from termloom.llm.shared import WORD, materialize, table


REST = "__tl_rest"


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage works on, and all others in one, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias(REST))


def unpacked(rows: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    return rows.select(*(F.col(c) if c in own else F.col(REST).getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(packed(docs, *own), model, keep=("text", "lang", REST))
    return unpacked(scored.where(~F.col("rejected")), docs, *own)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("doc_id", "text", "n_chars")
    cut = lines.dedup_lines(packed(docs, *own))
    return unpacked(cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")), docs, *own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Similar is 0.8 or more on five words, which differs from the query of operator 10. One row of each group stays: that of the smallest
    doc_id (nulls last), then row hash, then hash of its other columns. Rows without words are alike to none and stay."""
    groups = jaccard.similar_rows(docs, width=5, percent=80).where("n_shingles > 0").groupBy("component", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies"))
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "copies")).alias("first")).select("first.row", "first.copies")
    of = lambda which: kept.where(which).select(F.col("row").alias("__tl_row"))
    wordless = F.coalesce(~F.col("text").rlike(WORD), F.lit(True))
    rows = docs.withColumn("__tl_row", jaccard.row_hash()).where(~wordless)
    alone = rows.join(of("copies = 1"), "__tl_row", "left_semi")
    rest = F.xxhash64(*(f"`{c}`" for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()))
    copies = rows.join(of("copies > 1"), "__tl_row", "left_semi").withColumn("__tl_k", F.row_number().over(W.partitionBy("__tl_row").orderBy(rest)))
    one = alone.drop("__tl_row").unionByName(copies.where("__tl_k = 1").drop("__tl_row", "__tl_k"))
    return one.unionByName(docs.where(wordless))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("doc_id", "source", "text")
    return unpacked(mixing.mix(packed(docs, *own), whole_documents=True, keep=(REST,)), docs, *own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, digest=True, keep=("source",))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dups", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: A trained classifier decides what the first stage keeps, which SQL can't express; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, with a written table between any two."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = materialize(docs, f"pipeline-{name}")
    return docs
