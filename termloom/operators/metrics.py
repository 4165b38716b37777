"""MRR and NDCG at a cutoff, and signed-rank tests between variants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.sources.lineage import written

#: Coefficients of a published Chebyshev fit to erfc, from the lowest power of t.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, by: tuple[str, ...] = (), distinct_qrels: bool = False) -> DataFrame:
    """qid, rr, ndcg (and `by`) of every query that has results and relevant documents.

    run: qid, docid, rank. qrels: qid, docid, where presence means relevant; repeated rows raise the ideal gain unless distinct_qrels.
    """
    by, qrels = list(by), written(qrels, "qrels")  # read twice
    counted = (qrels.distinct() if distinct_qrels else qrels).groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    nth = F.row_number().over(W.partitionBy(*by, "qid").orderBy("rank"))
    top = run.join(counted.select("qid"), "qid", "left_semi").withColumn("nth", nth).where(F.col("nth") <= k)
    marked = top.join(qrels.select("qid", "docid").distinct().withColumn("hit", F.lit(True)), ["qid", "docid"], "left")
    gain = F.when(F.col("hit"), 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)
    found = marked.groupBy(*by, "qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.array(*(F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(1, k + 1)))
    return found.join(counted, "qid").select(
        *by, "qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / F.element_at(ideal, F.least(F.col("n_relevant"), F.lit(k)).cast("int"))).alias("ndcg")
    )


def summary(run: DataFrame, qrels: DataFrame, k: int = 10, by: tuple[str, ...] = ("variant",)) -> DataFrame:
    """Mean metrics of each variant, rounded to 4; queries_evaluated counts all queries with results."""
    run = written(run, "run")  # read twice
    each = per_query(run, qrels, k, by).groupBy(*by).agg(F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    all_queries = run.groupBy(*by).agg(F.countDistinct("qid").alias("queries_evaluated"))
    out = all_queries.join(each, list(by), "left")
    return out.select(*by, F.round(F.coalesce("mrr", F.lit(0.0)), 4).alias("mrr"), F.round(F.coalesce("ndcg", F.lit(0.0)), 4).alias("ndcg"), "queries_evaluated")


def signed_ranks(scores: DataFrame, baseline: str, value: str, least: int = 10) -> DataFrame:
    """variant, n_queries, n (differences that aren't zero), w, z of each variant against the baseline.

    w is the smaller sum of average ranks of |difference|, z its normal score with the correction for ties. Differences are
    rounded to 12 places so that equal ones tie. Variants with under `least` shared queries are left out.
    """
    base = scores.where(F.col("variant") == baseline).select("qid", F.col(value).alias("b"))
    pairs = scores.where(F.col("variant") != baseline).join(base, "qid").select("variant", "qid", F.round(F.col("b") - F.col(value), 12).alias("d"))
    shared = pairs.groupBy("variant").agg(F.count(F.lit(1)).alias("n_queries")).where(F.col("n_queries") >= least)
    size = F.abs("d")
    ranked = pairs.where("d <> 0").withColumns({
        "ties": F.count(F.lit(1)).over(W.partitionBy("variant", size)), "low": F.rank().over(W.partitionBy("variant").orderBy(size)),
    })
    rank = F.col("low") + (F.col("ties") - 1) / 2.0
    sums = ranked.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, rank).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, rank).otherwise(0.0)).alias("minus"),
        F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tied"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    w = F.least("plus", "minus")
    out = shared.join(sums, "variant", "left")
    return out.select("variant", "n_queries", F.coalesce("n", F.lit(0)).alias("n"), w.alias("w"), ((w - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0))).alias("z"))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a normal score, as erfc(|z| / sqrt 2) by a continued series that is exact to about 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def significance(scores: DataFrame, baseline: str, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """variant, n_queries, p_mrr, p_ndcg (to 6 places) and whether each, unrounded, is below alpha over the number of variants; p is null where no
    query differs."""
    n = scores.where(F.col("variant") != baseline).agg(F.countDistinct("variant").alias("n_variants"))
    mrr, ndcg = (signed_ranks(scores, baseline, v, least).select("variant", "n_queries", normal_tail(F.col("z")).alias(f"p_{name}")) for v, name in (("rr", "mrr"), ("ndcg", "ndcg")))
    both = mrr.join(ndcg.drop("n_queries"), "variant").crossJoin(F.broadcast(n))  # n is one row
    limit = F.lit(alpha) / F.col("n_variants")
    return both.select("variant", "n_queries", F.round("p_mrr", 6).alias("p_mrr"), F.round("p_ndcg", 6).alias("p_ndcg"), (F.col("p_mrr") < limit).alias("sig_mrr"), (F.col("p_ndcg") < limit).alias("sig_ndcg"))
