"""Click graphs: edges between queries and documents, pruning, random walks, co-click similarity and term weights.

Nodes keep their natural keys. Loops write each few rounds to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.sources.lineage import written


def click_edges(clicks: DataFrame) -> DataFrame:
    """query, docid, w: how often a query text led to a document."""
    return clicks.groupBy("query", "docid").agg(F.count(F.lit(1)).cast("double").alias("w"))


def two_core(edges: DataFrame) -> DataFrame:
    """The edges of the largest subgraph in which every query and document has at least two; weights become 1.

    Each round drops documents with one edge, then queries with one. The core is unique, so the order doesn't matter.
    """
    now = written(edges.select("query", "docid").distinct(), "core")
    n = now.count()
    while True:
        docs = now.groupBy("docid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("docid")
        left = now.join(docs, "docid", "left_semi")
        queries = left.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("query")
        now, before = written(left.join(queries, "query", "left_semi").select("query", "docid"), "core"), n
        n = now.count()
        if n == before:
            return now.withColumn("w", F.lit(1.0))


def adjacency(edges: DataFrame) -> DataFrame:
    """src_kind, src, dst, p: both directions of every edge, p summing to 1 over the edges that leave a node."""
    q = edges.select(F.lit("q").alias("src_kind"), F.col("query").cast("string").alias("src"), F.col("docid").cast("string").alias("dst"), "w")
    d = edges.select(F.lit("d").alias("src_kind"), F.col("docid").cast("string").alias("src"), F.col("query").cast("string").alias("dst"), "w")
    both = q.unionByName(d)
    sums = both.groupBy("src_kind", "src").agg(F.sum("w").alias("total"))
    return both.join(sums, ["src_kind", "src"]).select("src_kind", "src", "dst", (F.col("w") / F.col("total")).alias("p"))


def page_rank(edges: DataFrame, restart: float = 0.15, rounds: int = 20, every: int = 5) -> DataFrame:
    """kind, node, score of the sum of all queries' personalised walks: one walk with every query as a seed of mass 1."""
    moves = written(adjacency(edges), "adjacency")
    seeds = edges.select(F.lit("q").alias("kind"), F.col("query").cast("string").alias("node")).distinct().withColumn("score", F.lit(1.0))
    now = seeds
    for k in range(1, rounds + 1):
        step = now.join(moves, (F.col("kind") == F.col("src_kind")) & (F.col("node") == F.col("src")))
        step = step.select(F.when(F.col("kind") == "q", "d").otherwise("q").alias("kind"), F.col("dst").alias("node"), ((1 - restart) * F.col("score") * F.col("p")).alias("score"))
        now = step.unionByName(seeds.withColumn("score", F.lit(restart))).groupBy("kind", "node").agg(F.sum("score").alias("score"))
        if k % every == 0 or k == rounds:
            now = written(now, "walk")
    return now


def click_weights(post: DataFrame, edges: DataFrame, by_tf: bool = True, decimals: int = 8) -> DataFrame:
    """docid, term, probability of every document that a click reaches.

    A document's walk score scales all its terms alike and normalising takes it out again, so the weights are tf / length, or 1 /
    number of terms; the score's one effect is which documents have weights.
    """
    reached = post.join(written(edges.select("docid").distinct(), "reached"), "docid", "left_semi")
    whole = reached.groupBy("docid").agg((F.sum("tf") if by_tf else F.count(F.lit(1))).cast("double").alias("total"))
    share = F.col("tf") / F.col("total") if by_tf else 1 / F.col("total")
    return reached.join(whole, "docid").select("docid", "term", F.round(share, decimals).alias("probability"))


def coclick_similarity(edges: DataFrame, most: int | None = 64) -> DataFrame:
    """d1, d2, s for documents with a common query, d1 < d2: the sum over those queries of 1 / (their documents).

    The pairs of one query grow with the square of its documents. `most`, if given, splits a query of more documents into blocks of
    that many, pair by pair of blocks, so that no task holds them all; the pairs stay the same. None: no blocks.
    """
    degree = edges.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = edges.select("query", "docid").join(degree, "query")
    if most:
        blocks = F.ceil(F.col("n") / most).cast("int")
        own = own.withColumn("part", F.pmod(F.xxhash64("docid"), blocks).cast("int"))
        other = own.select("query", "docid", "n", "part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
        cell = other.select("query", "docid", "n", F.col("part"), F.least("part", "o").alias("a"), F.greatest("part", "o").alias("b"))
        x, y = cell.alias("x"), cell.alias("y")
        same = (F.col("x.query") == F.col("y.query")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b"))
        across = (F.col("x.part") != F.col("y.part")) | (F.col("x.a") == F.col("x.b"))
        pairs = x.join(y, same & across & (F.col("x.docid") < F.col("y.docid")))
    else:
        x, y = own.alias("x"), own.alias("y")
        pairs = x.join(y, (F.col("x.query") == F.col("y.query")) & (F.col("x.docid") < F.col("y.docid")))
    return pairs.groupBy(F.col("x.docid").alias("d1"), F.col("y.docid").alias("d2")).agg(F.sum(1 / F.col("x.n").cast("double")).alias("s"))


def neighbours(similar: DataFrame, k: int = 10) -> DataFrame:
    """docid, other, s, nth: each document's k most similar ones, ties by the larger docid first."""
    both = similar.select(F.col("d1").alias("docid"), F.col("d2").alias("other"), "s").unionByName(similar.select(F.col("d2").alias("docid"), F.col("d1").alias("other"), "s"))
    order = W.partitionBy("docid").orderBy(F.round("s", 9).desc(), F.col("other").desc())
    return both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def expansion_weights(post: DataFrame, near: DataFrame, decimals: int = 8) -> DataFrame:
    """docid, term, probability: the neighbours' term shares, mixed by similarity and normalised. A document's own terms don't enter."""
    near = near.join(near.groupBy("docid").agg(F.sum("s").alias("all_s")), "docid").select("docid", F.col("other"), (F.col("s") / F.col("all_s")).alias("p"))
    lengths = post.groupBy("docid").agg(F.sum("tf").cast("double").alias("dl"))
    shares = post.join(lengths, "docid").select(F.col("docid").alias("other"), "term", (F.col("tf") / F.col("dl")).alias("share"))
    mixed = near.join(shares, "other").groupBy("docid", "term").agg(F.sum(F.col("p") * F.col("share")).alias("v"))
    total = mixed.groupBy("docid").agg(F.sum("v").alias("total"))
    return mixed.join(total, "docid").select("docid", "term", F.round(F.col("v") / F.col("total"), decimals).alias("probability"))
