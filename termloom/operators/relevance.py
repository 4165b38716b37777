"""Relevance models from click queries: conditional sampling over the models of feedback documents.

For a query q with n feedback models m_i, and a term w of a clicked document d,

    weight(d, q, w) = cf(w) / cf(d) * product over query tokens t of max(P(t | w), 1e-10)
    P(t | w) = sum_i m_i(w) m_i(t) / sum_i m_i(w)

m_i(w) is lam * tf / dl + (1 - lam) * bg(w) where the document holds w, and all of bg(w) where it doesn't (absent terms aren't
discounted). With a_i(w) = m_i(w) - bg(w), which is zero unless the document holds w, the sums are

    sum_i m_i(w) m_i(t) = n bg(w) bg(t) + bg(w) B(t) + bg(t) A(w) + sum_i a_i(w) a_i(t)

so only present terms are joined, and the product is taken once for each (query, term) and not for each document. A query is its text:
clicks of several users that share one are searched and scored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from termloom.operators import blocks as B
from termloom.sources.lineage import written

FLOOR = 1e-10

#: Feedback and clicked documents of a block of queries, on average: some 5 kB of memory each where none is needed twice.
BLOCK = 100_000

#: Clicked documents of one query in one block, on average; a query with more meets several blocks.
PART = 5_000


def collection_model(post: DataFrame) -> DataFrame:
    """term, cf, bg with bg the share of all tokens."""
    # one row: the collection's length
    total = post.agg(F.sum("tf").cast("double").alias("total"))
    return post.groupBy("term").agg(F.sum("tf").alias("cf")).crossJoin(F.broadcast(total)).select("term", "cf", (F.col("cf") / F.col("total")).alias("bg"), "total")


def with_lengths(post: DataFrame) -> DataFrame:
    """Postings with dl, their document's length; nothing is shuffled where postings are dealt by docid."""
    return post.withColumn("dl", F.sum("tf").over(W.partitionBy("docid")).cast("double"))


def unigram_models(post: DataFrame, collection: DataFrame, lam: float = 0.6) -> DataFrame:
    """docid, term, p: smoothed probabilities of the terms that a document holds, and extra, how far p is above the background.

    post: docid, term, tf, and dl if it's known.
    """
    if "dl" not in post.columns:
        post = post.join(post.groupBy("docid").agg(F.sum("tf").cast("double").alias("dl")), "docid")
    rows = post.join(collection.select("term", "bg"), "term")
    share = F.col("tf") / F.col("dl")
    return rows.select("docid", "term", (lam * share + (1 - lam) * F.col("bg")).alias("p"), (lam * (share - F.col("bg"))).alias("extra"))


def query_term_scores(wanted: DataFrame, terms: DataFrame, feedback: DataFrame, models: DataFrame, collection: DataFrame) -> DataFrame:
    """query, term, log_p: the sum of ln max(P(t | term), FLOOR) over the query's tokens.

    wanted: query, term to score. terms: query, term, qtf of the queries. feedback: query, docid. Models are cut to terms that are wanted or
    asked before they meet the feedback. A query's tokens are an array, so there's a row for each (query, term), never for each token too.
    """
    flags = wanted.select("query", "term", F.lit(True).alias("w"), F.lit(False).alias("t")).unionByName(terms.select("query", "term", F.lit(False).alias("w"), F.lit(True).alias("t")))
    flags = flags.groupBy("query", "term").agg(F.bool_or("w").alias("is_wanted"), F.bool_or("t").alias("is_asked"))
    cut = models.join(flags.select("term").distinct(), "term", "left_semi").select("docid", "term", "extra")
    own = written(feedback.join(cut, "docid").join(flags, ["query", "term"]).select("query", "docid", "term", "extra", "is_wanted", "is_asked"), "feedback-terms")
    n = feedback.join(models.select("docid").distinct(), "docid", "left_semi").groupBy("query").agg(F.countDistinct("docid").alias("n"))
    bg = collection.select("term", "bg")
    # a query token that the collection lacks has a background of half an occurrence
    half = collection.select((0.5 / F.col("total")).alias("half")).limit(1)
    asked = terms.join(bg, "term", "left").crossJoin(F.broadcast(half)).select("query", "term", "qtf", F.coalesce("bg", "half").alias("bg"))
    present = own.where("is_asked")
    sums = present.groupBy("query", "term").agg(F.sum("extra").alias("b"))
    asked = asked.join(sums, ["query", "term"], "left").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "qtf", "bg", F.coalesce("b", F.lit(0.0)).alias("b")))).alias("asked"))
    asked = written(asked.join(n, "query"), "asked")  # a row for each query
    # how far each asked token is above its background in a document, in the order of the query's tokens
    above = present.groupBy("query", "docid").agg(F.map_from_entries(F.collect_list(F.struct("term", "extra"))).alias("above")).join(asked.select("query", "asked"), "query")
    above = above.select("query", "docid", F.transform("asked", lambda t: F.coalesce(F.try_element_at("above", t["term"]), F.lit(0.0))).alias("ys"))
    held = own.where("is_wanted").join(above, ["query", "docid"], "left")
    per = held.groupBy("query", "term").agg(F.sum("extra").alias("a"), F.collect_list(F.when(F.col("ys").isNotNull(), F.struct(F.col("extra").alias("x"), "ys"))).alias("docs"))
    grid = wanted.join(bg, "term").join(asked, "query").join(per, ["query", "term"], "left")
    grid = grid.select("query", "term", "bg", "n", "asked", F.coalesce("a", F.lit(0.0)).alias("a"), "docs")

    def log_p(t, i):
        x = F.coalesce(F.aggregate("docs", F.lit(0.0), lambda s, d: s + d["x"] * F.get(d["ys"], i)), F.lit(0.0))
        numerator = F.col("n") * F.col("bg") * t["bg"] + F.col("bg") * t["b"] + t["bg"] * F.col("a") + x
        return t["qtf"] * F.ln(F.greatest(numerator / F.nullif(F.col("n") * F.col("bg") + F.col("a"), F.lit(0.0)), F.lit(FLOOR)))

    return grid.select("query", "term", F.aggregate(F.transform("asked", log_p), F.lit(0.0), lambda s, v: s + v).alias("log_p"))


def query_weights(clicks: DataFrame, post: DataFrame, scores: DataFrame, collection: DataFrame, feedback: DataFrame) -> DataFrame:
    """docid, query, term, log_weight, doc_score, times for each document and query text that led to it.

    clicks: docid, query, times. feedback: query, docid, score; a document outside its query's feedback has score 0.
    """
    cf = collection.select("term", "cf")
    known = post.join(clicks.select("docid").distinct(), "docid", "left_semi").join(cf, "term").select("docid", "term", "cf")
    total = known.groupBy("docid").agg(F.sum("cf").cast("double").alias("all_cf"))
    rows = clicks.join(known, "docid").join(total, "docid").join(scores, ["query", "term"])
    rows = rows.join(feedback.select("query", "docid", "score"), ["query", "docid"], "left")
    return rows.select("docid", "query", "term", (F.ln(F.col("cf") / F.col("all_cf")) + F.col("log_p")).alias("log_weight"), F.coalesce("score", F.lit(0.0)).alias("doc_score"), "times")


def pair_weights(clicks: DataFrame, terms: DataFrame, feedback: DataFrame, post: DataFrame, collection: DataFrame, lam: float = 0.6) -> DataFrame:
    """What `query_weights` gives from `query_term_scores` of all terms of clicked documents, block by block of queries.

    clicks: docid, query, times. terms: query, term, qtf. feedback: query, docid, score. post, collection: as in `unigram_models`. No row is
    made or shuffled for a query's term: a query and its documents' names are one row, each block gets a document once, as arrays
    of term numbers and frequencies, and a block gives one row for each clicked document of a query. Rows for terms are made from those.
    """
    clicks = written(clicks.select("docid", "query", "times"), "clicks")
    parts = clicks.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    part = F.pmod(F.xxhash64("docid"), F.col("parts")).alias("part")
    lists = clicks.join(parts, "query").select("query", part, "docid", "times").groupBy("query", "part").agg(F.collect_list(F.struct("docid", "times")).alias("c"))
    fed = feedback.groupBy("query").agg(F.collect_list(F.struct("docid", "score")).alias("f"))
    reached = written(clicks.select("docid").distinct(), "reached")
    used = post.join(reached, "docid", "left_semi").select("term").unionByName(terms.select("term")).distinct()
    used = written(used.join(collection.select("term", "cf"), "term"), "used")
    # numbers without gaps: one task writes a row for each term, as many as every block holds
    vocabulary = written(used.repartition(1).select("term", F.col("cf").cast("bigint").alias("cf"), F.monotonically_increasing_id().cast("int").alias("id")), "vocabulary")
    asked = terms.join(vocabulary.select("term", "id"), "term", "left").groupBy("query").agg(F.collect_list(F.struct("id", "qtf")).alias("a"))
    asked = written(lists.join(asked, "query").join(fed, "query"), "asked")
    names = F.concat("f.docid", "c.docid")
    blocks = max(clicks.sparkSession.sparkContext.defaultParallelism, -(-(asked.agg(F.sum(F.size(names))).first()[0] or 0) // BLOCK))
    block = F.pmod(F.xxhash64("query", "part"), F.lit(blocks)).cast("int").alias("block")
    needs = written(asked.select(block, F.explode(names).alias("docid")).distinct(), "needs")
    held = post.join(needs.select("docid").distinct(), "docid", "left_semi").join(vocabulary.select("term", "id"), "term", "left")
    held = held.groupBy("docid").agg(F.sum("tf").cast("double").alias("dl"), F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", F.col("tf").cast("int").alias("tf")))).alias("own"))
    kind, text = post.schema["docid"].dataType, clicks.schema["query"].dataType
    columns = {
        "query": text.simpleString(), "docid": kind.simpleString(), "term": "string", "ids": "array<int>", "qtfs": "array<double>", "fed": f"array<{kind.simpleString()}>", "scores": "array<double>",
        "clicked": f"array<{kind.simpleString()}>", "times": "array<bigint>", "tfs": "array<int>", "dl": "double", "id": "int", "cf": "bigint",
    }
    row = lambda **own: [own.get(c, F.lit(None)).cast(of).alias(c) for c, of in columns.items()]
    col = F.col
    rows = (
        asked.select(block, *row(query=col("query"), ids=col("a.id"), qtfs=col("a.qtf"), fed=col("f.docid"), scores=col("f.score"), clicked=col("c.docid"), times=col("c.times")))
        .unionByName(needs.join(held, "docid").select("block", *row(docid=col("docid"), ids=col("own.id"), tfs=col("own.tf"), dl=col("dl"))))
        .unionByName(vocabulary.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *row(term=col("term"), id=col("id"), cf=col("cf"))))
    )
    total = collection.agg(F.max("total")).first()[0] or 1.0  # one row
    given = f"docid {columns['docid']}, query {columns['query']}, terms array<string>, weights array<double>, doc_score double, times bigint"
    found = rows.repartitionById(blocks, col("block")).drop("block").mapInArrow(B.weighed(total, lam, FLOOR, to_arrow_type(kind), to_arrow_type(text), B.WIDE), given)
    each = found.select("docid", "query", F.explode(F.arrays_zip("terms", "weights")).alias("x"), "doc_score", "times")
    return each.select("docid", "query", col("x.terms").alias("term"), col("x.weights").alias("log_weight"), "doc_score", "times")


def aggregate(weights: DataFrame, strategy: str = "weighted_mean") -> DataFrame:
    """docid, term, weight over a document's queries: "max", "mean", or "weighted_mean" by the document's retrieval scores (the mean
    where none of its queries finds it). Weights of zero are left out."""
    w = F.exp("log_weight")
    if strategy == "max":
        out = weights.groupBy("docid", "term").agg(F.max(w).alias("weight"))
    elif strategy in ("mean", "weighted_mean"):
        queries = weights.select("docid", "query", "doc_score", "times").distinct()
        whole = queries.groupBy("docid").agg(F.sum("times").alias("n"), F.sum(F.col("doc_score") * F.col("times")).alias("all_scores"))
        share = F.col("times") / F.col("n")
        if strategy == "weighted_mean":
            share = F.when(F.col("all_scores") > 0, F.col("doc_score") * F.col("times") / F.nullif(F.col("all_scores"), F.lit(0.0))).otherwise(share)
        out = weights.join(whole, "docid").groupBy("docid", "term").agg(F.sum(share * w).alias("weight"))
    else:
        raise ValueError(f"unknown aggregation strategy {strategy!r}")
    return out.where("weight > 0")
