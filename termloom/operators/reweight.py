"""Rewriting term frequencies from learned weights, all parameter settings in one pass."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators.index import rebuilt_text
from termloom.sources.lineage import written


def weight_range(weights: DataFrame) -> DataFrame:
    """One row: ln of the smallest positive probability, and the range of ln."""
    p = F.when(F.col("probability") > 0, F.col("probability"))
    return weights.agg(F.ln(F.min(p)).alias("log_min"), (F.ln(F.max(p)) - F.ln(F.min(p))).alias("log_range"))


def latest(weights: DataFrame, order: str) -> DataFrame:
    """docid, term, probability: the last of repeated rows."""
    return weights.groupBy("docid", "term").agg(F.max_by("probability", order).alias("probability"))


def scaled(weights: DataFrame, max_val: float) -> DataFrame:
    """docid, term, scaled: 1 for the smallest probability up to max_val + 1 for the largest, evenly in ln; none at or below zero.

    weights are read twice, so what they come from is written first.
    """
    weights = written(weights, "weights")
    one = F.broadcast(weight_range(weights))  # a single row
    v = F.when(F.col("log_range") > 0, (F.ln("probability") - F.col("log_min")) / F.nullif("log_range", F.lit(0.0)) * F.lit(float(max_val))).otherwise(F.lit(max_val / 2.0))
    return weights.where("probability > 0").crossJoin(one).select("docid", "term", (F.round(F.round(v, 9)).cast("int") + 1).alias("scaled"))


def number(v: float) -> str:
    return f"{v:.2f}".replace(".", "_")


def short(v: float) -> str:
    return str(int(v)) if v == int(v) else str(v).rstrip("0").rstrip(".")


def alpha_name(kind: str, tokenizer: str, max_val: float, alpha: float) -> str:
    return f"{kind}_{tokenizer}_maxval{short(max_val)}_alpha_{number(alpha)}"


def alpha_variants(spark, kind: str, tokenizer: str, max_val: float, alphas: list[float]) -> DataFrame:
    rows = [(alpha_name(kind, tokenizer, max_val, a), float(a)) for a in alphas]
    return spark.createDataFrame(rows, "variant string, alpha float")


def alpha_beta_variants(spark, tokenizer: str, max_rlm: float, max_cg: float, alphas: list[float], betas: list[float]) -> DataFrame:
    """All pairs with alpha + beta up to 1; a single pair above it is an error, in a grid it's left out."""
    pairs = [(a, b) for a, b in itertools.product(alphas, betas) if a + b <= 1 + 1e-6]
    if not pairs:
        raise ValueError("alpha + beta is above 1")
    rows = [(f"combined_{tokenizer}_maxvalrlm{short(max_rlm)}_maxvalcg{short(max_cg)}_a{number(a)}_b{number(b)}", float(a), float(b)) for a, b in pairs]
    return spark.createDataFrame(rows, "variant string, alpha float, beta float")


def at_least_one(v: Column) -> Column:
    return F.greatest(F.lit(1), F.round(F.round(v, 9)).cast("int"))


def with_weights(post: DataFrame, weights: DataFrame) -> DataFrame:
    """Postings of a stored index and their weights, null where there's none. Documents that have none are left out of the join by term."""
    weights = written(weights, "own-weights")
    keys = written(weights.select("docid").distinct(), "weighted")
    held = post.join(keys, "docid", "left_semi").join(weights, ["docid", "term"], "left")
    return held.unionByName(post.join(keys, "docid", "left_anti"), allowMissingColumns=True)


def reweighted(post: DataFrame, weights: DataFrame, variants: DataFrame) -> DataFrame:
    """variant, docid, term, tf = max(1, round(alpha tf + (1 - alpha) scaled)); terms without a weight keep their tf.

    Products with alpha are in single precision and the rest in double, as the formula is used elsewhere.
    """
    rows = with_weights(post, weights).crossJoin(F.broadcast(variants))  # a row for each setting
    return rows.select("variant", "docid", "term", rewritten_tf(F.col("alpha")).alias("tf"))


def rewritten_tf(alpha: Column) -> Column:
    """The new frequency of a posting (tf, scaled); alpha is a float."""
    mixed = (alpha * F.col("tf").cast("float")) + (1.0 - alpha) * F.col("scaled")
    return F.when(F.col("scaled").isNull(), F.greatest(F.lit(1), F.col("tf").cast("int"))).otherwise(at_least_one(mixed))


def reweighted_side_by_side(post: DataFrame, weights: DataFrame, alphas: list[float]) -> DataFrame:
    """docid, term, tfs: the frequencies of `reweighted`, one for each alpha, in one row for each posting."""
    rows = post.join(weights, ["docid", "term"], "left")
    return rows.select("docid", "term", F.array(*(rewritten_tf(F.lit(float(a)).cast("float")) for a in alphas)).alias("tfs"))


def unchanged_side_by_side(post: DataFrame, n: int) -> DataFrame:
    """What `reweighted_side_by_side` gives for documents that have no weights, without a join."""
    return post.select("docid", "term", F.array_repeat(F.greatest(F.lit(1), F.col("tf").cast("int")), n).alias("tfs"))


def reweighted_by_both(post: DataFrame, rlm: DataFrame, cg: DataFrame, variants: DataFrame) -> DataFrame:
    """variant, docid, term, tf = max(1, round(alpha tf + beta rlm + (1 - alpha - beta) cg)), with tf for a missing signal."""
    both = rlm.withColumnRenamed("scaled", "r").join(cg.withColumnRenamed("scaled", "c"), ["docid", "term"], "full")
    rows = with_weights(post, both).crossJoin(F.broadcast(variants))  # a row for each setting
    tf = F.col("tf").cast("float")
    first = F.col("alpha") * tf
    second = F.col("beta") * F.coalesce(F.col("r").cast("float"), tf)
    third = (1.0 - F.col("alpha") - F.col("beta")) * F.coalesce(F.col("c").cast("float"), tf)
    return rows.select("variant", "docid", "term", at_least_one(first + second + third).alias("tf"))


def debug_weights(post: DataFrame, mode: str, seed: int = 42) -> DataFrame:
    """docid, term, tf for checks of the chain: "constant" 1, "random" 1 to 3, "weighted_random" tf times 0.5 to 1.5, by a seeded hash."""
    mode = mode_of(mode)
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("docid").cast("string"), "term")), 1, 12), 16, 10).cast("bigint"), F.lit(1_000_000))
    if mode == "constant":
        tf = F.lit(1)
    elif mode == "random":
        tf = F.pmod(draw, F.lit(3)).cast("int") + 1
    elif mode == "weighted_random":
        tf = at_least_one(F.col("tf") * (0.5 + draw / 1e6))
    else:
        raise ValueError(f"{mode!r} is no mode without weights")
    return post.select("docid", "term", tf.alias("tf"))


def traversal_order(docs: DataFrame) -> DataFrame:
    """docid, traversal_idx: places from 0 in docid order, whatever the docids' type.

    Documents are sorted range by range; a place is that inside its range plus the sizes of the ranges before, so no task numbers all.
    """
    keys = docs.select("docid").distinct().repartitionByRange("docid").sortWithinPartitions("docid")
    numbered = written(keys.withColumn("id", F.monotonically_increasing_id()), "order")  # range number in the upper bits, place in the lower 33
    placed = numbered.select("docid", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND((1 << 33) - 1).alias("nth"))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    offsets = sizes.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("offset"))
    return placed.join(offsets, "range").select("docid", (F.col("offset") + F.col("nth")).alias("traversal_idx"))


def in_traversal_order(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """traversal_idx, docid, term, probability of the weights of indexed documents; see `unplaced` for the others."""
    return weights.join(traversal_order(docs), "docid").select("traversal_idx", "docid", "term", "probability")


def unplaced(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: how many weights, of how many documents, have no place since the index lacks the document."""
    rest = weights.join(docs.select("docid").distinct(), "docid", "left_anti")
    return rest.agg(F.count(F.lit(1)).alias("n_weights"), F.countDistinct("docid").alias("n_docs"))


def rewritten_documents(docs: DataFrame, rewritten: DataFrame, variants: DataFrame) -> DataFrame:
    """variant, docid, contents, counted for every document (docid, contents) of every variant: its terms as often as the rewritten tf
    says; a document without terms passes through as it is and isn't counted as rewritten."""
    texts = rebuilt_text(rewritten, ("variant",)).withColumnRenamed("contents", "rebuilt")
    every = docs.crossJoin(F.broadcast(variants.select("variant")))  # a row for each setting
    out = every.join(texts, ["variant", "docid"], "left")
    return out.select("variant", "docid", F.coalesce("rebuilt", "contents").alias("contents"), F.col("rebuilt").isNotNull().alias("counted"))


def rewritten_side_by_side(docs: DataFrame, wide: DataFrame, names: list[str]) -> DataFrame:
    """What `rewritten_documents` gives, from docs (docid, contents, tokens) and the postings (docid, term, tfs) of documents with weights.

    Other documents keep their frequencies: their tokens in order are their text in every variant, without a join.
    """
    terms = wide.groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("term", "tfs"))).alias("terms"))
    held = written(terms, "terms")
    keys = written(held.select("docid"), "rewritten")  # may be few enough for a broadcast, which terms are not
    numbered = F.posexplode(F.array(*map(F.lit, names))).alias("i", "variant")
    text = F.array_join(F.flatten(F.transform("terms", lambda t: F.array_repeat(t["term"], F.get(t["tfs"], F.col("i"))))), " ")
    changed = docs.select("docid").join(held, "docid").select("docid", "terms", numbered).select("variant", "docid", text.alias("contents"), F.lit(True).alias("counted"))
    has = F.size("tokens") > 0
    plain = docs.join(keys, "docid", "left_anti").select("docid", F.when(has, F.array_join(F.sort_array("tokens"), " ")).otherwise(F.col("contents")).alias("contents"), has.alias("counted"))
    plain = plain.select("docid", "contents", "counted", F.explode(F.array(*map(F.lit, names))).alias("variant"))
    return changed.unionByName(plain)


MODES = ("rlm", "cg", "combined", "constant", "random", "weighted_random")


def mode_of(name: str) -> str:
    """A mode's name as given on a command line, in any case."""
    mode = name.strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown mode {name!r}; one of {', '.join(MODES)}")
    return mode
