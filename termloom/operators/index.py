"""An inverted index as tables: postings, document, term and collection statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.sources.lineage import written


def postings(docs: DataFrame) -> DataFrame:
    """docid, term, tf from docs (docid, tokens). Where docs are dealt by docid, nothing is shuffled here; else counts combine before the shuffle."""
    each = docs.select("docid", F.explode_outer("tokens").alias("term")).where("term is not null")  # explode alone would tokenize twice, for a filter below
    return each.groupBy("docid", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("docid").agg(F.sum("tf").alias("dl"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def collection_stats(post: DataFrame) -> DataFrame:
    """One row: documents with a token, tokens, mean length, distinct terms."""
    lengths = doc_stats(post).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"))
    terms = post.select("term").distinct().agg(F.count(F.lit(1)).alias("n_terms"))
    return lengths.crossJoin(F.broadcast(terms)).withColumn("avgdl", F.col("n_tokens") / F.col("n_docs"))


def tf_percentiles(post: DataFrame, percents: tuple[float, ...] = (50, 75, 90, 95, 99, 99.9)) -> DataFrame:
    """Exact percentiles of tf with linear interpolation, a row for each percent."""
    values = post.agg(F.percentile("tf", F.array(*(F.lit(p / 100) for p in percents))).alias("v"))
    return values.select(F.posexplode("v").alias("i", "tf")).select(F.element_at(F.array(*(F.lit(float(p)) for p in percents)), F.col("i") + 1).alias("percent"), "tf")


def rebuilt_text(post: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """docid, contents (and `by`): each term as often as its tf, terms in order."""
    per = post.groupBy(*by, "docid").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    return per.select(*by, "docid", F.array_join(F.flatten(F.transform("terms", lambda t: F.array_repeat(t["term"], t["tf"].cast("int")))), " ").alias("contents"))


def length(tf: Column) -> Column:
    """A document's length: that in its row without a term, else the sum of its frequencies."""
    return F.coalesce(F.sum(F.when(F.col("term").isNull(), tf)), F.sum(tf))


@dataclass
class Index:
    """A stored index: postings (docid, term, tf) in the order they come in, and lengths (docid, dl), both read from written tables.

    What is stored may lack postings: documents' lengths are those in rows without a term then.

    Rewritten indexes of one corpus are stored as one: postings have tfs and lengths dls, a value for each of `variants`.
    """

    post: DataFrame
    lengths: DataFrame
    variants: tuple[str, ...] = ()

    @classmethod
    def store(cls, post: DataFrame) -> Index:
        """Write postings, which nothing deals by term, and the lengths that come from them."""
        stored = written(post, "postings")
        return cls(stored.where("term is not null"), written(stored.groupBy("docid").agg(length(F.col("tf")).alias("dl")), "lengths"))

    @classmethod
    def store_variants(cls, post: DataFrame, variants: list[str]) -> Index:
        """Write postings (docid, term, tfs) of several indexes, and their lengths."""
        stored = written(post, "postings")
        sums = F.array(*(length(F.col("tfs")[i]) for i in range(len(variants))))
        return cls(stored.where("term is not null"), written(stored.groupBy("docid").agg(sums.alias("dls")), "lengths"), tuple(variants))
