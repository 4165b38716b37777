"""BM25 retrieval: shards of documents that each meet all queries, a window over their best for the top k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from termloom.functions.text import strip, whitespace_tokens
from termloom.operators.index import Index
from termloom.operators.search import searched
from termloom.sources.lineage import written


def build_topics(queries: DataFrame) -> DataFrame:
    """Distinct (qid, query) with query_toks, the counts of the query's white-space tokens."""
    q = queries.select("qid", strip(F.col("query")).alias("query")).where("query <> ''").distinct()
    each = q.select("qid", "query", F.explode(whitespace_tokens(F.col("query"), lower=False)).alias("term")).groupBy("qid", "query", "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return each.groupBy("qid", "query").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "n")))).alias("query_toks"))


#: Postings in a shard of the search at most, on average: some 40 bytes of memory each for one index.
SHARD = 12_000_000


def bm25(index: Index, terms: DataFrame, k1: float = 0.9, b: float = 0.4, k: int = 10, key: str = "qid") -> DataFrame:
    """key, docid, score, rank (and variant, where the index has variants): the k best documents of each query, ties by docid as text.

    terms: one row (key, term) for each query token; repeats multiply. Each variant has its own lengths. Postings of terms that
    no query has are cut by a join with the queries' vocabulary. Documents are dealt to shards, each shard meets all queries and
    keeps what may be among a query's k best (see `search`), so no table of pairs of queries and documents is made.
    """
    spark = terms.sparkSession
    wanted = written(terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("qtf")), "wanted")
    queries = written(wanted.select(key).distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    size = lambda i: F.col("dl") if not index.variants else F.col("dls")[i]
    n = max(1, len(index.variants))
    whole = index.lengths.agg(F.count(F.lit(1)).alias("n_docs"), *((F.sum(size(i)) / F.count(F.lit(1))).alias(f"mean{i}") for i in range(n))).first()  # one row
    df = index.post.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.lit(whole.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    vocabulary = written(df.select("term", "df", idf.alias("idf"), F.monotonically_increasing_id().alias("t")), "vocabulary")
    shards = max(spark.sparkContext.defaultParallelism, -(-(vocabulary.agg(F.sum("df")).first()[0] or 0) * n // SHARD))
    asked = wanted.join(vocabulary, "term").join(queries.withColumnRenamed(key, "same"), F.col(key).eqNullSafe(F.col("same")))
    place, kind = F.pmod(F.xxhash64("docid"), F.lit(shards)).cast("int"), index.lengths.schema["docid"].dataType
    no = lambda name, of: F.lit(None).cast(of).alias(name)
    ints = lambda wide, one: F.col(wide).cast("array<int>") if index.variants else F.array(F.col(one).cast("int"))
    rows = (
        index.post.join(vocabulary.select("term", "t"), "term").select(place.alias("shard"), no("q", "bigint"), "docid", "t", no("w", "double"), ints("tfs", "tf").alias("values"))
        .unionByName(index.lengths.select(place.alias("shard"), no("q", "bigint"), "docid", no("t", "bigint"), no("w", "double"), ints("dls", "dl").alias("values")))
        .unionByName(asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "q", no("docid", kind), "t", (F.col("qtf") * F.col("idf")).alias("w"), no("values", "array<int>")))
    )
    search = searched([whole[f"mean{i}"] for i in range(n)], k1, b, k, to_arrow_type(kind))
    found = rows.repartitionById(shards, F.col("shard")).drop("shard").mapInArrow(search, f"q bigint, g int, docid {kind.simpleString()}, score double")
    best = W.partitionBy("g", "q").orderBy(F.round("score", 9).desc(), F.col("docid").cast("string"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(queries, "q")
    named = [F.element_at(F.array(*map(F.lit, index.variants)), F.col("g") + 1).alias("variant")] if index.variants else []
    return top.select(*named, key, "docid", "score", "rank")
