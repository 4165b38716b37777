"""What the costly steps of queries over postings leave out of their plans, and that results stay whole."""

from pyspark.sql import functions as F
from termloom.functions import text
from termloom.operators import index, reweight
from termloom.plans import inputs, queries

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_clicked_documents_are_tokenized(spark):
    post, edges = queries.clicked_post(spark, SF)
    clicked = edges.select("docid").distinct().join(inputs.indexed(spark, SF), "docid")
    assert {r.docid for r in post.select("docid").distinct().collect()} == {r.docid for r in clicked.collect()}
    assert post.exceptAll(inputs.post(spark, SF)).count() == 0
    assert inputs.indexed(spark, SF).exceptAll(inputs.post(spark, SF).select("docid").distinct()).count() == 0


def test_whole_texts_are_dealt_and_tokenized_once(spark):
    text = plan(inputs.post(spark, SF))
    assert text.count("Exchange") == 1 and text.count("regexp_extract_all") == 1


def test_rewritten_documents_side_by_side(spark):
    texts = [(1, "b a b"), (2, "c a"), (3, "?"), (4, "a")]
    docs = spark.createDataFrame([(d, x, [t for t in x.split() if t != "?"]) for d, x in texts], "docid long, contents string, tokens array<string>")
    post = index.postings(docs)
    weights = spark.createDataFrame([(1, "a", 3), (4, "a", 2)], "docid long, term string, scaled int")
    wide = reweight.reweighted_side_by_side(post.where("docid in (1, 4)"), weights, [0.0, 1.0])
    got = reweight.rewritten_side_by_side(docs, wide, ["v0", "v1"])
    assert sorted(map(tuple, got.select("variant", "docid", "contents", "counted").collect())) == [
        ("v0", 1, "a a a b b", True), ("v0", 2, "a c", True), ("v0", 3, "?", False), ("v0", 4, "a a", True),
        ("v1", 1, "a b b", True), ("v1", 2, "a c", True), ("v1", 3, "?", False), ("v1", 4, "a", True),
    ]


def test_all_clicks_of_a_document_count(spark):
    """rlm_per_query takes more than the first ten queries of a document."""
    log = queries.train_split(spark, SF)
    times = queries.rlm_per_query(spark, SF).select("docid", "query", "times").distinct()
    want = log.groupBy("docid").agg(F.count(F.lit(1)).alias("n")).join(inputs.indexed(spark, SF), "docid")
    got = times.groupBy("docid").agg(F.sum("times").alias("n"))
    assert want.where("n > 10").count() and got.count() and got.join(want.withColumnRenamed("n", "all"), "docid").where("n <> all").count() == 0


def test_words_are_stemmed_in_place(spark):
    rows = [(1, "Running dogs, C++ runs' x."), (2, None), (3, "the"), (4, "ponies running- ponies")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(1)
    got = text.analyze(df, "id", "text", "symbol")
    assert "SortMergeJoin" not in plan(got) and "BroadcastHashJoin" not in plan(got) and "tokens" in got.columns
    assert {r.id: r.tokens for r in got.collect()} == {1: ["run", "dog", "c++", "run", "x."], 2: [], 3: [], 4: ["poni", "running-", "poni"]}
    assert queries.analyze_english(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_postings_are_stored_as_they_come(spark, monkeypatch):
    """feedback_docs: no posting is dealt by term or sorted to be stored."""
    plans = []
    monkeypatch.setattr(index, "written", lambda df, name: plans.append((name, plan(df))) or df)
    index.Index.store(spark.range(20).selectExpr("id % 5 as docid", "cast(id as string) as term", "id as tf"))
    assert plans[0][0] == "postings" and "Exchange" not in plans[0][1] and "Sort" not in plans[0][1]


def test_documents_without_weights_are_not_joined(spark):
    """reweight_rlm_multi, reweight_combined_multi: only documents with weights meet them by term."""
    post = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 4), (3, "c", 1)], "docid long, term string, tf long")
    weights = spark.createDataFrame([(1, "a", 3), (9, "z", 2)], "docid long, term string, scaled int")
    got = reweight.reweighted(post, weights, spark.createDataFrame([("h", 0.5)], "variant string, alpha float"))
    assert sorted(map(tuple, got.collect())) == [("h", 1, "a", 3), ("h", 1, "b", 1), ("h", 2, "a", 4), ("h", 3, "c", 1)] and "LeftAnti" in plan(got)
    variants = spark.createDataFrame([("x", 0.0, 0.5)], "variant string, alpha float, beta float")
    both = reweight.reweighted_by_both(post, weights, weights.where("docid = 9").withColumn("docid", F.lit(2).cast("long")).withColumn("term", F.lit("a")), variants)
    assert sorted(map(tuple, both.collect())) == [("x", 1, "a", 3), ("x", 1, "b", 1), ("x", 2, "a", 3), ("x", 3, "c", 1)] and "LeftAnti" in plan(both)
