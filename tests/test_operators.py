import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions.porter import stem
from termloom.operators import clicks, index, metrics, relevance, retrieval, reweight, split


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tokenizers(spark):
    line = "C++ and COVID-19, AT&T the. dog's end! x_y .net 5% e-mail. naïve"
    df = spark.createDataFrame([(1, line), (2, None), (3, "")], "id int, text string")
    got = {m: [r[0] for r in df.select(T.join_tokens(T.tokens(F.col("text"), m))).collect()] for m in ("symbol", "alphanum")}
    assert got["symbol"] == ["c++ and covid-19 at&t the. dog s end ! x y net 5 e-mail. na ve", "", ""]
    assert got["alphanum"] == ["c and covid 19 at t the dog s end x y net 5 e mail na ve", "", ""]
    with pytest.raises(ValueError, match="unknown tokenizer"):
        T.tokens(F.col("text"), "other")


def test_filter_chain(spark):
    df = spark.createDataFrame([(1, "The running dogs and the. C++ running- ''"), (2, "the of"), (3, None)], "id int, text string")
    assert rows(T.analyze(df, "id", "text", "symbol")) == [(1, ["run", "dog", "the.", "c++", "running-"]), (2, []), (3, [])]
    assert rows(T.analyze(df, "id", "text", "symbol", stem=False))[0] == (1, ["running", "dogs", "the.", "c++", "running-"])
    english = spark.createDataFrame([(1, "Dog's ponies' caresses")], "id int, text string")
    assert rows(T.analyze(english, "id", "text", "english")) == [(1, ["dog", "poni", "caress"])]
    words = spark.createDataFrame([(["a'", "’‘", "b"],)], "w array<string>").select(T.trim_apostrophes(F.col("w")))
    assert words.first()[0] == ["a", "b"]
    spaced = spark.createDataFrame([(" A 12 b3\t",)], "t string").select(T.whitespace_tokens(F.col("t"), digits=False), T.strip(F.col("t")))
    assert tuple(spaced.first()) == (["a", "b3"], "A 12 b3")


def test_porter_published_pairs():
    pairs = "caresses caress ponies poni feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat sized size hopping hop falling fall filing file happy happi sky sky relational relat conditional condit vietnamization vietnam decisiveness decis sensibiliti sensibl triplicate triplic electrical electr revival reviv replacement replac adoption adopt communism commun bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


@pytest.fixture(scope="module")
def post(spark):
    docs = spark.createDataFrame([(1, "a a b".split()), (2, "b c".split()), (3, []), (4, "a c c d".split())], "docid long, tokens array<string>")
    return index.postings(docs)


def test_index(spark, post):
    assert rows(index.doc_stats(post)) == [(1, 3), (2, 2), (4, 4)]
    assert ("a", 2, 3) in rows(index.term_stats(post))
    assert rows(index.collection_stats(post)) == [(3, 9, 4, 3.0)]
    assert rows(index.rebuilt_text(post)) == [(1, "a a b"), (2, "b c"), (4, "a c c d")]
    values = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "tf long")
    got = {p: round(v, 3) for p, v in rows(index.tf_percentiles(values))}
    assert got[50.0] == 3 and got[75.0] == 4 and got[90.0] == 7.6 and got[99.9] == 9.976


def test_bm25_by_hand(spark, post):
    terms = spark.createDataFrame([(7, "a"), (7, "c"), (7, "c"), (8, "zz")], "qid long, term string")
    stored = index.Index.store(post)
    got = {r.docid: (r.score, r["rank"]) for r in retrieval.bm25(stored, terms).collect()}
    idf = math.log(1 + 1.5 / 2.5)
    part = lambda tf, dl: idf * tf / (tf + 0.9 * (0.6 + 0.4 * dl / 3))
    assert got[4][0] == pytest.approx(part(1, 4) + 2 * part(2, 4)) and got[4][1] == 1
    assert got[2][0] == pytest.approx(2 * part(1, 2)) and got[1][0] == pytest.approx(part(2, 3))
    assert len(rows(retrieval.bm25(stored, terms, k=1))) == 1
    assert rows(stored.lengths) == [(1, 3), (2, 2), (4, 4)]


def test_topics(spark):
    df = spark.createDataFrame([(1, " a b a "), (1, "a b a"), (2, " "), (3, "c")], "qid long, query string")
    assert rows(retrieval.build_topics(df)) == [(1, "a b a", {"a": 2.0, "b": 1.0}), (3, "c", {"c": 1.0})]


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (3, 5, 1)], "qid long, docid long, rank int")
    qrels = spark.createDataFrame([(1, 11), (2, 99), (2, 98)], "qid long, docid long")
    got = {r.qid: (r.rr, r.ndcg) for r in metrics.per_query(run, qrels).collect()}
    assert got == {1: (0.5, pytest.approx(1 / math.log2(3))), 2: (0.0, 0.0)}
    assert rows(metrics.summary(run.withColumn("variant", F.lit("v")), qrels)) == [("v", 0.25, 0.3155, 3)]
    twice = qrels.unionByName(qrels.where("qid = 1"))
    assert {r.qid: r.ndcg for r in metrics.per_query(run, twice).collect()}[1] < got[1][1]
    assert {r.qid: r.ndcg for r in metrics.per_query(run, twice, distinct_qrels=True).collect()}[1] == got[1][1]


def test_signed_ranks(spark):
    base = [0.1 * k for k in range(12)]
    other = [x + d for x, d in zip(base, [1, -1, 2, 3, -4, 5, 6, 7, 8, 9, 0, 0])]
    df = spark.createDataFrame([("b", k, x) for k, x in enumerate(base)] + [("v", k, x) for k, x in enumerate(other)] + [("few", 0, 1.0)] + [("same", k, x) for k, x in enumerate(base)], "variant string, qid int, rr double")
    got = {r.variant: r for r in metrics.signed_ranks(df, "b", "rr").collect()}
    # ranks of |d| 1 1 2 3 4 5 6 7 8 9: 1.5 1.5 3 4 5 6 ...; those of the other sign are 1.5 and 5
    assert got["v"].n == 10 and got["v"].w == 6.5
    assert got["v"].z == pytest.approx((6.5 - 27.5) / math.sqrt(10 * 11 * 21 / 24 - (2**3 - 2) / 48))
    assert "few" not in got and got["same"].n == 0 and got["same"].z is None
    p = metrics.significance(df.withColumn("ndcg", F.col("rr")), "b").where("variant = 'v'").first()
    assert p.p_mrr == pytest.approx(math.erfc(abs(got["v"].z) / math.sqrt(2)), abs=2e-6) and p.sig_mrr == (p.p_mrr < 0.05 / 3)


def test_two_core_and_similarity(spark):
    edges = spark.createDataFrame([("q1", 1), ("q1", 2), ("q2", 1), ("q2", 2), ("q3", 3), ("q3", 2), ("q4", 4)], "query string, docid long")
    left = clicks.two_core(edges)
    assert rows(left.select("query", "docid")) == [("q1", 1), ("q1", 2), ("q2", 1), ("q2", 2)]
    assert rows(clicks.two_core(left).select("query", "docid")) == rows(left.select("query", "docid"))
    assert rows(clicks.coclick_similarity(left)) == [(1, 2, 1.0)]


def test_similarity_in_blocks(spark):
    edges = spark.createDataFrame([(q, d) for q in range(3) for d in range(25) if (q + d) % 4], "query long, docid long")
    plain = {(a, b): round(s, 9) for a, b, s in clicks.coclick_similarity(edges, most=None).collect()}
    assert plain == {(a, b): round(s, 9) for a, b, s in clicks.coclick_similarity(edges, most=4).collect()}


def test_walk_keeps_its_mass(spark):
    edges = clicks.click_edges(spark.createDataFrame([("q1", 1), ("q1", 1), ("q1", 2), ("q2", 2), ("q3", 3)], "query string, docid long"))
    got = clicks.page_rank(edges).agg(F.sum("score")).first()[0]
    assert got == pytest.approx(3.0)


def test_click_weights(spark, post):
    edges = spark.createDataFrame([("q", 1)], "query string, docid long")
    assert rows(clicks.click_weights(post, edges)) == [(1, "a", 0.66666667), (1, "b", 0.33333333)]
    assert rows(clicks.click_weights(post, edges, by_tf=False)) == [(1, "a", 0.5), (1, "b", 0.5)]


def test_expansion(spark, post):
    near = spark.createDataFrame([(1, 2, 0.5), (1, 4, 1.5)], "docid long, other long, s double")
    got = {t: p for _, t, p in clicks.expansion_weights(post, near).collect()}
    assert got == {"a": 0.1875, "b": 0.125, "c": 0.5, "d": 0.1875}


def brute_model(docs, stop=()):
    cf = {}
    for t in docs.values():
        for w in t:
            cf[w] = cf.get(w, 0) + 1
    return cf, sum(cf.values())


def test_relevance_model_against_its_definition(spark):
    docs = {1: "a a b x".split(), 2: "b c c".split(), 3: "a c d d d".split(), 4: "x y".split()}
    clicked, query, hits = [1, 3], "a c zz c".split(), {1: 2.0, 2: 1.5, 3: 0.5}
    cf, size = brute_model(docs)
    bg = lambda w: cf.get(w, 0.5) / size
    model = lambda d: {w: 0.6 * docs[d].count(w) / len(docs[d]) + 0.4 * cf[w] / size for w in set(docs[d])}
    models = [model(d) for d in hits]
    want = {}
    for d in clicked:
        total = sum(cf[w] for w in set(docs[d]))
        for w in set(docs[d]):
            per = [m.get(w, bg(w)) for m in models]
            z = math.log(cf[w] / total)
            for t in query:
                z += math.log(max(sum(p / sum(per) * m.get(t, bg(t)) for p, m in zip(per, models)), 1e-10))
            want[d, w] = z
    post = index.postings(spark.createDataFrame(list(docs.items()), "docid long, tokens array<string>"))
    collection = relevance.collection_model(post)
    terms = spark.createDataFrame([(9, "a", 1), (9, "c", 2), (9, "zz", 1)], "query long, term string, qtf int")
    feedback = spark.createDataFrame([(9, d, s) for d, s in hits.items()], "query long, docid long, score double")
    pairs = spark.createDataFrame([(d, 9, 1) for d in clicked], "docid long, query long, times long")
    wanted = pairs.join(post, "docid").select("query", "term").distinct()
    scores = relevance.query_term_scores(wanted, terms, feedback.select("query", "docid"), relevance.unigram_models(post, collection), collection)
    got = relevance.query_weights(pairs, post, scores, collection, feedback)
    assert {(r.docid, r.term): pytest.approx(r.log_weight) for r in got.collect()} == want
    assert {r.docid: r.doc_score for r in got.collect()} == {1: 2.0, 3: 0.5}


def test_aggregation_strategies(spark):
    df = spark.createDataFrame([(1, 1, "a", math.log(0.2), 3.0, 1), (1, 2, "a", math.log(0.4), 1.0, 1), (2, 1, "a", math.log(0.2), 0.0, 2), (2, 2, "a", math.log(0.5), 0.0, 1)], "docid long, query long, term string, log_weight double, doc_score double, times long")
    value = lambda s: {r.docid: round(r.weight, 9) for r in relevance.aggregate(df, s).collect()}
    assert value("weighted_mean") == {1: 0.25, 2: 0.3} and value("mean") == {1: 0.3, 2: 0.3} and value("max") == {1: 0.4, 2: 0.5}
    with pytest.raises(ValueError, match="unknown aggregation"):
        relevance.aggregate(df, "median")


def test_reweighting_by_hand(spark):
    weights = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.001), (1, "z", 0.0)], "docid long, term string, probability double")
    scaled = reweight.scaled(weights, 10)
    assert rows(scaled) == [(1, "a", 11), (1, "b", 1)]
    post = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (1, "c", 3)], "docid long, term string, tf long")
    variants = reweight.alpha_variants(spark, "index_cg", "symbol", 10.0, [0.0, 0.5, 1.0])
    got = {(r.variant[-4:], r.term): r.tf for r in reweight.reweighted(post, scaled, variants).collect()}
    assert [got["1_00", t] for t in "abc"] == [3, 3, 3] and [got["0_50", t] for t in "abc"] == [7, 2, 3] and [got["0_00", t] for t in "abc"] == [11, 1, 3]
    only = reweight.scaled(weights.where("term = 'a'"), 10)
    assert rows(only) == [(1, "a", 6)]
    four = spark.createDataFrame([(1, "a", 4)], "docid long, term string, tf long")
    both = reweight.reweighted_by_both(four, spark.createDataFrame([(1, "a", 2)], "docid long, term string, scaled int"), only.where("false"), reweight.alpha_beta_variants(spark, "symbol", 10, 7.5, [0.5], [0.25]))
    assert rows(both) == [("combined_symbol_maxvalrlm10_maxvalcg7.5_a0_50_b0_25", 1, "a", 4)]
    assert reweight.alpha_beta_variants(spark, "symbol", 10, 10, [0, 0.5, 1], [0, 0.5, 1]).count() == 6
    with pytest.raises(ValueError, match="above 1"):
        reweight.alpha_beta_variants(spark, "symbol", 10, 10, [0.9], [0.2])
    last = spark.createDataFrame([(1, "a", 0.1, 0), (1, "a", 0.3, 1)], "docid long, term string, probability double, line_no int")
    assert rows(reweight.latest(last, "line_no")) == [(1, "a", 0.3)]
    assert {r.tf for r in reweight.debug_weights(post, "random").collect()} <= {1, 2, 3}
    with pytest.raises(ValueError, match="unknown mode"):
        reweight.debug_weights(post, "other")


def test_traversal_order(spark):
    docs = spark.range(0, 20_000, 3).withColumnRenamed("id", "docid")
    weights = spark.createDataFrame([(9, "a", 0.5), (3, "b", 0.5), (4, "c", 0.5), (19_998, "d", 0.1)], "docid long, term string, probability double")
    assert rows(reweight.in_traversal_order(weights, docs)) == [(1, 3, "b", 0.5), (3, 9, "a", 0.5), (6666, 19_998, "d", 0.1)]
    assert rows(reweight.unplaced(weights, docs)) == [(1, 1)]
    text = lambda df: df.withColumn("docid", F.concat(F.lit("D"), F.col("docid").cast("string")))
    names = sorted(f"D{k}" for k in range(0, 20_000, 3))
    assert rows(reweight.in_traversal_order(text(weights), text(docs))) == sorted(((names.index(d), d, t, p) for d, t, p in [("D3", "b", 0.5), ("D9", "a", 0.5), ("D19998", "d", 0.1)]), key=str)
    assert rows(reweight.in_traversal_order(weights, docs.where("false"))) == []


def test_documents_without_terms_pass_through(spark, post):
    docs = spark.createDataFrame([(1, "A a b"), (3, " ?! "), (4, "x")], "docid long, contents string")
    names = spark.createDataFrame([("v",), ("w",)], "variant string")
    tf = post.where("docid <> 2").crossJoin(names).select("variant", "docid", "term", (F.col("tf") + 1).cast("int").alias("tf"))
    got = reweight.rewritten_documents(docs, tf.where("variant = 'v' or docid = 4"), names)
    assert rows(got.where("variant = 'v'")) == [("v", 1, "a a a b b", True), ("v", 3, " ?! ", False), ("v", 4, "a a c c c d d", True)]
    assert rows(got.where("variant = 'w'"))[:2] == [("w", 1, "A a b", False), ("w", 3, " ?! ", False)]
    assert reweight.mode_of(" Weighted_Random ") == "weighted_random"


def test_white_space_and_digits_of_any_script(spark):
    line = " A\u3000b\u00a012 \u0661\u0662 x\u00b2 \u00b2\x1c7a\u2003"
    df = spark.createDataFrame([(line,), (None,)], "t string")
    got = df.select(T.whitespace_tokens(F.col("t")), T.whitespace_tokens(F.col("t"), digits=False), T.strip(F.col("t"))).collect()
    words = line.lower().split()
    assert tuple(got[0]) == (words, [w for w in words if not w.isdigit()], line.strip()) and tuple(got[1]) == ([], [], None)


def test_significance_uses_the_unrounded_p(spark):
    """A p that only rounding brings to the limit: at alpha just above it, it's significant."""
    rng = [0.01 * (k * 37 % 50) for k in range(24)]
    df = spark.createDataFrame([("b", k, x, x) for k, x in enumerate(rng)] + [("v", k, x + (0.02 if k % 3 else -0.015) * (k + 1), x) for k, x in enumerate(rng)], "variant string, qid int, rr double, ndcg double")
    z = metrics.signed_ranks(df, "b", "rr").first().z
    p = spark.range(1).select(metrics.normal_tail(F.lit(z))).first()[0]
    limits = {math.nextafter(p, 1): True, math.nextafter(p, 0): False}
    assert {a: metrics.significance(df, "b", alpha=a).first().sig_mrr for a in limits} == limits and p != round(p, 6)


def test_short_passages_are_found(spark):
    from termloom.plans import inputs

    texts = ["some words here", "awesome wordsmith", "a b c d e f g h", "xa b c d e f gy", "", "one", None, "some  words"]
    passages = ["some", "some words", "e w", "b c d", "a b c d e f g", "one", "s", "", "words here", "some  words", "zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "docid long, text string")
    wanted = spark.createDataFrame(list(enumerate(passages)), "qid long, passage string").withColumn("words", F.split("passage", " ", -1))
    want = sorted((q, d) for q, p in enumerate(passages) for d, t in enumerate(texts) if t is not None and p in t)
    assert sorted(map(tuple, inputs.short_qrels(wanted, docs).collect())) == want


def test_split(spark):
    log = spark.createDataFrame([(q, f"t{q}", q % 5, q) for q in range(40)], "qid long, query string, docid long, line_no long")
    test = split.sample_keys(log, "qid", 10)
    assert test.count() == 10 and rows(test) == rows(split.sample_keys(log.repartition(3), "qid", 10))
    assert split.held_out(log, test).count() == 10 and split.remaining(log, test).count() == 30
    corpus = spark.createDataFrame([(0,), (1,), (9,)], "docid long")
    assert rows(split.clicked_documents(corpus, log)) == [(0,), (1,)] and rows(split.missing_documents(log, corpus)) == [(2,), (3,), (4,)]
    assert split.first_clicks(log, 3).where("docid = 2").agg(F.max("line_no")).first()[0] == 12
    assert split.queries_of(log).where("docid = 1").first().queries[:2] == ["t1", "t6"]
    assert rows(split.busiest_documents(log, corpus, 2, 1)) == [(0, 8)]
    assert rows(split.queries_per_document(log.where("line_no < 38"))) == [(7, 8, 7.6)]
