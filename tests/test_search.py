import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from termloom.operators import index, relevance, retrieval, reweight


def brute(docs, queries, k):
    """query -> [(docid, score)] by the formula, document by document."""
    df = Counter(t for words in docs.values() for t in set(words))
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, words in queries.items():
        scores = defaultdict(float)
        for d, own in docs.items():
            tf = Counter(own)
            for t, n in Counter(words).items():
                if tf[t]:
                    scores[d] += n * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] / (tf[t] + 0.9 * (0.6 + 0.4 * len(own) / mean))
        out[q] = [(d, pytest.approx(s)) for d, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), str(x[0])))[:k]]
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(1)
    words = [f"w{int(draw.paretovariate(0.6))}" for _ in range(40_000)]
    docs = {d: [draw.choice(words) for _ in range(draw.randint(1, 60))] for d in range(600)}
    docs |= {d: docs[d % 3] for d in range(600, 680)}  # ties
    return docs, {q: [draw.choice(words) for _ in range(draw.randint(1, 12))] for q in range(80)} | {80: docs[0], 81: ["w1"]}


def found(df):
    rows = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        rows[r.qid].append((r.docid, r.score))
    return rows


def test_search_is_exact(spark, corpus):
    docs, queries = corpus
    stored = index.Index.store(index.postings(spark.createDataFrame(list(docs.items()), "docid long, tokens array<string>")))
    terms = spark.createDataFrame([(q, t) for q, ws in queries.items() for t in ws], "qid long, term string")
    for k in (1, 10):
        top = retrieval.bm25(stored, terms, k=k)
        assert found(top) == brute(docs, queries, k)
    # documents meet queries in shards: nothing is summed for each pair of them
    text = top._jdf.queryExecution().executedPlan().toString()
    assert "sum(" not in text and "WindowGroupLimit" in text


def test_variants_lie_side_by_side(spark, corpus):
    docs, queries = corpus
    post = index.postings(spark.createDataFrame(list(docs.items()), "docid long, tokens array<string>"))
    weights = post.where("docid % 2 = 0").select("docid", "term", F.lit(3).alias("scaled"))
    wide = reweight.reweighted_side_by_side(post, weights, [1.0, 0.5])
    stored = index.Index.store_variants(wide, ["plain", "half"])
    assert stored.post.count() == post.count()
    top = retrieval.bm25(stored, spark.createDataFrame([(q, t) for q, ws in queries.items() for t in ws], "qid long, term string"))
    assert found(top.where("variant = 'plain'")) == brute(docs, queries, 10)
    longs = reweight.reweighted(post, weights, spark.createDataFrame([("half", 0.5)], "variant string, alpha float"))
    single = retrieval.bm25(index.Index.store(longs.select("docid", "term", "tf")), spark.createDataFrame([(q, t) for q, ws in queries.items() for t in ws], "qid long, term string"))
    assert {q: [(d, pytest.approx(s)) for d, s in r] for q, r in found(single).items()} == found(top.where("variant = 'half'"))


def test_relevance_in_blocks(spark, corpus, monkeypatch):
    """Blocks give what joins by query and term give, also where a query's clicks meet several blocks, and nothing is dealt by term of a query."""
    docs, queries = corpus
    post = index.postings(spark.createDataFrame([(d, ws) for d, ws in docs.items() if d < 300], "docid long, tokens array<string>"))
    collection = relevance.collection_model(post)
    own = {q: ws for q, ws in queries.items() if q < 30} | {30: ["zz"], 31: ["w1", "zz", "w1"]}
    terms = spark.createDataFrame([(f"q{q}", t, n) for q, ws in own.items() for t, n in Counter(ws).items()], "query string, term string, qtf long")
    draw = random.Random(2)
    hits = spark.createDataFrame([(f"q{q}", d, draw.random() * 9) for q in own if q != 3 for d in draw.sample(range(310), 20)], "query string, docid long, score double")
    pairs = spark.createDataFrame([(d, f"q{q}", draw.randint(1, 3)) for q in own for d in draw.sample(range(310), 12)], "docid long, query string, times long")
    wanted = pairs.join(post, "docid").select("query", "term").distinct()
    scores = relevance.query_term_scores(wanted, terms, hits.select("query", "docid"), relevance.unigram_models(post, collection), collection)
    want = {(r.docid, r.query, r.term): (pytest.approx(r.log_weight, abs=1e-9), r.doc_score, r.times) for r in relevance.query_weights(pairs, post, scores, collection, hits).collect()}
    for part, block, wide in ((5_000, 100_000, 16_384), (5, 50, 7)):
        monkeypatch.setattr(relevance, "PART", part)
        monkeypatch.setattr(relevance, "BLOCK", block)
        monkeypatch.setattr(relevance.B, "WIDE", wide)
        got = relevance.pair_weights(pairs, terms, hits, post, collection)
        assert {(r.docid, r.query, r.term): (r.log_weight, r.doc_score, r.times) for r in got.collect()} == want and len(want) > 1000
        assert "hashpartitioning(query" not in got._jdf.queryExecution().executedPlan().toString()
