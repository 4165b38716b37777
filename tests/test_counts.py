"""Postings and judgements that are made in numpy: results as the plain definitions give them, and what their plans leave out."""

import re
from collections import Counter

import pytest
from termloom.functions import passages, text
from termloom.operators import index
from termloom.plans import inputs, queries

TEXTS = [
    "one Two  three three 4four KKİ straße é", None, "", "a", "b a", "...", "tail", "Head of a text", "x " * 5 + "one two three four five six seven eight nine ten",
    "zone two three four five six seven eight nines ten", "two three four five six seven", " p q r s t u v w ", "p  q r s t u v w", "éé p q r s t u v wé",
]
PASSAGES = ["one two three four five six seven eight nine", "p q r s t u v w", " q r s t u v w", "two three", "p  q r s t u v w", "no such run of words is in any of them", "a", ""]


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(1, "b b a"), (4, "A c"), (None, "a z")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, p) for i, p in enumerate(PASSAGES)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [1, 30, 4_000_000])
def test_counts_are_those_of_postings(spark, folder, monkeypatch, piece):
    """Also where docids are null or repeated; no hash map of a task's postings is made."""
    sf, docs = folder
    monkeypatch.setattr(text, "PIECE", piece)
    want = Counter((d, w.lower()) for d, t in docs for w in re.findall(r"(?a:[a-zA-Z0-9]+)", t or ""))
    got = [tuple(r) for r in inputs.counted(spark, sf).collect()]
    assert {(d, t): n for d, t, n in got} == want and len(got) == len(want)
    assert sorted(map(repr, map(tuple, inputs.post(spark, sf).collect()))) == sorted(map(repr, got))
    few = spark.createDataFrame([(0,), (4,), (99,)], "docid long")
    assert {(r.docid, r.term): r.tf for r in inputs.counted(spark, sf, only=few).collect()} == {k: n for k, n in want.items() if k[0] in (0, 4)}
    assert {(r.docid, r.term): r.tf for r in inputs.counted(spark, sf, but=few).collect()} == {k: n for k, n in want.items() if k[0] not in (0, 4)}


def test_index_is_counted_without_a_map(spark, monkeypatch):
    """read_runs, evaluation_summary, read_results: a task's memory doesn't hold its postings."""
    plans = []
    monkeypatch.setattr(index, "written", lambda df, name: plans.append((name, plan(df))) or df)
    inputs.index(spark, "/root/testdata/sf0.001")
    assert plans[0][0] == "postings" and "HashAggregate" not in plans[0][1] and "MapInArrow" in plans[0][1]


def test_qrels_hold_what_texts_contain(spark, folder, monkeypatch):
    sf, docs = folder
    for piece in (1, 60, 4_000_000):
        monkeypatch.setattr(text, "PIECE", piece)
        got = [tuple(r) for r in inputs.qrels(spark, sf).collect()]
        want = {(i, d) for i, p in enumerate(PASSAGES) for d, t in docs if t is not None and p in t}
        assert set(got) == want and len(got) == len(want)


def test_qrels_without_a_second_pass_over_texts(spark):
    """significance, variant_summary, wilcoxon_w_z: texts are read once, and runs of words aren't rows."""
    text = plan(queries.qrels(spark, "/root/testdata/sf0.01"))
    assert text.count("parquet") and "SortMergeJoin" not in text and "xxhash64" not in text and text.count("text#") and text.count("REPARTITION_BY_COL") == 1


def test_runs_across_texts_are_none():
    import pyarrow as pa

    texts = pa.array(["a b c d", None, "b c", "x b c y", "", "q x b c"])
    rows, keys = passages.inner_runs(texts, 2)
    assert rows.tolist() == [0, 3, 5] and keys[0] == keys[1] != keys[2]


def test_documents_without_weights_have_no_join_by_term(spark, monkeypatch):
    """variant_summary, wilcoxon_w_z, significance: documents that no click reaches keep their frequencies without a join by term."""
    wide = queries.cg_side_by_side(spark, "/root/testdata/sf0.01")
    text = plan(wide)
    assert "Union" in text and "array_repeat" in text and "HashAggregate" not in text.split("Union")[0]


def test_only_wanted_terms_are_stored(spark, folder):
    """Postings of terms that no topic has are left out before they leave numpy; lengths and results stay whole."""
    sf, docs = folder
    terms = spark.createDataFrame([("two",), ("w",), ("nowhere",), ("a",)], "term string")
    few, all_ = inputs.index(spark, sf, terms), inputs.index(spark, sf)
    assert sorted(map(repr, few.lengths.collect())) == sorted(map(repr, all_.lengths.collect()))
    assert sorted(map(repr, few.post.collect())) == sorted(map(repr, all_.post.join(terms, "term", "left_semi").select("docid", "term", "tf").collect()))
    small = "/root/testdata/sf0.01"
    wide = queries.cg_side_by_side(spark, small, inputs.topic_terms(spark, small)).where("term is not null")
    assert wide.count() < queries.cg_side_by_side(spark, small).count() / 2
