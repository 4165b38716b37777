"""The near_dups stage: five words to a shingle, a similarity of 0.8 or more."""

import random

import corpus_pipeline
from tests.llm.test_jaccard import brute, corpus, shingle_set


def test_pair_between_the_thresholds(spark):
    """86/106 on five words, 89/105 on four."""
    words = [f"w{k}" for k in range(100)]
    other = ["x" if k in (30, 60) else w for k, w in enumerate(words)]
    one, two = shingle_set(" ".join(words), 5), shingle_set(" ".join(other), 5)
    assert (len(one & two), len(one | two)) == (86, 106)
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:50]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [1, 3]


def test_stage_against_brute_force(spark):
    rows = {i: t for i, t in corpus(random.Random(3)) if i is not None}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    want = sorted(i for i, _, c in brute(list(rows.items()), 80, 5) if i == c)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == want


def test_rows_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, "x"), (None, a, "x"), (5, a, "x"), (5, b, "x"), (None, c, "x"), (None, c, "x"), (7, "one two", "x"), (7, "one two", "y"), (7, "one two", "x"), (8, "", "x"), (8, "", "x"), (None, None, "x"), (9, " \t", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    sevens = [r for r in got if r[0] == 7]
    assert len(sevens) == 1 and sevens[0] in rows
    assert sorted((r for r in got if r[0] != 7), key=str) == sorted([rows[0], rows[3], rows[4], *rows[9:]], key=str)
