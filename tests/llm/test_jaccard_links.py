import random

import pytest
from tests.llm.test_jaccard import corpus, edited, shingle_set

from termloom.llm import jaccard


def count_links(rows, percent=85):
    """(doc_id, number of other rows that link with it), by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    link = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    return sorted(((i, sum(link(s, o) for j, o in enumerate(sets) if j != k and o) if s else 0) for k, (i, s) in enumerate(zip((i for i, _ in rows), sets))), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_link_counts_against_brute_force(spark, seed):
    rng, base = random.Random(seed), [f"g{k}" for k in range(120)]
    rows = corpus(rng) + [(1000 + k, " ".join(edited(rng, base, 0.006))) for k in range(50)]  # a group above the few that are compared one by one
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = count_links(rows)
    assert max(n for _, n in want) > 20
    for options in ({}, {"block_docs": 7}):
        assert sorted(((r.doc_id, r.n_links) for r in jaccard.similar_documents(df, **options).collect()), key=str) == want
