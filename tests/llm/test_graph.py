import random

import numpy as np
import pytest

from termloom.llm import graph


def brute(edges):
    """Node -> smallest node reachable, for nodes of edges that aren't loops."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        stack = [x] if x not in out else []
        while stack:
            y = stack.pop()
            if y not in out:
                out[y] = x
                stack.extend(near[y])
    return out


def several(rng):
    path = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(120)]
    hubs = [(1, k) for k in range(5000, 5300)] + [(9000, k) for k in range(6000, 6300)] + [(7000, k) for k in range(6900, 7200)] + [(5001, 6001), (6, 7001)]
    return list(zip(path, path[1:])) + hubs + [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(777, 777), (5001, 6001), (6001, 5001)]


@pytest.mark.parametrize("few", [0, 900, 1 << 20])
def test_rounds_and_merge_agree(spark, few):
    """By rounds alone, by rounds until few edges are left, and in one task."""
    edges = several(random.Random(2))
    rows = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7), few=few).collect()
    got = {r.node: r.component for r in rows}
    assert got == brute(edges) and len(rows) == len(got)


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """A long path took many rounds, each of two tables and some ten shuffles: the edges and their merge are all that is written now."""
    written, plain = [], graph.materialize

    def watched(df, name):
        written.append(name)
        return plain(df, name)

    monkeypatch.setattr(graph, "materialize", watched)
    edges = [(k, k + 1) for k in range(1000, 1200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges) and len(written) == 2
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_against_brute_force(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(rng.choice([50, 400, 900]))]
    edges = [(a, b) for a, b in edges if a != b]
    u, least = graph.merged(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert dict(zip(u.tolist(), least.tolist())) == {x: c for x, c in brute(edges).items() if x != c}
