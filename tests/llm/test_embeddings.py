import math
import random

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import embeddings
from termloom.llm.graph import components


def brute(rows, threshold=0.98, number=np.float32):
    """(n_links, component) of each row of (vec_id, embedding, label)."""
    def unit(r):
        if r[0] is None or r[1] is None or r[2] is None or not r[1] or any(x is None or not math.isfinite(x) for x in r[1]) or not any(r[1]):
            return None
        x = np.array(number(r[1]), np.float64)
        x = x / abs(x).max()
        return x / np.sqrt(x @ x)

    units = [unit(r) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [(r[0], n[k], least.get(find(k))) for k, r in enumerate(rows)]


def test_hot_group_in_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2):
        centre = rng.normal(size=16)
        for _ in range(120):  # a chain of near copies: many links at the threshold
            centre = centre + rng.normal(size=16) * 0.02
            rows.append([len(rows), [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.08)], label])
    rows += [[500 + k, list(rows[3][1]), 1] for k in range(40)]
    rows += [[600, list(rows[3][1]), None], [601, None, 1], [602, [], 1], [603, [0.0] * 16, 1], [604, [float("nan")] + [1.0] * 15, 1], [605, [None] + [1.0] * 15, 1], [606, [float("inf")] + [1.0] * 15, 1]]
    rows += [[None, list(rows[3][1]), 1], [607, rows[3][1][:8], 1], [608, [x * 1e-30 for x in rows[3][1]], 1], [609, [x * 1e30 for x in rows[3][1]], 1], [700, [1.0, 0.0], 9], [700, [0.0, 1.0], 9], [701, [0.0, 2.0], 9]]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, id int")
    want = sorted(brute(rows), key=str)
    for block in (16, 2048):
        got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=block).collect()), key=str)
        assert got == want
    assert embeddings.near_duplicates(df.where(F.lit(False))).count() == 0


def turned(rng, x, cosine):
    """A vector at the given cosine to the unit vector x."""
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    y /= np.sqrt(y @ y)
    return cosine * x + math.sqrt(1 - cosine * cosine) * y


def test_doubles_right_at_the_threshold(spark):
    """Pairs at 0.98 +- 1e-10 as doubles: the lower ones don't link, which floats can't tell."""
    rng, rows, want = np.random.default_rng(8), [], []
    for k in range(150):
        x = rng.normal(size=24)
        x /= np.sqrt(x @ x)
        for j, y in enumerate((x, turned(rng, x, 0.98 + (1e-10 if k % 2 else -1e-10)))):
            rows.append((2 * k + j, [float(e) for e in y * (k + 0.5)], k % 3))
            want.append((2 * k + j, k % 2, 2 * k if k % 2 else 2 * k + j))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == want == sorted(brute(rows, number=np.float64))


def test_pieces_and_candidates():
    """Buckets over batches and over the size of a piece: the same forests as all pairs give."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    bucket = np.sort(rng.integers(0, 40, 900))
    bucket[300:700] = 20
    bucket.sort()
    s = rng.integers(0, 1 << 62, (6, 2))[rng.integers(0, 6, 900)] ^ (1 << rng.integers(0, 60, (900, 2)))
    rows = pa.table({"bucket": bucket, "id": np.arange(900), "s1": s[:, 0], "s2": s[:, 1]})
    batches = rows.to_batches(max_chunksize=37)
    assert sum(t.num_rows - carried for t, carried in embeddings._pieces(batches, 64)) == 900
    for block, most in ((5, 9), (60, 64), (2000, 2000)):
        root = {k: k for k in range(900)}

        def find(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for batch in embeddings.candidates(iter(batches), 4, block, most):
            for a, b in zip(*(batch[k].to_pylist() for k in ("id", "root"))):
                root[find(a)] = find(b)
        for i in range(900):
            for j in range(i):
                if bucket[i] == bucket[j]:
                    near = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(s[i], s[j])) <= 4 or (bucket == bucket[i]).sum() > block
                    assert not near or find(i) == find(j)


def test_misses_by_design():
    """The planned chances, by drawing pairs right at the threshold."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    y = np.stack([turned(rng, e, 0.98) for e in x])
    bits, tables = embeddings.plan_tables(1 << 18, 0.98, 1e-3)
    s, t = (embeddings.signs(v, bits * tables, 1).reshape(4000, tables, bits) for v in (x, y))
    assert 1 - (s == t).all(2).any(1).mean() <= 4e-3
    apart = embeddings.most_apart(0.98, 1e-3)
    far = (embeddings.signs(x, 128, 2) != embeddings.signs(y, 128, 2)).sum(1)
    assert (far > apart).mean() <= 4e-3 < (far > apart - 4).mean()


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(k) == c for k, c in got.items())
    assert set(got) == {x for a, b in edges for x in (a, b) if a != b}


def test_components_with_hubs(spark):
    """Hubs with more edges than a task should get: a low one, a high one and one in between."""
    edges = [(1, k) for k in range(5000, 5300)] + [(9000, k) for k in range(6000, 6300)] + [(7000, k) for k in range(6900, 7200)] + [(5001, 6001), (6, 7001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 6 if 6900 <= x < 7200 or x == 6 else 1 for e in edges for x in e}
