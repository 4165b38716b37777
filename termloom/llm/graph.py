"""Connected components of an edge table, as rounds of joins while it has many edges, then in one task.

Each round is a large star and a small star: every node's larger neighbours, then its smaller ones, are linked to the smallest node
near it. Minima are combined before the shuffle, and a round never has more edges than the one before. A node with a large part of all edges
is joined by broadcast, so no task gets them all. Rounds are written to the
shared folder; the loop ends when a round changes nothing, which takes a number of rounds that grows with the logarithm of the
largest component, or when no more than `few` edges are left. A round costs several shuffles even for a handful of edges, so those are
merged in the memory of one task, whose size `few` bounds whatever the input: 16 bytes an edge as they come, some 200 while they are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.shared import drop, lean, materialize


def hot_join(rows: DataFrame, facts: DataFrame, key: str, total: int, times: str = "times") -> DataFrame:
    """rows joined with facts, which holds each key once and in `times` how many rows have it.

    Keys with over a thousandth of the `total` rows, hence under a thousand keys, are broadcast and their rows stay where they are.
    """
    hot = F.col(times) * 1000 > F.lit(max(total, 100_000))
    often = F.broadcast(facts.where(hot).drop(times))
    rest = rows.join(often.select(key), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(facts.where(~hot).drop(times), key))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def merged(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that isn't the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x < y:
            root[y] = x
        else:
            root[x] = y
    for k, x in enumerate(root):  # roots are smaller, so that of x is final
        root[k] = root[x]
    least = np.array(root, np.int64)
    rest = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[rest], nodes[least[rest]]


def _merge(batches):
    held = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches if b.num_rows]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(*map(np.concatenate, zip(*held)))], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 1 << 20) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge; nodes are long, edges may repeat, point either way or be loops."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    spark = edges.sparkSession
    now, path = materialize(now, "edges")
    mark = _mark(now)
    while mark[0] > few:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("times")).select("u", F.least("u", "m").alias("m"), "times")
        large = hot_join(now.select(F.col("v").alias("u"), F.col("u").alias("w")), least, "u", mark[0]).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large, middle = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times"))
        small = hot_join(large, least, "u", mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small, after = materialize(small, "edges")
        drop(spark, middle)
        drop(spark, path)
        now, path, before, mark = small, after, mark, _mark(small)
        if mark == before:
            break
    else:
        if mark[0]:
            now, _ = materialize(now.coalesce(1).mapInArrow(lean(_merge, None), "u bigint, v bigint"), "edges")
            drop(spark, path)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
