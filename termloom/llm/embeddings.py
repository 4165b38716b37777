"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, distributed components.

Equal vectors of a label are one class. A class's code in a table is the signs of its products with `bits` random hyperplanes; bits
grow with the logarithm of the number of classes and the number of tables follows from the chance `miss` with which a pair right
at the threshold may share no bucket. Buckets hold no vectors: a class sends its number and a sketch, the signs of 128 further
hyperplanes, to each of its buckets. Classes of a bucket whose sketches differ in no more signs than a pair at the threshold does, but for the
chance `miss`, are candidates; a bucket of over `block` classes takes all of its classes for candidates, so no task holds a whole hot bucket.
A task returns a forest of a bucket's candidates, and components of these forests are the clusters to which vectors are sent, each once.

A cluster of over `block` classes is cut into blocks by a hash and each pair of its blocks is a unit of its own. A unit takes all its cosines
in double precision as products of matrices; it returns, for each class, how many vectors it links there and the smallest class that links
reach: a row for each class, never a row for each pair. Components come from the latter.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose label or id is null, link with
nothing and are their own component; vectors of different lengths don't link; arrays of doubles are compared as doubles; repeated rows are
vectors of their own, all with the same results; an empty table gives an empty result. Columns besides vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.graph import components, hot_join
from termloom.llm.groups import map_groups
from termloom.llm.shared import lean, materialize, table

#: Signs in a sketch.
SKETCH = 128


def plan_tables(classes: int, threshold: float, miss: float, in_bucket: int = 256) -> tuple[int, int]:
    """Bits for each code and number of tables."""
    bits = min(30, max(6, math.ceil(math.log2(max(1, classes) / in_bucket))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


def most_apart(threshold: float, miss: float, signs: int = SKETCH) -> int:
    """The least number of signs that a pair at the threshold exceeds with a chance of at most `miss`."""
    p = math.acos(min(1.0, threshold)) / math.pi
    over = 1.0
    for k in range(signs + 1):
        over -= math.comb(signs, k) * p**k * (1 - p) ** (signs - k)
        if over <= miss:
            return k
    return signs


def signs(vectors: np.ndarray, n: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, vectors.shape[1]]).normal(size=(vectors.shape[1], n))
    return vectors @ planes > 0


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of n nodes that links i, j reach from each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(group: pa.Table, threshold: float, kind_of: type, rows: int = 1024) -> dict | None:
    """Links inside one unit: id, n (vectors linked), root (smallest id reached here)."""
    bi, bj = (group[k][0].as_py() for k in ("bi", "bj"))
    ids, size, part, kind = (group[k].to_numpy() for k in ("id", "m", "sub", "kind"))
    order = np.argsort(ids, kind="stable")
    ids, size, part, kind = ids[order], size[order], part[order], kind[order]
    raw = [np.frombuffer(v.as_buffer(), kind_of) for v in group["vector"]]
    width = max(map(len, raw))
    if min(map(len, raw)) < width:  # vectors of other lengths have another kind
        raw = [np.pad(v, (0, width - len(v))) for v in raw]
    x = unit(np.stack(raw).astype(np.float64)[order])
    left = np.flatnonzero(part == bi)
    right = np.flatnonzero(part == bj)
    from_, to = [], []
    for a in range(0, len(left), rows):
        i, j = np.nonzero(x[left[a : a + rows]] @ x[right].T >= threshold)
        i, j = left[a : a + rows][i], right[j]
        ok = kind[i] == kind[j]
        if bi == bj:
            ok &= i < j
        from_.append(i[ok])
        to.append(j[ok])
    if not from_ or not sum(map(len, from_)):
        return None
    i, j = np.concatenate(from_), np.concatenate(to)
    n = np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))
    root = forest(i, j, len(ids))
    some = np.unique(np.concatenate([i, j]))
    return {"id": ids[some], "n": n[some].astype(np.int64), "root": ids[root[some]]}


def candidates(batches, apart: int, block: int, most: int = 1 << 16):
    """id, root: forests of the candidates of every bucket, from rows sorted by bucket and id. most: rows held, at least `block`."""
    for rows, carried in _pieces(batches, max(most, block)):
        bucket, ids = rows["bucket"].to_numpy(), rows["id"].to_numpy()
        s1, s2 = (rows[k].to_numpy().view(np.uint64) for k in ("s1", "s2"))
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        end = np.append(start[1:], len(bucket))
        found = []
        for a, b in zip(start, end):
            if b - a < 2:
                continue
            if b - a > block or carried and a == 0:
                found.append((ids[a + 1 : b], np.full(b - a - 1, ids[a])))
                continue
            x, y = s1[a:b], s2[a:b]
            far = np.bitwise_count(x[:, None] ^ x) + np.bitwise_count(y[:, None] ^ y)
            i, j = np.nonzero(np.triu(far <= apart, 1))
            if len(i):
                root = forest(i, j, b - a)
                below = np.flatnonzero(root < np.arange(b - a))
                found.append((ids[a + below], ids[a + root[below]]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "root"])


def _pieces(batches, most: int):
    """Tables of whole buckets, and whether the first bucket's earlier rows went before: a bucket of over `most` rows comes in tables that
    each begin with its first row."""
    held: list[pa.RecordBatch] = []
    n, carried = 0, False

    def cut(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
        bucket = rows["bucket"].to_numpy()
        at = int(np.searchsorted(bucket, bucket[-1]))  # sorted, so the last bucket begins here
        return rows.slice(0, at), rows.slice(at)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        whole, rest = cut(pa.Table.from_batches(held))
        if whole.num_rows:
            yield whole, carried
            carried = False
        if rest.num_rows >= most:
            yield rest, carried
            rest, carried = rest.slice(0, 1), True
        held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held), carried


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-8, block: int = 2048, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    double = isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    number, kind_of = ("double", np.float64) if double else ("float", np.float32)
    v = F.col("embedding").cast(f"array<{number}>")
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), F.xxhash64("label", F.size(v)).alias("kind"), fine.alias("fine"), F.xxhash64("label", v).alias("k1"), F.xxhash64(F.lit("class"), v, F.col("label")).alias("k2"))
    good = rows.where("fine")
    classes = good.groupBy("k1", "k2", "kind").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    # one vec_id may come with several vectors, so classes have numbers of their own; they're fixed by the written table
    classes, _ = materialize(classes.withColumnRenamed("id", "vec").withColumn("id", F.monotonically_increasing_id()), "vectors")
    bits, tables = plan_tables(classes.count(), threshold, miss)
    apart = most_apart(threshold, miss)

    def code(batches):
        for batch in batches:
            ids, kind = batch["id"].to_numpy(), batch["kind"].to_numpy()
            flat, sizes = batch["v"].flatten().to_numpy(), batch["v"].value_lengths().to_numpy()
            start = np.cumsum(sizes) - sizes
            for width in np.unique(sizes):
                own = np.flatnonzero(sizes == width)
                x = flat[start[own][:, None] + np.arange(width)].astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                s = signs(x, bits * tables + SKETCH, seed)
                codes = s[:, :-SKETCH].reshape(len(own), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                sketch = np.packbits(s[:, -SKETCH:], axis=1).view(np.int64)
                each = lambda c: pa.array(np.repeat(c, tables))
                number = pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own)))
                yield pa.RecordBatch.from_arrays([each(ids[own]), each(kind[own]), number, pa.array(codes.ravel()), each(sketch[:, 0]), each(sketch[:, 1])], ["id", "kind", "t", "code", "s1", "s2"])

    coded = classes.select("id", "kind", "v").mapInArrow(lean(code), "id bigint, kind bigint, t int, code bigint, s1 bigint, s2 bigint")
    buckets = coded.select(F.xxhash64("kind", "t", "code").alias("bucket"), "id", "s1", "s2").repartition("bucket").sortWithinPartitions("bucket", "id")
    chosen = buckets.mapInArrow(lean(lambda it: candidates(it, apart, block), None), "id bigint, root bigint").distinct()
    chosen, _ = materialize(chosen, "candidates")
    clusters = components(chosen, "id", "root")

    blocks = F.ceil(F.col("classes") / block).cast("int")
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("classes")).select("component", "classes", blocks.alias("blocks"))
    members = hot_join(clusters, sizes, "component", clusters.count(), "classes").withColumn("sub", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("blocks")).cast("int"))
    packed = classes.join(members.withColumnRenamed("node", "id"), "id").select("id", "m", "kind", "v", "component", "sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))

    def pack(batches):
        for batch in batches:
            yield batch.drop_columns(["v"]).append_column("vector", pa.array([np.asarray(e, kind_of).tobytes() for e in _arrays(batch["v"])], pa.binary()))

    heavy = packed.select("component", F.least("sub", "o").alias("bi"), F.greatest("sub", "o").alias("bj"), "id", "m", "kind", "sub", "v")
    heavy = heavy.mapInArrow(lean(pack), "component bigint, bi int, bj int, id bigint, m bigint, kind bigint, sub int, vector binary")
    found = map_groups(heavy, ["component", "bi", "bj"], lambda g: block_links(g, threshold, kind_of), "id bigint, n bigint, root bigint", pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))
    found, _ = materialize(found, "links")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    reached = components(found.where("id <> root"), "id", "root")
    least = reached.join(classes.select("id", "vec"), F.col("id") == F.col("node")).groupBy("component").agg(F.min("vec").alias("least"), F.count(F.lit(1)).alias("times"))
    reached = hot_join(reached, least, "component", reached.count()).select("node", "least")
    of = classes.join(links, "id", "left").join(reached, F.col("id") == F.col("node"), "left")
    of = of.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("least", "vec").alias("component"))
    out = rows.withColumn("k1", F.when(F.col("fine"), F.col("k1"))).select("vec_id", "k1", "k2").join(of, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _arrays(lists: pa.ListArray):
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    end = np.cumsum(sizes)
    return (flat[b - n : b] for b, n in zip(end, sizes))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine
  FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.fine AND b.fine AND list_cosine_similarity(a.e, b.e) >= 0.98
), walk(vec_id, reach) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT walk.vec_id, links.b FROM walk JOIN links ON walk.reach = links.a
), c AS (
  SELECT vec_id, min(reach) AS component_id FROM walk GROUP BY vec_id
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.vec_id
"""
