"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct word shingles; documents with equal sets are one class. Two sets link when
100 * intersection >= percent * union. The join is exact:

1. Shingles are hashed into m groups, m above the largest symmetric difference D that linked sets of a size class can have. At most
   D groups differ, so linked sets have equal groups, more than a set has groups of one shingle or none: each set sends a hash of every
   larger group to a bucket. Where that count fails, it also sends its groups of one shingle, and where that fails its empty ones. A task
   combines its own rows of a bucket before the shuffle; sets of a bucket are chained, and components of the chains are the candidate clusters.
2. Inside a cluster the group counts of each set are a point, and points go into an R-tree. The sum of coordinate minima of a
   point and a node's upper corner bounds the overlap with every set below it; nodes and points whose bound can't reach the
   threshold are left out, and all survivors are verified by intersecting the shingles. Clusters with many shingles
   are cut into blocks by set size, then by a hash, and each pair of blocks whose sizes allow a link is a unit of its own.
3. Components of the verified links, and sums of the link counts of the units; a set counts for each of its rows.

Only a row for each linked set of a unit leaves a task, so rows never grow with the square of a group. Shingles are told apart by 64-bit
hashes, sets by two of them: where two sets share the first, which names them, all hashes are made anew with another seed.

Defined results: a null or empty text, or one of white space, has the empty set, links with nothing and is its own component;
n_links is the number of other rows that a row links with, rows of an equal set included;
rows with a null doc_id link like others but never name a component unless alone with such rows; repeated rows each get a row; an empty
table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.graph import components
from termloom.llm.groups import map_groups
from termloom.llm.hashing import MASK, U, mix, shingles, word_hashes
from termloom.llm.shared import lean, materialize, maybe_in, table


def set_hash(s: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> int:
    """Of a set without order, as a signed 64-bit number."""
    x = (int(mix(s ^ U(salt)).sum(dtype=U)) ^ (len(s) * 0x9E3779B97F4A7C15)) & MASK
    return x - (1 << 64) if x >> 63 else x


#: Salt of the second hash of a set.
CHECK = 0xDA942042E4DD58B5


def shingle_set(text: pa.StringScalar, width: int, seed: int) -> np.ndarray:
    return shingles(word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), seed), width)


class SizeClasses:
    """Classes [low, high) of the smaller set's size, with the number of groups of each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [self.least_size()]

    def most_apart(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def least_size(self) -> int:
        n = 1
        while self.most_apart(n, n * 100 // self.percent) < 1 and n < 1000:
            n += 1
        return n

    def high(self, low: int) -> int:
        return max(low + 1, low * 3 // 2)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(low, groups, D) of the classes in which a set of n shingles takes part; D is for its own pairs there."""
        while self.bounds[-1] <= n:
            self.bounds.append(self.high(self.bounds[-1]))
        out = []
        for low, high in zip(self.bounds, self.bounds[1:]):
            if high <= n * self.percent / 100 or low > n:
                continue
            top = high - 1
            d = self.most_apart(top, top * 100 // self.percent)
            own = self.most_apart(n, n * 100 // self.percent) if n < high else self.most_apart(top, n)
            out.append((low, d + 3 + d // 10, own))
        return out


def signatures(s: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """Bucket hashes of a set's groups in all its size classes."""
    found = []
    spread, value = mix(s ^ U(0x2545F4914F6CDD1D)), mix(s ^ U(0x632BE59BD9B4E019))
    for low, groups, apart in classes.of(len(s)):
        of = ((spread >> U(32)) * U(groups) >> U(32)).astype(np.int64)
        lo = np.bincount(of, (value & U(0xFFFFFFFF)).astype(np.float64), groups)  # sums below 2^53 are exact
        hi = np.bincount(of, (value >> U(32)).astype(np.float64), groups)
        n = np.bincount(of, minlength=groups)
        rows = np.arange(groups)
        for few in (1, 0):  # equal groups have equal counts, so both sets keep or leave out the same of them
            if groups - apart - int((n <= few).sum()) >= 1:
                rows = rows[n > few]
                break
        key = (hi[rows].astype(U) << U(32)) + lo[rows].astype(U) + n[rows].astype(U) * U(0x9E3779B97F4A7C15)
        found.append(mix(key + mix(rows.astype(U) * U(0xD6E8FEB86659FD93) + U(low))))
    return np.concatenate(found) if found else np.zeros(0, U)


class CountTree:
    """An R-tree of group-count points, packed in order of set size and first coordinates."""

    def __init__(self, sets: list[np.ndarray], groups: int, fan: int = 16):
        self.sets, self.groups = sets, groups
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.points = np.stack([self.point(s) for s in sets])
        self.order = np.lexsort((self.points[:, 0], self.sizes))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # upper corners and least sizes, leaves first
        corner, least = self.points[self.order], self.sizes[self.order]
        self.fan = fan
        while len(corner) > 1:
            cuts = np.arange(0, len(corner), fan)
            corner, least = np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((corner, least))

    def point(self, s: np.ndarray) -> np.ndarray:
        return np.bincount(((mix(s) >> U(40)) * U(self.groups) >> U(24)).astype(np.int64), minlength=self.groups).astype(np.int32)

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of the sets whose overlap, bounded by summed coordinate minima, can reach the threshold."""
        reach = lambda corner, least: (100 + percent) * np.minimum(point, corner).sum(1) >= percent * (size + least)
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.order))
        for k in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[k]
            at = at[reach(corner[at], least[at])]
            below = len(self.levels[k - 1][0]) if k else len(self.order)
            at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
            at = at[at < below]
        at = self.order[at]
        return at[reach(self.points[at], self.sizes[at])]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    k = np.searchsorted(b, a)
    both = int((b[np.minimum(k, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Postings:
    """Which sets hold a shingle, for the overlaps of one set with all of them."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.keys, self.of = every[order], np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
        self.n = len(sets)

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        at, end = np.searchsorted(self.keys, s), np.searchsorted(self.keys, s, "right")
        many = end - at
        rows = np.repeat(end - np.cumsum(many), many) + np.arange(int(many.sum()))
        return np.bincount(self.of[rows], minlength=self.n)


def verified(group: pa.Table, percent: int, few: int = 16) -> dict | None:
    """All links in one unit, which is all pairs of a block or all pairs across two blocks: each linked set with the number of rows it links
    with there, and the first set of the unit that links reach from it."""
    bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
    seen: dict[int, int] = {}
    for k, node in enumerate(group["node"].to_pylist()):
        seen.setdefault(node, k)
    rows = list(seen.values())
    nodes, part = np.array(list(seen)), group["sub"].to_numpy()[rows]
    binary = group["shingles"]
    sets = [np.frombuffer(binary[k].as_py(), U) for k in rows]
    left, right = np.flatnonzero(part == bi), np.flatnonzero(part == bj)
    if not len(left) or not len(right):
        return None
    groups = int(min(512, max(16, np.mean([len(s) for s in sets]) // 4)))
    tree, postings = CountTree([sets[k] for k in right], groups), None
    copies, sizes = group["copies"].to_numpy()[rows], np.array([len(s) for s in sets])
    n, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for x in left:
        near = tree.search(tree.point(sets[x]), len(sets[x]), percent)
        near = near[right[near] > x] if bi == bj else near
        if len(near) > few:
            postings = postings or Postings([sets[k] for k in right])
            both = postings.overlaps(sets[x])[near]
            found = right[near[100 * both >= percent * (sizes[x] + sizes[right[near]] - both)]]
        else:
            found = right[[k for k in near if linked(sets[x], sets[right[k]], percent)]]
        if len(found):
            n[x] += copies[found].sum()
            n[found] += copies[x]
            joined = np.unique(np.append(root[found], root[x]))
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    some = np.flatnonzero(n)
    return {"id": nodes[some], "n": n[some], "root": nodes[root[some]]} if len(some) else None


def _nodes(batches, width: int, seed: int):
    for batch in batches:
        sets = [shingle_set(t, width, seed) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["text"], pa.array([set_hash(s) for s in sets], pa.int64())], ["text", "node"])


def units(members: DataFrame, percent: int, block_shingles: int, block_docs: int) -> DataFrame:
    """node, component, first, copies, sub (a block) and units (the pairs of blocks to compare) of every member of a candidate cluster.

    A cluster within the limits is one block. A larger one is cut by set size into classes, of which only neighbours can hold linked
    sets, and a class over the limits is cut further by a hash. Blocks are numbered class * 2^16 + part.
    """
    wide = math.log(100 / percent) * 1.001  # a little more than linked sizes can differ by
    size = F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count(F.lit(1)) / block_docs)).cast("int")
    whole = members.groupBy("component").agg((size > 1).alias("large"))
    rows = members.join(whole, "component").withColumn("class", F.when(F.col("large"), F.floor(F.ln("n") / wide)).otherwise(0).cast("int"))
    parts = rows.groupBy("component", "class").agg(size.alias("parts"))
    near = W.partitionBy("component").orderBy("class")  # some sixty classes at most
    beside = lambda fn, step: F.when(fn("class").over(near) == F.col("class") + step, fn("parts").over(near)).otherwise(0)
    parts = parts.withColumns({"before": F.coalesce(beside(F.lag, -1), F.lit(0)), "after": F.coalesce(beside(F.lead, 1), F.lit(0))})
    rows = rows.join(parts, ["component", "class"])
    part = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int")
    block = lambda c, k: (c * 65536 + k).cast("int")
    rows = rows.withColumn("part", part).withColumn("sub", block(F.col("class"), F.col("part")))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda x, y: F.struct(F.least(x, y).alias("bi"), F.greatest(x, y).alias("bj"))
    each = lambda n, step: F.transform(upto(n), lambda k: pair(F.col("sub"), block(F.col("class") + step, k)))
    found = F.concat(each(F.col("parts"), 0), each(F.col("before"), -1), each(F.col("after"), 1))
    return rows.select("node", "component", "first", "copies", "sub", found.alias("units"))


def row_hash() -> Column:
    """Of a row's doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), "text")


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs (doc_id, text); the options are those of similar_rows."""
    return similar_rows(docs, **options).drop("row", "component")


def similar_rows(docs: DataFrame, width: int = 4, percent: int = 85, block_shingles: int = 1 << 21, block_docs: int = 8192, seed: int = 1) -> DataFrame:
    """As similar_documents, with row (row_hash) and component, which tells components apart where doc_ids are null or repeat."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def shape(batches):
        for batch in batches:
            sets = [shingle_set(t, width, seed) for t in batch["text"]]
            hashes = [pa.array([set_hash(s, *salt) for s in sets], pa.int64()) for salt in ((), (CHECK,))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array([len(s) for s in sets], pa.int64()), *hashes], ["doc_id", "row", "n", "node", "check"])

    shapes, _ = materialize(rows.withColumn("row", row_hash()).mapInArrow(lean(shape), "doc_id bigint, row bigint, n bigint, node bigint, check bigint"), "shapes")
    first = shapes.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), (F.min("check") != F.max("check")).alias("clash"))
    first, _ = materialize(first, "sets")
    if first.where("clash").limit(1).count():
        return similar_rows(docs, width, percent, block_shingles, block_docs, seed + 1)
    shapes, first = shapes.drop("check"), first.drop("clash")

    def sign(batches):
        classes = SizeClasses(percent)
        own: dict[int, None] = {}
        sigs, of, total = [], [], 0

        def flush():
            """One row for each bucket of the task, and the links between its own sets in a bucket."""
            sig, node = np.concatenate(sigs).view(np.int64), np.concatenate(of)
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            same = sig[1:] == sig[:-1]
            a, b = node[1:][same], node[:-1][same]
            pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
            first = np.concatenate([[True], ~same])
            yield pa.RecordBatch.from_arrays([pa.array(sig[first]), pa.array(node[first]), pa.nulls(int(first.sum()), pa.int64())], ["sig", "node", "other"])
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0] ^ pairs[:, 1]), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["sig", "node", "other"])

        for batch in batches:
            for t in batch["text"]:
                s = shingle_set(t, width, seed)
                node = set_hash(s)
                if node in own:
                    continue
                if len(own) > 1 << 20:
                    own.clear()
                own[node] = None
                x = signatures(s, classes)
                if len(x):
                    sigs.append(x)
                    of.append(np.full(len(x), node))
                    total += len(x)
                if total > 1 << 20:
                    yield from flush()
                    sigs, of, total = [], [], 0
        if sigs:
            yield from flush()

    buckets = rows.select("text").mapInArrow(lean(sign), "sig bigint, node bigint, other bigint")
    chained = buckets.withColumn("before", F.lag("node").over(W.partitionBy("sig", F.col("other").isNull()).orderBy("node")))
    edges = chained.select("node", F.when(F.col("other").isNull(), F.col("before")).otherwise(F.col("other")).alias("other")).where("node <> other")
    clusters = components(edges, "node", "other")

    members = clusters.join(first, "node").select("node", "component", "first", "n", "copies")
    members, _ = materialize(members, "members")
    placed = units(members, percent, block_shingles, block_docs)

    def gather(batches):
        for batch in batches:
            sets = [shingle_set(t, width, seed) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["node"], batch["component"], batch["copies"], batch["sub"], batch["units"], pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "component", "copies", "sub", "units", "own", "shingles"],
            )

    likely = maybe_in(rows, "doc_id", members.select(F.col("first").alias("doc_id")))
    texts = likely.join(placed.withColumnRenamed("first", "doc_id"), "doc_id").drop("doc_id")
    unnamed = placed.where("first is null").drop("first")
    if unnamed.limit(1).count():  # sets that only rows without an id have
        nodes = rows.where("doc_id is null").select("text").mapInArrow(lean(lambda it: _nodes(it, width, seed)), "text string, node bigint").dropDuplicates(["node"])
        texts = texts.unionByName(nodes.join(unnamed, "node").select(texts.columns))
    held = texts.select("text", "node", "component", "copies", "sub", "units").mapInArrow(lean(gather), "node bigint, component bigint, copies bigint, sub int, units array<struct<bi int, bj int>>, own bigint, shingles binary")
    # rows that share a doc_id may hold other texts than the one that was placed
    held = held.where("own = node").select("node", "component", "copies", "sub", "shingles", F.explode("units").alias("u")).select("node", "component", "copies", "sub", "shingles", "u.bi", "u.bj")
    found = map_groups(held, ["component", "bi", "bj"], lambda g: verified(g, percent), "id bigint, n bigint, root bigint", pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))
    found, _ = materialize(found, "links")
    links = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("links"))
    reached = components(found.where("id <> root"), "id", "root")
    least = reached.join(first, "node").groupBy("component").agg(F.min("first").alias("least"))
    names = first.join(reached.join(least, "component").select("node", "least", "component"), "node", "left").join(links, "node", "left")
    names = names.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("least", "first").alias("named"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = shapes.join(names, "node", "left")
    linked_rows = F.when(F.col("n") > 0, F.col("links")).otherwise(0).cast("bigint")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("named")).otherwise(F.col("doc_id")).alias("component_id"), linked_rows.alias("n_links"), "row", "component")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of its SQL; n_links is the operator's."""
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS x FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS d1, b.doc_id AS d2, count(*) AS both_n FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT d1, d2 FROM b JOIN n x ON x.doc_id = d1 JOIN n y ON y.doc_id = d2 WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)
), e AS MATERIALIZED (SELECT d1 AS a, d2 AS b FROM links UNION ALL SELECT d2, d1 FROM links),
walk(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT walk.doc_id, e.b FROM walk JOIN e ON walk.reach = e.a
)
SELECT walk.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id FROM walk LEFT JOIN n ON n.doc_id = walk.doc_id GROUP BY walk.doc_id
"""
