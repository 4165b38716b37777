"""Mixing sources to target weights, with DataFrame functions only.

Each source is one stream of words: its documents in the order of a keyed hash of doc_id and text. The stream is cut into blocks of
`block_words` words; the tail shorter than a block comes last. A source's target is a number of words, and the quota
of blocks that gives it is exact: whole passes over all blocks, then the first blocks of a keyed permutation, the last
of them cut to the word. A multivariate-hypergeometric splitting tree deals the quotas of all sources to the output
shards: each node splits its quotas between its two halves as a random draw without replacement would, so every shard
gets its full capacity and a fair mixture. Within a source the shards take consecutive, hence disjoint, stretches of
the permuted blocks; a block finds its shard by a join over ranges. A shard is shuffled on its own: its blocks come in the order of a keyed
hash, and `at` is the place of a piece's first word in its shard.

Prefix sums over a stream go through hash buckets of a bounded number of rows, so that a source with a third of all
documents isn't sorted by one task. State per tree node is one count for each source.

Defined results: null text has size 0; a null source is a source of its own, the last in order; a document of size 0 is
never taken; repeated rows are documents of their own; an empty table gives an empty mixture; a null doc_id counts
as an empty string. Rows that agree in doc_id, text and the columns of `keep` may swap what is taken of them, so any run gives the same rows.
Columns besides doc_id, source and text are ignored or, by `keep`, carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.shared import WORD, materialize, table

#: Primes above any supported number of blocks per source, as multipliers of the block permutation.
PRIMES = (2147483629, 2147483587, 2147483579)


def uniform(*parts: Column) -> Column:
    """60 bits of a hash of the parts, as a bigint that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def document_size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """source, source_size, target: weights in order of the sources, water-filled up to `most` times a source's size.

    The shares that iterated resharing reaches are min(most * size, weight * level) for the one level that uses up
    the total: sources are capped in order of most * size / weight, while the sum at that level stays below the total.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", pick.cast("bigint"))
    whole, by_level = W.partitionBy(), W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "all_size": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole),
        "caps": F.sum(most * F.col("source_size")).over(by_level), "capped_weight": F.sum("weight").over(by_level),
    })
    top, bottom = share
    full = bottom * (F.col("caps") * F.col("weight") + most * F.col("source_size") * (F.col("all_weight") - F.col("capped_weight"))) <= top * F.col("all_size") * F.col("weight")
    s = s.withColumn("capped", full)
    left = F.lit(float(top)) * F.col("all_size") / F.lit(float(bottom)) - F.sum(F.when(F.col("capped"), most * F.col("source_size")).otherwise(0)).over(whole)
    rest = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * left / F.nullif(rest, F.lit(0)))
    return s.select("source", "source_size", target.alias("target"))


def let(value: Column, body) -> Column:
    """body of a value that is computed once: transform() over one element names it, which SQL expressions can't otherwise do."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(x: Column) -> Column:
    """ln x!, from a list for small x and by Stirling's series beyond."""
    small = F.element_at(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(11))), F.least(F.lit(11), x + 1).cast("int"))
    y = F.greatest(x, F.lit(11)).cast("double")
    series = y * F.ln(y) - y + 0.5 * F.ln(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    return F.when(x <= 10, small).otherwise(series)


def hypergeometric(u: Column, good: Column, total: Column, drawn: Column) -> Column:
    """How many of `good` among `total` items `drawn` draws take, by inversion at u in [0, 1).

    Counts over nine standard deviations from the mean have less mass than a double's last bit and are left out.
    """
    mean = drawn * good / F.greatest(total, F.lit(1))
    spread = 9 * F.sqrt(mean * (total - good) / F.greatest(total, F.lit(1)) * (total - drawn) / F.greatest(total - 1, F.lit(1))) + 2
    low = F.greatest(F.lit(0).cast("bigint"), drawn - (total - good), F.floor(mean - spread))
    high = F.least(drawn, good, F.ceil(mean + spread))
    weigh = lambda k: -(log_factorial(k) + log_factorial(good - k) + log_factorial(drawn - k) + log_factorial(total - good - drawn + k))
    logs = F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), weigh(k).alias("w")))
    def draw(rows: Column) -> Column:
        top = F.aggregate(rows, F.lit(float("-inf")), lambda a, r: F.greatest(a, r["w"]))
        return let(top, lambda t: let(F.transform(rows, lambda r: F.struct(r["k"].alias("k"), F.exp(r["w"] - t).alias("p"))), invert))

    def invert(rows: Column) -> Column:
        mass = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["p"])
        step = lambda a, r: F.struct((a["left"] - r["p"]).alias("left"), F.when(a["left"] >= 0, r["k"]).otherwise(a["k"]).alias("k"))
        return F.aggregate(rows, F.struct((u * mass).alias("left"), F.lit(0).cast("bigint").alias("k")), step, lambda a: a["k"])

    return let(logs, draw)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, shard, first, end: the stretch of the source's block instances that each shard takes, where it takes any.

    quotas: one row (source, quota). shards is a power of two. A node holds the quotas of all sources in source order, where their
    stretches begin, and the number of its shards; its left half gets as many instances as its shards' capacity, split over the
    sources by conditional hypergeometric draws.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota")))
    nodes = quotas.agg(order.alias("rows")).select(
        F.col("rows.source").alias("sources"), F.lit(1).cast("bigint").alias("node"), F.col("rows.quota").alias("counts"), F.transform("rows", lambda r: F.lit(0).cast("bigint")).alias("starts")
    )
    for _ in range(int(math.log2(shards))):
        total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
        nodes = nodes.withColumn("total", total)
        half = F.floor((F.col("total") + F.pmod("node", F.lit(2))) / 2)

        def take(a, pair):
            u = uniform(F.lit(str(seed)), F.col("node").cast("string"), pair["i"].cast("string")) / float(1 << 60)
            got = hypergeometric(u, pair["c"], a["total"], a["room"])
            return let(got, lambda g: F.struct((a["total"] - pair["c"]).alias("total"), (a["room"] - g).alias("room"), F.concat(a["got"], F.array(g)).alias("got")))

        pairs = F.transform("counts", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        left = F.aggregate(pairs, F.struct(F.col("total").alias("total"), half.alias("room"), F.array().cast("array<bigint>").alias("got")), take, lambda a: a["got"])
        nodes = nodes.withColumn("left", left)
        rest = (F.zip_with("counts", "left", lambda c, x: c - x).alias("counts"), F.zip_with("starts", "left", lambda c, x: c + x).alias("starts"))
        halves = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("counts"), "starts"), F.struct((2 * F.col("node") + 1).alias("node"), *rest))
        nodes = nodes.select("sources", F.explode(halves).alias("half")).select("sources", "half.node", "half.counts", "half.starts")
    cells = nodes.select((F.col("node") - shards).alias("shard"), F.explode(F.arrays_zip("sources", "counts", "starts")).alias("cell"))
    return cells.where("cell.counts > 0").select(F.col("cell.sources").alias("source"), "shard", F.col("cell.starts").alias("first"), (F.col("cell.starts") + F.col("cell.counts")).alias("end"))


def source_key() -> Column:
    """A source as a key that is never null: null-safe joins would deal rows anew."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2,
    block_words: int = 4096, shard_words: int = 1 << 22, seed: int = 7, whole_documents: bool = False, keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Documents with the pieces that the mixture takes of them, and the stretches that the tree deals to the shards.

    Documents: doc_id, source, size, source_size, target, `keep`, key, bucket, nth (these three name the row), width, pos (the first word's
    place in its source), and pieces: array of (instance, epoch, block, start, n): n words from word `start` of the document, for the
    source's block instance of that number. Stretches: key, shard, first, end, bin: all instances from first below end go to that shard;
    each bin of `width` instances that they touch has a row. The mixture has share[0] / share[1] times all words. whole_documents: a
    document belongs to the block of its first word and is taken whole or not at all, so a source's words differ from its target
    by a block's overhang.
    """
    hashed = uniform(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sizes, _ = materialize(docs.select("doc_id", "source", document_size().alias("size"), hashed.alias("h")), "mix-sizes")
    count, words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, count) / 4096)))
    shards = 1 << max(2, math.ceil(math.log2(max(1, words * share[0] / share[1] / shard_words))))
    sources = source_targets(sizes, weights, share, most)
    b = F.lit(block_words).cast("bigint")
    size = F.greatest(F.col("source_size"), F.lit(1))
    sources = sources.withColumns({"whole": F.round("target").cast("bigint")}).withColumns({"passes": F.floor(F.col("whole") / size), "rest": F.pmod("whole", size)})
    sources = sources.withColumns({"blocks": F.ceil(F.col("source_size") / b), "full": F.floor(F.col("source_size") / b)})
    sources = sources.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b)).withColumn("width", F.greatest(F.floor(F.col("quota") / shards), F.lit(1)))
    key = lambda what, epoch: uniform(F.lit(f"{seed}:{what}"), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"), F.lit(str(epoch)))
    prime = lambda epoch: F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(key("a", epoch), F.lit(3)) + 1).cast("int")).cast("bigint")
    sources = sources.withColumn("keys", F.array(*(F.struct(prime(e).alias("prime"), key("b", e).alias("shift")) for e in range(most + 1))))
    sources, _ = materialize(sources.withColumn("key", source_key()), "mix-sources")
    stretches = splitting_tree(sources.select("source", "quota"), shards, seed).withColumn("key", source_key()).join(sources.select("key", "width"), "key")
    bins = F.sequence(F.floor(F.col("first") / F.col("width")), F.floor((F.col("end") - 1) / F.col("width")))
    stretches, _ = materialize(stretches.select("key", "shard", "first", "end", F.explode(bins).alias("bin")), "mix-stretches")

    bucket = F.shiftright("h", 60 - bits) if bits else F.lit(0).cast("bigint")
    sums = sizes.select(source_key().alias("key"), bucket.alias("bucket"), "size").groupBy("key", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(W.partitionBy("key").orderBy("bucket")) - F.col("in_bucket")
    offsets = sums.select("key", "bucket", before.alias("offset"))
    rows = docs.select("doc_id", "source", document_size().alias("size"), hashed.alias("h"), *keep) if keep else sizes
    tie = F.xxhash64(*(F.col(c) for c in keep if "map<" not in docs.schema[c].dataType.simpleString())) if keep else F.lit(0)
    near = W.partitionBy("key", "bucket").orderBy("h", "tie")
    rows = rows.withColumns({"key": source_key(), "bucket": bucket, "tie": tie})
    placed = rows.withColumns({"inside": F.sum("size").over(near.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"), "nth": F.row_number().over(near)})
    placed = placed.join(offsets, ["key", "bucket"]).withColumn("pos", F.col("offset") + F.col("inside"))
    placed = placed.join(sources.drop("source"), "key")

    first, last = F.floor(F.col("pos") / b), F.floor((F.col("pos") + F.col("size") - 1) / b)

    def permuted(block, key):
        full = F.greatest("full", F.lit(1))
        return F.when(block >= F.col("full"), block).otherwise(F.pmod(block * key["prime"] + F.pmod(key["shift"], full), full))

    def piece(block, epoch, place):
        if whole_documents:
            start, n = F.lit(0).cast("bigint"), F.col("size")
            room = F.when((epoch < F.col("passes")) | (place * b < F.col("rest")), n).otherwise(0)
        else:
            start = F.greatest(block * b - F.col("pos"), F.lit(0))
            n = F.least((block + 1) * b - F.col("pos"), F.col("size")) - start
            cut = F.col("rest") - place * b - (F.col("pos") + start - block * b)
            room = F.when(epoch < F.col("passes"), n).otherwise(cut)
        instance = epoch * F.col("blocks") + place
        return F.struct(instance.alias("instance"), epoch.alias("epoch"), block.alias("block"), start.alias("start"), F.least(n, F.greatest(room, F.lit(0))).alias("n"))

    epochs = F.sequence(F.lit(0).cast("bigint"), F.col("passes"))
    touched = F.array(first) if whole_documents else F.sequence(first, last)
    pieces = F.flatten(F.transform(epochs, lambda e: let(F.get("keys", e.cast("int")), lambda key: F.transform(touched, lambda k: let(permuted(k, key), lambda place: piece(k, e, place))))))
    pieces = F.when(F.col("size") > 0, F.filter(pieces, lambda p: p["n"] > 0)).otherwise(F.expr("filter(array(named_struct('instance', 0L, 'epoch', 0L, 'block', 0L, 'start', 0L, 'n', 0L)), p -> false)"))
    return placed.select("doc_id", "source", "size", "source_size", "target", *keep, "key", "bucket", "nth", "width", "pos", pieces.alias("pieces")), stretches


def deal(plan: DataFrame, stretches: DataFrame, seed: int = 7) -> DataFrame:
    """A row for each piece of plan_mix(): its columns, with shard, place (the order of blocks in their shard), instance, epoch, block, start and n.

    The shard is that of the tree's stretch which holds the piece's block instance.
    """
    rows = plan.withColumn("p", F.explode("pieces")).select(*(c for c in plan.columns if c != "pieces"), "p.*")
    place = uniform(F.lit(f"{seed}:p"), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"), F.col("instance").cast("string"))
    rows = rows.withColumns({"bin": F.floor(F.col("instance") / F.col("width")), "place": place})
    held = (F.col("instance") >= F.col("first")) & (F.col("instance") < F.col("end"))
    return rows.join(stretches, ["key", "bin"]).where(held).drop("bin", "first", "end", "width")


#: The order of pieces in their shard.
SHUFFLED = ("place", "key", "instance", "pos", "nth")


def mix(docs: DataFrame, keep: tuple[str, ...] = (), seed: int = 7, **options) -> DataFrame:
    """The mixture itself: doc_id, source, text (the words, or the whole text untouched), `keep`, shard, place, epoch, start, n.

    Shards lie in partitions of their own, or several whole ones in one, each shuffled.
    """
    rows = deal(*plan_mix(docs, keep=("text", *keep), seed=seed, **options), seed)
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), (F.col("start") + 1).cast("int"), F.col("n").cast("int")), " ")
    text = F.when((F.col("start") == 0) & (F.col("n") == F.col("size")), F.col("text")).otherwise(words)
    rows = rows.repartition("shard").sortWithinPartitions("shard", *SHUFFLED)
    return rows.select("doc_id", "source", text.alias("text"), *keep, "shard", "place", "epoch", "start", "n")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards hold of each document: words, number of shards, and a digest of (epoch, block, shard, at, n) of its pieces."""
    plan, stretches = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    plan, _ = materialize(plan, "mix-plan")
    row = ["key", "bucket", "nth"]
    dealt = deal(plan.select("source", *row, "width", "pos", "pieces"), stretches)
    at = F.sum("n").over(W.partitionBy("shard").orderBy(*SHUFFLED).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    dealt = dealt.withColumn("at", at).groupBy(*row).agg(F.sum("n").alias("taken"), F.count_distinct("shard").alias("n_shards"), F.array_sort(F.collect_list(F.struct("epoch", "block", "shard", "at", "n"))).alias("dealt"))
    told = F.array_join(F.transform("dealt", lambda p: F.concat_ws(":", p["epoch"], p["block"], p["shard"], p["at"], p["n"])), ";")
    out = plan.drop("pieces").join(dealt, row, "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("n_shards", zero).alias("n_shards"), F.md5(F.coalesce(told, F.lit("")).cast("binary")).alias("dealt_md5"))


OP2_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM s0
), s2 AS (
  SELECT *, [5, 2, 1][((rn - 1) % 3) + 1]::BIGINT AS w FROM s1
), s3 AS (
  SELECT *, sum(source_size) OVER () AS alls, sum(w) OVER () AS allw,
         sum(2 * source_size) OVER (ORDER BY source_size / w, source ASC NULLS LAST) AS caps,
         sum(w) OVER (ORDER BY source_size / w, source ASC NULLS LAST) AS capw
  FROM s2
), s4 AS (
  SELECT *, 2 * (caps * w + 2 * source_size * (allw - capw)) <= 3 * alls * w AS capped FROM s3
), s5 AS (
  SELECT *, 3.0::DOUBLE * alls::DOUBLE / 2.0::DOUBLE - (sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ())::DOUBLE AS lft,
         sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS restw
  FROM s4
), s6 AS (
  SELECT rn, source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE w::DOUBLE * lft / nullif(restw, 0)::DOUBLE END AS target FROM s5
), s7 AS (
  SELECT *, floor(target + 0.5)::BIGINT // greatest(source_size, 1) AS passes, floor(target + 0.5)::BIGINT % greatest(source_size, 1) AS rest,
         source_size // 4096 AS nfull, (source_size + 4095) // 4096 AS blocks
  FROM s6
), s AS MATERIALIZED (
  SELECT *, (passes * blocks + (rest + 4095) // 4096)::BIGINT AS quota, coalesce(source, '') || ':' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END AS name,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key
  FROM s7
), size_of AS (
  SELECT greatest(2, ceil(log2(greatest(1.0::DOUBLE, sum(size)::DOUBLE * 1.5::DOUBLE / 4194304.0::DOUBLE))))::BIGINT AS depth FROM d
), tree(depth, node, counts, starts) AS (
  SELECT 0::BIGINT, 1::BIGINT, counts, list_transform(counts, lambda c: 0::BIGINT) FROM (SELECT list(quota ORDER BY rn) AS counts FROM s) WHERE counts IS NOT NULL
  UNION ALL
  SELECT depth + 1, 2 * node + side,
         CASE WHEN side = 0 THEN lft ELSE list_transform(range(1, len(counts) + 1), lambda i: counts[i] - lft[i]) END,
         CASE WHEN side = 0 THEN starts ELSE list_transform(range(1, len(counts) + 1), lambda i: starts[i] + lft[i]) END
  FROM (
    SELECT *, list_reduce(range(1, len(counts) + 1), lambda a, i: list_transform([{
        'u': ('0x' || substr(md5('7:' || node || ':' || (i - 1)), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE, 'good': counts[i], 'total': a.total, 'drawn': a.room
      }], lambda p: list_transform([{
        'mean': p.drawn * p.good / greatest(p.total, 1),
        'spread': 9 * sqrt((p.drawn * p.good / greatest(p.total, 1)) * (p.total - p.good) / greatest(p.total, 1) * (p.total - p.drawn) / greatest(p.total - 1, 1)) + 2
      }], lambda m: list_transform([{
        'low': greatest(0, p.drawn - (p.total - p.good), floor(m.mean - m.spread)::BIGINT), 'high': least(p.drawn, p.good, ceil(m.mean + m.spread)::BIGINT)
      }], lambda r: list_transform([list_transform(range(r.low, r.high + 1),
          lambda k: -(lgamma(k + 1) + lgamma(p.good - k + 1) + lgamma(p.drawn - k + 1) + lgamma(p.total - p.good - p.drawn + k + 1)))], lambda w:
        list_transform([list_transform(w, lambda x: exp(x - list_max(w)))], lambda e:
          list_transform([list_reduce(range(1, len(e) + 1), lambda t, j: {'lft': t.lft - e[j], 'k': CASE WHEN t.lft >= 0 THEN r.low + j - 1 ELSE t.k END}, {'lft': p.u * list_sum(e), 'k': 0::BIGINT}).k], lambda g:
            {'total': (a.total - p.good)::BIGINT, 'room': (a.room - g)::BIGINT, 'got': list_append(a.got, g::BIGINT)})[1])[1])[1])[1])[1])[1],
      {'total': list_sum(counts)::BIGINT, 'room': ((list_sum(counts)::BIGINT + node % 2) // 2)::BIGINT, 'got': []::BIGINT[]}).got AS lft
    FROM tree WHERE depth < (SELECT depth FROM size_of)
  ), (VALUES (0), (1)) v(side)
), leaves AS (
  SELECT node - pow(2, depth)::BIGINT AS shard, unnest(range(1, len(counts) + 1)) AS rn, unnest(starts) AS first, unnest(counts) AS n FROM tree WHERE depth = (SELECT depth FROM size_of)
), p AS MATERIALIZED (
  SELECT d.rid, d.doc_id, d.size, s.*,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.rid ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS pos
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), parts AS (
  SELECT *, unnest(range(pos // 4096, (pos + size - 1) // 4096 + 1)) AS b FROM p WHERE size > 0
), epochs AS (
  SELECT *, unnest(range(0, passes + 1)) AS e, greatest(b * 4096 - pos, 0) AS st, least((b + 1) * 4096 - pos, size) - greatest(b * 4096 - pos, 0) AS whole FROM parts
), placed AS (
  SELECT *, CASE WHEN b >= nfull THEN b ELSE (b * [2147483629, 2147483587, 2147483579][(('0x' || substr(md5('7:a:' || name || ':' || e), 1, 15))::BIGINT % 3) + 1]::BIGINT
           + ('0x' || substr(md5('7:b:' || name || ':' || e), 1, 15))::BIGINT % greatest(nfull, 1)) % greatest(nfull, 1) END AS place
  FROM epochs
), taken AS (
  SELECT *, e * blocks + place AS instance, CASE WHEN e < passes THEN whole ELSE least(whole, greatest(rest - place * 4096 - (pos + st - b * 4096), 0)) END AS n FROM placed
), dealt AS (
  SELECT t.rid, t.e, t.b, t.n, l.shard, (sum(t.n) OVER (PARTITION BY l.shard
      ORDER BY ('0x' || substr(md5('7:p:' || t.name || ':' || t.instance), 1, 15))::BIGINT, t.key, t.instance, t.pos ROWS UNBOUNDED PRECEDING) - t.n)::BIGINT AS spot
  FROM taken t JOIN leaves l ON l.rn = t.rn AND t.instance >= l.first AND t.instance < l.first + l.n WHERE t.n > 0
), told AS (
  SELECT rid, sum(n)::BIGINT AS taken, count(DISTINCT shard) AS n_shards, string_agg(e || ':' || b || ':' || shard || ':' || spot || ':' || n, ';' ORDER BY e, b) AS x FROM dealt GROUP BY rid
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(told.taken, 0)::BIGINT AS taken, coalesce(told.n_shards, 0)::BIGINT AS n_shards, md5(coalesce(told.x, '')) AS dealt_md5
FROM p LEFT JOIN told ON told.rid = p.rid
"""
