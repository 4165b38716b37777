"""Removal of repeated substrings: prefix doubling over sampled positions, with Spark doing the sorts.

Wanted are all positions p whose `length`-byte string also starts earlier. The rank of a string of 2w bytes is that of the pair of its halves'
ranks at w, from eight bytes on, which are their own rank. Ranks only need to tell strings apart, so the rank of a pair is a 64-bit
number made from it, and a round needs no numbering of sorted pairs. Doubling from every byte would sort about
24 bytes of state for each byte of text in every round; sampled positions cut that to one row in about 32 bytes:

1. Each window of `length` bytes belongs to the position in it whose `first`-byte string has the smallest rank. Equal windows
   choose the same place, so a sampled position and the run of windows it owns stand for all of them. Spark sorts the positions by
   their rank at `first` bytes; those whose rank is unique leave.
2. Positions of one rank are sorted by the pair of that rank and the rank of their whole run, which reaches past the threshold. Of
   equal pairs the earliest stays and the others are repeated as a whole. A rank with a single pair is settled.
3. Where a rank has different pairs, its runs are reread and their windows ranked anew at growing offsets: at twice the bytes, where unique
   ranks leave, and again until the offset is past half the threshold; then the pair of the ranks of a window's first and last
   bytes covers it, and all but the earliest of equal pairs are repeated.

A task settles its own equal pairs before the shuffle, so a passage that a third of all documents share reaches the sort once for
each task. Sorted rows are streamed without holding a rank's rows. In step 3 a rank with over `block` runs goes through rounds of its own first:
the windows of a run are halved by their distance to the sampled position, and each half gets the rank of the string that all of its windows
would share, 66 bytes in the first round, 83 in the next, and so on up to all 100. What is unique or has a single pair leaves in each round.

Defined results: null and empty texts have no bytes; texts under `length` bytes lose nothing; among rows of one doc_id the order is that
of their texts' hashes, rows that agree in both count as one document and get the same result; null doc_ids come first; an empty table
gives an empty result. Other columns, whatever their names, stay as they are. Long texts are ranked in segments. `first` is 8 times a power of
2 and at most `length`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.groups import map_groups
from termloom.llm.hashing import MASK, PLACES, U, doubled, mix, pair_ranks
from termloom.llm.shared import lean, materialize, table

#: A run of windows is its first start and, in the last 24 bits, how many starts follow.
SHIFT = 24
SEGMENT = 1 << 20
ROW = "h bigint, pair bigint, did bigint, run bigint, done boolean"


def run_ranks(ranks: np.ndarray, width: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of strings of several sizes from `width` bytes on, folded from ranks at `width` that cover them evenly."""
    parts = -(-int(size.max()) // width)
    out = mix(size.astype(U))
    for k in range(parts):
        out = pair_ranks(out, ranks[start + (size - width) * k // max(1, parts - 1)])
    return out


def sampled(data: np.ndarray, first: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rank at `first` bytes, rank of the whole run, first and last window start, of every sampled position."""
    ranks = doubled(data, first)
    wide = length - first + 1
    low = U(0xFFFFFFFF)
    keyed = (ranks & ~low) | np.arange(len(ranks), dtype=U)  # the leftmost of equal ones wins
    size = -(-len(keyed) // wide) * wide
    blocks = np.full(size, U(MASK))
    blocks[: len(keyed)] = keyed
    blocks = blocks.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    at = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & low).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.append(start[1:], n) - 1
    at = at[start]
    pair = mix(run_ranks(ranks, first, start, end - start + length) + (at - start).astype(U) * U(PLACES[2]))
    return ranks[at], pair, start, end


def widest(length: int) -> int:
    """Bytes of the last doubling round: 8 times a power of 2, past half of length and within it."""
    w = 8
    while 2 * w <= length:
        w *= 2
    return w


def window_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows: the ranks of their first and last widest(length) bytes, a pair that covers them."""
    w = widest(length)
    ranks, n = doubled(data, w), len(data) - length + 1
    return ranks[:n], ranks[length - w : length - w + n]


def packed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << SHIFT | (end - start).astype(np.int64)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [start, end] joined where they touch; sorted by start."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1] + 1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def rows_of(h, pair, did, run, done) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(h).view(np.int64)), pa.array(np.asarray(pair).view(np.int64)), pa.array(did), pa.array(run), pa.array(done)], ["h", "pair", "did", "run", "done"])


class Settler:
    """Collects a task's rows and settles equal pairs among them."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.parts, self.n = limit, [], 0

    def add(self, h, pair, did: int, start, end) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, pair, np.full(len(h), did, np.int64), packed(start, end)))
        self.n += len(h)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, pair, did, run = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        order = np.lexsort((run, did, pair, h))
        h, pair, did, run = h[order], pair[order], did[order], run[order]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])])
        stay = ~again
        first = np.maximum.accumulate(np.where(stay, np.arange(len(h)), 0))
        again &= (did != did[first]) | (run != run[first])  # a repeated row of a document isn't a repeat of its text
        yield rows_of(h[stay], pair[stay], did[stay], run[stay], np.zeros(int(stay.sum()), bool))
        if again.any():
            did, run = did[again], run[again]
            order = np.lexsort((run, did))
            did, run = did[order], run[order]
            start, end = run >> SHIFT, (run >> SHIFT) + (run & ((1 << SHIFT) - 1))
            far = np.concatenate([[True], (did[1:] != did[:-1]) | (start[1:] > end[:-1] + 1) | (start[1:] >> 20 != start[:-1] >> 20)])  # runs stay under 2^21
            last = np.append(np.flatnonzero(far)[1:] - 1, len(far) - 1)
            did, run = did[far], packed(start[far], end[last])
            yield rows_of(mix(did.astype(U) * U(PLACES[3]) + run.astype(U)), np.zeros(len(did), np.int64), did, run, np.ones(len(did), bool))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, pair, did, run: repeated runs (done), and the first run of each pair where a rank has several pairs."""
    last_h = last_pair = None
    last_did = last_run = 0  # of the first row of the pair at hand
    pairs, held = 0, None  # of the rank at hand: pairs so far (2 stands for more), and its first run while it's the only one
    out = lambda h, did, run, done: rows_of(h, np.zeros(len(h), np.int64), did, run, np.full(len(h), done))
    for batch in batches:
        h, pair, did, run = (batch[k].to_numpy() for k in ("h", "pair", "did", "run"))
        done = batch["done"].to_numpy(zero_copy_only=False)
        if done.any():
            yield out(h[done], did[done], run[done], True)
            h, pair, did, run = h[~done], pair[~done], did[~done], run[~done]
        if not len(h):
            continue
        same_h = np.concatenate([[last_h is not None and h[0] == last_h], h[1:] == h[:-1]])
        again = same_h & np.concatenate([[last_h is not None and pair[0] == last_pair], pair[1:] == pair[:-1]])
        first = np.maximum.accumulate(np.where(again, -1, np.arange(len(h))))
        first_did, first_run = np.where(first < 0, last_did, did[first]), np.where(first < 0, last_run, run[first])
        last_did, last_run = first_did[-1], first_run[-1]
        other = again & ((did != first_did) | (run != first_run))  # not a repeated row of the same document
        if other.any():
            yield out(h[other], did[other], run[other], True)
        k = np.flatnonzero(~again)
        rank = np.cumsum(~same_h)  # 0: the rank at hand when the batch began
        of = rank[k]
        counts = np.bincount(of, minlength=int(rank[-1]) + 1)
        counts[0] += pairs
        several = counts >= 2
        if held is not None and several[0]:
            yield out(*(np.array([x]) for x in held), False)
            held = None
        elif held is not None and rank[-1] > 0:
            held = None
        sent = k[several[of]]
        if len(sent):
            yield out(h[sent], did[sent], run[sent], False)
        pairs = min(2, int(counts[-1]))
        if pairs == 1 and not (rank[-1] == 0 and held is not None):
            j = k[of == rank[-1]][-1]
            held = h[j], did[j], run[j]
        last_h, last_pair = h[-1], pair[-1]


def repeats_in_rank(group: pa.Table, length: int) -> dict | None:
    """Repeated windows of one rank's runs, as joined runs."""
    did, run = group["did"].to_numpy(), group["run"].to_numpy()
    a, b, of, at = [], [], [], []
    places = {(d, r): k for k, (d, r) in enumerate(zip(did.tolist(), run.tolist()))}  # repeated rows of a document count once
    for k in places.values():
        text = group["bytes"][k]
        x, y = window_ranks(np.frombuffer(text.as_buffer(), np.uint8), length)
        a.append(x)
        b.append(y)
        of.append(np.full(len(x), did[k]))
        at.append((run[k] >> SHIFT) + np.arange(len(x)))
    a, b, of, at = map(np.concatenate, (a, b, of, at))
    _, which, count = np.unique(a, return_inverse=True, return_counts=True)
    a, b, of, at = (x[count[which] > 1] for x in (a, b, of, at))  # unique after this round: settled
    order = np.lexsort((at, of, b, a))
    again = order[1:][(a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])]
    if not len(again):
        return None
    of, at = of[again], at[again]
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] > at[:-1] + 1)])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)
    return {"did": of[new], "run": packed(at[new], at[last])}


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


PARTS = "h bigint, did bigint, run bigint, near int, far int, bytes binary"
PART = pa.schema([("h", pa.int64()), ("did", pa.int64()), ("run", pa.int64()), ("near", pa.int32()), ("far", pa.int32()), ("bytes", pa.binary())])


def parts_of(batch: pa.RecordBatch, ranges: list[tuple[int, int]], first: int, length: int) -> pa.RecordBatch:
    """The parts of runs whose windows' distances to the sampled position lie in each range, with the rank of the string that all windows
    of the range share, the pair with the part's own rank, and the part's bytes."""
    h, did, run, near, far = (batch[k].to_numpy() for k in ("h", "did", "run", "near", "far"))
    data = [x.as_buffer() for x in batch["bytes"]]
    sizes = np.array([len(x) for x in data])
    place = np.cumsum(sizes) - sizes + (far.astype(np.int64))  # of the sampled positions in the joined bytes
    ranks = doubled(np.frombuffer(b"".join(data), np.uint8), first)
    out = []
    for a, b in ranges:
        k = np.flatnonzero((near <= b) & (far >= a))
        if not len(k):
            continue
        lo, hi = np.maximum(near[k], a).astype(np.int64), np.minimum(far[k], b).astype(np.int64)
        key = run_ranks(ranks, first, place[k] - a, np.full(len(k), length - (b - a)))
        key = mix(key + U((a * 1024 + b) * 2 + 1) * U(PLACES[4])) ^ mix(h[k].view(U))
        start, size = place[k] - hi, hi - lo + length
        pair = mix(run_ranks(ranks, first, start, size) + hi.astype(U) * U(PLACES[2]))
        begin = (run[k] >> SHIFT) + far[k] - hi
        cut = [bytes(data[i][int(far[i] - x) : int(far[i] - x) + int(n)]) for i, x, n in zip(k.tolist(), hi.tolist(), size.tolist())]
        out.append(pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pair.view(np.int64)), pa.array(did[k]), pa.array(begin << SHIFT | (hi - lo)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(cut, pa.binary())], ["h", "pair", *PART.names[1:]]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def halved(hot: DataFrame, ranges: list[tuple[int, int]], first: int, length: int) -> tuple[DataFrame, DataFrame]:
    """did, run of the parts of hot runs that repeat an equal part as a whole, and the first part of each pair of a rank with several pairs."""

    def split(batches):
        for batch in batches:
            if batch.num_rows:
                yield parts_of(batch, ranges, first, length)

    parts, _ = materialize(hot.mapInArrow(lean(split), PARTS.replace("did", "pair bigint, did", 1)), "parts")
    pairs = parts.groupBy("h", "pair").agg(F.min(F.struct("did", "run")).alias("head"), F.count(F.lit(1)).alias("times"))
    pairs, _ = materialize(pairs, "pairs")
    several = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("pairs")).where("pairs > 1").select("h")
    again = pairs.where("times > 1").select("h", "pair", "head")
    done = parts.join(again, ["h", "pair"]).where(F.struct("did", "run") != F.col("head")).select("did", "run")
    heads = pairs.join(several, "h", "left_semi").select("h", F.col("head.did").alias("did"), F.col("head.run").alias("run"), "pair")
    open_parts = parts.join(heads, ["h", "pair", "did", "run"], "left_semi").dropDuplicates(["h", "pair", "did", "run"]).select(*PART.names)
    return materialize(done, "repeats")[0], materialize(open_parts, "open-parts")[0]


def find_repeats(rows: DataFrame, length: int, first: int, block: int) -> DataFrame:
    """did, runs: all window starts of a document (did, text) that start earlier, as packed runs."""

    def sample(batches):
        own = Settler()
        for batch in batches:
            for did, text in zip(batch["did"].to_pylist(), batch["text"]):
                data = np.frombuffer(utf8(text.as_py()), np.uint8)
                for a in range(0, len(data) - length + 1, SEGMENT):
                    h, pair, start, end = sampled(data[a : a + SEGMENT + length - 1], first, length)
                    yield from own.add(h, pair, did, start + a, end + a)
        yield from own.flush()

    sorted_by = ["h", "pair", "did", "run"]
    ranked = rows.mapInArrow(lean(sample), ROW).repartition("h").sortWithinPartitions(*sorted_by).mapInArrow(lean(settle, None), ROW)
    ranked, _ = materialize(ranked.select("h", "did", "run", "done"), "ranked")
    open_runs = ranked.where(~F.col("done"))
    many = open_runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    found = [ranked.where("done").select("did", "run")]

    def texts_with(part: DataFrame) -> DataFrame:
        lists = part.groupBy("did").agg(F.collect_list(F.struct("h", "run")).alias("runs"))
        return rows.join(lists, "did").select("did", "text", "runs")

    def context(batches):
        for batch in batches:
            out = []
            for did, text, runs in zip(batch["did"].to_pylist(), batch["text"], batch["runs"].to_pylist()):
                data = utf8(text.as_py())
                for r in runs:
                    start, more = r["run"] >> SHIFT, r["run"] & ((1 << SHIFT) - 1)
                    out.append((r["h"], did, r["run"], data[start : start + more + length]))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["h", "did", "run", "bytes"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["h", "did", "run", "bytes"])

    contexts = texts_with(open_runs).mapInArrow(lean(context), "h bigint, did bigint, run bigint, bytes binary")
    contexts, _ = materialize(contexts, "contexts")  # whole texts are shuffled once, whatever the number of runs of a rank
    inner = map_groups(contexts.join(many, "h", "left_anti"), ["h"], lambda g: repeats_in_rank(g, length), "did bigint, run bigint", pa.schema([("did", pa.int64()), ("run", pa.int64())]))
    found.append(materialize(inner, "repeats")[0])

    if many.limit(1).count():

        def locate(batches):
            """The distances from the sampled position to a run's first and last window."""
            for batch in batches:
                runs, at = batch["run"].to_numpy(), []
                for h, data in zip(batch["h"].to_numpy().view(U), batch["bytes"]):
                    at.append(int(np.argmax(doubled(np.frombuffer(data.as_buffer(), np.uint8), first) == h)))  # the leftmost is the sampled one
                far = np.array(at, np.int32)
                yield pa.RecordBatch.from_arrays([batch["h"], batch["did"], batch["run"], pa.array(far - (runs & ((1 << SHIFT) - 1)).astype(np.int32)), pa.array(far), batch["bytes"]], PART.names)

        hot = contexts.join(many, "h", "left_semi").mapInArrow(lean(locate), PARTS)
        low, high = 0, length - first  # the range of distances
        ranges = [(low, high)]
        while True:
            ranges = [half for a, b in ranges for half in ((a, (a + b) // 2), ((a + b) // 2 + 1, b)) if half[0] <= half[1]]
            done, hot = halved(hot, ranges, first, length)
            found.append(done)
            sizes = hot.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
            large = sizes.where(F.col("times") > block)
            few = hot.join(large, "h", "left_anti").select("h", "did", "run", "bytes")
            inner = map_groups(few, ["h"], lambda g: repeats_in_rank(g, length), "did bigint, run bigint", pa.schema([("did", pa.int64()), ("run", pa.int64())]))
            found.append(materialize(inner, "repeats")[0])
            if max(b - a for a, b in ranges) == 0 or not large.limit(1).count():  # windows of one distance are whole strings, which halved() settles
                break
            hot = hot.join(large, "h", "left_semi")
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    return runs.groupBy("did").agg(F.collect_list("run").alias("runs"))


def remove_repeats(docs: DataFrame, length: int = 100, first: int = 32, block: int = 8_000, digest: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, and kept (binary: the bytes that stay) or with `digest` kept_sha256."""
    spark = docs.sparkSession
    plain, hashed = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit("")))
    ids = docs.select(plain.alias("__tl_id"), hashed.alias("__tl_hash"))
    marked = docs.withColumns({"__tl_id": plain, "__tl_hash": hashed})
    repeated = ids.groupBy("__tl_id").agg(F.min("__tl_hash").alias("a"), F.max("__tl_hash").alias("b")).where("a <> b").limit(1).count()
    if repeated:  # one doc_id with several texts: number the documents in order, range by range; the written table fixes the numbers
        order = ids.distinct().repartitionByRange("__tl_id", "__tl_hash").sortWithinPartitions("__tl_id", "__tl_hash")
        order, _ = materialize(order.withColumn("__tl_did", F.monotonically_increasing_id()), "order")
        marked = marked.join(order, ["__tl_id", "__tl_hash"])
    else:
        marked = marked.withColumn("__tl_did", F.col("__tl_id"))
    runs = find_repeats(marked.select(F.col("__tl_did").alias("did"), "text"), length, first, block)
    runs = runs.select(F.col("did").alias("__tl_did"), F.col("runs").alias("__tl_runs"))
    joined = marked.join(runs, "__tl_did", "left").drop("__tl_id", "__tl_hash", "__tl_did", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    carried = [f for f in joined.schema if f.name not in ("text", "__tl_runs")]
    with_text = [] if digest else [f for f in joined.schema if f.name == "text"]
    last = "kept_sha256" if digest else "kept"
    schema = T.StructType([*carried, *with_text])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, T.LongType())
    schema = schema.add(last, T.StringType() if digest else T.BinaryType())

    def cut(batches):
        for batch in batches:
            n_bytes, removed, spans, kept = [], [], [], []
            for text, packed_runs in zip(batch["text"], batch["__tl_runs"]):
                data = utf8(text.as_py())
                n_bytes.append(len(data))
                if packed_runs.as_py():
                    run = packed_runs.values.to_numpy()
                    start, end = merged(run >> SHIFT, (run >> SHIFT) + (run & ((1 << SHIFT) - 1)) + length - 1)
                    removed.append(int((end - start + 1).sum()))
                    spans.append(len(start))
                    edges = [0, *np.stack([start, end + 1], 1).ravel().tolist(), len(data)]
                    data = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(hashlib.sha256(data).hexdigest() if digest else data)
            names = [f.name for f in [*carried, *with_text]]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in names), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())],
                [*names, "n_bytes", "n_removed", "n_spans", last],
            )

    return joined.mapInArrow(lean(cut), schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


OP6_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 99)) AS p, x FROM d),
w AS MATERIALIZED (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h FROM p),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
r AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM again),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
runs AS MATERIALIZED (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
keep AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs
  UNION ALL SELECT d.doc_id, coalesce(m.b, 0), d.n FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM runs GROUP BY doc_id) m ON m.doc_id = d.doc_id
), k AS (SELECT keep.doc_id, string_agg(substr(d.x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS x FROM keep JOIN d ON d.doc_id = keep.doc_id GROUP BY keep.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.x, ''))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id) t ON t.doc_id = d.doc_id
"""
