import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from termloom.llm import mixing


def documents(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.choice([0, 0, 0, 1, 2, 3])}" if i % 50 else None, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(600)]
    rows += [(600, "s9", None), (601, "s9", " \n"), (602, "s4", "long " * 60_000), (3, "s0", rows[3][2]), (3, "s0", rows[3][2]), (None, "s1", "no id here")]
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, size int")


def dealt(docs, **options):
    """Rows of the plan, and of the pieces dealt to shards."""
    plan, stretches = mixing.plan_mix(docs, block_words=64, shard_words=2000, **options)
    return plan.collect(), mixing.deal(plan, stretches).collect()


def test_targets_caps_and_disjoint_pieces(spark):
    rows, pieces = dealt(documents(spark))
    assert len(rows) == 606 and sum(len(r.pieces) for r in rows) == len(pieces)
    taken, have, target = Counter(), Counter(), {r.source: r.target for r in rows}
    for r in rows:
        assert sum(p.n for p in r.pieces) <= 2 * r.size and all(p.start + p.n <= r.size for p in r.pieces)
        have[r.source] += r.size
    instances = {}
    for p in pieces:
        taken[p.source] += p.n
        instances.setdefault((p.source, p.epoch, p.block), set()).add((p.shard, p.instance))
    assert all(have[s] == next(r.source_size for r in rows if r.source == s) for s in have)
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * have[s] for s in have)
    assert abs(sum(target.values()) - 1.5 * sum(have.values())) < 1e-6
    assert all(len(x) == 1 for x in instances.values())  # a block instance is in one shard
    shards = Counter(next(iter(x))[0] for x in instances.values())
    assert max(shards.values()) - min(shards.values()) <= 2 + len(shards).bit_length()


def draw(u, good, total, drawn):
    """The quantile u of the hypergeometric distribution, with whole numbers."""
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    ways = [math.comb(good, k) * math.comb(total - good, drawn - k) for k in range(low, high + 1)]
    left = Fraction(u) * sum(ways)
    for k, w in enumerate(ways):
        left -= w
        if left < 0:
            return low + k
    return high


def brute_tree(quotas, shards, seed):
    """(source, instance) -> shard, node by node."""
    names, found = [s for s, _ in quotas], {}
    todo = [(1, [q for _, q in quotas], [0] * len(quotas))]
    while todo:
        node, counts, starts = todo.pop()
        if node >= shards:
            found |= {(names[i], starts[i] + k): node - shards for i in range(len(names)) for k in range(counts[i])}
            continue
        total, left = sum(counts), []
        room = (total + node % 2) // 2
        for i, c in enumerate(counts):
            u = int(hashlib.md5(f"{seed}:{node}:{i}".encode()).hexdigest()[:15], 16) / float(1 << 60)
            left.append(draw(u, c, total, room))
            total, room = total - c, room - left[-1]
        todo += [(2 * node, left, starts), (2 * node + 1, [c - x for c, x in zip(counts, left)], [s + x for s, x in zip(starts, left)])]
    return found


def test_shards_are_the_trees(spark):
    """Every piece is in the shard that a tree drawn with whole numbers gives its block."""
    rows, pieces = dealt(documents(spark))
    size, words = Counter(), sum(r.size for r in rows)
    shards = 1 << max(2, math.ceil(math.log2(words * 1.5 / 2000)))
    for r in rows:
        size[r.source] += r.size
    quota = {}
    for r in rows:
        whole, n = math.floor(r.target + 0.5), max(1, size[r.source])
        quota[r.source] = whole // n * -(-size[r.source] // 64) + -(-(whole % n) // 64)
    want = brute_tree(sorted(quota.items(), key=lambda x: (x[0] is None, x[0])), shards, 7)
    instances = {(p.source, p.instance): p.shard for p in pieces}
    assert instances == want and len(set(want.values())) == shards


def test_reruns_agree(spark):
    """Whatever the partitions: ids that repeat with other texts, null ids and repeated rows."""
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, k]), rng.choice("ab"), " ".join("x" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), k % 2) for k in range(400)]
    rows += rows[:40]
    seen, whole = set(), set()
    for k, by in ((1, "text"), (3, "doc_id"), (7, "source")):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra int").repartition(k, by)
        plan, pieces = dealt(docs)
        seen.add(str((sorted(str((r.doc_id, r.source, r.size, r.pieces)) for r in plan), sorted(str((p.doc_id, p.shard, p.place, p.n)) for p in pieces))))
        mixed = mixing.mix(docs, block_words=64, shard_words=2000, whole_documents=True, keep=("extra",))
        whole.add(str(sorted(map(str, mixed.collect()))))
    assert len(seen) == len(whole) == 1


def test_whole_documents_and_texts(spark):
    docs = documents(spark)
    whole = mixing.mix(docs, block_words=64, shard_words=2000, whole_documents=True)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == text[r.doc_id] for r in whole.collect())
    cut = mixing.mix(docs, block_words=64, shard_words=2000)
    assert all(len(r.text.split()) == r.n for r in cut.collect())
    parts = cut.select(F.spark_partition_id().alias("at"), "shard", "place").collect()
    homes = {}
    for r in parts:
        homes.setdefault(r.shard, set()).add(r.at)
    assert all(len(x) == 1 for x in homes.values())
    for shard in homes:  # whole blocks in the order of their hash
        order = [r.place for r in parts if r.shard == shard]
        assert order == sorted(order)
    assert mixing.mix(docs.where(F.lit(False))).count() == 0


def test_hypergeometric_draws(spark):
    """Against exact probabilities: mean and spread of many draws, and hard limits."""
    cases = [(7, 20, 5), (300, 1000, 400), (1, 2, 1), (0, 10, 4), (10, 10, 4), (5000, 9000, 100)]
    for good, total, drawn in cases:
        u = (F.col("id") + 0.5) / 2000
        cast = lambda v: F.lit(v).cast("bigint")
        got = np.array([r[0] for r in spark.range(2000).select(mixing.hypergeometric(u, cast(good), cast(total), cast(drawn))).collect()])
        mean = drawn * good / total
        var = mean * (total - good) / total * (total - drawn) / max(1, total - 1)
        assert abs(got.mean() - mean) < 0.02 + 0.01 * var**0.5 and abs(got.var() - var) < 0.02 + 0.02 * var
        assert got.min() >= max(0, drawn - (total - good)) and got.max() <= min(good, drawn) and (np.diff(got) >= 0).all()


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 70), ("b", 5), (None, 26), ("c", 0)], "source string, quota long")
    got = mixing.splitting_tree(quotas, 8, 3).collect()
    per, ends = Counter(), {}
    for r in sorted(got, key=lambda r: r.shard):
        assert r.first == ends.get(r.source, 0) < r.end
        ends[r.source] = r.end
        per[r.shard] += r.end - r.first
    assert ends == {"a": 70, "b": 5, None: 26}
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 1


def test_sql_matches_on_duckdb(spark, tmp_path):
    df = documents(spark).drop("size").dropDuplicates(["doc_id"]).where("doc_id is not null")
    path = str(tmp_path / "documents.parquet")
    df.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    got = mixing.op2_source_mix(spark, str(tmp_path))
    names = ["doc_id", "size", "source_size", "target", "taken", "n_shards", "dealt_md5"]
    want = sorted(tuple(r) for r in con.sql(f"select {', '.join(names)} from ({mixing.OP2_SQL})").fetchall())
    assert sorted(tuple(r) for r in got.select(names).collect()) == want
