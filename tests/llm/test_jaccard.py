import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import jaccard
from termloom.llm.hashing import mix, shingles, word_hashes
from termloom.llm.registry import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85, width=4):
    """(doc_id, n_shingles, component) by comparing every pair that shares a shingle."""
    sets = [shingle_set(t, width) for _, t in rows]
    holders, root = {}, list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        counts = {}
        for x in s:
            for j in holders.setdefault(x, []):
                counts[j] = counts.get(j, 0) + 1
            holders[x].append(k)
        for j, both in counts.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def result(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df, **options).collect()), key=str)


def edited(rng, words, p):
    return [rng.choice("uvwxyz") + str(rng.randrange(999)) if rng.random() < p else w for w in words]


def corpus(rng):
    rows, common = [], [f"c{k}" for k in range(60)]
    for _ in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 90, 200, 400]))]
        if rng.random() < 0.5:
            base += common
        for _ in range(rng.randint(1, 6)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04]))))
    chain = [f"h{k}" for k in range(150)]
    for _ in range(90):  # a large group of near copies that drifts
        chain = edited(rng, chain, 0.004)
        rows.append(" ".join(edited(rng, chain, 0.008)))
    rows += [rows[0].upper(), rows[5], rows[5], None, "", " \t\n", "a", "A", "a b", "x " * 5000, "x " * 40, "É é", "é É", "é É", "na me"]
    rng.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)] + [(7, rows[9]), (None, rows[3]), (None, "only without id"), (None, "only without id")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    want = brute(rows)
    assert result(df) == want
    assert result(df, block_docs=7) == want


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries()["op10_ngram_jaccard"](spark, sf).collect()), key=str)
    assert got == brute(rows)
    assert jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_thue_morse_words_are_told_apart(spark):
    """One-word texts of 1024 letters whose hashes agree under any polynomial modulo 2^64, and texts that hold them."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(12))
    rows = list(enumerate([one, other, one[:16], other[:16], one[:64], other[:64], f"{one} {rest}", f"{other} {rest}", f"{one} {rest}"]))
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and [c for _, _, c in got] == [0, 1, 2, 3, 4, 5, 6, 7, 6]


def test_sets_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    """With a set hash of 6 bits for the first seed, most sets clash; the result is that of the second."""
    rows = corpus(random.Random(3))[:80]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, seeds = jaccard.set_hash, []

    def short(s, *salt):
        return plain(s, *salt) if salt or len(seeds) > 1 else plain(s) & 63

    whole = jaccard.similar_rows

    def watched(docs, *args, **options):
        seeds.append(args)
        return whole(docs, *args, **options)

    monkeypatch.setattr(jaccard, "set_hash", short)
    monkeypatch.setattr(jaccard, "similar_rows", watched)
    assert result(df) == brute(rows) and len(seeds) == 2


def test_linked_sets_share_a_bucket():
    """At the threshold itself, for many sizes: whatever differs, some bucket is shared."""
    rng, classes = np.random.default_rng(4), jaccard.SizeClasses(85)
    for _ in range(4000):
        a = int(rng.integers(6, 400))
        b = int(rng.integers(a, a * 100 // 85 + 1))
        both = -(-85 * (a + b) // 185)
        if both > a:
            continue
        x = mix(rng.integers(0, 1 << 62, a + b, dtype=np.int64).astype(np.uint64))
        left, right = np.sort(np.concatenate([x[:both], x[both:a]])), np.sort(np.concatenate([x[:both], x[a : a + b - both]]))
        assert jaccard.linked(left, right, 85)
        assert set(jaccard.signatures(left, classes).tolist()) & set(jaccard.signatures(right, classes).tolist())


def test_tree_bound_loses_no_link():
    rng = np.random.default_rng(6)
    base = [np.unique(mix(rng.integers(0, 1 << 62, int(rng.integers(1, 120)), dtype=np.int64).astype(np.uint64))) for _ in range(40)]
    sets = [np.unique(np.concatenate([s[rng.random(len(s)) > 0.03], mix(rng.integers(0, 1 << 62, 1, dtype=np.int64).astype(np.uint64))])) for s in base for _ in range(5)]
    tree = jaccard.CountTree(sets, 32, fan=4)
    for s in sets:
        found = set(tree.search(tree.point(s), len(s), 85).tolist())
        true = {k for k, other in enumerate(sets) if jaccard.linked(s, other, 85)}
        assert true <= found and len(found) < len(sets)


def test_segments_of_long_texts_hash_alike():
    text = ("Abc  def\tghi\n" * 300 + "x" * 5000 + " end").encode()
    assert (word_hashes(text, segment=64) == word_hashes(text)).all()
    assert len(shingles(word_hashes(b"a b c d e"), 4)) == 2 and (word_hashes(b"A \xc3\x89") == word_hashes(b"a \xc3\x89")).all()
