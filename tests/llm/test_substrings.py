import hashlib
import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import substrings
from termloom.llm.registry import queries


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of the rest) of rows (doc_id, text) in order, byte by byte."""
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        rest = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, digest=True, **options).collect()), key=str)


def corpus(rng):
    word = lambda: rng.choice(["the", "of", "é", "and"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(15, 60)) for _ in range(8)]
    docs = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(text(rng.randint(1, 40)))
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randrange(len(s) // 2)
                parts.append(s[a : rng.randint(a, len(s))])
        docs.append(rng.choice([" ", "", "\n"]).join(parts))
    docs += [docs[3], docs[3], docs[4][:99], docs[4][:100], docs[4][1:101], None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 700, "ab" * 300, "ab" * 90, docs[7] + docs[7], "é" * 260]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, did int").repartition(4)
    want = brute(rows)
    assert result(df) == want
    assert result(df, block=3) == want


def test_segments_and_small_flushes(monkeypatch):
    import numpy as np

    rng = random.Random(9)
    data = np.frombuffer("".join(rng.choice("abcd") for _ in range(5000)).encode(), np.uint8)
    h, pair, start, end = substrings.sampled(data, 32, 100)
    assert (start[1:] == end[:-1] + 1).all() and start[0] == 0 and end[-1] == len(data) - 100
    cut = [substrings.sampled(data[a : a + 700 + 99], 32, 100) for a in range(0, len(data) - 99, 700)]
    runs = {(int(s), int(e)): int(x) for x, s, e in zip(h, start, end)}
    inside = [(700 * k + int(s), 700 * k + int(e), int(x)) for k, (hh, _, ss, ee) in enumerate(cut) for x, s, e in zip(hh, ss, ee)]
    assert sum((s, e) in runs and runs[s, e] == x for s, e, x in inside) > 0.8 * len(runs)


def test_equal_ids_extra_columns_and_empty(spark):
    rng = random.Random(5)
    t = "".join(rng.choice("abcdef") for _ in range(400))
    df = spark.createDataFrame([(1, t, "a", 1), (1, t, "b", 2), (2, t[:200] + "zz", "c", 3), (None, t[50:150], "d", 4), (2, "other", "e", 5)], "doc_id long, text string, kept string, n_bytes int")
    got = {(r.doc_id, r.text): (r.n_bytes, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(df).collect()}
    assert got[None, t[50:150]] == (100, 0, t[50:150].encode())
    assert got[1, t] == (400, 100, (t[:50] + t[150:]).encode())
    assert got[2, t[:200] + "zz"] == (202, 200, b"zz") and got[2, "other"] == (5, 0, b"other")
    assert substrings.remove_repeats(df.where(F.lit(False))).count() == 0


def thue_morse(k, a="a", b="b"):
    s = a
    for _ in range(k):
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_thue_morse_texts_are_told_apart(spark):
    """Words whose hashes agree under any polynomial modulo 2^64, whole and inside other text."""
    one = thue_morse(11)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = list(enumerate([one, other, "x" * 40 + other[:300], one[500:900] + "y" * 30 + other[500:900], thue_morse(8, "é", "a")]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    assert result(df, block=1) == brute(rows)


def test_ranks_double():
    import numpy as np

    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), np.uint8)
    for width in (8, 16, 32, 64):
        strings = [data[p : p + width].tobytes() for p in range(len(data) - width + 1)]
        ranks = substrings.doubled(data, width).tolist()
        assert len(ranks) == len(strings) and len(set(zip(ranks, strings))) == len(set(ranks)) == len(set(strings))
    for length in (64, 100, 127, 128):
        strings = [data[p : p + length].tobytes() for p in range(len(data) - length + 1)]
        pairs = list(zip(*(x.tolist() for x in substrings.window_ranks(data, length))))
        assert len(set(zip(pairs, strings))) == len(set(pairs)) == len(set(strings))


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op6_suffix_dedup"](spark, sf).collect()), key=str)
    assert got == brute(rows)
