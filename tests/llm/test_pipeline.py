import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from termloom.llm import bpe, toxicity
from termloom.llm.shared import materialize
from tests.llm.test_jaccard import brute as similar

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], SF), name)[0])
    return [{"columns": t.columns, "rows": [r.asDict() for r in t.collect()]} for t in found]


def test_columns(tables):
    assert all(t["columns"] == tables[0]["columns"] for t in tables[:-1])
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_toxicity(spark, tables):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    words = toxicity.Words(model.rows)
    rows = tables[0]["rows"]
    score = model.scores(model.logits([words(r["text"]) for r in rows]))
    stay = [r for r, s in zip(rows, score) if s < model.thresholds.get(r["lang"], model.thresholds[None])]
    assert sorted(map(str, tables[1]["rows"])) == sorted(map(str, stay))


def test_line_dedup(tables):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    holders = defaultdict(set)
    for r in tables[1]["rows"]:
        for x in (r["text"] or "").split("\n"):
            holders[key(x)].add(r["doc_id"])
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = {r["doc_id"]: "\n".join(x for x in (r["text"] or "").split("\n") if gone.get(key(x), r["doc_id"]) == r["doc_id"]) for r in tables[1]["rows"]}
    assert {r["doc_id"]: r["text"] or "" for r in tables[2]["rows"]} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in tables[2]["rows"])


def test_near_duplicates(tables):
    groups = similar([(r["doc_id"], r["text"]) for r in tables[2]["rows"]], percent=80, width=5)
    assert sorted(r["doc_id"] for r in tables[3]["rows"]) == sorted(i for i, _, c in groups if i == c)
    before = {r["doc_id"]: str(r) for r in tables[2]["rows"]}
    assert all(before[r["doc_id"]] == str(r) for r in tables[3]["rows"])


def test_mixture(tables):
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
    before = {r["doc_id"]: str(r) for r in tables[3]["rows"]}
    assert all(before[r["doc_id"]] == str(r) for r in tables[4]["rows"])
    assert max(Counter(r["doc_id"] for r in tables[4]["rows"]).values()) <= 2
    have, got, longest = Counter(), Counter(), Counter()
    for r in tables[3]["rows"]:
        have[r["source"]] += size(r)
        longest[r["source"]] = max(longest[r["source"]], size(r))
    for r in tables[4]["rows"]:
        got[r["source"]] += size(r)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(have))}
    target, room = {}, set(have)
    while room:
        left = 1.5 * sum(have.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in room) for s in room}
        over = {s for s in room if share[s] > 2 * have[s]}
        target |= {s: 2 * have[s] for s in over} if over else share
        room = room - over if over else set()
    assert all(abs(got[s] - target[s]) <= 4096 + longest[s] for s in have)


def test_bpe(tables):
    library = bpe.Encoder(bpe.vocabulary_path()).library
    want = Counter()
    for r in tables[4]["rows"]:
        e = library.encode(r["text"] or "", add_special_tokens=False)
        want[r["doc_id"], len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in tables[5]["rows"]) == want


def test_run_repeats(spark, tables):
    assert sorted(str(r.asDict()) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(map(str, tables[5]["rows"]))


def odd_documents(spark):
    text = "some words that make a line of good length\nand a second line that only few have "
    rows = [(k, f"{text}{k} " * 3, "en", f"s{k % 3}", 9) for k in range(30)]
    rows += [(31, None, None, None, None), (32, "", "en", None, 0), (33, rows[3][1], "en", "s0", 9), (3, rows[3][1], "en", "s0", 9), (None, rows[4][1], "en", "s1", 9), (None, "alone without an id", None, "s1", 9), (34, "long " * 80_000, "xx", "s2", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "score double, rejected boolean, n_lines int, h1 string, size int, `a.b` string, pieces string, component_id long"
    return spark.createDataFrame([(*r, 0.5, True, 1, "h", 2, "dot", "p", 7) for r in rows], f"{names}, {extra}")


def test_odd_rows_and_clashing_columns(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs, _ = materialize(stage(spark, docs, SF), f"odd-{name}")
        if name != "bpe":
            assert docs.schema.names == before.schema.names
            left = docs.select("score", "rejected", "n_lines", "h1", "size", "`a.b`", "pieces", "component_id").distinct().collect()
            assert [tuple(r) for r in left] == [(0.5, True, 1, "h", 2, "dot", "p", 7)]
        assert docs.count() > 0


def test_empty_table(spark):
    docs = odd_documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
