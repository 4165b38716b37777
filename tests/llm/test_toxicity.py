import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import toxicity
from termloom.llm.registry import queries


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op4_toxicity"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, hit = rows.toxic.to_numpy(), rows.predicted.to_numpy() == 1
    assert auc(rows.score.to_numpy(), y) > 0.93
    assert (hit & (y == 1)).sum() / y.sum() > 0.8 and (hit & (y == 1)).sum() / hit.sum() > 0.8
    assert got.count() == 10_000


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = {r.doc_id: r.f for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", toxicity.fold().alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


def corpus(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(3, 40))]
        if bad:
            words.insert(rng.randint(0, len(words)), rng.choice(["grobbly", "grobble", "snarfing"]))
        rows.append((i, " ".join(words), "en" if i % 3 else None, i))
        labels.append((i, None if i % 10 == 9 else int(bad)))
    rows += [(400, None, None, 0), (401, "", "xx", 0), (402, "alpha " * 70_000 + "grobbly", "en", 0), (0, rows[0][1], None, 0), (None, "beta", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    return docs, spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")


def test_nulls_long_texts_and_repeats(spark):
    docs, labels = corpus(spark)
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).toPandas()
    assert len(got) == 405 and got.score.between(0, 1).all()
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert by.loc[402, "rejected"] and not by.loc[400, "rejected"]
    assert by.loc[400, "score"] == by.loc[401, "score"]
    assert by.loc[0, "score"].nunique() == 1
    assert (by.loc[[i for i in range(1, 400)], "rejected"].to_numpy() == [i % 4 == 0 for i in range(1, 400)]).mean() > 0.97


def test_one_class_and_empty(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert model == 0.0
    got = toxicity.score_documents(docs, model)
    assert got.where("rejected or score <> 0").count() == 0
    assert toxicity.score_documents(docs.where(F.lit(False)), toxicity.train(docs.where(F.lit(False)), labels)).count() == 0


def brute_score(model, text):
    """The network written out word by word: hashed rows, every filter at every place, the largest response, one logit."""
    import math
    import re

    words = re.findall(r"\w+", (text or "").lower())
    emb = model.params["emb"].astype(float)
    vectors = []
    for w in words:
        parts = [w, f"3:{w[:3]}", f"4:{w[:4]}", f"5:{w[:5]}"]
        vectors.append(sum(emb[1 + zlib.crc32(p.encode("utf-8", "replace")) % (len(emb) - 1)] for p in parts))
    zero = np.zeros(emb.shape[1])
    z, lane = float(model.params["bias"][0]), 0
    for width in (1, 2, 3):
        f, b = model.params[f"f{width}"].astype(float), model.params[f"b{width}"].astype(float)
        for k in range(f.shape[2]):
            best = -math.inf
            for at in range(len(words) + 1):  # the place past the last word sees padding alone
                window = [(vectors[at + j] if at + j < len(words) else zero) for j in range(width)]
                best = max(best, sum(float(v @ f[j, :, k]) for j, v in enumerate(window)))
            best += b[k]
            z += float(model.params["out"][lane]) * (best if best > 0 else 0.1 * best)
            lane += 1
    return 1 / (1 + math.exp(-(model.slope * z + model.shift)))


def test_scores_against_the_network_written_out(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    some = docs.where("doc_id < 60 or doc_id in (400, 401)")
    for r in some.join(toxicity.score_documents(some, model).select("doc_id", F.col("score").alias("got")), "doc_id").collect():
        assert abs(brute_score(model, r.text) - r.got) < 1e-5, r.doc_id
    with np.testing.assert_raises(ValueError):
        toxicity.score_documents(docs, model, keep=("score",))


def test_training_repeats(spark):
    docs, labels = corpus(spark)
    one, two = (toxicity.train(docs.repartition(n), labels, sample_chars=300) for n in (1, 5))
    assert all((one.params[k] == two.params[k]).all() for k in one.params) and one.thresholds == two.thresholds
