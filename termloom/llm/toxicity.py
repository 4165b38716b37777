"""Toxicity scores from a convolutional text classifier that is trained in numpy.

Words and their first letters are hashed into rows of an embedding table, and a word's vector is the sum of its rows, so inflected
forms share what their stems mean. Filters of several widths run over all words of a text, each filter keeps its
largest response (max pooling), and a logistic layer maps these to a logit. The first embedding column starts as the words'
log odds in the sample; everything is then trained with Adam. A held-back fold of the sample gives Platt's scaling, shifted to
the labels' base rate, and for each language the threshold with the best F1 (languages with few toxic rows share one).

Training runs on the driver on a bounded sample of labelled rows: at most `per_class` rows a label, of at most `sample_chars` code
points each, chosen by a hash of doc_id. The sample is written, read in parts, and kept as one number for each word. Scoring reads every whole
text, in blocks of words, so a text's length isn't limited.

Defined results: null and empty texts get the score of a text without words; unlabelled rows and null labels don't train; without
rows of both labels each score is the base rate; repeated rows score alike; an empty table gives an empty result; a null
language uses the shared threshold. Further columns are ignored or carried along by `keep`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.shared import drop, lean, materialize, table

WORDS = re.compile(r"\w+")
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3


#: Slope of the filters' response below zero.
LEAK = 0.1
#: A word is hashed whole and by its first so many letters.
STEMS = (3, 4, 5)


def word_rows(word: str, rows: int) -> list[int]:
    parts = [word, *(f"{n}:{word[:n]}" for n in STEMS)]
    return [1 + zlib.crc32(p.encode("utf-8", "replace")) % (rows - 1) for p in parts]


class Words:
    """A cache of bounded size from words to their rows."""

    def __init__(self, rows: int, kept: int = 300_000):
        self.rows, self.kept = rows, kept
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, 1 + len(STEMS)), np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        """Row numbers from 1, one line for each word of the text."""
        if len(self.at) > self.kept:
            self.clear()
        at = self.numbers(text)  # may make the table longer
        return self.table[at]

    def numbers(self, text: str | None) -> np.ndarray:
        """Places in the cache's table, one for each word of the text."""
        words = WORDS.findall((text or "").lower())
        for w in set(words):
            if w not in self.at:
                n = self.at[w] = len(self.at)
                if n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[n] = word_rows(w, self.rows)
        return np.fromiter(map(self.at.__getitem__, words), np.int32, len(words))


class Sample:
    """Texts as places in the table of their words' rows."""

    def __init__(self, words: Words, texts: list[np.ndarray]):
        self.words, self.texts = words, texts

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.words.table[self.texts[k]]

    def part(self, chosen: Iterable[int]) -> Sample:
        return Sample(self.words, [self.texts[k] for k in chosen])


@dataclass
class Classifier:
    rows: int = 1 << 16
    width: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    seed: int = 5
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)

    def start(self, texts: Sample, toxic: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        counts = np.full((2, self.rows), 0.5)
        for ids, y in zip(texts, toxic):
            counts[int(y), np.unique(ids)] += 1
        odds = np.log(counts[1] / (toxic.sum() + 1)) - np.log(counts[0] / ((1 - toxic).sum() + 1))
        table_ = rng.normal(0, 0.05, (self.rows, self.width))
        table_[:, 0] = np.clip(odds, -3, 3) / (1 + len(STEMS))
        table_[0] = 0
        p = {"emb": table_, "out": rng.normal(0.3, 0.05, self.filters * len(self.widths)), "bias": np.zeros(1) - 2}
        for w in self.widths:
            p[f"f{w}"] = rng.normal(0, 0.1, (w, self.width, self.filters))
            p[f"f{w}"][:, 0, :] += 0.6 / w
            p[f"b{w}"] = np.zeros(self.filters)
        self.params = {k: v.astype(np.float32) for k, v in p.items()}

    def padded(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([ids, np.zeros((max(self.widths), ids.shape[1]), np.int32)])

    def pooled(self, ids: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses of all filters and where they begin."""
        best = np.full((len(self.widths), self.filters), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64)
        ids = self.padded(ids)
        pad = max(self.widths) - 1
        n = len(ids) - pad
        lanes = np.arange(self.filters)
        for a in range(0, n, block):
            b = min(n, a + block)
            own = ids[a : b + pad]
            x = self.params["emb"][own[:, 0]]
            for c in range(1, own.shape[1]):
                x += self.params["emb"][own[:, c]]
            for k, w in enumerate(self.widths):
                r = x[: b - a] @ self.params[f"f{w}"][0]
                for j in range(1, w):
                    r += x[j : b - a + j] @ self.params[f"f{w}"][j]
                i = r.argmax(0)
                v = r[i, lanes]
                better = v > best[k]
                best[k], where[k] = np.where(better, v, best[k]), np.where(better, a + i, where[k])
        bias = np.stack([self.params[f"b{w}"] for w in self.widths])
        best += bias
        return np.where(best > 0, best, LEAK * best).ravel(), where

    def train(self, texts: Sample, toxic: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.003) -> None:
        self.start(texts, toxic)
        rng, p = np.random.default_rng(self.seed), self.params
        mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                grads = {k: np.zeros_like(v) for k, v in p.items() if k != "emb"}
                touched: list[tuple[np.ndarray, np.ndarray]] = []
                chosen = order[a : a + batch]
                for i in chosen:
                    ids = texts[i]
                    top, at = self.pooled(ids)
                    z = float(top @ p["out"] + p["bias"][0])
                    d = (1 / (1 + np.exp(-z)) - toxic[i]) / len(chosen)
                    grads["out"] += d * top
                    grads["bias"] += d
                    back = d * p["out"] * np.where(top > 0, 1, LEAK)
                    padded = self.padded(ids)
                    for k, w in enumerate(self.widths):
                        g = back[k * self.filters : (k + 1) * self.filters]
                        grads[f"b{w}"] += g
                        for j in range(w):
                            rows = padded[at[k] + j]
                            grads[f"f{w}"][j] += p["emb"][rows].sum(1).T * g
                            touched += [(r, (p[f"f{w}"][j] * g).T) for r in rows.T]
                step += 1
                rows, inverse = np.unique(np.concatenate([r for r, _ in touched]), return_inverse=True)
                g_emb = np.zeros((len(rows), self.width), np.float32)
                np.add.at(g_emb, inverse, np.concatenate([g for _, g in touched]))
                g_emb[rows == 0] = 0
                for k, g, at_ in [*((k, g, slice(None)) for k, g in grads.items()), ("emb", g_emb, rows)]:
                    mean[k][at_] = 0.9 * mean[k][at_] + 0.1 * g
                    square[k][at_] = 0.999 * square[k][at_] + 0.001 * g * g
                    p[k][at_] -= rate * (mean[k][at_] / (1 - 0.9**step)) / (np.sqrt(square[k][at_] / (1 - 0.999**step)) + 1e-6)

    def logits(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        out, bias = self.params["out"], float(self.params["bias"][0])
        return np.array([float(self.pooled(ids)[0] @ out) + bias for ids in texts])

    def calibrate(self, z: np.ndarray, toxic: np.ndarray, langs: list, prior_shift: float, fewest: int = 20) -> None:
        """Platt's scaling on held-back rows, then thresholds: the best F1, shared and by language."""
        y = np.where(toxic == 1, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((1 - toxic).sum() + 2))
        at, centre = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        x = np.stack([z, np.ones_like(z)], 1)
        loss = lambda v: np.logaddexp(0, x @ v).sum() - (y * (x @ v)).sum() + ((v - centre) ** 2).sum()
        for _ in range(100):  # Newton's steps, halved while they don't lower the loss; the penalty keeps few rows from extremes
            q = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            move = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 2 * np.eye(2), x.T @ (q - y) + 2 * (at - centre))
            while abs(move).max() > 1e-9 and loss(at - move) > loss(at):
                move = move / 2
            at = at - move
            if abs(move).max() < 1e-9:
                break
        a, b = at
        self.slope, self.shift = float(max(a, 1e-3)), float(b + prior_shift)
        score, weight = self.scores(z), np.where(toxic == 1, np.exp(prior_shift), 1.0)
        self.thresholds = {None: self._best(score, toxic, weight)}
        langs = np.array(langs, dtype=object)
        for lang in {x for x in langs if x is not None}:
            own = langs == lang
            if toxic[own].sum() >= fewest:
                self.thresholds[lang] = self._best(score[own], toxic[own], weight[own])

    @staticmethod
    def _best(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
        order = np.argsort(-score, kind="stable")
        hit = np.cumsum(weight[order] * toxic[order])
        f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * toxic).sum() + 1e-12)
        k = int(f1.argmax())
        below = score[order[k + 1]] if k + 1 < len(order) else 0.0
        return float((score[order[k]] + below) / 2)

    def scores(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, sample_chars: int = 50_000, seed: int = 5) -> Classifier | float:
    """A trained and calibrated Classifier, or the base rate where the labels have one class only."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).select("doc_id", F.col("toxic").cast("int").alias("__tl_toxic"))
    counts = {r["__tl_toxic"]: r["n"] for r in usable.groupBy("__tl_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("__tl_toxic") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # bounded by 2 * per_class rows of a number each
    sample = docs.select("doc_id", "text", "lang").where(F.length("text") <= sample_chars).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "lang", "__tl_toxic", fold().alias("fold"))
    written, path = materialize(sample.repartition(16), "sample")
    model = Classifier(seed=seed)
    words, rows = Words(model.rows), []
    for r in written.toLocalIterator():  # one part at a time
        rows.append((r["doc_id"], zlib.crc32((r["text"] or "").encode("utf-8", "surrogatepass")), r["__tl_toxic"], r["fold"], r["lang"], words.numbers(r["text"])))
    drop(docs.sparkSession, path)
    rows.sort(key=lambda r: r[:2])
    toxic = np.array([r[2] for r in rows], np.float64)
    every = Sample(words, [r[5] for r in rows])
    fit, rest = (np.array([k for k, r in enumerate(rows) if (r[3] == CALIBRATION) == c], int) for c in (False, True))
    if len({*toxic[fit]}) < 2 or len({*toxic[rest]}) < 2:
        fit = rest = np.arange(len(rows))
    if len({*toxic}) < 2:
        return counts[1] / (counts[0] + counts[1])
    model.train(every.part(fit), toxic[fit])
    ratio = counts[1] / counts[0] / (toxic.sum() / (1 - toxic).sum())
    model.calibrate(model.logits(every[k] for k in rest), toxic[rest], [rows[k][4] for k in rest], float(np.log(ratio)))
    return model


def score_documents(docs: DataFrame, model: Classifier | float, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, score, and rejected: whether the score reaches its language's threshold. lang picks the threshold alone."""
    if clash := {"doc_id", "score", "rejected"} & set(keep):
        raise ValueError(f"keep names {', '.join(sorted(clash))}, which the result has of its own")
    schema = T.StructType([docs.schema[c] for c in ("doc_id", *keep)]).add("score", T.DoubleType()).add("rejected", T.BooleanType())
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        words = Words(own.rows) if isinstance(own, Classifier) else None
        for batch in batches:
            if isinstance(own, Classifier):
                score = own.scores(own.logits(words(t) for t in batch["text"].to_pylist()))
                limit = np.array([own.thresholds.get(x, own.thresholds[None]) for x in batch["lang"].to_pylist()], np.float64)
            else:
                score, limit = np.full(batch.num_rows, float(own)), np.full(batch.num_rows, np.inf)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(batch[k] for k in keep), pa.array(score), pa.array(score >= limit)], ["doc_id", *keep, "score", "rejected"])

    need = list(dict.fromkeys(["doc_id", "text", "lang", *keep]))
    return docs.select(*need).mapInArrow(lean(run), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected")
