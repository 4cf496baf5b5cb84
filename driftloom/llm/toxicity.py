"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; each model sees the text's features and the probabilities of the categories before it. While
training, those are out-of-fold predictions (FOLDS folds), so that later models learn from inputs as uncertain as they will get.
The labels name toxic texts only, so the earlier categories are weak labels: a toxic text that holds one of the category's seed words; the last
category is the label itself, which also reaches languages that the seeds don't know.

Features are words, stripped of punctuation and lower-cased, and prefixes of 4 and 5 characters (which carry inflected forms), present or
not; the FEATURES with the largest chi-square against the label in the training sample are used. Labels are used only from rows whose
crc32(doc_id as text) mod 5 is not 0, at most TRAIN_ROWS of each class.

Defined cases: null and empty texts have no features and get the models' base score; without labels of both classes every
probability is the smoothed base rate; whole texts count. Columns named like the outputs are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, over_batches, replaced, stage
from .quality import is_held_out, labelled

TRAIN_ROWS, FEATURES, FOLDS, LEAST_ROWS, THRESHOLD = 5000, 768, 4, 5, 0.5
#: Seed words of the weak categories, in the order of the chain.
SEEDS = {
    "insult": ("idiot", "moron", "loser", "clown", "fool", "imbecile", "jerk"),
    "contempt": ("stupid", "pathetic", "worthless", "disgusting", "ridiculous", "useless"),
    "dehumanizing": ("scum", "trash", "vermin", "garbage", "filth", "parasite"),
}
LAST = "toxic"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’–—…"


def parts_of(word: bytes) -> tuple[str, ...]:
    w = word.decode("utf-8", "replace").lower().strip(MARKS)
    return (w, *(f"{w[:n]}*" for n in (4, 5) if len(w) > n)) if 2 < len(w) < 40 else ()


def texts_parts(data: bytes) -> set[str]:
    return {p for w in set(data.split()) for p in parts_of(w)}


class Features:
    """The chosen features by place; words that are seen again are looked up in a bounded memory."""

    def __init__(self, names: list[str]):
        self.names, self.at, self.known = names, {n: i for i, n in enumerate(names)}, {}

    def __reduce__(self):
        return Features, (self.names,)

    def of(self, data: bytes) -> list[int]:
        out: set[int] = set()
        if len(self.known) > 1 << 18:
            self.known = {}
        for w in set(data.split()):
            if (got := self.known.get(w)) is None:
                got = self.known[w] = tuple(self.at[p] for p in parts_of(w) if p in self.at)
            out.update(got)
        return sorted(out)

    def matrix(self, texts: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.names)))
        for i, t in enumerate(texts):
            x[i, t] = 1
        return x


class Linear:
    """Logistic regression on few of many 0/1 features: ridge on the raw scale, so rare features stay small. start: weights to begin with."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, steps: int = 25, start: np.ndarray | None = None):
        base = ((weight * y).sum() + 1) / (weight.sum() + 2)
        self.w = np.r_[np.zeros(x.shape[1]), np.log(base / (1 - base))]
        if len(np.unique(y)) < 2:
            return
        self.w = self.w if start is None else start.copy()
        a = np.c_[x, np.ones(len(x))]
        hold = np.r_[np.full(x.shape[1], ridge), 1e-6]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-6) * weight
            step = np.linalg.solve((a.T * s) @ a + np.diag(hold), a.T @ (weight * (p - y)) + hold * self.w)
            self.w -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


class Chain:
    def __init__(self, features: Features, categories: list[str], models: list[Linear]):
        self.features, self.categories, self.models = features, categories, models

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """A column of probabilities for each category: each model sums its weights at the features that are there, and of the categories before."""
        n = len(self.features.names)
        held = [self.features.of(t) for t in texts]
        owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
        at = np.fromiter((k for h in held for k in h), np.int64, len(owner))
        out = np.zeros((len(texts), 0))
        for m in self.models:
            z = np.bincount(owner, weights=m.w[at], minlength=len(texts)) + out @ m.w[n:-1] + m.w[-1]
            out = np.c_[out, 1 / (1 + np.exp(-np.clip(z, -30, 30)))]
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain:
    sample = stage(labelled(docs, labels, LAST, rows), "toxic-train")

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, ys = [], []
        for data, y in zip(binary(batch.column("text")), batch.column("y").to_pylist(), strict=True):
            got = texts_parts(data)
            names += got
            ys += [y] * len(got)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int64())], names=["name", "y"])

    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    counts = over_batches(sample, present, "name string, y long").groupBy("name").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.col("a") + F.col("b") >= LEAST_ROWS)
    chi = F.expr(f"(a * ({good} - b) - b * ({bad} - a)) * (a * ({good} - b) - b * ({bad} - a)) / (cast((a + b) as double) * ({bad + good} - a - b + 1))")
    features = Features(sorted(r["name"] for r in counts.orderBy(chi.desc(), "name").limit(FEATURES).collect()))
    seeds = {c: set(words) for c, words in SEEDS.items()}

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = binary(batch.column("text"))
        held = [texts_parts(t) for t in texts]
        weak = [[int(bool(h & s)) for s in seeds.values()] for h in held]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("weight"), pa.array([features.of(t) for t in texts], pa.list_(pa.int32())), pa.array(weak, pa.list_(pa.int32()))], names=["doc_id", "y", "weight", "at", "weak"])

    got = sorted(over_batches(sample.withColumn("doc_id", F.col("doc_id").cast("long")), vectors, "doc_id long, y int, weight double, at array<int>, weak array<int>").collect())
    x, y = features.matrix([r["at"] for r in got]), np.array([r["y"] for r in got], float)
    weight = np.array([r["weight"] for r in got], float)
    weak = np.array([r["weak"] for r in got], float).reshape(len(got), len(seeds))
    fold = np.array([zlib.crc32(f"fold{r['doc_id']}".encode()) % FOLDS for r in got], int)
    before, models = np.zeros((len(got), 0)), []
    for target in (*(y * weak[:, k] for k in range(len(seeds))), y):
        seen, out = np.c_[x, before], np.zeros(len(got))
        models.append(Linear(seen, target, weight))
        for f in range(FOLDS):  # begun where all rows lead, each goes on to its own optimum
            out[fold == f] = Linear(seen[fold != f], target[fold != f], weight[fold != f], start=models[-1].w).predict(seen[fold == f])
        before = np.c_[before, out]
    return Chain(features, [*seeds, LAST], models)


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a probability for each weak category, score (of being toxic), held_out and predicted."""
    names = [*chain.categories[:-1], "score"]
    schema = replaced(docs, **{n: T.DoubleType() for n in names})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = binary(batch.column("text"))
        p = chain.predict(texts)
        new = {n: pa.array(p[:, k]) for k, n in enumerate(names)}
        return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in schema.names], names=schema.names)

    scored = over_batches(docs.select(*(f"`{n}`" for n in schema.names if n not in names)), run, schema)
    return scored.withColumn("held_out", is_held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
