"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive examples, texts of any kind the unlabelled ones; no text is ever taken as a
negative example.  With class prior p the risk is p R+(positive) + max(0, R-(unlabelled) - p R-(positive)): where
the second part falls below zero, the step goes the other way, so the model can't explain the unlabelled texts away.

Features are the words of a whole text and their first ``PREFIX`` bytes; those that stand out among the positive
examples (``LEAST_Z`` standard errors) are kept, and a logistic model is fitted to them with numpy.  Both samples are
bounded, ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` distinct rows in the order of a hash of doc_id and text, of which
``MAX_FEATURES`` features each, chosen by hash from the whole text, are learnt from; scoring covers all documents and features.

Defined results: a null or empty text scores as one without features; rows that repeat a doc_id are scored each
by their own text; without labels or positive examples every score is 0; an empty table gives no row; a null
doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clipsieve.llm.common import batches, mix64, sampled_rows
from clipsieve.llm.shingles import words

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
MAX_FEATURES = 4_000
PREFIX = 5
LEAST_Z = 5.0
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct word and prefix hashes."""
    whole, counts = words(texts)
    start, _ = words(texts, PREFIX)
    ends = np.cumsum(counts)
    return [np.unique(np.concatenate([whole[a:b], start[a:b] ^ np.uint64(1)])) for a, b in zip((ends - counts).tolist(), ends.tolist())]


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if not self.keys.size:
            return out
        for k, found in enumerate(features(texts)):
            at = np.minimum(np.searchsorted(self.keys, found), self.keys.size - 1)
            out[k] = self.weights[at[self.keys[at] == found]].sum()
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Features of both samples in, model out."""
    n, m = len(positive), len(unlabelled)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not n or not m or not 0 < prior < 1:
        return none
    keys, dp = np.unique(np.concatenate(positive), return_counts=True)
    keys, dp = keys[dp >= 3], dp[dp >= 3]
    if not keys.size:
        return none

    def columns(sample: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sample)), [x.size for x in sample])
        flat = np.concatenate(sample)
        at = np.minimum(np.searchsorted(keys, flat), keys.size - 1)
        hit = keys[at] == flat
        return row[hit], at[hit]

    in_u = np.bincount(columns(unlabelled, keys)[1], minlength=keys.size)
    share_p, share_u = dp / n, (in_u + 0.5) / (m + 0.5)
    spread = np.sqrt(share_u * (1 - np.minimum(share_u, 0.99)) * (1 / n + 1 / m))
    keys = keys[(share_p - share_u) / spread >= LEAST_Z]
    if not keys.size:
        return none
    (rp, cp), (ru, cu) = columns(positive, keys), columns(unlabelled, keys)
    w = np.zeros(keys.size + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, steps + 1):
        zp = np.bincount(rp, w[cp], minlength=n) + w[-1]
        zu = np.bincount(ru, w[cu], minlength=m) + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp = -prior * np.ones(n) / n  # both parts of a positive example together
            gu = sigmoid(zu) / m
        else:
            gp, gu = prior * sigmoid(zp) / n, -sigmoid(zu) / m
        grad = np.append(np.bincount(cp, gp[rp], minlength=keys.size) + np.bincount(cu, gu[ru], minlength=keys.size), gp.sum() + gu.sum())
        grad[:-1] += ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(keys, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> Model:
    """Fits from two bounded samples; held-out labels are not read into any of them."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    confirmed = sampled_rows(docs, usable.where("toxic = 1").select("doc_id", F.lit(True).alias("positive")), max_positive)
    anything = sampled_rows(docs.where(~held_out(F.col("doc_id"))), None, max_unlabelled).withColumn("positive", F.lit(False))

    def run(source):
        for batch in batches(source, "text"):
            found = [x[np.argsort(mix64(x))[:max_features]].tobytes() for x in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.binary())], names=["positive", "features"])

    rows = confirmed.select("positive", "text").union(anything.select("positive", "text")).mapInArrow(run, "positive boolean, features binary")

    def learn(source):
        """Fits in one task, which the bounds of the samples keep small."""
        sides: tuple[list, list] = [], []
        for batch in source:
            for positive, found in zip(batch.column("positive").to_pylist(), batch.column("features")):
                sides[not positive].append(np.frombuffer(found.as_py(), np.uint64))
        for side in sides:
            side.sort(key=lambda x: x.tobytes())  # the order of arrival must not matter
        model = fit(*sides, prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.keys.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["keys", "weights", "bias"])

    found = rows.repartition(1).mapInArrow(learn, "keys binary, weights binary, bias double").first()
    if found is None:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    return Model(np.frombuffer(bytes(found["keys"]), np.uint64), np.frombuffer(bytes(found["weights"])), found["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(source):
        for batch in batches(source, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""

    def run(source):
        for batch in batches(source, "text"):
            yield batch.filter(pa.array(model.score(batch.column("text")) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
