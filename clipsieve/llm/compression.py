"""Quality by compression: a text is like the labelled texts whose dictionary makes it smaller.

One zstandard dictionary is built from texts labelled good, one from texts labelled bad.  Every block of ``BLOCK``
bytes of a whole text is compressed with each of them on its own, so the dictionary matters to the last byte of a long
text.  With g and b the compressed bytes of all blocks, the difference is (b - g) / max(g, b); the score is a logistic
function of it and of the logarithm of min(g, b) over the text's bytes, fitted to labelled rows that are in no dictionary.

Bounds of what is learnt from: ``MAX_SAMPLE`` rows of each class for the dictionaries, of which ``MAX_BLOCKS`` blocks
each, evenly spread over the text; ``MAX_CALIBRATION`` rows for the fit, of which two numbers and the label are kept.
Scoring covers every row and whole texts.

Defined results: a null or empty text has a difference and a logarithm of 0; rows that repeat a doc_id are scored each by
their own text; a doc_id labelled more than once counts as good if any label says so; without labels of both kinds
every score is 0.5; an empty table gives no row; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from clipsieve.llm.common import batches, sampled_rows

BLOCK = 512
DICTIONARY_BYTES = 32_000
LEVEL = 3
MAX_SAMPLE = 2_000
MAX_BLOCKS = 64
MAX_CALIBRATION = 6_000
THRESHOLD = 0.5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def calibrates() -> Column:
    """Of three labelled rows one calibrates, by the row's hash; the others may enter a dictionary."""
    return F.pmod(F.col("h"), F.lit(3)) == 0


def blocks(text: str | None, most: int | None = None) -> list[bytes]:
    """A text's bytes in blocks; with ``most``, so many of them, evenly spread."""
    data = (text or "").encode()
    starts = range(0, len(data), BLOCK)
    if most and len(starts) > most:
        starts = [starts[k * len(starts) // most] for k in range(most)]
    return [data[k : k + BLOCK] for k in starts]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; samples too few or too alike to train one are the dictionary as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Sizes:
    """Compressed sizes of whole texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.coders = []
        for data in (good, bad):
            table = zstandard.ZstdCompressionDict(data)
            table.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=table, write_content_size=False, write_dict_id=False, write_checksum=False))

    def of(self, text: str | None) -> tuple[float, float]:
        parts = blocks(text)
        if not parts:
            return 0.0, 0.0
        g, b = (sum(len(c.compress(p)) for p in parts) for c in self.coders)
        return (b - g) / max(g, b), float(np.log(min(g, b) / sum(map(len, parts))))


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray  # difference, logarithm of the ratio, its square, constant

    def score(self, texts: pa.Array) -> np.ndarray:
        sizes = Sizes(self.good, self.bad)
        found = np.array([sizes.of(t) for t in texts.to_pylist()]).reshape(-1, 2)
        return probability(design(found), self.weights)


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x[:, 0] * 10, x[:, 1], x[:, 1] ** 2, np.ones(len(x))])


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; ``ridge`` spares the constant."""
    x = design(x)
    hold = np.diag([ridge, ridge, ridge, 1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = probability(x, w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, max_calibration: int = MAX_CALIBRATION) -> Model | None:
    """Builds the dictionaries in one task and fits the score; held-out labels are not read."""
    usable = (
        labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    )
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))

    def cut(source):
        for batch in batches(source, "text"):
            found = [blocks(t, MAX_BLOCKS) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(found, pa.list_(pa.binary()))], names=["quality", "blocks"])

    def learn(source):
        sides: dict[int, list] = {0: [], 1: []}
        for batch in source:
            for quality, found in zip(batch.column("quality").to_pylist(), batch.column("blocks").to_pylist()):
                sides[int(quality == 1)].append(found)
        for side in sides.values():
            side.sort()  # the order of arrival must not matter
        flat = [[b for found in sides[k] for b in found] for k in (1, 0)]
        if all(flat):
            yield pa.RecordBatch.from_arrays([pa.array([dictionary(f)], pa.binary()) for f in flat], names=["good", "bad"])

    chosen = [sampled_rows(docs.where(~calibrates()), usable.where(side), max_sample) for side in ("quality = 1", "quality <> 1")]
    parts = chosen[0].union(chosen[1]).select("quality", "text").mapInArrow(cut, "quality int, blocks array<binary>")
    found = parts.repartition(1).mapInArrow(learn, "good binary, bad binary").first()
    if found is None:
        return None
    good, bad = bytes(found["good"]), bytes(found["bad"])

    def measure(source):
        sizes = Sizes(good, bad)
        for batch in batches(source, "text"):
            x = np.array([sizes.of(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["quality", "difference", "ratio"])

    rows = sampled_rows(docs.where(calibrates()), usable, max_calibration).select("quality", "text")
    points = rows.mapInArrow(measure, "quality int, difference double, ratio double").toArrow()  # at most max_calibration rows of three numbers
    y = (points["quality"].to_numpy() == 1).astype(float)
    x = np.column_stack([points["difference"].to_numpy(), points["ratio"].to_numpy()])
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    if not 0 < y.sum() < y.size:
        return None
    return Model(good, bad, calibrate(x[order], y[order]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(source):
        for batch in batches(source, "text"):
            text = batch.column("text")
            found = model.score(text) if model else np.full(len(text), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
