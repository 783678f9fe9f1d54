import random
import zlib

import numpy as np
import pyarrow as pa

from clipsieve.llm import compression as C

from cases import clashing, documents, got, rows, sentence

GOOD, BAD = "red green blue cyan amber violet teal".split(), "buy!! click!! free!! win!! now!! cash!! deal!!".split()


def sample(n=240, seed=4):
    rng = random.Random(seed)
    data = list(rows())
    marks = []
    for k in range(n):
        words = GOOD if k % 3 else BAD
        text = " ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(20, 300)))
        data.append((5000 + k, text, "en", "a", len(text)))
        marks.append((5000 + k, int(k % 3 > 0), 0))
    data.append((9000, " ".join(rng.choice(BAD) for _ in range(200_000)), "en", "a", 1))
    marks += [(5000, None, None), (None, 1, 1), (5003, 0, 1), (9000, 0, 0), (0, None, 1)]
    return data, marks


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def test_scores(spark):
    data, marks = sample()
    docs, y = documents(spark, data), labels(spark, marks)
    model = C.train(docs, y)
    found = C.score(docs, model).collect()
    assert len(found) == len(data) and all(0 <= r["score"] <= 1 for r in found)
    want = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in data if i is not None}
    assert all(r["held_out"] is want.get(r["doc_id"], False) and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    out = [r for r in found if r["held_out"] and r["doc_id"] is not None and 5000 <= r["doc_id"] < 9000]
    assert len(out) > 50 and sum(r["predicted"] == int((r["doc_id"] - 5000) % 3 > 0) for r in out) >= 0.97 * len(out)
    assert next(r for r in found if r["doc_id"] == 9000)["predicted"] == 0
    # held-out labels and the other columns are never read
    turned = [(i, None if q is None else 1 - q if want.get(i) else q, 1) for i, q, _ in marks]
    again = C.train(clashing(documents(spark, data).repartition(7)), labels(spark, turned))
    assert again.good == model.good and again.bad == model.bad and np.array_equal(again.weights, model.weights)
    assert got(C.score(clashing(docs), again)) == got(C.score(docs, model))


def test_empty_and_one_sided(spark):
    data, marks = sample(60)
    docs = documents(spark, data)
    assert C.train(docs, labels(spark, [])) is None
    assert C.train(docs, labels(spark, [(i, 1, 0) for i, *_ in marks])) is None
    assert {r["score"] for r in C.score(docs, None).collect()} == {0.5}
    model = C.train(docs, labels(spark, marks))
    assert C.score(documents(spark, []), model).count() == 0 and C.train(documents(spark, []), labels(spark, marks)) is None
    assert model.score(pa.array([None, "", "red greens"])).shape == (3,)


def test_sample_is_bounded_by_rows(spark):
    from clipsieve.llm.common import sampled_rows

    docs = documents(spark, [(1, f"text {k % 7}", "en", "a", 1) for k in range(3000)] + [(k, "same", "en", "a", 1) for k in range(2, 50)])
    marks = spark.createDataFrame([(k, 1) for k in range(50)], "doc_id long, quality int")
    some = sampled_rows(docs, marks, 10)
    assert some.count() == 10 and got(some) == got(sampled_rows(docs.repartition(5), marks, 10))
    assert sampled_rows(docs, marks, 10_000).count() == 7 + 48


def test_whole_texts_and_blocks():
    text = "é" * 1000 + "x" * 5000
    assert b"".join(C.blocks(text)) == text.encode() and C.blocks(None) == []
    few = C.blocks(text, 3)
    assert len(few) == 3 and set(few) <= set(C.blocks(text))


def test_calibration_is_the_best_fit():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=400) / 10, -rng.random(400)])
    y = (rng.random(400) < C.probability(C.design(x), np.array([2.0, 1.0, 0.5, 0.3]))).astype(float)
    w = C.calibrate(x, y)

    def loss(v):
        p = np.clip(C.probability(C.design(x), v), 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 0.005 * (v[:3] ** 2).sum()

    assert all(loss(w) <= loss(w + d) + 1e-9 for d in rng.normal(size=(50, 4)) * 0.05)
