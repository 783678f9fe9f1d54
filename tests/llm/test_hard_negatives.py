import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsieve.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=260, dims=6, seed=1):
    rng = random.Random(seed)
    data = []
    for k in range(n):
        v = [rng.choice([-1, 0, 0.5, 1]) * 0.25 if k % 3 else rng.uniform(-1, 1) for _ in range(dims)]
        data.append((k, v, rng.randrange(3)))
    data += [(n + k, [0.5, 0.5, 0, 0, 0, 0], k % 2) for k in range(40)]  # a group of copies
    data += [(50, data[50][1], data[50][2]), (100, [0.1] * dims, 1), (7, None, 1), (9, [float("nan")] * dims, 0), (11, [float("inf")] + [0.0] * 5, 0), (13, [None] * dims, 2), (14, [0.5] * dims, None)]
    data += [(None, [0.9] * dims, 0), (None, [0.4] * dims, 1), (150, [], 0), (15, [0.75], 2), (16, [1e30, 0, 0, 0, 0, 0], 1), (17, [0.0] * dims, 1)]
    return [(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in data]


def brute(data):
    rows = []
    for vec_id, v, label in data:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = np.array(list(v) + [0.0] * (6 - len(v)), np.float32).astype(float)
        q = np.clip(np.floor(256 * v), -H.LARGEST, H.LARGEST).astype(int)
        rows.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, q))
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, (anchor, label, u) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scored = [(int(u @ q), i, other) for j, (i, other, q) in enumerate(rows) if j != k]
        positives = sorted([(s, i) for s, i, other in scored if other == label], key=key)[:5]
        for ps, p in positives:
            inside = sorted([(s, i) for s, i, other in scored if other != label and 50 * ps <= 100 * s <= 95 * ps], key=key)
            out += [(anchor, p, n, i, ps, s) for n, (s, i) in enumerate(inside[:3], 1)]
    return sorted(map(repr, out))


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = H.mine(df, moved, F.col("vec_id") % 50 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(repr(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 20, "MEMBERS": 2, "CELLS": 8, "STRIDE": 4, "ANCHORS_PER_CLUSTER": 2, "FIRST": 1}])
def test_equals_all_pairs(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(H, name, value)
    data = vectors()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert mined(df) == brute(data)
    clash = {c: F.lit("clash") for c in ("row", "cell", "part", "score", "slot", "q", "cluster", "place", "length", "copies")}
    if not sizes:
        assert mined(df.withColumns(clash)) == brute(data)
        assert mined(df.where("vec_id = 50").limit(1)) == []
        assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 50 <> 0")) == []


def test_lists_stop_early_and_bounds_hold():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(5, 16)) * 6
    q = (np.concatenate([c + rng.normal(size=(80, 16)) for c in centre]) * 20).astype(np.int32)
    members = q[:8]
    unit, length = H.directions(members)
    c = H.centroids(members, 1)
    lists = H.Lists(c, np.array([np.arccos(np.clip(unit @ c.T, -1, 1)).max()]))
    bound = lists.bounds(q)[:, 0]
    assert (members @ q.T <= H.certain(length[:, None], bound[None])).all()
    seen = []

    class Counted(H.Walk):
        def take(self, members, scores, ids, matches, column):
            seen.append(scores.size)
            super().take(members, scores, ids, matches, column)

    walk = Counted(8, 1, 3, True)
    H.STRIDE, held = 16, H.STRIDE
    H.walk_chunk(lists, walk, np.zeros(8, int), length, np.zeros(8, int), members, np.arange(len(q)), np.zeros(len(q), int), q)
    H.STRIDE = held
    wanted = [[-s for s, _ in sorted((-int(x), i) for i, x in enumerate(row))[:3]] for row in members @ q.T]
    assert [sorted(walk.hits[0][1][walk.hits[0][0] == k].tolist(), reverse=True) for k in range(8)] == wanted
    assert sum(seen) < 8 * len(q)


def test_integer_products_are_exact():
    for top in (100, 1 << 20, 1 << 22):
        x = np.random.default_rng(top).integers(-top, top, (5, 40)).astype(np.int32)
        assert [[int(v) for v in row] for row in H.exact(x, x)] == [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in x]
