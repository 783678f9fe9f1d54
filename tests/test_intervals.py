"""Interval primitives against brute force, with one hot source and several chunk widths."""

import random

import pytest
from pyspark.sql import functions as F

from clipsieve.operators import intervals as I
from clipsieve.operators.ranking import global_rank, top_n


def hot_source(rng):
    """Source s0 holds most rows."""
    return "s0" if rng.random() < 0.6 else f"s{rng.randint(1, 4)}"


def intervals(n, seed, longest=30):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randint(0, 600)
        out.append((i, hot_source(rng), float(start), float(start + rng.randint(1, longest)), rng.choice("abc"), rng.randint(0, 3)))
    return out


def merged_by_loop(rows, gap):
    out = []
    for source in sorted({r[1] for r in rows}):
        current = None
        for _, _, start, end, label, _ in sorted((r for r in rows if r[1] == source), key=lambda r: r[2]):
            if current and start <= current[1] + gap:
                current[1] = max(current[1], end)
                current[2].add(label)
            else:
                if current:
                    out.append((source, current[0], current[1], tuple(sorted(current[2]))))
                current = [start, end, {label}]
        out.append((source, current[0], current[1], tuple(sorted(current[2]))))
    return sorted(out)


@pytest.mark.parametrize("width", [3.0, 40.0, 1e6])
def test_merge_windows(spark, width):
    rows = intervals(250, 1)
    df = spark.createDataFrame([(r[1], r[2], r[3], [r[4]]) for r in rows], "source string, start double, end double, labels array<string>")
    got = I.merge_windows(df, ["source"], F.lit(2.0), width)
    assert sorted((r.source, r.start, r.end, tuple(r.labels)) for r in got.collect()) == merged_by_loop(rows, 2.0)
    again = I.merge_windows(got, ["source"], F.lit(2.0), width)
    assert again.exceptAll(got).isEmpty()


@pytest.mark.parametrize("width", [5.0, 1e6])
def test_islands_match_merge(spark, width):
    rows = intervals(150, 2)
    df = spark.createDataFrame([(r[1], r[2], r[3]) for r in rows], "source string, start double, end double")
    got = I.with_islands(df, ["source"], F.lit(1.0), width=width).groupBy("source", "island").agg(F.max("end").alias("end")).collect()
    assert sorted((r.source, r.island, r.end) for r in got) == [m[:3] for m in merged_by_loop(rows, 1.0)]


def gap(a, b, c, d):
    if min(b, d) > max(a, c):
        return 0.0
    return c - b if b <= c else a - d


@pytest.mark.parametrize("width", [20.0, 1e6])
def test_nearest_interval(spark, width):
    left, right = intervals(120, 3, 20), [r for r in intervals(60, 4, 20) if r[1] != "s4"]
    a = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in left], "ann long, source string, start double, end double")
    c = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[5]) for r in right], "idx long, source string, h_start double, h_end double, score int")
    got = {r.ann: (r.gap, r.idx) for r in I.nearest_interval(
        a, c, ["source"], ["ann"], [F.col("score"), -F.col("idx")], ["idx"], width=width).collect()}
    for i, source, start, end, _, _ in left:
        options = [(gap(start, end, r[2], r[3]), -r[5], r[0]) for r in right if r[1] == source]
        assert got.get(i) == ((min(options)[0], min(options)[2]) if options else None)


def test_range_joins(spark):
    windows, hits = intervals(40, 5, 90), intervals(120, 6, 70)
    zero = [(900, "s0", 100.0, 100.0, "a", 0)]
    w = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in windows], "w long, source string, start double, end double")
    h = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in hits + zero], "h long, source string, h_start double, h_end double")
    pairs = lambda df: sorted((r.w, r.h) for r in df.collect())
    want = lambda test: sorted((a[0], b[0]) for a in windows for b in hits + zero if a[1] == b[1] and test(a[2], a[3], b[2], b[3]))
    assert pairs(I.overlapping_hits(w, h, ["source"], 25.0)) == want(lambda a, b, c, d: min(b, d) > max(a, c))
    assert pairs(I.endpoint_hits(w, h, ["source"], 25.0)) == want(lambda a, b, c, d: a <= c <= b or a <= d <= b)
    points = h.select("h", "source", F.col("h_start").alias("time"))
    assert pairs(I.points_in_windows(w, points, ["source"], width=25.0)) == want(lambda a, b, c, d: a <= c <= b)
    covered = {h for _, h in want(lambda a, b, c, d: a <= c <= b)}
    assert {r.h for r in I.uncovered_points(points, w, ["source"], width=25.0).collect()} == {r[0] for r in hits + zero} - covered


def test_no_nested_loop_join(spark):
    w = spark.createDataFrame([("s", 0.0, 1.0)], "source string, start double, end double")
    h = spark.createDataFrame([("s", 0.0, 1.0)], "source string, h_start double, h_end double")
    for df in (I.overlapping_hits(w, h, ["source"]), I.uncovered_points(h.withColumnRenamed("h_start", "time"), w, ["source"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_sum_and_ranks(spark):
    rng = random.Random(7)
    rows = [(i + 1, float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, pos long, v double")
    got = {r.pos: r.s for r in I.running_sum(df, ["k"], "pos", F.col("v"), "s", rows_per_chunk=17).collect()}
    total = 0.0
    for pos, value in rows:
        assert got[pos] == total
        total += value
    order = [F.desc("v"), F.asc("pos")]
    want = [pos for pos, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.pos for r in global_rank(df, order).orderBy("rank").collect()] == want
    assert [r.pos for r in top_n(df, order, 12).orderBy("rank").collect()] == want[:12]
