"""Evaluation, matching and decisions on small known cases."""

import random

from pyspark.sql import functions as F

from clipsieve import schemas
from clipsieve.config import ScoringConfig
from clipsieve.operators import evaluate as E, learning as L, matching as M, review as V, sweep as W, timeline as T
from clipsieve.operators.rating import Signals

CANDIDATES = "rank long, id string, source string, start double, end double, score int, action string, labels array<string>, reasons array<string>, signals map<string,double>"


def candidates(spark, rows):
    full = [(i, f"clip_{i:04d}", *r, [], ["because"], {"transcript_score": 1.0}) if len(r) == 5 else (i, *r) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, CANDIDATES)


def annotations(spark, rows):
    return spark.createDataFrame([(i, f"annotation_{i:04d}", *r, "") for i, r in enumerate(rows, 1)], schemas.ANNOTATIONS)


def test_report(spark):
    c = candidates(spark, [("a", 10.0, 20.0, 90, "select"), ("a", 40.0, 50.0, 75, "review"), ("b", 0.0, 5.0, 30, "cut")])
    a = annotations(spark, [("a", 12.0, 18.0, "select", ["quote"]), ("b", 30.0, 40.0, "broll", []), ("a", 42.0, 48.0, "reject", []), ("b", 1.0, 2.0, "ignore", [])])
    e = E.evaluate(a, c)
    m = e.metrics.first()
    assert (m.true_positives, m.false_positives, m.missed, m.precision, m.recall) == (1, 1, 1, 0.5, 0.5)
    assert {r.tag: r.recall for r in e.recall_by_tag.collect()} == {"quote": 1.0, "untagged": 0.0}
    assert {(r.action, r.actual): r.n for r in e.confusion.collect()}[("review", "reject")] == 1
    assert e.missed.first().near_id == "clip_0003" and e.missed.first().gap == 25.0
    assert {r.k: r.recall for r in e.recall_at.collect()}[5] == 0.5


def test_half_of_a_ratio_is_rounded_on_the_scaled_number(spark):
    counts = spark.createDataFrame([(17, 783, 800), (139, 661, 800)], "tp long, fp long, pos long")
    rows = counts.orderBy("tp").select(*[c.alias(n) for n, c in E.prf("tp", "fp", "pos").items()]).collect()
    assert [(r.precision, r.recall) for r in rows] == [(0.0213, 0.0213), (0.1737, 0.1737)]


def test_greedy_match_equals_the_loop(spark):
    rng = random.Random(11)
    span = lambda: (float(s := rng.randint(0, 200)), float(s + rng.randint(1, 40)))
    c_rows = [(f"s{rng.randint(0, 1)}", *span(), rng.randint(0, 4) * 10, "select") for _ in range(40)]
    a_rows = [(f"s{rng.randint(0, 1)}", *span(), "select", []) for _ in range(80)]
    got = E.greedy_match(annotations(spark, a_rows), candidates(spark, c_rows))
    assert {r.ann_index: r.cand_rank for r in got.collect()} == loop(a_rows, c_rows)


def loop(a_rows, c_rows):
    used, want = set(), {}
    for i, (s, a, b, *_) in enumerate(a_rows, 1):
        options = [(-(min(b, d) - max(a, x)), -score, j) for j, (t, x, d, score, _) in enumerate(c_rows, 1) if t == s and j not in used and min(b, d) > max(a, x)]
        if options:
            want[i] = min(options)[2]
            used.add(want[i])
    return want


def test_copies_are_matched_like_the_loop(spark):
    """Few intervals, many copies of each on both sides, in mixed order."""
    rng = random.Random(5)
    spans = [(0.0, 10.0), (5.0, 20.0), (8.0, 12.0), (15.0, 30.0)]
    a_rows = [("s", *rng.choice(spans), "select", []) for _ in range(16)]
    c_rows = [("s", *rng.choice(spans), rng.randint(0, 2) * 10, "select") for _ in range(12)]
    got = E.greedy_match(annotations(spark, a_rows), candidates(spark, c_rows))
    assert {r.ann_index: r.cand_rank for r in got.collect()} == loop(a_rows, c_rows)


def test_copies_in_one_round(spark, monkeypatch):
    rounds = []
    cut = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    n = 3000
    a_rows = [("s", 2.0, 4.0, "select", [])] * 3 + [("s", 0.0, 10.0, "select", [])] * n
    c_rows = [("s", 0.0, 10.0, 50, "select")] * n
    got = {r.ann_index: r.cand_rank for r in E.greedy_match(annotations(spark, a_rows), candidates(spark, c_rows)).collect()}
    assert got == {i: i for i in range(1, n + 1)}
    assert len(rounds) == 2  # the candidates, and the matches of the only round


def test_a_hot_source_in_blocks_and_parts(spark, monkeypatch):
    """Half of the source under every annotation: any block and part size gives the loop's matches."""
    rng = random.Random(3)
    spans = [(float(s := rng.randint(0, 400)), float(s + rng.randint(200, 400))) for _ in range(90)]
    a_rows = [("hot", *s, "select", []) for s in spans] + [(f"s{k % 5}", 0.0, float(k), "select", []) for k in range(20)]
    c_rows = [("hot", float(s := rng.randint(0, 790)), float(s + rng.randint(1, 9)), rng.randint(0, 5) * 10, "select") for _ in range(160)]
    c_rows += [(f"s{k % 5}", float(k), float(k + 2), 50, "select") for k in range(15)]
    want = loop(a_rows, c_rows)
    rounds = []
    cut = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    for block, part in ((4096, 20), (40, 4096), (30, 11)):
        monkeypatch.setattr(M, "BLOCK", block), monkeypatch.setattr(M, "PART", part)
        rounds.clear()
        got = E.greedy_match(annotations(spark, a_rows), candidates(spark, c_rows))
        assert {r.ann_index: r.cand_rank for r in got.collect()} == want
        blocks, parts = -(-90 // block), -(-160 // part)
        merges = 0
        while parts > 1:
            parts, merges = -(-parts // M.FAN), merges + 1
        # the candidates; the numbering of blocks; per block its merges, its matches, and what they leave
        assert len(rounds) == 1 + (blocks > 1) + blocks * (merges + 1) + (blocks - 1)


def test_matching_defined_results(spark):
    schema = "source string, rank long, start double, end double, score int"
    a = annotations(spark, [("s", 0.0, 10.0, "select", []), ("s", 5.0, 5.0, "select", []), ("s", None, 4.0, "select", []), (None, 0.0, 9.0, "select", [])])
    c = spark.createDataFrame([("s", 1, 1.0, 3.0, None), ("s", 2, 4.0, 6.0, 7), ("s", 3, 8.0, 8.0, 9), (None, 4, 0.0, 9.0, 9), ("s", 5, None, 9.0, 9)], schema)
    assert [(r.ann_index, r.cand_rank, r.overlap) for r in M.greedy_pairs(a, c).collect()] == [(1, 2, 2.0)]
    assert M.greedy_pairs(a, c.limit(0)).count() == 0 and M.greedy_pairs(a.limit(0), c).count() == 0


def test_one_candidate_wanted_by_all(spark):
    """The earliest annotation wins; the others find nothing else."""
    a = annotations(spark, [("s", float(i), float(i + 50), "select", []) for i in range(30)])
    c = candidates(spark, [("s", 0.0, 100.0, 80, "select"), ("s", 200.0, 201.0, 80, "select")])
    rows = E.greedy_match(a, c).collect()
    assert [(r.ann_index, r.cand_rank) for r in rows] == [(1, 1)]


def test_decisions_override_scores(spark):
    c = candidates(spark, [("a", 10.0, 20.0, 95, "select"), ("a", 30.0, 40.0, 40, "cut"), ("a", 50.5, 60.0, 60, "broll"), ("a", 70.0, 80.0, 90, "select")])
    d = spark.createDataFrame(
        [("clip_0001", "Reject", 1, ""), ("clip_0002", "promote", 2, " keep "), ("clip_0003", "b-roll", None, ""), ("clip_0004", "ignore", 3, "")], "id string, decision string, order int, note string")
    rows = {r.label: r for r in V.approve(c, d).collect()}
    assert set(rows) == {"clip_0002", "clip_0003"}
    assert rows["clip_0002"].review_note == "keep" and rows["clip_0003"].sort_order == 999999 and rows["clip_0003"].start == "00:00:50"
    assert {r.label for r in V.approve(c, min_score=91).collect()} == {"clip_0001"}
    assert {r.label for r in V.approve(c, ids=["clip_0002"]).collect()} == {"clip_0002"}


def test_decisions_survive_regeneration(spark):
    c = candidates(spark, [("a", 0.0, 1.0, 90, "select"), ("a", 2.0, 3.0, 60, "broll"), ("a", 4.0, 5.0, 30, "cut")])
    old = spark.createDataFrame([("clip_0002", "promote", 7, "mine")], "id string, decision string, order int, note string")
    rows = {r.id: (r.decision, r.order, r.note) for r in V.merge_decisions(c, old).collect()}
    assert rows == {"clip_0001": ("approve", 8, ""), "clip_0002": ("promote", 7, "mine"), "clip_0003": ("reject", 9, "")}
    fresh = {r.id: r.order for r in V.merge_decisions(c).collect()}
    assert fresh == {"clip_0001": 1, "clip_0002": 2, "clip_0003": 3}
    changed = V.update_decision(V.merge_decisions(c), "clip_0001", note="x").where("id = 'clip_0001'").first()
    assert changed.note == "x" and changed.decision == "approve"


def clips(spark, rows):
    table = [("sel", s, i, f"c{i}", None, None, float(a), float(b), score, order, [], []) for i, (s, a, b, score, order) in enumerate(rows, 1)]
    return spark.createDataFrame(table, schemas.SELECTION_CLIPS)


def test_roughcut(spark):
    plan = T.plan_roughcut(clips(spark, [("a", 10, 20, 70, 2), ("b", 5, 15, 95, 1)]), "score", target_duration=12.0, handles=1.0).orderBy("pos").collect()
    assert plan[0].label == "c2" and plan[0].duration == 12.0
    assert T.plan_summary(T.plan_roughcut(clips(spark, [("a", 10, 20, 70, 2), ("b", 5, 15, 95, 1)]))).first().duration == 20.0


def fit_by_loop(durations, target):
    out, elapsed = [], 0.0
    for i, d in enumerate(durations, 1):
        if elapsed >= target:
            break
        left = target - elapsed
        if d <= left or not out:
            kept = round(left, 3) if d > left and left >= 1.0 else d
            out.append((i, kept))
            elapsed += kept
        elif left >= 1.0:
            out.append((i, round(left, 3)))
            break
    return out


def test_fit_target_duration_equals_the_loop(spark):
    rng = random.Random(5)
    for target in (0.5, 7.0, 30.0):
        durations = [rng.choice([0.25, 0.5, 2.0, 3.5, 9.0]) for _ in range(25)]
        df = spark.createDataFrame([("s", i, 0.0, d, d) for i, d in enumerate(durations, 1)], "selection string, pos int, start_seconds double, end_seconds double, duration double")
        got = sorted((r.pos, r.duration) for r in T.fit_target_duration(df, target).collect())
        assert got == fit_by_loop(durations, target)


def test_training(spark):
    rows = [({"deterministic_score": 90.0, "audio_interest_score": 12.0, "label_audio_spike": 1.0}, ("approve", 1)),
            ({"deterministic_score": 35.0, "audio_interest_score": 0.0, "label_audio_spike": 0.0}, ("reject", 0))]
    data = spark.createDataFrame(rows, "features map<string,double>, label struct<rating: string, target: int>")
    model = L.train_scorer(data)
    assert {r.feature: r.weight for r in model.weights.collect()} == {"deterministic_score": 1.0, "audio_interest_score": 1.0, "label_audio_spike": 1.0}
    assert L.training_accuracy(data, model).first().accuracy == 1.0
    c = candidates(spark, [("a", 0.0, 10.0, 90, "select"), ("a", 20.0, 30.0, 20, "cut")])
    learned = {r.id: r.learned_score for r in L.score_with_model(c, model).collect()}
    assert learned["clip_0001"] > 50 > learned["clip_0002"]


def test_features_are_made_of_decided_clips_only(spark):
    c = candidates(spark, [("a", 0.0, 10.0, 90, "select"), ("a", 20.0, 30.0, 20, "cut")])
    decisions = spark.createDataFrame([("clip_0001", "approve", 1, "")], "id string, decision string, order int, note string")
    data = L.build_review_dataset(decisions, c)
    rows = L.feature_values(data.select("features", F.col("label.target").alias("target")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "map_from_entries" in above and "map_from_entries" not in below
    assert {r.feature: r.value for r in rows.collect()}["deterministic_score"] == 90.0


def test_repeated_names_keep_the_last_value(spark):
    c = candidates(spark, [("a", 0.0, 10.0, 90, "select")]).withColumn("signals", F.expr("map('Dog Run', 1.0D, 'dog_run', 2.0D, '_x_', 3.0D, '', 4.0D)"))
    got = L.candidate_features(c).first().features
    assert (got["dog_run"], got["x"], got["value"]) == (2.0, 3.0, 4.0)


def test_large_models_join_by_feature(spark, monkeypatch):
    data = spark.createDataFrame([({"x": 4.0}, ("y", 1)), ({"x": 1.0, "z": 2.0}, ("n", 0))], "features map<string,double>, label struct<rating: string, target: int>")
    model = L.train_scorer(data)
    small = sorted(r.raw_score for r in L.with_raw_score(data, model).collect())
    monkeypatch.setattr(L, "MAX_SHIPPED_WEIGHTS", 0)
    assert sorted(r.raw_score for r in L.with_raw_score(data, model).collect()) == small


def test_single_class_training_fails(spark):
    import pytest

    data = spark.createDataFrame([({"x": 1.0}, ("approve", 1))], "features map<string,double>, label struct<rating: string, target: int>")
    with pytest.raises(Exception, match="both positive and negative"):
        L.train_scorer(data)


def test_sweep_grid_and_rank(spark):
    grid = W.config_grid(spark, ScoringConfig(max_candidates=50))
    assert grid.count() == 648 and W.config_grid(spark, ScoringConfig(max_candidates=60)).count() == 864
    asset = spark.createDataFrame([("a", "a", 1.0, 60.0, 1920, 1080, "h264", 30.0, True, "ok", None)], schemas.ASSETS)
    signals = Signals(asset, scenes=spark.createDataFrame([("a", 10.0)], schemas.SCENES), levels=spark.createDataFrame([("a", 9.0, -42.0), ("a", 10.0, -12.0)], schemas.LEVELS))
    rows = W.sweep_scoring(signals, annotations(spark, [("a", 9.0, 14.0, "select", [])]), ScoringConfig(max_candidates=50)).orderBy("rank").collect()
    assert len(rows) == 648 and rows[0].f1 == 1.0 and rows[0].true_positives == 1


def test_limited_sets_are_the_first_of_whole_sets(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"s{i}" for i in range(40)]
    asset = spark.createDataFrame([(n, n, 1.0, 300.0, 1920, 1080, "h264", 30.0, True, "ok", None) for n in names], schemas.ASSETS)
    times = [(n, float(rng.randrange(300))) for n in names[1:] for _ in range(5)]
    signals = Signals(asset, scenes=spark.createDataFrame(times, schemas.SCENES),
                      levels=spark.createDataFrame([(n, t, rng.choice((-42.0, -30.0, -12.0))) for n, t in times], schemas.LEVELS))
    base = ScoringConfig(max_candidates=7)
    whole = W.scored_sets(signals, base, None).where("rank <= 7").select("weight", "audio", "roll", "source", "start", "end", "score", "rank")
    want = sorted(whole.collect())
    monkeypatch.setattr(W, "PENDING", 10)
    found = W.scored_sets(signals, base, 7)
    assert sorted(found.select(whole.columns).collect()) == want and len(want) == 7 * 54
    # No task orders all of its scored windows: only what each left of them.
    assert "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()


def test_sweep_seeds_move_once_to_their_chunk(spark, monkeypatch):
    asset = spark.createDataFrame([("a", "a", 1.0, 60.0, 1920, 1080, "h264", 30.0, True, "ok", None)], schemas.ASSETS)
    signals = Signals(asset, scenes=spark.createDataFrame([("a", 10.0)], schemas.SCENES), levels=spark.createDataFrame([("a", 9.0, -42.0)], schemas.LEVELS))
    plans = []
    monkeypatch.setattr(W, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    windows = W.windows_by_profile(signals, ScoringConfig(max_candidates=50))
    assert set(windows.columns) == {"profile", "source", "start", "end"} and len(plans) == 1
    assert sum("Exchange" in line and "_chunk" in line for line in plans[0].splitlines()) == 1


def test_several_documents_are_one_evaluation(spark):
    a = annotations(spark, [("a", 10.0, 20.0, "select", [])]).withColumn("path", F.lit("one.json"))
    a = a.union(annotations(spark, [("b", 30.0, 40.0, "select", [])]).withColumn("path", F.lit("two.json")))
    c = candidates(spark, [("a", 10.0, 20.0, 90, "select")]).withColumn("path", F.lit("one.json"))
    c = c.union(candidates(spark, [("b", 30.0, 40.0, 90, "select")]).withColumn("path", F.lit("two.json")))
    e = E.evaluate(a, c)
    m = e.metrics.first()
    assert (m.true_positives, m.false_positives, m.missed, m.precision) == (2, 0, 0, 1.0)
    assert {r.source for r in e.matches.collect()} == {"a", "b"}
    assert all(r.recall == 1.0 for r in e.recall_at.collect())


def test_equal_frames_stay_apart_in_any_block_size(spark, monkeypatch):
    from clipsieve.operators import ai

    frames = spark.createDataFrame([("a", 1.0, [1.0, 0.0]), ("a", 1.0, [1.0, 0.0]), ("a", 2.0, [0.0, 1.0])], "source string, time double, vector array<double>")
    prompts = spark.createDataFrame([("p", i, f"l{i}", "t", "x", [float(i == "a"), float(i == "b")]) for i in "ab"],
                                    "profile string, id string, label string, prompt string, intent string, vector array<double>")
    want = sorted(map(str, ai.score_frames(frames, prompts, profile="p").collect()))
    for name, value in (("MAX_SHIPPED_BLOCKS", 0), ("PROMPT_BLOCK", 1), ("FRAME_PARTS", 1)):
        monkeypatch.setattr(ai, name, value)
        assert sorted(map(str, ai.score_frames(frames, prompts, profile="p").collect())) == want and len(want) == 3


def test_grid_without_a_limit():
    assert list(W.grid_axes(ScoringConfig(max_candidates=None))["limit"]) == ["all", "50", "75", "100"]
    assert list(W.grid_axes(ScoringConfig(max_candidates=50))["limit"]) == ["50", "75", "100"]


def test_rank_per_group_equals_a_window(spark):
    from pyspark.sql import Window

    from clipsieve.operators.ranking import rank_per_group

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id"), F.xxhash64("id").alias("v"))
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("long"))
    assert sorted(rank_per_group(df, ["k"], [F.col("v")]).select(*want.columns).collect()) == sorted(want.collect())
