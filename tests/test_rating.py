"""Hand-built signals with known scores."""

import random

import pytest
from pyspark.sql import functions as F

from checks.registry import r4
from clipsieve import schemas
from clipsieve.config import ScoringConfig
from clipsieve.operators import ai, rating as R
from clipsieve.plans import flows

CFG = ScoringConfig()


def assets(spark, duration=30.0, has_audio=True):
    row = ("a.mp4", "/m/a.mp4", 1.0, duration, 1920, 1080, "h264", 30.0, has_audio, "ok", None)
    return spark.createDataFrame([row], schemas.ASSETS)


def advanced(spark, rows):
    names = [f.split(" ")[0] for f in schemas.ADVANCED_HITS.split(", ")[:17]]
    table = [tuple(r.get(n) for n in names) for r in rows]
    schema = (
        "source string, kind string, start double, end double, source_wide boolean, text string, face_count int, person_count int, event_type string, "
        "confidence double, evidence array<string>, topic string, keywords array<string>, time_seconds double, top_score double, top_label string, labels array<string>"
    )
    return spark.createDataFrame(table, schema)


def test_audio_spike_and_scene(spark):
    levels = spark.createDataFrame([("/m/a.mp4", 5.0, -40.0), ("/m/a.mp4", 6.0, -10.0)], schemas.LEVELS)
    scenes = spark.createDataFrame([("/m/a.mp4", 6.0)], schemas.SCENES)
    rows = flows.rate(R.Signals(assets(spark), scenes=scenes, levels=levels), CFG).collect()
    assert len(rows) == 1
    clip = rows[0]
    assert (clip.start, clip.end, clip.score, clip.action) == (3.0, 15.0, 56, "broll")
    assert clip.labels == ["audio_spike", "scene_change"]
    assert clip.reasons == ["1 scene change in window", "audio peak -10.0 dB RMS"]
    assert clip.signals["technical_score"] == 18.0 and clip.id == "clip_0001"


def test_half_of_a_level_goes_to_the_even_tenth(spark):
    levels = spark.createDataFrame([("/m/a.mp4", 5.0, 25.15 - 40.0)], schemas.LEVELS)
    assert flows.rate(R.Signals(assets(spark), levels=levels), CFG).first().reasons == ["audio peak -14.8 dB RMS"]


def test_four_decimals_are_those_of_the_sql(spark):
    times = [0.13015, 0.15435, 0.10994999999999999, 10.5, -3.0]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t double").orderBy("i").select(r4("t"))
    assert [r.t for r in rows.collect()] == [0.1301, 0.1543, 0.11, 10.5, -3.0]


def test_objects(spark):
    hits = spark.createDataFrame([("/m/a.mp4", 5.0, 8.0, "person", 0, 20, None)], schemas.OBJECT_HITS)
    clip = flows.rate(R.Signals(assets(spark), object_hits=hits), CFG).first()
    assert {"object_presence", "object_person"} <= set(clip.labels)
    assert clip.object_presence_score == pytest.approx(2 + 2 + 0.1)


def test_advanced_hits(spark):
    s = "/m/a.mp4"
    hits = advanced(spark, [
        dict(source=s, kind="motorsports_event", start=5.0, end=8.0, event_type="pass", confidence=0.8),
        dict(source=s, kind="topic_cluster", start=6.0, end=9.0, topic="racecraft"),
        dict(source=s, kind="ocr_signage", start=0.0, end=0.0, source_wide=True, text="PIT"),
        dict(source=s, kind="face_person", start=0.0, end=0.0, source_wide=True, face_count=2, person_count=3),
    ])
    rows = flows.rate(R.Signals(assets(spark), advanced_hits=hits), CFG).collect()
    assert len(rows) == 1
    assert {"motorsports_event", "motorsports_pass", "topic_cluster", "topic_racecraft", "ocr_signage", "face_person", "face_presence", "person_presence"} <= set(rows[0].labels)
    assert rows[0].signals["face_person_score"] == 5.25


def test_ai_frame_hit(spark):
    hits = advanced(spark, [dict(source="/m/a.mp4", kind="ai_frame_score", start=8.0, end=9.0, top_score=0.86, top_label="ai_reel_opener", labels=["ai_broll_candidate", "ai_reel_opener"])])
    rows = flows.rate(R.Signals(assets(spark), advanced_hits=hits), CFG).collect()
    assert len(rows) == 1 and {"ai_broll_candidate", "ai_reel_opener"} <= set(rows[0].labels)


def test_quiet_file_gets_a_fallback(spark):
    clip = flows.rate(R.Signals(assets(spark)), CFG).first()
    assert (clip.start, clip.end, clip.labels) == (0.0, 12.0, ["low_signal"])


def test_broken_and_short_files_give_nothing(spark):
    short = assets(spark, duration=0.5)
    assert flows.rate(R.Signals(short), CFG).isEmpty()
    assert flows.rate(R.Signals(assets(spark).withColumn("status", F.lit("error"))), CFG).isEmpty()


@pytest.mark.parametrize("percentile", [0.0, 50.0, 85.0, 90.0, 100.0])
def test_spike_threshold_is_floor_nearest_rank(spark, percentile):
    rng = random.Random(int(percentile))
    rows = [(f"s{i % 3}", float(i), round(rng.uniform(-60, 0), 3) if i % 4 else -12.5) for i in range(200)]
    df = spark.createDataFrame(rows, schemas.LEVELS)
    got = {r.source: r.threshold for r in R.spike_thresholds(df, [("p", percentile, -99.0)]).collect()}
    for s in got:
        values = sorted(r[2] for r in rows if r[0] == s)
        assert got[s] == values[int((len(values) - 1) * (percentile / 100.0))]


def test_limit_keeps_best_and_partitions_do_not_matter(spark):
    rng = random.Random(3)
    table = [(f"/m/{i % 5}.mp4", float(rng.randint(0, 590)), float(rng.randint(-60, 0))) for i in range(400)]
    a = spark.createDataFrame([(f"{i}.mp4", f"/m/{i}.mp4", 1.0, 600.0, 640, 480, "h264", 24.0, True, "ok", None) for i in range(6)], schemas.ASSETS)
    results = []
    for parts in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        levels = spark.createDataFrame(table, schemas.LEVELS)
        rows = flows.rate(R.Signals(a, levels=levels), CFG.with_(max_candidates=10)).collect()
        results.append(sorted((r.rank, r.source, r.start, r.end, r.score, tuple(r.labels)) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and len(results[0]) == 10


def test_negative_gap_is_refused():
    with pytest.raises(ValueError):
        ScoringConfig(merge_gap=-1.0)


def test_unknown_profile_is_an_error():
    with pytest.raises(KeyError):
        ai.profile_id("nope")
