"""Rating: scores, windows, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import ORACLE, flat, query, r4, rounded4
from checks.views import ADVANCED, ADVANCED_SCORES, with_views
from clipsieve.config import SHORT_REPORT, ScoringConfig
from clipsieve.functions import scalars as S
from clipsieve.operators import intervals as I, rating as R
from clipsieve.plans import bridge as B, flows

CFG = ScoringConfig()
SHORT = CFG.with_(**SHORT_REPORT)


@query("P1_technical_score", with_views("technical") + "SELECT source, technical_score FROM technical")
def technical_score(spark, sf):
    return R.technical_score(B.assets(spark, sf), CFG).select(F.col("filepath").alias("source"), "technical_score")


@query("P2_action_for_score", with_views("cands") + "SELECT action, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM cands GROUP BY action")
def action_for_score(spark, sf):
    rows = B.candidates(spark, sf).withColumn("action", R.action_for_score("score", CFG))
    return rows.groupBy("action").agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query("P3_audio_tier", with_views("components") + """
  SELECT source, round("start", 4) AS "start", audio_interest_score,
         CASE WHEN peak >= -35 THEN 'audio_spike' WHEN peak IS NOT NULL THEN 'audio_present' ELSE '' END AS label
  FROM components""")
def audio_tier(spark, sf):
    facts = B.candidates(spark, sf)
    return facts.select(
        "source", r4("start"), R.audio_points("peak", "silence_ratio").alias("audio_interest_score"),
        F.coalesce(R.audio_label("peak", F.lit(-35.0)), F.lit("")).alias("label"),
    )


@query("P4_interesting_objects", with_views("interesting") + "SELECT source, class_name, count(*) AS n FROM interesting GROUP BY ALL")
def interesting_objects(spark, sf):
    hits = R.interesting_objects(B.object_hits(B.events(spark, sf)), CFG.object_interest_classes)
    return hits.groupBy("source", "class_name").agg(F.count("*").alias("n"))


@query("P8_advanced_labels", with_views("advanced_labels") + """
  SELECT event_id, array_to_string(list_sort(hit_labels), '|') AS labels FROM advanced_labels""")
def advanced_labels(spark, sf):
    hits = B.advanced_hits(B.events(spark, sf))
    return hits.select("event_id", F.array_join(R.advanced_labels(), "|").alias("labels"))


@query("P9_candidate_reasons", with_views("scored") + """
  SELECT source, round("start", 4) AS "start", array_to_string(reasons, '|') AS reasons FROM scored""")
def candidate_reasons(spark, sf):
    return B.candidates(spark, sf).select("source", r4("start"), flat("reasons"))


FILE = with_views("assets", "technical", "levels", "spikes", "scenes", "silences", "transcript_hits", "object_hits", "interesting", "advanced_labels") + f"""
, f_scene AS (SELECT source, count(*) AS scenes FROM scenes GROUP BY source)
, f_spike AS (SELECT source, count(*) AS spikes FROM spikes GROUP BY source)
, f_level AS (SELECT source, max(rms_db) AS peak FROM levels GROUP BY source)
, f_silence AS (SELECT source, count(*) AS silences, sum(greatest(0, "end" - "start")) AS silent FROM silences GROUP BY source)
, f_transcript AS (SELECT source, count(*) AS transcripts FROM transcript_hits GROUP BY source)
, f_object AS (SELECT source, count(*) AS objects, count(DISTINCT class_name) AS object_classes,
     list_sort(list_distinct(list(class_name))) AS names FROM object_hits GROUP BY source)
, f_interest AS (SELECT source, count(DISTINCT class_name) AS classes, sum(greatest(1, cnt)) AS detections FROM interesting GROUP BY source)
, f_advanced AS (SELECT source, {ADVANCED}, list_sort(list_distinct(list(main_label))) AS main_labels FROM advanced_labels GROUP BY source)
, f_all AS (
  SELECT a.source, technical_score, coalesce(scenes, 0) AS scenes, coalesce(spikes, 0) AS spikes, peak, coalesce(silences, 0) AS silences,
    coalesce(silent, 0) AS silent, coalesce(transcripts, 0) AS transcripts, coalesce(objects, 0) AS objects, coalesce(names, []) AS names,
    coalesce(object_classes, 0) AS object_class_count,
    CASE WHEN coalesce(detections, 0) = 0 THEN 0 ELSE least(10.0::DOUBLE, classes * 3.0 + least(7.0::DOUBLE, detections / 8.0::DOUBLE)) END AS object_presence_score,
    coalesce(main_labels, []) AS main_labels,
    coalesce(scenes, 0) / greatest(duration / 60.0::DOUBLE, 0.1) AS density,
    greatest(0.0, 1.0 - least(1.0, coalesce(silent, 0) / duration)) AS quiet_free, has_audio,
    coalesce(ocr_signage_score, 0) AS ocr_signage_score, coalesce(face_person_score, 0) AS face_person_score,
    coalesce(motorsports_event_score, 0) AS motorsports_event_score, coalesce(topic_cluster_score, 0) AS topic_cluster_score,
    coalesce(ai_frame_score, 0) AS ai_frame_score
  FROM assets a JOIN technical USING (source) LEFT JOIN f_scene USING (source) LEFT JOIN f_spike USING (source) LEFT JOIN f_level USING (source)
  LEFT JOIN f_silence USING (source) LEFT JOIN f_transcript USING (source) LEFT JOIN f_object USING (source)
  LEFT JOIN f_interest USING (source) LEFT JOIN (SELECT *, {ADVANCED_SCORES} FROM f_advanced) USING (source))
, f_scores AS (
  SELECT *, least(25.0, density * 5.0) AS visual, CASE WHEN has_audio THEN least(35.0, quiet_free * 15.0 + least(20.0, spikes * 4.0)) ELSE 0 END AS audio,
    least(20.0, transcripts * 8.0) AS transcript FROM f_all)
"""


@query("A1_score_sources", FILE + """
  SELECT source, technical_score, round(visual, 4) AS visual, round(audio, 4) AS audio, transcript, round(object_presence_score, 4) AS object_presence_score,
    spikes, round(peak, 4) AS peak, objects, object_class_count, round(quiet_free, 5) AS quiet_free,
    round(least(100.0, technical_score + visual + audio + transcript + object_presence_score + ocr_signage_score + face_person_score
      + motorsports_event_score + topic_cluster_score + ai_frame_score), 4) AS total
  FROM f_scores""")
def score_sources(spark, sf):
    rows = R.score_sources(B.signals(spark, sf), CFG)
    return rows.select(
        "source", "technical_score", r4("visual_activity_score", "visual"), r4("audio_interest_score", "audio"),
        F.col("transcript_score").alias("transcript"), r4("object_presence_score"), F.col("audio_spikes").alias("spikes"),
        r4("peak_rms_db", "peak"), F.col("object_hits").alias("objects"),
        F.size("object_classes").alias("object_class_count"), F.round("non_silent_ratio", 5).alias("quiet_free"), r4("total_score", "total"),
    )


@query("P9_file_reasons", FILE + """
  SELECT source, array_to_string(CASE WHEN len(r) = 0 THEN ['no strong highlight signals detected'] ELSE r END, '|') AS reasons
  FROM (SELECT source, list_filter([
    CASE WHEN scenes > 0 THEN scenes || ' scene changes detected' END, CASE WHEN silences > 0 THEN silences || ' silence intervals detected' END,
    CASE WHEN spikes > 0 THEN spikes || ' audio spikes detected' END, CASE WHEN transcripts > 0 THEN transcripts || ' transcript highlight hits' END,
    CASE WHEN len(names) > 0 THEN 'object detections: ' || array_to_string(names, ', ') END,
    CASE WHEN len(main_labels) > 0 THEN 'advanced signal artifacts: ' || array_to_string(main_labels, ', ') END], lambda x: x IS NOT NULL) AS r FROM f_all)""")
def file_reasons(spark, sf):
    return R.score_sources(B.signals(spark, sf), CFG).select("source", flat("reasons"))


@query("P9_file_reasons_short_report", ORACLE["P9_file_reasons"].replace("(names, ", "(names[1:6], ").replace("(main_labels, ", "(main_labels[1:6], "))
def file_reasons_short(spark, sf):
    return R.score_sources(B.signals(spark, sf), SHORT).select("source", flat("reasons"))


@query("A2_audio_spikes", with_views("spikes") + "SELECT source, round(time, 4) AS time, round(rms_db, 4) AS rms_db FROM spikes")
def audio_spikes(spark, sf):
    spikes = R.audio_spikes(B.levels(B.events(spark, sf)), CFG.audio_spike_percentile, CFG.audio_spike_floor_db)
    return spikes.select("source", r4("time"), r4("rms_db"))


@query("A4_advanced_scores", with_views("advanced_labels") + f"""
  SELECT source, ocr_hits, face_person_hits, motorsports_events, topic_hits, ai_frame_scores, ocr_signage_score, face_person_score,
    round(motorsports_event_score, 4) AS motorsports_event_score, topic_cluster_score, round(ai_frame_score, 4) AS ai_frame_score
  FROM (SELECT *, {ADVANCED_SCORES} FROM (SELECT source, {ADVANCED} FROM advanced_labels GROUP BY source))""")
def advanced_scores(spark, sf):
    rows = R.advanced_scores(B.advanced_hits(B.events(spark, sf)), CFG, ["source"])
    return rows.select(
        "source", *R.COUNT_NAMES, "ocr_signage_score", "face_person_score", r4("motorsports_event_score"),
        "topic_cluster_score", r4("ai_frame_score"),
    )


@query("U1_seed_windows", with_views("seeds") + """
  SELECT source, array_to_string(list_sort(labels), '|') AS labels, count(*) AS n, round(sum("start"), 3) AS starts, round(sum("end"), 3) AS ends
  FROM seeds GROUP BY ALL""")
def seed_windows(spark, sf):
    seeds = R.seed_windows(B.signals(spark, sf), CFG).withColumn("labels", F.array_join(F.array_sort("labels"), "|"))
    return seeds.groupBy("source", "labels").agg(
        F.count("*").alias("n"), F.round(F.sum("start"), 3).alias("starts"), F.round(F.sum("end"), 3).alias("ends")
    )


OBJECT_ONLY = with_views("assets", "interesting") + """
, only_seeds AS (SELECT DISTINCT source FROM interesting WHERE class_name = 'truck')
SELECT source, CAST(0.0 AS DOUBLE) AS "start", least(duration, 12.0) AS "end", 'low_signal' AS labels FROM assets
WHERE source NOT IN (SELECT source FROM only_seeds)"""


@query("U2_fallback_windows", OBJECT_ONLY)
def fallback_windows(spark, sf):
    """Trucks are the only seeds here, so some sources have none."""
    hits = R.interesting_objects(B.object_hits(B.events(spark, sf)), ["truck"])
    return R.fallback_windows(B.assets(spark, sf), hits).select("source", "start", "end", flat("labels"))


@query("U3_label_algebra", with_views("cands") + """
  SELECT id, array_to_string(list_sort(list_distinct(labels || ['audio_spike', 'broll'])), '|') AS united,
    array_to_string(list_sort(list_intersect(labels, ['audio_spike', 'scene_change'])), '|') AS shared,
    array_to_string(list_sort(list_filter(labels, lambda x: x NOT IN ('audio_spike', 'scene_change'))), '|') AS rest,
    list_has_any(labels, ['scene_cluster', 'topic_cluster']) AS touches FROM cands""")
def label_algebra(spark, sf):
    pair = S.string_array(["audio_spike", "scene_change"])
    join = lambda a: F.array_join(F.array_sort(a), "|")
    return B.candidates(spark, sf).select(
        "id", join(S.sorted_union("labels", S.string_array(["audio_spike", "broll"]))).alias("united"),
        join(F.array_intersect("labels", pair)).alias("shared"), join(F.array_except("labels", pair)).alias("rest"),
        F.arrays_overlap("labels", S.string_array(["scene_cluster", "topic_cluster"])).alias("touches"),
    )


@query("W1_merge_windows", with_views("merged") + """
  SELECT source, round("start", 4) AS "start", round("end", 4) AS "end", array_to_string(labels, '|') AS labels FROM merged WHERE "end" - "start" >= 1.0""")
def merge_windows(spark, sf):
    s = B.signals(spark, sf)
    windows = R.candidate_windows(s.assets, R.seed_windows(s, CFG), CFG.merge_gap)
    return windows.select("source", r4("start"), r4("end"), flat("labels"))


def _windows(spark, sf):
    return B.candidates(spark, sf).select("source", "start", "end")


@query("J2_points_in_window", with_views("windows", "levels") + """
  SELECT source, round("start", 4) AS "start", count(*) AS n, round(max(rms_db), 4) AS peak
  FROM windows JOIN levels l USING (source) WHERE l.time BETWEEN "start" AND "end" GROUP BY source, "start" """)
def points_in_window(spark, sf):
    pairs = I.points_in_windows(_windows(spark, sf), B.levels(B.events(spark, sf)), ["source"])
    return pairs.groupBy("source", "start").agg(F.count("*").alias("n"), rounded4(F.max("rms_db")).alias("peak")).withColumn("start", rounded4("start"))


def _h(df):
    return df.withColumnsRenamed({"start": "h_start", "end": "h_end"})


@query("J3_overlap_join", with_views("windows", "object_hits") + """
  SELECT source, round("start", 4) AS "start", event_id, class_name FROM windows JOIN object_hits USING (source)
  WHERE least("end", h_end) > greatest("start", h_start)""")
def overlap_join(spark, sf):
    hits = _h(B.object_hits(B.events(spark, sf)))
    return I.overlapping_hits(_windows(spark, sf), hits, ["source"]).select("source", r4("start"), "event_id", "class_name")


@query("J4_transcript_in_window", with_views("windows", "transcript_hits") + """
  SELECT source, round("start", 4) AS "start", event_id FROM windows JOIN transcript_hits USING (source)
  WHERE h_start BETWEEN "start" AND "end" OR h_end BETWEEN "start" AND "end" """)
def transcript_in_window(spark, sf):
    hits = _h(B.transcript_hits(B.events(spark, sf)))
    return I.endpoint_hits(_windows(spark, sf), hits, ["source"]).select("source", r4("start"), "event_id")


@query("J5_silence_overlap", with_views("windows", "w_silence") + """
  SELECT source, round("start", 4) AS "start", round(coalesce(silence_overlap, 0), 4) AS silence_overlap,
    round(coalesce(silence_overlap, 0) / greatest(0.1, "end" - "start"), 4) AS silence_ratio
  FROM windows LEFT JOIN w_silence USING (source, "start")""")
def silence_overlap(spark, sf):
    windows = _windows(spark, sf)
    shared = I.overlapping_hits(windows, _h(B.silences(B.events(spark, sf))), ["source"]).groupBy("source", "start", "end").agg(
        F.sum(S.overlap_seconds("start", "end", "h_start", "h_end")).alias("silence_overlap")
    )
    rows = windows.join(shared, ["source", "start", "end"], "left").fillna(0.0, ["silence_overlap"])
    return rows.withColumn("silence_ratio", R.silence_ratio()).select("source", r4("start"), r4("silence_overlap"), r4("silence_ratio"))


@query("J6_advanced_in_window", with_views("windows", "advanced_hits") + """
  SELECT source, round("start", 4) AS "start", kind, count(*) AS n FROM windows JOIN advanced_hits USING (source)
  WHERE wide OR least("end", h_end) > greatest("start", h_start) GROUP BY source, "start", kind""")
def advanced_in_window(spark, sf):
    counts = R.advanced_in_windows(_windows(spark, sf), B.advanced_hits(B.events(spark, sf)))
    return counts.select("source", r4("start"), "kind", "n")


SCORED = """
  SELECT source, round("start", 4) AS "start", round("end", 4) AS "end", score, action, array_to_string(labels, '|') AS labels,
    array_to_string(reasons, '|') AS reasons, technical_score, visual_activity_score, audio_interest_score, transcript_score,
    round(object_presence_score, 4) AS object_presence_score, round(motorsports_event_score, 4) AS motorsports_event_score,
    round(ai_frame_score, 4) AS ai_frame_score, scene_changes, round(peak, 4) AS peak, round(silence_ratio, 4) AS silence_ratio, object_hits"""


def _scored(rows, *more):
    return rows.select(
        *more, "source", r4("start"), r4("end"), "score", "action", flat("labels"), flat("reasons"), "technical_score",
        "visual_activity_score", "audio_interest_score", "transcript_score", r4("object_presence_score"),
        r4("motorsports_event_score"), r4("ai_frame_score"), "scene_changes", r4("peak"), r4("silence_ratio"), "object_hits",
    )


@query("A3_score_windows", with_views("scored") + SCORED + " FROM scored")
def score_windows(spark, sf):
    return _scored(R.generate_candidates(B.signals(spark, sf), CFG))


@query("W4_rank_candidates", with_views("cands") + 'SELECT "rank", id, source, round("start", 4) AS "start", score, action FROM cands WHERE "rank" <= 50')
def rank_candidates(spark, sf):
    scored = B.candidates(spark, sf).drop("rank", "id")
    return R.rank_candidates(scored, SHORT.max_candidates).select("rank", "id", "source", r4("start"), "score", "action")


@query("W4_rank_all", with_views("cands") + 'SELECT "rank", id, source, round("start", 4) AS "start", score, action FROM cands')
def rank_all(spark, sf):
    return B.candidates(spark, sf).select("rank", "id", "source", r4("start"), "score", "action")


@query("C6_rate", with_views("cands") + SCORED.replace("SELECT", 'SELECT "rank", id,') + " FROM cands")
def rate(spark, sf):
    rows = flows.rate(B.signals(spark, sf), CFG)
    return _scored(rows, "rank", "id")


@query("C6_rate_short_report", with_views("cands_short") + SCORED.replace("SELECT", 'SELECT "rank", id,') + " FROM cands_short")
def rate_short(spark, sf):
    rows = flows.rate(B.signals(spark, sf), SHORT)
    return _scored(rows, "rank", "id")


@query("A3_score_windows_short_report", with_views("scored_short") + SCORED + " FROM scored_short")
def score_windows_short(spark, sf):
    return _scored(R.generate_candidates(B.signals(spark, sf), SHORT))



@query("A5_rating_summary", with_views("cands", "assets") + """
  SELECT (SELECT count(*) FROM assets) AS files, (SELECT sum(duration) FROM assets) AS total_duration, count(*) AS candidates,
    count(*) FILTER (action = 'select') AS "select", count(*) FILTER (action = 'review') AS review,
    count(*) FILTER (action = 'broll') AS broll, count(*) FILTER (action = 'cut') AS cut
  FROM cands""")
def rating_summary(spark, sf):
    s = B.signals(spark, sf)
    return R.rating_summary(flows.rate(s, CFG), s.assets)
