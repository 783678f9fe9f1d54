"""Review, sequencing and timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.evaluation import evaluation
from checks.registry import flat, query, r4
from checks.views import view, with_views
from clipsieve.config import ScoringConfig
from clipsieve.functions import scalars as S
from clipsieve.operators import rating as R, review as V, timeline as T
from clipsieve.plans import bridge as B
from clipsieve.session import cut_lineage
from clipsieve.sinks import tables as K

CFG = ScoringConfig()
HMS = "printf('%02d:%02d:%02d', CAST(floor({0}) AS BIGINT) // 3600, CAST(floor({0}) AS BIGINT) % 3600 // 60, CAST(floor({0}) AS BIGINT) % 60)"


def hms(x: str) -> str:
    return HMS.format(x)


@query("P5_filter_by_label", with_views("cands") + "SELECT id, 'audio_spike' AS label FROM cands WHERE list_contains(labels, 'audio_spike') UNION ALL SELECT id, 'transcript_hit' FROM cands WHERE list_contains(labels, 'transcript_hit')")
def filter_by_label(spark, sf):
    cand = B.candidates(spark, sf)
    pick = lambda label: V.filter_by_label(cand, label).select("id", F.lit(label).alias("label"))
    return pick("audio_spike").unionByName(pick("transcript_hit"))


view("approved", "cands decisions", f"""
  SELECT c."rank", c.source, {hms('c."start"')} AS "start", {hms('c."end"')} AS "end", c.id AS label, score, action AS original_action,
    d.decision AS review_decision, d."order" AS review_order, d.note AS review_note, coalesce(d."order", 999999) AS sort_order
  FROM cands c LEFT JOIN decisions d USING (id)
  WHERE CASE WHEN d.decision = 'approve' THEN true WHEN d.decision IN ('reject', 'ignore') THEN false ELSE action IN ('select', 'review') END""")


@query("P6_approve", with_views("approved") + 'SELECT label, source, "start", "end", score, original_action, review_decision, review_order, review_note FROM approved')
def approve(spark, sf):
    rows = V.approve(B.candidates(spark, sf), B.decisions(spark, sf))
    return rows.select("label", "source", "start", "end", "score", "original_action", "review_decision", "review_order", "review_note")


@query("P6_approve_by_score", with_views("cands") + "SELECT id AS label, score FROM cands WHERE action IN ('select', 'review', 'broll') AND score >= 60")
def approve_by_score(spark, sf):
    rows = V.approve(B.candidates(spark, sf), actions=["select", "review", "broll"], min_score=60)
    return rows.select("label", "score")


@query("P11_default_decision", with_views("cands") + """
  SELECT id, CASE WHEN action IN ('select', 'review') THEN 'approve' WHEN action = 'broll' THEN 'broll' ELSE 'reject' END AS decision FROM cands""")
def default_decision(spark, sf):
    return B.candidates(spark, sf).select("id", V.default_decision().alias("decision"))


@query("P10_annotation_rating", with_views("decisions") + """
  SELECT id, CASE decision WHEN 'approve' THEN 'select' ELSE decision END AS rating FROM decisions""")
def annotation_rating(spark, sf):
    return B.decisions(spark, sf).select("id", V.annotation_rating("decision", F.lit(None).cast("string")).alias("rating"))


@query("J16_decision_join", with_views("cands", "decisions") + """
  SELECT d.id, coalesce(source, '') AS source, CASE d.decision WHEN 'approve' THEN 'select' ELSE d.decision END AS rating,
    coalesce(array_to_string(labels, '|'), '') AS tags, score, action AS original_action,
    CASE WHEN source IS NULL THEN 'missing source' END AS error
  FROM decisions d LEFT JOIN cands c USING (id)""")
def decision_join(spark, sf):
    rows = V.decision_join(B.candidates(spark, sf), B.decisions(spark, sf))
    return rows.select("id", F.coalesce("source", F.lit("")).alias("source"), "rating", flat("tags"), "score", "original_action", "error")


@query("W5_merge_decisions", with_views("cands", "decisions") + """
  SELECT id, CASE WHEN d.decision IS NOT NULL THEN d.decision WHEN action IN ('select', 'review') THEN 'approve' WHEN action = 'broll' THEN 'broll' ELSE 'reject' END AS decision,
    coalesce(note, '') AS note,
    coalesce(d."order", (SELECT max("order") FROM decisions JOIN cands USING (id)) + row_number() OVER (PARTITION BY d.id IS NULL ORDER BY c."rank")) AS "order"
  FROM cands c LEFT JOIN decisions d USING (id)""")
def merge_decisions(spark, sf):
    rows = V.merge_decisions(B.candidates(spark, sf).select("rank", "id", "action"), B.decisions(spark, sf))
    return rows.select("id", "decision", "note", "order")


def _judged(spark, sf):
    e = evaluation(spark, sf)
    return V.calibration_status(e.matches, e.false_positives)


def _review(spark, sf, calibration=None):
    ev = B.events(spark, sf)
    assets = B.assets(spark, sf).select(
        F.col("filepath").alias("source"), F.concat_ws("x", "width", "height").alias("resolution"), "fps", "codec",
        S.hhmmss("duration").alias("duration_formatted"), R.technical_points(20.0).alias("file_technical"))
    hits = B.object_hits(ev).withColumnsRenamed({"start": "h_start", "end": "h_end", "event_id": "hit_order"})
    advanced = B.advanced_hits(ev).withColumnsRenamed({"start": "h_start", "end": "h_end", "event_id": "hit_order"})
    return V.review_rows(B.candidates(spark, sf), assets, hits, advanced, calibration, max_items=None)


# The window table, ranked, with the hits of each clip in event order.
view("clip_objects", "cands object_hits", """
  SELECT c."rank", class_name, cnt, row_number() OVER (PARTITION BY c."rank" ORDER BY event_id) AS n
  FROM cands c JOIN object_hits h ON c.source = h.source AND least(c."end", h_end) > greatest(c."start", h_start)""")
view("clip_advanced", "cands advanced_labels", """
  SELECT c."rank", kind, model_label, row_number() OVER (PARTITION BY c."rank" ORDER BY event_id) AS n
  FROM cands c JOIN advanced_labels h ON c.source = h.source AND (wide OR least(c."end", h_end) > greatest(c."start", h_start))""")
view("status", "matches fps", """
  SELECT cand_rank AS "rank", 'matched' AS status FROM matches UNION ALL SELECT "rank", 'false_positive' FROM fps""")


@query("J14_review_rows", with_views("cands", "assets", "technical", "clip_objects", "clip_advanced", "status", recursive=True) + """
  SELECT c.id, width || 'x' || height AS resolution, fps, technical.technical_score AS file_technical,
    (SELECT count(*) FROM clip_objects o WHERE o."rank" = c."rank" AND n <= 20) AS listed_objects,
    (SELECT count(*) FROM clip_advanced o WHERE o."rank" = c."rank" AND n <= 20) AS listed_advanced,
    (SELECT count(*) FROM clip_objects o WHERE o."rank" = c."rank") AS object_count,
    (SELECT count(*) FROM clip_advanced o WHERE o."rank" = c."rank") AS advanced_count, coalesce(status.status, 'unreviewed') AS calibration_status
  FROM cands c JOIN assets USING (source) JOIN technical USING (source) LEFT JOIN status USING ("rank")""")
def review_rows(spark, sf):
    rows = _review(spark, sf, _judged(spark, sf))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.select(
        "id", "resolution", "fps", "file_technical", F.greatest(F.lit(0), n("object_hit_rows")).alias("listed_objects"),
        F.greatest(F.lit(0), n("advanced_hit_rows")).alias("listed_advanced"), F.coalesce("object_hit_count", F.lit(0)).alias("object_count"),
        F.coalesce("advanced_hit_count", F.lit(0)).alias("advanced_count"), "calibration_status")


LISTED_SUMMARIES = with_views("cands", "clip_objects", "clip_advanced") + """
, o AS (SELECT "rank", string_agg(class_name || ' x' || total, ', ' ORDER BY class_name) AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY "rank" ORDER BY class_name) AS k FROM (
      SELECT "rank", class_name, sum(greatest(1, cnt)) AS total FROM clip_objects WHERE n <= 20 GROUP BY "rank", class_name)) WHERE k <= 6 GROUP BY "rank")
, a AS (SELECT "rank", string_agg(kind || ' x' || total, ', ' ORDER BY kind) AS text FROM (
    SELECT "rank", kind, count(*) AS total FROM clip_advanced WHERE n <= 20 GROUP BY ALL) GROUP BY "rank")
, l AS (SELECT "rank", array_to_string(list_sort(list_distinct(list(model_label)))[1:6], ', ') AS text FROM clip_advanced WHERE n <= 20 AND kind = 'ai_frame_score' GROUP BY "rank")
  SELECT id, coalesce('Objects: ' || o.text, '') AS object_summary, coalesce('Advanced: ' || a.text || coalesce('; AI labels: ' || l.text, ''), '') AS advanced_summary,
    'Calibration: unreviewed' AS calibration_line
  FROM cands LEFT JOIN o USING ("rank") LEFT JOIN a USING ("rank") LEFT JOIN l USING ("rank")"""


@query("A16_hit_summaries", LISTED_SUMMARIES.replace("WHERE n <= 20 AND", "WHERE").replace("WHERE n <= 20 GROUP", "GROUP").replace("WHERE k <= 6 ", "").replace("[1:6]", ""))
def hit_summaries(spark, sf):
    return V.hit_summaries(_review(spark, sf)).select("id", "object_summary", "advanced_summary", "calibration_line")


@query("A16_listed_hit_summaries", LISTED_SUMMARIES)
def listed_hit_summaries(spark, sf):
    return V.hit_summaries(_review(spark, sf), of_listed=True, shown=6).select("id", "object_summary", "advanced_summary", "calibration_line")


@query("P7_filter_review", with_views("cands", "decisions") + """
  SELECT id, source AS source_name, "order", score FROM (
    SELECT c.id, source, score, coalesce(d."order", "rank") AS "order",
      coalesce(d.decision, CASE WHEN action IN ('select', 'review') THEN 'approve' WHEN action = 'broll' THEN 'broll' ELSE 'reject' END) AS decision,
      action, labels, reasons FROM cands c LEFT JOIN decisions d USING (id))
  WHERE contains(lower(concat_ws(' ', id, source, decision, 'unreviewed', array_to_string(labels, ' '), array_to_string(reasons, ' '))), 'audio peak')
    AND list_contains(labels, 'object_car') AND decision = 'reject' AND contains(source, '1')""")
def filter_review(spark, sf):
    cand = B.candidates(spark, sf)
    d = V.latest_decisions(B.decisions(spark, sf)).select("id", F.col("decision").alias("d"), F.col("order").alias("o"))
    clips = cand.join(d, "id", "left").withColumns({
        "decision": F.coalesce("d", V.default_decision()), "order": F.coalesce("o", "rank"), "source_name": S.basename("source"),
        "calibration_status": F.lit("unreviewed")})
    return V.filter_review(clips, query="Audio Peak", label="object_car", decision="reject", source="1").select("id", "source_name", "order", "score")


# -- selections and plans: one selection per source, from the approved clips -----------------

def selection_clips(spark, sf, selection=F.col):
    """One selection per source, or per ``selection("source")``."""
    rows = V.approve(B.candidates(spark, sf), B.decisions(spark, sf), actions=["select", "review", "broll"])
    whole = S.seconds_of("end") > S.seconds_of("start")
    nth = F.row_number().over(R.Window.partitionBy("selection").orderBy("sort_order", "rank"))
    none = F.lit(None).cast("double")
    return rows.where(whole).withColumn("selection", selection("source")).select(
        "selection", "source", nth.cast("int").alias("clip_index"), "label", "start", "end",
        none.alias("start_seconds"), none.alias("end_seconds"), "score", "review_order", "labels", "reasons")


PICKED = """
  SELECT {sel} AS selection, source, row_number() OVER (PARTITION BY {sel} ORDER BY coalesce(d."order", 999999), c."rank") AS clip_index, c.id AS label,
    floor("start") AS s, floor("end") AS e, score, coalesce(nullif(d."order", 0), row_number() OVER (PARTITION BY {sel} ORDER BY coalesce(d."order", 999999), c."rank")) AS review_order
  FROM cands c LEFT JOIN decisions d USING (id)
  WHERE CASE WHEN d.decision = 'approve' THEN true WHEN d.decision IN ('reject', 'ignore') THEN false ELSE action IN ('select', 'review', 'broll') END"""
view("picked", "cands decisions", PICKED.format(sel="source"))
view("picked_mixed", "cands decisions", PICKED.format(sel="regexp_extract(source, '([0-9]).mp4', 1)"))
PLANNED = """
  SELECT selection, source, clip_index AS source_order, label, greatest(0, s - 1.5) AS start_seconds, e + 1.5 AS end_seconds, e + 1.5 - greatest(0, s - 1.5) AS duration,
    score, review_order FROM {table}"""
view("planned", "picked", PLANNED.format(table="picked"))
view("mixed", "picked_mixed", PLANNED.format(table="picked_mixed"))
ORDERS = {
    "review_order": "review_order, score DESC, source_order",
    "score": "score DESC, review_order, source_order",
    "source_order": "source, start_seconds, source_order",
    "diversified": "round, source",
}


def _sequence_sql():
    parts = [f"""SELECT '{mode}' AS mode, selection, label, row_number() OVER (PARTITION BY selection ORDER BY {order}) AS pos
      FROM (SELECT *, row_number() OVER (PARTITION BY selection, source ORDER BY {ORDERS['score']}) AS round FROM mixed)""" for mode, order in ORDERS.items()]
    return with_views("mixed") + " UNION ALL ".join(parts)


@query("W6_sequence_clips", _sequence_sql())
def sequence_clips(spark, sf):
    """Selections of several sources: one per last digit of the source's number."""
    rows = T.planned_clips(selection_clips(spark, sf, lambda c: F.regexp_extract(c, r"([0-9])\.mp4", 1)), 1.5)
    rows = cut_lineage(rows.drop("labels", "reasons"))
    out = None
    for mode in ORDERS:
        part = T.sequence_clips(rows, mode).select(F.lit(mode).alias("mode"), "selection", "label", "pos")
        out = part if out is None else out.unionByName(part)
    return out


view("ordered", "planned", f"SELECT *, row_number() OVER (PARTITION BY selection ORDER BY {ORDERS['score']}) AS pos FROM planned")


@query("W7_timeline", with_views("ordered") + """
  SELECT selection, pos, label, round(record_in, 4) AS record_in, round(record_in + duration, 4) AS record_out, in_frame, out_frame, record_in_frame FROM (
    SELECT *, coalesce(sum(duration) OVER w, 0) AS record_in, CAST(floor(start_seconds * 24) AS BIGINT) AS in_frame, CAST(floor(end_seconds * 24) AS BIGINT) AS out_frame,
      CAST(coalesce(sum(floor(end_seconds * 24) - floor(start_seconds * 24)) OVER w, 0) AS BIGINT) AS record_in_frame
    FROM ordered WINDOW w AS (PARTITION BY selection ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def timeline(spark, sf):
    rows = T.timeline(T.sequence_clips(T.planned_clips(selection_clips(spark, sf), 1.5), "score"), 24.0)
    return rows.select("selection", "pos", "label", r4("record_in"), r4("record_out"), "in_frame", "out_frame", "record_in_frame")


def _tc(x: str, fps: str) -> str:
    return (f"printf('%02d:%02d:%02d:%02d', CAST(floor({x}) AS BIGINT) // 3600, CAST(floor({x}) AS BIGINT) % 3600 // 60, CAST(floor({x}) AS BIGINT) % 60, "
            f"CAST(round_even(({x} - floor({x})) * {fps}, 0) AS BIGINT) % {fps})")


@query("K7_timeline_table", with_views("ordered") + f"""
  SELECT selection, pos, label, source, {_tc("start_seconds", "24")} AS source_in, {_tc("end_seconds", "24")} AS source_out,
    {_tc("record_in", "24")} AS record_in_tc, {_tc("record_in + duration", "24")} AS record_out_tc
  FROM (SELECT *, coalesce(sum(duration) OVER (PARTITION BY selection ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS record_in FROM ordered)""")
def timeline_table(spark, sf):
    clips = T.planned_clips(selection_clips(spark, sf), 1.5).drop("labels", "reasons")
    rows = T.timeline_table(T.sequence_clips(clips, "score"), 24.0)
    return rows.select("selection", "pos", "label", "source", "source_in", "source_out", "record_in_tc", "record_out_tc")


FIT = with_views("ordered", recursive=True)[:-1] + """
, fit AS (
  SELECT selection, 0::BIGINT AS pos, 0.0::DOUBLE AS elapsed, 0 AS taken, false AS done, NULL::VARCHAR AS label, NULL::DOUBLE AS kept FROM (SELECT DISTINCT selection FROM ordered)
  UNION ALL
  SELECT selection, pos, elapsed + coalesce(kept, 0), taken + CASE WHEN kept IS NULL THEN 0 ELSE 1 END, done OR (kept IS NOT NULL AND trimmed AND taken > 0), label, kept FROM (
    SELECT f.selection, o.pos, f.elapsed, f.taken, f.done, o.label, o.duration > 45 - f.elapsed AND 45 - f.elapsed >= 1 AS trimmed,
      CASE WHEN f.done OR f.elapsed >= 45 THEN NULL
           WHEN o.duration <= 45 - f.elapsed THEN o.duration
           WHEN 45 - f.elapsed >= 1 THEN round(45 - f.elapsed, 3)
           WHEN f.taken = 0 THEN o.duration END::DOUBLE AS kept
    FROM fit f JOIN ordered o ON o.selection = f.selection AND o.pos = f.pos + 1))
"""


@query("W8_fit_target_duration", FIT + "SELECT selection, pos, label, round(kept, 4) AS duration FROM fit WHERE kept IS NOT NULL")
def fit_target_duration(spark, sf):
    rows = T.fit_target_duration(T.sequence_clips(T.planned_clips(selection_clips(spark, sf), 1.5), "score"), 45.0)
    return rows.select("selection", "pos", "label", r4("duration"))


@query("W9_plan_roughcut", FIT + f"""
  SELECT f.selection, f.pos, f.label, {hms("o.start_seconds")} AS "start", {hms("o.start_seconds + f.kept")} AS "end" FROM fit f JOIN ordered o USING (selection, pos) WHERE kept IS NOT NULL""")
def plan_roughcut(spark, sf):
    rows = T.plan_roughcut(selection_clips(spark, sf), "score", target_duration=45.0, handles=1.5, format_type="reel")
    return rows.select("selection", "pos", "label", "start", "end")


@query("A18_plan_summary", with_views("planned") + f"""
  SELECT selection, count(*) AS clips, round(sum(duration), 3) AS duration, count(DISTINCT source) AS sources, {hms("sum(duration)")} AS duration_formatted FROM planned GROUP BY selection""")
def plan_summary(spark, sf):
    return T.plan_summary(T.sequence_clips(T.planned_clips(selection_clips(spark, sf), 1.5), "review_order"))


# -- report tables -------------------------------------------------------------------------

@query("K3_candidates_csv", with_views("cands") + f"""
  SELECT id, source, {hms('"start"')} AS "start", {hms('"end"')} AS "end", score, action, array_to_string(labels, ', ') AS labels, array_to_string(reasons, ' | ') AS reasons FROM cands""")
def candidates_csv(spark, sf):
    return K.candidate_table(B.candidates(spark, sf)).drop("duration")


@query("K4_selection_sets", with_views("cands") + f"""
  SELECT source, count(*) AS clips, string_agg(id, '|' ORDER BY "start") AS ids FROM cands WHERE action IN ('select', 'review') GROUP BY source""")
def selection_sets(spark, sf):
    sets = K.selection_sets(B.candidates(spark, sf))
    return sets.select("source", F.size("clips").alias("clips"), F.array_join(F.transform("clips", lambda c: c["label"]), "|").alias("ids"))


@query("K5_missed_csv", with_views("missed", "cands", recursive=True) + f"""
  SELECT n.id, a.source, {hms('a."start"')} AS "start", {hms('a."end"')} AS "end", a.rating, a.tag AS tags, n.near_id AS nearest_candidate
  FROM (SELECT a.id, a.ann_index, c.id AS near_id FROM missed a LEFT JOIN cands c ON a.source = c.source
        QUALIFY row_number() OVER (PARTITION BY a.ann_index ORDER BY CASE WHEN least(a."end", c."end") > greatest(a."start", c."start") THEN 0
          WHEN a."end" <= c."start" THEN c."start" - a."end" ELSE a."start" - c."end" END, c.score DESC, c."rank") = 1) n JOIN missed a USING (ann_index)""")
def missed_csv(spark, sf):
    e = evaluation(spark, sf)
    return K.missed_table(e.missed).drop("notes", "nearest_gap_seconds")


@query("K5_false_positive_csv", with_views("fps", recursive=True) + f"""
  SELECT id, source, {hms('"start"')} AS "start", score, action, array_to_string(labels, ', ') AS labels, array_to_string(reasons, ' | ') AS reasons FROM fps""")
def false_positive_csv(spark, sf):
    e = evaluation(spark, sf)
    return K.false_positive_table(e.false_positives).select("id", "source", "start", "score", "action", "labels", "reasons")


REPORT = with_views("cands") + f"""
  SELECT "rank", id, score, action, source AS file, {hms('"start"')} || ' - ' || {hms('"end"')} AS time, array_to_string(reasons, '; ') AS why FROM cands"""


@query("K8_review_report", REPORT)
def review_report(spark, sf):
    return K.top_candidate_table(B.candidates(spark, sf))


@query("K8_top_of_report", REPORT + ' WHERE "rank" <= 50')
def top_of_report(spark, sf):
    return K.top_candidate_table(B.candidates(spark, sf), 50)
