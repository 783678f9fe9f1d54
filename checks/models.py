"""Frame scores, judgments, the learned scorer, content planning, scalar functions, presets and sinks."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

import checks.evaluation  # noqa: F401  (its views are used here)
from checks.registry import flat, query, r4
from checks.evaluation import SWEEP
from checks.review import hms
from checks.views import view, with_views
from clipsieve.config import ScoringConfig
from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators import ai as A, content as C, learning as L, rating as R, sweep as W
from clipsieve.plans import bridge as B, presets as P
from clipsieve.session import shared_dir
from clipsieve.sinks import tables as K
from clipsieve.sources import documents as D

CFG = ScoringConfig(max_candidates=50)

# -- frame scores -------------------------------------------------------------------------------

view("prompt_vectors", "", """
  SELECT label AS no, 'p' || label AS id, 'label_' || label % 4 AS label, list(m ORDER BY pos) AS pv FROM (
    SELECT label, pos, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label""")
view("prompt_scores", "frame_vectors prompt_vectors", """
  SELECT source, time, id, label, round_even(exp(logit - peak) / sum(exp(logit - peak)) OVER (PARTITION BY source, time), 4) AS score FROM (
    SELECT *, max(logit) OVER (PARTITION BY source, time) AS peak FROM (
      SELECT source, time, id, label, 100 * list_dot_product(vector::DOUBLE[], pv) / (sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_dot_product(pv, pv))) AS logit
      FROM frame_vectors, prompt_vectors))""")
view("scored_frames", "prompt_scores", """
  SELECT *, CASE WHEN len(over_labels) > 0 THEN over_labels ELSE [top_label] END AS labels FROM (
    SELECT source, time, max(score) AS top_score, list(label ORDER BY score DESC, id)[1] AS top_label, list_sort(list_distinct(list(label) FILTER (score >= 0.22))) AS over_labels,
      list({id: id, label: label, score: score} ORDER BY score DESC, id) AS ps
    FROM prompt_scores GROUP BY source, time)""")


def _scored(spark, sf):
    return A.score_frames(B.frame_vectors(spark, sf), B.prompt_vectors(spark, sf), profile="bank")


@query("L5_score_frames", with_views("scored_frames") + """
  SELECT source, time, top_score, top_label, array_to_string(labels, '|') AS labels, array_to_string(list_transform(ps, lambda p: p.id), '|') AS prompts FROM scored_frames""")
def score_frames(spark, sf):
    rows = _scored(spark, sf)
    return rows.select("source", "time", "top_score", "top_label", flat("labels"), F.array_join(F.transform("prompt_scores", lambda p: p["id"]), "|").alias("prompts"))


@query("L5_frame_summaries", with_views("scored_frames") + """
  SELECT source, count(*) AS frame_count, array_to_string(list_sort(list_distinct(flatten(list(labels)))), '|') AS labels, max(top_score) AS top_score FROM scored_frames GROUP BY source""")
def frame_summaries(spark, sf):
    return A.frame_summaries(_scored(spark, sf)).select("source", "frame_count", flat("labels"), "top_score")


@query("W10_sample_timestamps", with_views("assets") + """
  SELECT source, k AS frame_no, least(d / 2, 5) + k * 10 AS time FROM (SELECT source, user_id % 90 AS d FROM assets), range(8) r(k) WHERE d > 0 AND least(d / 2, 5) + k * 10 < d
  UNION ALL SELECT source, 0, 0 FROM assets WHERE user_id % 90 = 0""")
def sample_timestamps(spark, sf):
    number = F.regexp_extract("filepath", r"(\d+)", 1).cast("int")
    a = B.assets(spark, sf).withColumn("duration", F.pmod(number, F.lit(90)).cast("double"))
    return A.sample_timestamps(a)


def _framed(spark, sf):
    return _scored(spark, sf).withColumn("frame_id", F.concat("source", F.lit("@"), F.col("time").cast("long").cast("string")))


@lru_cache(maxsize=None)
def _moments(app_id, spark, sf):
    return A.missed_moments(_framed(spark, sf), B.candidates(spark, sf), min_score=0.2)


def _missed(spark, sf):
    """Ranking materialises the moments; both queries read them."""
    return _moments(spark.sparkContext.applicationId, spark, sf)


view("moment_frames", "scored_frames cands", """
  SELECT f.*, greatest(0, time - 2) AS s, time + 4 AS e FROM scored_frames f WHERE top_score >= 0.2
    AND NOT EXISTS (SELECT 1 FROM cands c WHERE c.action IN ('select', 'review', 'broll') AND c.source = f.source AND f.time BETWEEN c."start" AND c."end")""")
view("moment_near", "moment_frames cands", """
  SELECT source, time, id FROM (
    SELECT f.source, f.time, c.id, c.score, c."rank", CASE WHEN time BETWEEN c."start" AND c."end" THEN 0 ELSE least(abs(time - c."start"), abs(time - c."end")) END AS gap
    FROM moment_frames f JOIN cands c ON c.source = f.source) QUALIFY row_number() OVER (PARTITION BY source, time ORDER BY gap, score DESC, "rank") = 1""")
view("moments", "moment_frames moment_near", """
  SELECT source, min(s) AS "start", max(e) AS "end", max(top_score) AS confidence, count(*) AS frame_count, list_sort(list_distinct(flatten(list(labels)))) AS labels,
    list(near_id ORDER BY s, time) AS near_ids
  FROM (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY s, time ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT f.*, n.id AS near_id, CASE WHEN s <= max(e) OVER (PARTITION BY source ORDER BY s, time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS opens
    FROM moment_frames f LEFT JOIN moment_near n USING (source, time))) GROUP BY source, island""")
MOMENTS = with_views("moments") + """, r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, source, "start") AS "rank" FROM moments)
  SELECT format('missed_{:04d}', "rank") AS id, """


@query("W3_missed_moments", MOMENTS + """source, "start", "end", confidence, frame_count, array_to_string(labels, '|') AS labels,
    list_filter(near_ids, lambda x: x IS NOT NULL)[1] AS near_id FROM r""")
def missed_moments(spark, sf):
    return _missed(spark, sf).select("id", "source", "start", "end", "confidence", "frame_count", flat("labels"), F.col("existing_candidate.id").alias("near_id"))


@query("L6_missed_review", MOMENTS + """'review' AS decision, "rank" AS "order", source, confidence AS score FROM r""")
def missed_review(spark, sf):
    return A.missed_review(_missed(spark, sf)).select("id", "decision", "order", "source", "score")


# -- judgments ------------------------------------------------------------------------------------

def _responses(spark, sf):
    """Five kinds of answers in turn, one per candidate."""
    n = F.col("rank")
    answers = F.array(
        F.format_string('{"score_dimensions": {"hook": %d, "clarity!": 0.5, "note": "high"}, "suggested_action": " Select ", "labels": ["a", " ", "b"], "reason": "good", "score": 0.%d}', n % 100, n % 90 + 10),
        F.format_string('{"judgment": {"scores": {"x": 0.25, "y": "%d"}, "action": "cut", "explanation": "weak"}}', n % 50 + 2),
        F.lit('{"score_dimensions": {"x": "none"}, "suggested_action": "cut", "reason": "r"}'),
        F.lit('{"score_dimensions": {"x": 1}, "suggested_action": "maybe", "reason": "r"}'), F.lit("no json at all"))
    return B.candidates(spark, sf).select("id", F.element_at(answers, (F.pmod(n, F.lit(5)) + 1).cast("int")).alias("response"))


@query("P14_normalize_judgment", with_views("cands") + """
, k AS (SELECT id, "rank" AS n, "rank" % 5 AS kind FROM cands)
  SELECT id, CASE kind WHEN 0 THEN round_even((n % 90 + 10) / 100.0::DOUBLE * 100, 2) WHEN 1 THEN round_even((0.25 + (n % 50 + 2) / 100.0::DOUBLE) / 2 * 100, 2) END AS score,
    CASE kind WHEN 0 THEN CASE WHEN n % 100 > 1 THEN (n % 100) / 100.0::DOUBLE ELSE (n % 100)::DOUBLE END END AS hook,
    CASE kind WHEN 0 THEN 'select' WHEN 1 THEN 'cut' END AS action, CASE kind WHEN 0 THEN 'a|b' WHEN 1 THEN 'ai_clip_judge' END AS labels,
    CASE kind WHEN 2 THEN 'score_dimensions must contain numeric values' WHEN 3 THEN 'suggested_action must be one of broll, cut, ignore, reject, review, select'
      WHEN 4 THEN 'response must be a JSON object' END AS error FROM k""")
def normalize_judgment(spark, sf):
    rows = A.normalize_judgment(_responses(spark, sf))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select("id", good(F.col("score")).alias("score"), good(F.element_at("score_dimensions", "hook")).alias("hook"),
                       good(F.col("suggested_action")).alias("action"), good(F.array_join("labels", "|")).alias("labels"), "error")


def _requests(spark, sf):
    rows = B.candidates(spark, sf).withColumns({
        "source_name": S.basename("source"), "start_tc": S.hhmmss("start"), "end_tc": S.hhmmss("end"), "duration": S.interval_duration("start", "end")})
    return A.judge_requests(rows, "general-broll")


@query("P15_judge_requests", with_views("cands") + f"""
  SELECT id, {hms('"start"')} AS "start", score, array_to_string(labels, '|') AS labels, 4 AS prompts, 'general_broll' AS profile FROM cands""")
def judge_requests(spark, sf):
    get = lambda path: F.get_json_object("request", path)
    return _requests(spark, sf).select(
        "id", get("$.clip.start").alias("start"), get("$.clip.score").cast("int").alias("score"),
        F.array_join(F.from_json(get("$.clip.labels"), "array<string>"), "|").alias("labels"),
        F.size(F.from_json(get("$.profile.prompts"), "array<string>")).alias("prompts"), get("$.profile.id").alias("profile"))


@query("X2_judge_clips", with_views("cands") + """
  SELECT id, score::DOUBLE AS score, CASE WHEN score >= 55 THEN 'select' ELSE 'cut' END AS action, CAST(NULL AS VARCHAR) AS error FROM cands""")
def judge_clips(spark, sf):
    """A judge that answers with broken text first and is asked again."""
    def judge(request):
        judge.calls = getattr(judge, "calls", 0) + 1
        if judge.calls % 2:
            return "not json"
        score = request["clip"]["score"]
        return {"score_dimensions": {"overall": 0.5}, "score": max(score, 1.01) if score > 1 else score / 100, "suggested_action": "select" if score >= 55 else "cut", "reason": "by score"}

    return A.judge_clips(_requests(spark, sf), judge, retries=1).select("id", "score", F.col("suggested_action").alias("action"), "error")


@query("X1_encode_frames", with_views("frame_vectors") + """
  SELECT source, time, [length(source), CAST(time AS INT)]::FLOAT[] AS vector FROM frame_vectors""")
def encode_frames(spark, sf):
    frames = B.frame_vectors(spark, sf).select("source", "time", F.concat_ws("@", "source", F.col("time").cast("int").cast("string")).alias("frame"))

    def encode(paths):
        return [[float(len(p.split("@")[0])), float(p.split("@")[1])] for p in paths]

    return A.encode_frames(frames, encode)


# -- learning --------------------------------------------------------------------------------------

def _even2(x: str) -> str:
    """Two decimals, halves of the printed decimal to even."""
    d = f"(CAST(CAST(({x})::DOUBLE AS VARCHAR) AS DECIMAL(30, 16)) * 100)"
    return f"((floor({d}) + CASE WHEN {d} - floor({d}) > 0.5 OR ({d} - floor({d}) = 0.5 AND CAST(floor({d}) AS BIGINT) % 2 <> 0) THEN 1 ELSE 0 END)::DOUBLE / 100.0::DOUBLE)"


SIGNAL_COLUMNS = {
    **{n: _even2(n) for n in R.SCORE_NAMES}, "scene_changes": "scene_changes", "peak_rms_db": _even2("peak"),
    "silence_ratio": "round_even(silence_ratio, 3)", "object_hits": "object_hits", "object_class_count": "len(classes)", **{n: n for n in R.COUNT_NAMES},
}
view("features", "cands", f"""
  SELECT "rank", id, u.f.name AS feature, round_even(u.f.value, 6) AS value FROM (SELECT *, unnest(list_filter(
    [{{name: 'deterministic_score', value: score::DOUBLE}}, {{name: 'duration_seconds', value: "end" - "start"}}, {", ".join(f"{{name: '{n}', value: ({x})::DOUBLE}}" for n, x in SIGNAL_COLUMNS.items())}]
    || list_transform(labels, lambda l: {{name: 'label_' || l, value: 1.0::DOUBLE}}), lambda f: f.value IS NOT NULL)) AS f FROM cands) u""")


@query("L1_candidate_features", with_views("features") + """
  SELECT id, count(*) AS n, round(sum(value), 6) AS total, array_to_string(list(feature ORDER BY feature), '|') AS names FROM features GROUP BY id""")
def candidate_features(spark, sf):
    rows = L.candidate_features(B.candidates(spark, sf))
    total = F.aggregate(F.map_values("features"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("id", F.size("features").alias("n"), F.round(total, 6).alias("total"), F.array_join(F.array_sort(F.map_keys("features")), "|").alias("names"))


view("training", "cands decisions", """
  SELECT id, c."rank", CASE decision WHEN 'approve' THEN 1 ELSE 0 END AS target FROM decisions JOIN cands c USING (id) WHERE decision <> 'ignore'""")


def _dataset(spark, sf):
    return L.build_review_dataset(B.decisions(spark, sf), B.candidates(spark, sf))


@query("L2_build_review_dataset", with_views("training", "cands", "decisions") + """
  SELECT t.id, target, substring(sha1(source), 1, 16) AS source_id, source AS source_name, note FROM training t JOIN cands USING (id) JOIN decisions USING (id)""")
def build_review_dataset(spark, sf):
    return _dataset(spark, sf).select("clip.id", "label.target", "clip.source_id", "clip.source_name", "decision.note")


view("stats", "training features", """
  SELECT *, round_even((pm - nm) / greatest(1.0::DOUBLE, hi - lo), 6) AS weight FROM (
    SELECT feature, coalesce(sum(value) FILTER (target = 1), 0) / (SELECT count(*) FROM training WHERE target = 1) AS pm,
      coalesce(sum(value) FILTER (target = 0), 0) / (SELECT count(*) FROM training WHERE target = 0) AS nm,
      CASE WHEN count(*) < (SELECT count(*) FROM training) THEN least(min(value), 0) ELSE min(value) END AS lo,
      CASE WHEN count(*) < (SELECT count(*) FROM training) THEN greatest(max(value), 0) ELSE max(value) END AS hi
    FROM training JOIN features USING ("rank") GROUP BY feature)""")
view("threshold", "stats", "SELECT round_even((sum(weight * pm) + sum(weight * nm)) / 2, 6) AS threshold FROM stats")


@query("A17_train_scorer", with_views("stats", "threshold") + """
  SELECT feature, weight, round(lo, 4) AS lo, round(hi, 4) AS hi, round((SELECT threshold FROM threshold), 4) AS threshold FROM stats""")
def train_scorer(spark, sf):
    model = L.train_scorer(_dataset(spark, sf))
    one = model.summary.select(F.lit(1).alias("_one"), "threshold")
    rows = model.weights.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    return rows.select("feature", "weight", r4("min", "lo"), r4("max", "hi"), r4("threshold"))


view("raw_scores", "features stats", 'SELECT "rank", sum(value * weight) AS raw FROM features LEFT JOIN stats USING (feature) GROUP BY "rank"')


@query("A17_training_accuracy", with_views("training", "raw_scores", "threshold") + """
  SELECT count(*) AS records, round_even(count(*) FILTER ((raw >= threshold) = (target = 1)) / count(*)::DOUBLE, 4) AS accuracy FROM training JOIN raw_scores USING ("rank"), threshold""")
def training_accuracy(spark, sf):
    data = _dataset(spark, sf)
    return L.training_accuracy(data, L.train_scorer(data))


view("learned", "cands raw_scores threshold", """
  SELECT c.*, raw, round_even(100 / (1 + exp(-(raw - threshold))), 2) AS learned_score FROM cands c JOIN raw_scores USING ("rank"), threshold""")


@query("L3_score_with_model", with_views("learned") + """
  SELECT id, round(learned_score, 1) AS learned_score, CASE WHEN learned_score >= 50 THEN 'learned_positive' ELSE 'learned_negative' END AS verdict, len(labels) + 1 AS n_labels FROM learned""")
def score_with_model(spark, sf):
    rows = L.score_with_model(B.candidates(spark, sf), L.train_scorer(_dataset(spark, sf)))
    verdict = F.element_at(F.filter("labels", lambda x: F.startswith(x, F.lit("learned_"))), 1)
    return rows.select("id", F.round("learned_score", 1).alias("learned_score"), verdict.alias("verdict"), F.size("labels").alias("n_labels"))


@query("L4_apply_learned", with_views("learned") + """
, b AS (SELECT *, CAST(greatest(0, least(100, round_even((score + learned_score) / 2, 0))) AS INT) AS blended FROM learned)
  SELECT row_number() OVER (ORDER BY blended DESC, source, "start") AS "rank", source, round("start", 4) AS "start", blended AS score,
    CASE WHEN blended >= 85 THEN 'select' WHEN blended >= 70 THEN 'review' WHEN blended >= 55 THEN 'broll' ELSE 'cut' END AS action FROM b""")
def apply_learned(spark, sf):
    rows = L.apply_learned(B.candidates(spark, sf), L.train_scorer(_dataset(spark, sf)), B.FULL)
    return rows.select("rank", "source", r4("start"), "score", "action")


def _fresh(spark):
    """A new folder that the driver and all executors see."""
    return f"{shared_dir(spark)}/checks/{uuid.uuid4().hex}"


@query("S26_review_dataset_files", with_views("training", "features") + """
  SELECT t.id, target, count(*) AS features FROM training t JOIN features f USING ("rank") GROUP BY t.id, target""")
def review_dataset_files(spark, sf):
    path = _fresh(spark)
    D.write_review_dataset(_dataset(spark, sf), path)
    return D.read_review_dataset(spark, path).select("clip.id", "label.target", F.size("features").alias("features"))


# -- content -----------------------------------------------------------------------------------------

def _ranked_sql(preferred, n, table="cands"):
    shared = f"len(list_intersect(labels, {preferred}))" if preferred else "0"
    return f"""SELECT *, row_number() OVER (ORDER BY score + CASE WHEN {shared} > 0 THEN 20 ELSE 0 END DESC, {shared} DESC, id DESC) AS place FROM {table}
      QUALIFY place <= {n}"""


@query("C1_rank_for_labels", with_views("cands") + f"SELECT place AS \"rank\", id, score FROM ({_ranked_sql(['scene_cluster', 'audio_spike'], 100)})")
def rank_for_labels(spark, sf):
    return C.rank_for_labels(B.candidates(spark, sf), ["scene_cluster", "audio_spike"], 100).select("rank", "id", "score")


TEXT = """lower(concat_ws(' ', id, array_to_string(labels, ' '), array_to_string(reasons, ' '), '""" + " ".join(SIGNAL_COLUMNS) + "'))"


def _pillar_sql():
    parts = []
    for key, p in V.PILLARS.items():
        words = " OR ".join(f"contains(text, '{w}')" for w in p["keywords"])
        labels = f"list_has_any(labels, {p['labels']})" if p["labels"] else "false"
        parts.append(f"SELECT '{key}' AS pillar, id, score FROM t WHERE {labels} OR {words}")
    return with_views("cands") + f", t AS (SELECT *, {TEXT} AS text FROM cands), m AS ({' UNION ALL '.join(parts)})"


@query("C2_content_map", _pillar_sql() + """
  SELECT pillar, id, row_number() OVER (PARTITION BY pillar ORDER BY score DESC, id DESC) AS "rank" FROM m""")
def content_map(spark, sf):
    return C.content_map(B.candidates(spark, sf)).select("pillar", "id", "rank")


@query("C2_best_of_pillars", _pillar_sql() + """
  SELECT pillar, id, row_number() OVER (PARTITION BY pillar ORDER BY score DESC, id DESC) AS "rank" FROM m QUALIFY "rank" <= 10""")
def best_of_pillars(spark, sf):
    return C.content_map(B.candidates(spark, sf), 10).select("pillar", "id", "rank")


@query("C2_top_candidates", with_views("cands") + f"SELECT place AS \"rank\", id FROM ({_ranked_sql([], 20)})")
def top_candidates(spark, sf):
    return C.top_candidates(B.candidates(spark, sf), 20).select("rank", "id")


@query("F7_text_matches", _pillar_sql() + """
  SELECT id, contains(text, 'motorsports') AS motorsports, contains(text, 'zebra') AS zebra, contains(text, 'dog') AS dog FROM t""")
def text_matches(spark, sf):
    rows = B.candidates(spark, sf).withColumn("text", S.candidate_search_text())
    return rows.select("id", *[S.any_substring("text", [w]).alias(w) for w in ("motorsports", "zebra", "dog")])


HOOKS = V.SERIES_TEMPLATES["engine_build_montage"]


@query("C3_series_plan", with_views("cands") + f"""
  SELECT place AS "rank", id, ['{"', '".join(HOOKS["hooks"])}'][CAST((place - 1) % 3 AS INT) + 1] AS hook,
    ['{"', '".join(HOOKS["hooks"])}'][CAST((place - 1) % 3 AS INT) + 1] || ' {" ".join(HOOKS["hashtags"])}' AS caption,
    trim(array_to_string(labels, ', ') || '. ' || array_to_string(reasons[1:2], '; ')) AS edit_note
  FROM ({_ranked_sql(HOOKS["labels"], 5)})""")
def series_plan(spark, sf):
    return C.series_plan(B.candidates(spark, sf), "engine_build_montage", 5).select("rank", "id", "hook", "caption", "edit_note")


_SERIES = ", ".join(f"('{k}', $${t['name']}$$, {t['labels']})" for k, t in V.SERIES_TEMPLATES.items())


@query("C3_series_supply", with_views("cands") + f"""
  SELECT template, name, count("rank") AS candidates, max(score) AS best_score
  FROM (VALUES {_SERIES}) t(template, name, wanted) LEFT JOIN cands ON list_has_any(labels, wanted) GROUP BY template, name""")
def series_supply(spark, sf):
    return C.series_supply(B.candidates(spark, sf)).select("template", "name", "candidates", "best_score")


@query("W11_series_hooks", with_views("cands") + """SELECT id, ['a', 'b', 'c', 'd'][CAST(("rank" - 1) % 4 AS INT) + 1] AS hook FROM cands""")
def series_hooks(spark, sf):
    return B.candidates(spark, sf).select("id", C.series_hook(["a", "b", "c", "d"]).alias("hook"))


@query("C4_quote_candidates", with_views("cands") + f""", q AS (SELECT * FROM cands) SELECT place AS "rank", id FROM ({_ranked_sql([], 25, "q")})""")
def quote_candidates(spark, sf):
    """Every candidate stores a transcript score, and the search text includes key names."""
    return C.quote_candidates(B.candidates(spark, sf), 25).select("rank", "id")


QUOTES = with_views("cues") + f"""
  SELECT source, {hms('"start"')} AS start_tc, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM cues"""


@query("C4_quote_hits", QUOTES)
def quote_hits(spark, sf, n=None):
    return C.quote_hits(B.cues(spark, sf), [F.asc("source"), F.asc("cue_index")], n).select("source", "start_tc", "text")


@query("C4_first_quotes", QUOTES + " ORDER BY source, cue_index LIMIT 50")
def first_quotes(spark, sf):
    return quote_hits(spark, sf, 50)


# -- scalar functions ----------------------------------------------------------------------------------

@query("F1_seconds_to_hhmmss", with_views("ev") + f"SELECT event_id, {hms('t * 1000')} AS tc FROM ev")
def seconds_to_hhmmss(spark, sf):
    return B.events(spark, sf).select("event_id", S.hhmmss(F.col("t") * 1000).alias("tc"))


@query("F2_seconds_to_timecode", with_views("ev") + """
  SELECT event_id, printf('%02d:%02d:%02d:%02d', CAST(floor(t) AS BIGINT) // 3600, CAST(floor(t) AS BIGINT) % 3600 // 60, CAST(floor(t) AS BIGINT) % 60,
    CAST(round_even((t - floor(t)) * 24, 0) AS BIGINT) % 24) AS tc FROM ev""")
def seconds_to_timecode(spark, sf):
    return B.events(spark, sf).select("event_id", S.timecode("t", 24.0).alias("tc"))


@query("F3_timecode_to_seconds", with_views("ev") + """
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 3600 + 120 + event_id % 60 + 0.5 WHEN 1 THEN 7200 + 60 * (event_id % 60) + 9 ELSE event_id + 0.25 END::DOUBLE AS seconds FROM ev""")
def timecode_to_seconds(spark, sf):
    n = F.col("event_id")
    text = F.when(n % 3 == 0, F.format_string("01:02:%02d.5", n % 60)).when(n % 3 == 1, F.format_string("02:%02d:09:17", n % 60)).otherwise(F.concat(n.cast("string"), F.lit(".25")))
    return B.events(spark, sf).select("event_id", S.seconds_of(text).alias("seconds"))


@query("F4_clamp_window", with_views("ev") + """
  SELECT event_id, round(greatest(0, least(t - 50, 600)), 4) AS "start", round(greatest(greatest(0, least(t - 50, 600)), least(t - 20, 600)), 4) AS "end" FROM ev""")
def clamp_window(spark, sf):
    ev = B.events(spark, sf).select("event_id", (F.col("t") - 50).alias("s"), (F.col("t") - 20).alias("e"), F.lit(600.0).alias("d"))
    return ev.select("event_id", F.round(S.clamp_start("s", "d"), 4).alias("start"), F.round(S.clamp_end("s", "e", "d"), 4).alias("end"))


def _slug_sql(pattern, text="text", default="item", lower=False):
    x = f"lower(trim({text}))" if lower else text
    return f"coalesce(nullif(trim(regexp_replace({x}, '{pattern}', '_', 'g'), '_'), ''), '{default}')"


@query("F5_slug", f"""
  SELECT item_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'), ''), 'object') AS label_slug,
    {_slug_sql('[^a-z0-9_]+', default='value', lower=True)} AS feature, {_slug_sql('[^A-Za-z0-9_.-]+')} AS file FROM benchmark""")
def slug(spark, sf):
    b = B.table(spark, sf, "benchmark")
    return b.select("item_id", S.slug("text").alias("label_slug"), S.feature_name("text").alias("feature"), S.file_slug("text").alias("file"))


@query("F8_interval_functions", with_views("ev") + """
  SELECT event_id, round(greatest(0, least(t + 5, 300 + value) - greatest(t, 300)), 4) AS shared,
    round(CASE WHEN greatest(0, least(t + 5, 300 + value) - greatest(t, 300)) > 0 THEN 0 WHEN t + 5 <= 300 THEN 300 - (t + 5) ELSE t - (300 + value) END, 4) AS gap FROM ev""")
def interval_functions(spark, sf):
    ev = B.events(spark, sf).select("event_id", F.col("t").alias("a"), (F.col("t") + 5).alias("b"), F.lit(300.0).alias("c"), (F.col("value") + 300).alias("d"))
    return ev.select("event_id", F.round(S.overlap_seconds("a", "b", "c", "d"), 4).alias("shared"), F.round(S.time_gap("a", "b", "c", "d"), 4).alias("gap"))


@query("F9_sigmoid", with_views("ev") + """
  SELECT event_id, round(CASE WHEN x >= 50 THEN 1 WHEN x <= -50 THEN 0 ELSE 1 / (1 + exp(-x)) END, 6) AS y FROM (SELECT event_id, value - 40 AS x FROM ev)""")
def sigmoid(spark, sf):
    return B.events(spark, sf).select("event_id", F.round(S.sigmoid(F.col("value") - 40), 6).alias("y"))


@query("F10_source_id", with_views("assets") + "SELECT source, substring(sha1(source), 1, 16) AS source_id FROM assets")
def source_id(spark, sf):
    return B.assets(spark, sf).select(F.col("filepath").alias("source"), S.source_id("filepath").alias("source_id"))


@query("F11_path_key", with_views("assets") + """
  SELECT source, '/a/c/' || source AS key, source AS name, '../' || source AS up FROM assets""")
def path_key(spark, sf):
    p = F.col("filepath")
    return B.assets(spark, sf).select(
        p.alias("source"), S.path_key(F.concat(F.lit("\\a\\.\\b\\..\\\\c/"), p)).alias("key"), S.basename(F.concat(F.lit("C:\\x\\"), p)).alias("name"),
        S.path_key(F.concat(F.lit("./x/../../"), p, F.lit("/"))).alias("up"))


@query("F12_map_helpers", with_views("cands") + """
  SELECT id, round(technical_score, 4) AS technical, round_even(visual_activity_score, 2) AS visual, len(labels) AS n FROM cands""")
def map_helpers(spark, sf):
    at = lambda k: F.element_at("signals", k)
    return B.candidates(spark, sf).select("id", at("technical_score").alias("technical"), at("visual_activity_score").alias("visual"), F.size(S.label_array("labels")).alias("n"))


@query("F13_clip_seconds", with_views("ev") + """
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN 65.5 ELSE 0 END AS seconds FROM ev""")
def clip_seconds(spark, sf):
    n = F.col("event_id")
    return B.events(spark, sf).withColumns({"tc": F.when(n % 3 < 2, "00:01:05.5"), "s": F.when(n % 3 == 0, n)}).select("event_id", S.clip_seconds("tc", "s").alias("seconds"))


@query("F14_normalize_key", with_views("ev") + "SELECT event_id, 'a_' || event_type || '_b' AS key FROM ev")
def normalize_key(spark, sf):
    return B.events(spark, sf).select("event_id", S.normalize_key(F.concat(F.lit("  A-"), F.upper("event_type"), F.lit("-b "))).alias("key"))


# -- sinks, documents on disk, presets --------------------------------------------------------------------

INVENTORY = with_views("assets") + f"""
  SELECT source AS filename, {hms('duration')} AS duration, width || 'x' || height AS resolution, codec, fps, size_mb, has_audio, status, source AS filepath FROM assets"""


def _inventory(spark, sf, part, summary=None):
    path = _fresh(spark)
    K.write_inventory(B.assets(spark, sf), path, summary)
    rows = spark.read.option("header", True).csv(f"{path}/{part}")
    return rows.withColumns({"fps": F.col("fps").cast("double"), "size_mb": F.col("size_mb").cast("double"), "has_audio": F.col("has_audio").cast("boolean")})


@query("K1_write_inventory", INVENTORY)
def write_inventory(spark, sf):
    return _inventory(spark, sf, "csv")


@query("K1_inventory_summary", INVENTORY + " ORDER BY source LIMIT 200")
def inventory_summary(spark, sf):
    return _inventory(spark, sf, "summary", 200)


@query("K2_write_ratings", with_views("cands") + "SELECT id, source, score, action FROM cands")
def write_ratings(spark, sf):
    path = _fresh(spark)
    K.write_table(B.candidates(spark, sf).select(*R.CANDIDATE_COLUMNS), path)
    return spark.read.parquet(path).select("id", "source", "score", "action")


@query("K6_config_candidates_csv", with_views("grid") + f"""
  SELECT s."rank", s.name, f1, candidate_count, w_visual::DOUBLE AS visual_weight FROM ({SWEEP}) s JOIN grid g ON g.name = s.name""")
def config_candidates_csv(spark, sf):
    rows = W.sweep_scoring(B.signals(spark, sf), B.annotations(spark, sf), CFG)
    path = _fresh(spark)
    K.write_csv(K.config_table(rows), path)
    back = spark.read.option("header", True).option("escape", "\\").csv(path)
    return back.select(
        F.col("rank").cast("long"), "name", F.col("f1").cast("double"), F.col("candidate_count").cast("long"),
        F.get_json_object("weights", "$.visual").cast("double").alias("visual_weight"))


@query("S12_read_ratings", with_views("levels", "scenes", "silences", "object_hits", "cands") + """
  SELECT 'levels' AS part, count(*) AS n, round(sum(time), 2) AS total FROM levels UNION ALL SELECT 'scenes', count(*), round(sum(time), 2) FROM scenes
  UNION ALL SELECT 'silences', count(*), round(sum("end"), 2) FROM silences UNION ALL SELECT 'object_hits', count(*), round(sum(h_end), 2) FROM object_hits
  UNION ALL SELECT 'candidates', count(*), sum(score) FROM cands""")
def read_ratings(spark, sf):
    """One report per event or candidate, so no document grows with the data."""
    ev = B.events(spark, sf)
    asset = F.struct(F.col("source").alias("filename"), F.col("source").alias("filepath")).alias("asset")
    doc = lambda df, **parts: df.select(F.lit("r.json").alias("path"), F.to_json(F.struct(F.array(F.struct(asset, *[v.alias(k) for k, v in parts.items()])).alias("signals"))).alias("content"))
    docs = (
        doc(B.levels(ev), audio_levels=F.array(F.struct("time", "rms_db")))
        .unionByName(doc(B.scenes(ev), scene_changes=F.array("time")))
        .unionByName(doc(B.silences(ev), silence_intervals=F.array(F.struct("start", "end"))))
        .unionByName(doc(B.object_hits(ev), object_hits=F.array(F.struct("start", "end", "class_name", "class_id", "count"))))
    )
    clip = F.struct("id", "source", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), "score", "action", "labels", "reasons", "signals")
    clips = B.candidates(spark, sf).select(F.lit("c.json").alias("path"), F.to_json(F.struct(F.array(clip).alias("candidates"))).alias("content"))
    t = D.read_ratings(docs.unionByName(clips))
    part = lambda name, column: t[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.round(F.sum(column), 2).alias("total"))
    return (
        part("levels", "time").unionByName(part("scenes", "time")).unionByName(part("silences", "end")).unionByName(part("object_hits", "end"))
        .unionByName(part("candidates", F.col("score").cast("double")))
    )


def _preset(name):
    def run(spark, sf):
        frames = B.frame_vectors(spark, sf).withColumn("profile", F.lit("bank"))
        out = P.run_preset(name, B.signals(spark, sf), frames, B.prompt_vectors(spark, sf), None)
        last = "timeline" if "timeline" in out else "candidates"
        return out[last].select("label" if last == "timeline" else "id", "source")

    return run


for _name in P.PRESETS:
    query(f"C5_preset_{_name}")(_preset(_name))
