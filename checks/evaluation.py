"""Evaluation, identity and the parameter sweep."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from checks.registry import ORACLE, flat, query, r4, rounded4
from checks.views import MERGE, TOTAL, view, with_views
from clipsieve.config import ScoringConfig
from clipsieve.operators import evaluate as E, intervals as I, sweep as W
from clipsieve.plans import bridge as B
from clipsieve.sources.identity import resolve_sources

CFG = ScoringConfig(max_candidates=50)

GAP = """CASE WHEN least(a."end", c."end") > greatest(a."start", c."start") THEN 0
  WHEN a."end" <= c."start" THEN c."start" - a."end" ELSE a."start" - c."end" END"""
OVERLAP = """greatest(0, least(a."end", c."end") - greatest(a."start", c."start"))"""
MEETS = 'least(a."end", c."end") > greatest(a."start", c."start")'
POSITIVE = "('select', 'review', 'broll')"

view("positives", "annotations", f"SELECT * FROM annotations WHERE rating IN {POSITIVE}")
view("predicted", "cands", f"SELECT * FROM cands WHERE action IN {POSITIVE}")
view("wishes", "positives predicted", f"""
  SELECT a.source, a.ann_index, row_number() OVER (PARTITION BY a.source ORDER BY a.ann_index) AS k,
    list(c."rank" ORDER BY {OVERLAP} DESC, c.score DESC, c."rank") AS opts
  FROM positives a JOIN predicted c ON a.source = c.source AND {MEETS} GROUP BY a.source, a.ann_index""")
view("greedy", "wishes", """
  SELECT source, 0::BIGINT AS k, NULL::BIGINT AS ann_index, NULL::BIGINT AS pick, []::BIGINT[] AS used FROM (SELECT DISTINCT source FROM wishes)
  UNION ALL
  SELECT source, k, ann_index, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
  FROM (SELECT g.source, w.k, w.ann_index, list_filter(w.opts, lambda x: NOT list_contains(g.used, x))[1] AS pick, g.used
        FROM greedy g JOIN wishes w ON w.source = g.source AND w.k = g.k + 1)""")
view("matches", "greedy positives cands", f"""
  SELECT a.ann_index, a.id AS annotation_id, a.tag, c."rank" AS cand_rank, c.id AS candidate_id, {OVERLAP} AS overlap, a."end" - a."start" AS len
  FROM greedy g JOIN positives a USING (ann_index) JOIN cands c ON c."rank" = g.pick""")
view("missed", "matches positives", "SELECT * FROM positives WHERE ann_index NOT IN (SELECT ann_index FROM matches)")
view("fps", "matches predicted annotations", f"""
  SELECT * FROM predicted c WHERE "rank" NOT IN (SELECT cand_rank FROM matches)
    AND NOT EXISTS (SELECT 1 FROM annotations a WHERE a.rating = 'ignore' AND a.source = c.source AND {MEETS})""")


@lru_cache(maxsize=None)
def _evaluation(app_id, spark, sf):
    return E.evaluate(*_inputs(spark, sf))


def evaluation(spark, sf):
    """The report of all candidates.  Its matches are materialised; queries of a session share them."""
    return _evaluation(spark.sparkContext.applicationId, spark, sf)


def _inputs(spark, sf):
    return B.annotations(spark, sf), B.candidates(spark, sf)


@query("J7_greedy_match", with_views("matches", recursive=True) + """
  SELECT annotation_id, candidate_id, round(overlap, 4) AS overlap, round(overlap / len, 4) AS overlap_ratio FROM matches""")
def greedy_match(spark, sf):
    return E.greedy_match(*_inputs(spark, sf)).select("annotation_id", "candidate_id", r4("overlap"), r4("overlap_ratio"))


NEAREST_CAND = f"""
  SELECT a.id, c.id AS near_id, round({GAP}, 4) AS gap FROM {{left}} a LEFT JOIN cands c ON a.source = c.source
  QUALIFY row_number() OVER (PARTITION BY a.ann_index ORDER BY {GAP}, c.score DESC, c."rank") = 1"""


@query("J8_nearest_candidate", with_views("annotations", "cands") + NEAREST_CAND.format(left="annotations"))
def nearest_candidate(spark, sf):
    return E.nearest_candidate(*_inputs(spark, sf)).select("id", "near_id", r4("gap"))


NEAREST_ANN = f"""
  SELECT c.id, a.id AS near_id, a.rating AS near_rating, round({GAP}, 4) AS gap, round({OVERLAP}, 4) AS shared
  FROM {{left}} c LEFT JOIN annotations a ON a.source = c.source
  QUALIFY row_number() OVER (PARTITION BY c."rank" ORDER BY {GAP}, {OVERLAP} DESC, a.ann_index) = 1"""


@query("J9_nearest_annotation", with_views("annotations", "cands") + NEAREST_ANN.format(left="cands"))
def nearest_annotation(spark, sf):
    ann, cand = _inputs(spark, sf)
    return E.nearest_annotation(cand, ann).select("id", "near_id", "near_rating", r4("gap"), r4("shared"))


view("frames", "frame_vectors", "SELECT source, time, source || '@' || CAST(time AS BIGINT) AS frame_id FROM frame_vectors")


def _frames(spark, sf):
    frames = B.frame_vectors(spark, sf).drop("vector")
    return frames.withColumn("frame_id", F.concat("source", F.lit("@"), F.col("time").cast("long").cast("string")))


@query("J10_nearest_to_point", with_views("frames", "cands") + """
  SELECT frame_id, id AS near_id, round(gap, 4) AS gap FROM (
    SELECT f.frame_id, c.id, c.score, c."rank", CASE WHEN time BETWEEN c."start" AND c."end" THEN 0
      ELSE least(abs(time - c."start"), abs(time - c."end")) END AS gap FROM frames f LEFT JOIN cands c USING (source))
  QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY gap, score DESC, "rank") = 1""")
def nearest_to_point(spark, sf):
    return E.nearest_to_point(_frames(spark, sf), B.candidates(spark, sf)).select("frame_id", "near_id", r4("gap"))


view("actuals", "annotations cands", f"""
  SELECT c."rank", c.id, c.action, coalesce(b.rating, 'unmatched') AS actual FROM cands c LEFT JOIN (
    SELECT c."rank", a.rating FROM cands c JOIN annotations a ON a.source = c.source AND {MEETS}
    QUALIFY row_number() OVER (PARTITION BY c."rank" ORDER BY {OVERLAP} DESC, a.ann_index) = 1) b USING ("rank")""")


@query("J11_best_overlap", with_views("actuals") + "SELECT id, action, actual FROM actuals")
def best_overlap(spark, sf):
    ann, cand = _inputs(spark, sf)
    return E.best_overlap(cand, ann).select("id", "action", "actual")


@query("J12_anti_covered", with_views("frames", "predicted") + """
  SELECT frame_id FROM frames f WHERE NOT EXISTS (SELECT 1 FROM predicted c WHERE c.source = f.source AND f.time BETWEEN c."start" AND c."end")""")
def anti_covered(spark, sf):
    covered = E.predicted_positive(B.candidates(spark, sf)).select("source", "start", "end")
    return I.uncovered_points(_frames(spark, sf), covered, ["source"]).select("frame_id")


@query("J13_anti_ignored", with_views("predicted", "annotations") + f"""
  SELECT id FROM predicted c WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.rating = 'ignore' AND a.source = c.source AND {MEETS})""")
def anti_ignored(spark, sf):
    ann, cand = _inputs(spark, sf)
    return E.outside_ignored(E.predicted_positive(cand), ann).select("id")


COUNTS = """SELECT (SELECT count(*) FROM matches) AS tp, (SELECT count(*) FROM fps) AS fp, (SELECT count(*) FROM missed) AS missed,
  (SELECT count(*) FROM positives) AS pos"""
PRF = """round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1"""
RATIOS = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN pos = 0 THEN 0 ELSE tp / pos::DOUBLE END AS r"""


@query("A6_evaluate", with_views("matches", "fps", "missed", "annotations", recursive=True) + f"""
  SELECT 'match' AS part, annotation_id AS id, candidate_id AS other, round(overlap, 4) AS measure FROM matches
  UNION ALL SELECT 'missed', id, near_id, gap FROM ({NEAREST_CAND.format(left="missed")})
  UNION ALL SELECT 'false_positive', id, near_id, gap FROM ({NEAREST_ANN.format(left="fps")})""")
def evaluate(spark, sf):
    e = evaluation(spark, sf)
    part = lambda df, name, own, other, measure: df.select(
        F.lit(name).alias("part"), F.col(own).alias("id"), F.col(other).alias("other"), rounded4(measure).alias("measure")
    )
    return (
        part(e.matches, "match", "annotation_id", "candidate_id", "overlap")
        .unionByName(part(e.missed, "missed", "id", "near_id", "gap"))
        .unionByName(part(e.false_positives, "false_positive", "id", "near_id", "gap"))
    )


@query("A7_prf_metrics", with_views("matches", "fps", "missed", recursive=True) + f"""
  SELECT tp AS true_positives, fp AS false_positives, missed, pos AS positive_annotations, {PRF} FROM (SELECT *, {RATIOS} FROM ({COUNTS}))""")
def prf_metrics(spark, sf):
    return evaluation(spark, sf).metrics


@query("A8_recall_at_k", with_views("positives", "cands") + f"""
  SELECT k, matched, round_even(matched / (SELECT count(*) FROM positives)::DOUBLE, 4) AS recall FROM (
    SELECT k, (SELECT count(DISTINCT a.id) FROM positives a JOIN cands c ON a.source = c.source AND {MEETS}
      WHERE c."rank" <= k AND c.action IN {POSITIVE}) AS matched FROM (VALUES (5), (10), (25), (50)) v(k))""")
def recall_at_k(spark, sf):
    return E.recall_at_k(*_inputs(spark, sf))


@query("A9_recall_by_tag", with_views("matches", "positives", recursive=True) + """
  SELECT p.tag, count(*) AS total, count(m.ann_index) AS matched, round_even(count(m.ann_index) / count(*)::DOUBLE, 4) AS recall
  FROM positives p LEFT JOIN matches m USING (ann_index) GROUP BY p.tag""")
def recall_by_tag(spark, sf):
    return evaluation(spark, sf).recall_by_tag


@query("A10_action_confusion", with_views("actuals") + "SELECT action, actual, count(*) AS n FROM actuals GROUP BY ALL")
def action_confusion(spark, sf):
    ann, cand = _inputs(spark, sf)
    return E.action_confusion(cand, ann)


SIGNALS = ("technical_score visual_activity_score audio_interest_score transcript_score object_presence_score ocr_signage_score "
           "face_person_score motorsports_event_score topic_cluster_score ai_frame_score").split()


@query("P12_signal_breakdown", with_views("cands") + f"""
, score_rows AS (SELECT "rank", reasons, unnest([{", ".join(f"{{name: '{s}', value: {s}::DOUBLE}}" for s in SIGNALS)}]) AS s FROM cands)
  SELECT format('clip_{{:04d}}', "rank") AS id, list(s.name ORDER BY s.value DESC, s.name) AS names,
    array_to_string(any_value(reasons), '|') AS first_reasons
  FROM score_rows WHERE s.value <> 0 GROUP BY "rank" """)
def signal_breakdown(spark, sf, shown=None):
    rows = E.signal_breakdown(B.candidates(spark, sf), shown)
    return rows.select("id", F.transform("top_scores", lambda s: s["name"]).alias("names"), flat("first_reasons"))


@query("P12_first_signals", ORACLE["P12_signal_breakdown"].replace("s.name) AS names", "s.name)[1:6] AS names").replace("any_value(reasons)", "any_value(reasons)[1:6]"))
def first_signals(spark, sf):
    return signal_breakdown(spark, sf, 6)


@query("P13_scoring_modes", with_views("cands") + "SELECT 'deterministic|ai-assisted' AS modes FROM cands LIMIT 1")
def scoring_modes(spark, sf):
    return E.scoring_modes(B.candidates(spark, sf)).select(flat("modes"))


# Annotated spellings: a prefix of folders, back slashes, and a basename known twice.
@query("J1_resolve_sources", with_views("assets") + """
, known AS (SELECT '/media/day1/' || source AS path, source FROM assets UNION ALL
            SELECT '/media/day2/' || source, source FROM assets WHERE user_id < 5)
, spelled AS (SELECT DISTINCT source, user_id, unnest(['day1/' || source, '/media/./day1//' || source, 'C:\\clips\\' || source, 'elsewhere/' || source]) AS spelling,
              unnest([0, 1, 2, 3]) AS rule FROM assets)
  SELECT spelling AS source, CASE WHEN rule IN (0, 1) THEN '/media/day1/' || source WHEN user_id >= 5 THEN '/media/day1/' || source ELSE spelling END AS canonical_source
  FROM spelled""")
def resolve(spark, sf):
    assets = B.assets(spark, sf)
    name = F.col("filepath")
    twice = F.regexp_extract(name, r"user_(\d+)", 1).cast("int") < 5
    known = assets.select(F.explode(F.array_compact(F.array(
        F.concat(F.lit("/media/day1/"), name), F.when(twice, F.concat(F.lit("/media/day2/"), name))))).alias("source"))
    spelled = assets.select(F.explode(F.array(*[F.concat(F.lit(p), name) for p in (
        "day1/", "/media/./day1//", "C:\\clips\\", "elsewhere/")])).alias("source"))
    return resolve_sources(spelled, known, ["/media"]).select("source", "canonical_source")


# -- sweep ---------------------------------------------------------------------------------

def _struct_list(values: dict, names) -> str:
    rows = ", ".join(
        "{" + ", ".join([f"'no': {i}", f"'name': '{k}'", *[f"'{n}': {v}" for n, v in zip(names, row)]]) + "}"
        for i, (k, row) in enumerate(values.items())
    )
    return f"[{rows}]"


AXES = W.grid_axes(CFG)
WEIGHTS = W._NAMES
view("grid", "", f"""
  SELECT *, format('config_{{:03d}}', row_number() OVER (ORDER BY wn, tn, rn, an, ln)) AS name, row_number() OVER (ORDER BY wn, tn, rn, an, ln) AS config_no
  FROM (SELECT w.no AS wn, t.no AS tn, r.no AS rn, a.no AS an, l.no AS ln, w.name AS weight, t.name AS threshold, r.name AS roll, a.name AS audio,
          {", ".join(f"w.{n} AS w_{n}" for n in WEIGHTS)}, t.s AS min_select, t.r AS min_review, t.b AS min_broll, l.n AS max_candidates
        FROM (SELECT unnest({_struct_list(AXES["weight"], WEIGHTS)}) AS w), (SELECT unnest({_struct_list(AXES["threshold"], "srb")}) AS t),
          (SELECT unnest({_struct_list(AXES["roll"], ("pre", "post", "gap"))}) AS r), (SELECT unnest({_struct_list(AXES["audio"], ("p", "f"))}) AS a),
          (SELECT unnest({_struct_list(AXES["limit"], "n")}) AS l))""")


@query("J15_config_grid", with_views("grid", "cands") + """
, per AS (SELECT DISTINCT max_candidates, min_select FROM grid)
, n AS (SELECT max_candidates, min_select, count(id) AS selected FROM per LEFT JOIN cands ON "rank" <= max_candidates AND score >= min_select GROUP BY ALL)
  SELECT name, weight, threshold, roll, audio, w_visual, w_transcript, min_select, min_broll, max_candidates, selected FROM grid JOIN n USING (max_candidates, min_select)""")
def config_grid(spark, sf):
    """The grid, with the number of candidates of the run that each configuration's limit and threshold would select."""
    grid = W.config_grid(spark, CFG.with_(max_candidates=50))
    limits = F.array(*(F.lit(int(k)) for k in W.grid_axes(CFG.with_(max_candidates=50))["limit"]))
    within = F.explode(F.filter(limits, lambda k: F.col("rank") <= k)).alias("max_candidates")
    scores = B.candidates(spark, sf).select("score", within).groupBy("max_candidates", "score").agg(F.count("*").alias("n"))
    selected = grid.join(scores, "max_candidates", "left").groupBy("name").agg(F.coalesce(F.sum(F.when(F.col("score") >= F.col("min_select"), F.col("n"))), F.lit(0)).alias("selected"))
    return grid.join(selected, "name").select("name", "weight", "threshold", "roll", "audio", "w_visual", "w_transcript", "min_select", "min_broll", "max_candidates", "selected")


view("s_audio", "", f"SELECT a.* FROM (SELECT unnest({_struct_list(AXES['audio'], ('p', 'f'))}) AS a)")
view("s_roll", "", f"SELECT r.* FROM (SELECT unnest({_struct_list(AXES['roll'], ('pre', 'post', 'gap'))}) AS r)")
view("s_spikes", "levels s_audio", """
  SELECT l.source, l.time, t.audio FROM levels l JOIN (
    SELECT a.name AS audio, source, greatest(a.f, list_sort(list(rms_db))[CAST(floor((count(*) - 1) * (a.p::DOUBLE / 100.0::DOUBLE)) AS BIGINT) + 1]) AS threshold
    FROM levels, s_audio a GROUP BY a.name, a.f, a.p, source) t ON l.source = t.source AND l.rms_db >= t.threshold""")
view("s_seeds", "scenes s_spikes transcript_hits interesting advanced_labels s_audio s_roll", """
  SELECT audio, r.name AS roll, r.gap, source, a0 - CASE WHEN fixed THEN 1 ELSE r.pre END AS "start", b0 + CASE WHEN fixed THEN 2 ELSE r.post END AS "end" FROM (
    SELECT audio, source, time AS a0, time AS b0, false AS fixed FROM s_spikes
    UNION ALL SELECT a.name, source, a0, b0, fixed FROM s_audio a, (
      SELECT source, time AS a0, time AS b0, false AS fixed FROM scenes
      UNION ALL SELECT source, h_start, h_end, false FROM transcript_hits
      UNION ALL SELECT source, h_start, h_end, true FROM interesting
      UNION ALL SELECT source, h_start, h_end, false FROM advanced_labels WHERE NOT wide)), s_roll r""")
view("s_clamped", "s_seeds assets", """
  SELECT audio, roll, gap, source, greatest(0, least("start", duration)) AS "start",
    greatest(greatest(0, least("start", duration)), least("end", duration)) AS "end", ['x'] AS labels FROM s_seeds JOIN assets USING (source)""")
view("s_merged", "s_clamped", MERGE.format(keys="audio, roll, gap, source", gap="gap", table="s_clamped"))
view("s_windows", "s_merged assets s_audio s_roll", """
  SELECT audio, roll, source, "start", "end" FROM s_merged WHERE "end" - "start" >= 1.0
  UNION ALL SELECT a.name, r.name, source, 0.0, least(duration, 12.0) FROM assets, s_audio a, s_roll r
  WHERE (a.name, r.name, source) NOT IN (SELECT (audio, roll, source) FROM s_seeds)""")
KEY = 'audio, roll, source, "start", "end"'
view("s_facts", "s_windows scenes levels silences transcript_hits interesting advanced_labels technical", f"""
  SELECT w.*, t.technical_score, coalesce(n_scene, 0) AS n_scene, peak, coalesce(quiet, 0) / greatest(0.1, "end" - "start") AS silence_ratio,
    coalesce(n_tr, 0) AS n_tr, coalesce(n_obj, 0) AS n_obj, coalesce(n_cls, 0) AS n_cls, coalesce(det, 0) AS det, coalesce(x_ocr, 0) AS x_ocr,
    coalesce(x_face, 0) AS x_face, coalesce(x_ev, 0) AS x_ev, coalesce(x_topic, 0) AS x_topic, coalesce(x_ai, 0) AS x_ai
  FROM s_windows w JOIN technical t USING (source)
  LEFT JOIN (SELECT {KEY}, count(*) AS n_scene FROM s_windows JOIN scenes s USING (source) WHERE s.time BETWEEN "start" AND "end" GROUP BY ALL) USING ({KEY})
  LEFT JOIN (SELECT {KEY}, max(rms_db) AS peak FROM s_windows JOIN levels s USING (source) WHERE s.time BETWEEN "start" AND "end" GROUP BY ALL) USING ({KEY})
  LEFT JOIN (SELECT audio, roll, w.source, w."start", w."end", sum(greatest(0, least(w."end", s."end") - greatest(w."start", s."start"))) AS quiet
             FROM s_windows w JOIN silences s ON w.source = s.source GROUP BY ALL) USING ({KEY})
  LEFT JOIN (SELECT {KEY}, count(*) AS n_tr FROM s_windows JOIN transcript_hits USING (source)
             WHERE h_start BETWEEN "start" AND "end" OR h_end BETWEEN "start" AND "end" GROUP BY ALL) USING ({KEY})
  LEFT JOIN (SELECT {KEY}, count(*) AS n_obj, count(DISTINCT class_name) AS n_cls, sum(cnt) AS det FROM s_windows JOIN interesting USING (source)
             WHERE least("end", h_end) > greatest("start", h_start) GROUP BY ALL) USING ({KEY})
  LEFT JOIN (SELECT {KEY}, count(*) FILTER (kind = 'ocr_signage') * 4.0 AS x_ocr, sum(face_count) * 1.5 + sum(person_count) * 0.75 AS x_face,
               count(*) FILTER (kind = 'motorsports_event') * 5.0 + coalesce(sum(conf) FILTER (kind = 'motorsports_event'), 0) * 4.0 AS x_ev,
               count(*) FILTER (kind = 'topic_cluster') * 5.0 AS x_topic,
               count(*) FILTER (kind = 'ai_frame_score') * 2.0 + coalesce(sum(conf) FILTER (kind = 'ai_frame_score'), 0) * 6.0 AS x_ai
             FROM s_windows JOIN advanced_labels USING (source) WHERE wide OR least("end", h_end) > greatest("start", h_start) GROUP BY ALL) USING ({KEY})""")
view("s_weights", "", f"SELECT w.* FROM (SELECT unnest({_struct_list(AXES['weight'], WEIGHTS)}) AS w)")
view("s_sets", "s_facts s_weights", f"""
  SELECT weight, {KEY}, score, row_number() OVER (PARTITION BY weight, audio, roll ORDER BY score DESC, source, "start") AS "rank" FROM (
    SELECT weight, {KEY}, {TOTAL} AS score FROM (
      SELECT f.*, w.name AS weight, least(w.visual, n_scene * 8.0) AS visual_activity_score,
        CASE WHEN silence_ratio > 0.6 THEN greatest(0, tier - 10) ELSE tier END AS audio_interest_score,
        least(w.transcript, n_tr * 10.0) AS transcript_score,
        least(w.objects::DOUBLE, n_obj * 2.0 + n_cls * 2.0 + least(6.0::DOUBLE, det / 200.0::DOUBLE)) AS object_presence_score,
        least(w.ocr, x_ocr) AS ocr_signage_score, least(w.face_person, x_face) AS face_person_score,
        least(w.motorsports::DOUBLE, x_ev) AS motorsports_event_score, least(w.topics, x_topic) AS topic_cluster_score, least(w.ai::DOUBLE, x_ai) AS ai_frame_score
      FROM (SELECT *, CASE WHEN peak IS NULL THEN 0.0 WHEN peak >= -18 THEN 30 WHEN peak >= -25 THEN 22 WHEN peak >= -35 THEN 14 ELSE 6 END AS tier FROM s_facts) f,
        s_weights w))""")
view("s_chosen", "s_sets grid", """
  SELECT config_no, s.*, score >= min_broll AS positive FROM s_sets s JOIN grid g USING (weight, audio, roll) WHERE "rank" <= max_candidates""")
view("s_pairs", "s_sets positives", f"""
  SELECT c.weight, c.audio, c.roll, c."rank", a.source, a.ann_index, {OVERLAP} AS overlap FROM s_sets c JOIN positives a ON a.source = c.source AND {MEETS}
  WHERE c."rank" <= 100""")
view("s_wishes", "s_chosen s_pairs", """
  SELECT config_no, p.source, ann_index, row_number() OVER (PARTITION BY config_no, p.source ORDER BY ann_index) AS k,
    list(p."rank" ORDER BY overlap DESC, score DESC, p."rank") AS opts
  FROM s_chosen c JOIN s_pairs p ON (c.weight, c.audio, c.roll, c."rank") = (p.weight, p.audio, p.roll, p."rank") WHERE positive
  GROUP BY config_no, p.source, ann_index""")
view("s_greedy", "s_wishes", """
  SELECT config_no, source, 0::BIGINT AS k, NULL::BIGINT AS ann_index, NULL::BIGINT AS pick, []::BIGINT[] AS used
  FROM (SELECT DISTINCT config_no, source FROM s_wishes)
  UNION ALL
  SELECT config_no, source, k, ann_index, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
  FROM (SELECT g.config_no, g.source, w.k, w.ann_index, list_filter(w.opts, lambda x: NOT list_contains(g.used, x))[1] AS pick, g.used
        FROM s_greedy g JOIN s_wishes w ON w.config_no = g.config_no AND w.source = g.source AND w.k = g.k + 1)""")
view("s_counts", "s_greedy s_chosen annotations grid positives", f"""
  SELECT g.config_no, g.name, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n, 0) AS candidate_count, (SELECT count(*) FROM positives) AS pos
  FROM grid g
  LEFT JOIN (SELECT config_no, count(*) AS tp FROM s_greedy WHERE pick IS NOT NULL GROUP BY ALL) USING (config_no)
  LEFT JOIN (SELECT config_no, count(*) AS n FROM s_chosen GROUP BY ALL) USING (config_no)
  LEFT JOIN (SELECT c.config_no, count(*) AS fp FROM s_chosen c
             LEFT JOIN (SELECT config_no, pick FROM s_greedy WHERE pick IS NOT NULL) m ON m.config_no = c.config_no AND m.pick = c."rank"
             WHERE positive AND m.pick IS NULL AND NOT EXISTS (SELECT 1 FROM annotations a WHERE a.rating = 'ignore' AND a.source = c.source AND {MEETS})
             GROUP BY ALL) USING (config_no)""")
SWEEP = with_views("s_counts", recursive=True) + f"""
  SELECT name, tp AS true_positives, fp AS false_positives, pos - tp AS missed, candidate_count, {PRF},
    row_number() OVER (ORDER BY round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) DESC, round_even(r, 4) DESC, round_even(p, 4) DESC,
      candidate_count, config_no) AS "rank"
  FROM (SELECT *, {RATIOS} FROM s_counts)"""


@query("A11_sweep_scoring", SWEEP)
def sweep_scoring(spark, sf):
    rows = W.sweep_scoring(B.signals(spark, sf), B.annotations(spark, sf), CFG)
    return rows.select("name", "true_positives", "false_positives", "missed", "candidate_count", "precision", "recall", "f1", "rank")


def _runs(spark, sf):
    """One run per number of candidates kept; metrics from the recall and confusion tables."""
    cand, ann = B.candidates(spark, sf), B.annotations(spark, sf)
    marked = cand.join(E.best_overlap(cand, ann).select("rank", "actual"), "rank")
    runs = marked.select("*", F.inline(F.array(*[F.struct(F.lit(a).alias("run")) for a in ("broll", "review", "select")])))
    hit = F.col("actual").isin(*E.POSITIVE_RATINGS)
    told = F.when(F.col("run") == "select", F.col("action") == "select").when(
        F.col("run") == "review", F.col("action").isin("select", "review")).otherwise(F.col("action") != "cut")
    counts = runs.groupBy("run").agg(
        F.count_if(told & hit).alias("tp"), F.count_if(told & ~hit).alias("false_positives"), F.count_if(~told & hit).alias("missed"))
    return counts.withColumn("pos", F.col("tp") + F.col("missed")).withColumns(E.prf("tp", "false_positives", "pos"))


@query("J17_compare_runs", with_views("actuals") + f"""
, runs AS (SELECT run, count(*) FILTER (told AND hit) AS tp, count(*) FILTER (told AND NOT hit) AS fp, count(*) FILTER (NOT told AND hit) AS missed FROM (
    SELECT run, actual IN {POSITIVE} AS hit, CASE run WHEN 'select' THEN action = 'select' WHEN 'review' THEN action IN ('select', 'review') ELSE action <> 'cut' END AS told
    FROM actuals, (VALUES ('broll'), ('review'), ('select')) v(run)) GROUP BY run)
, m AS (SELECT run, missed, fp, {PRF} FROM (SELECT *, {RATIOS} FROM (SELECT *, tp + missed AS pos FROM runs)))
  SELECT m.run, round_even(m.precision - b.precision, 4) AS delta_precision, round_even(m.recall - b.recall, 4) AS delta_recall,
    round_even(m.f1 - b.f1, 4) AS delta_f1, m.missed - b.missed AS missed_delta, m.fp - b.fp AS false_positive_delta,
    row_number() OVER (ORDER BY m.f1 DESC, m.recall DESC, m.precision DESC, m.missed, m.fp, m.run) AS "rank"
  FROM m, m b WHERE b.run = 'broll'""")
def compare_runs(spark, sf):
    return E.compare_runs(_runs(spark, sf), "broll").select(
        "run", "delta_precision", "delta_recall", "delta_f1", "missed_delta", "false_positive_delta", "rank")

