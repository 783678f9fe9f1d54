"""Scans, parsers and document readers.  Logs and documents are derived from the events table, one per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import ORACLE, flat, query, r4
from checks.views import view, with_views
from clipsieve.operators import signals as G
from clipsieve.operators.keywords import find_keywords
from clipsieve.operators.ranking import global_rank
from clipsieve.plans import bridge as B
from clipsieve.sources import documents as D, logs as L, media as M, transcripts as X
from clipsieve.streaming import incremental as N

# Words that occur in the synthetic conversations and documents.
WORDS = ("The", "that", "with", "zebra")


# -- files on disk --------------------------------------------------------------------------

@query("S1_scan_media")
def scan_media(spark, sf):
    """The data folder itself is the media folder: parquet plays the extension."""
    files = M.scan_media(spark, sf, (".PARQUET",))
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("bytes"))


def _probes(spark, sf):
    """One probe document per user; every seventh lacks sound, every fifth document is cut short."""
    a = B.assets(spark, sf)
    number = F.regexp_extract("filepath", r"(\d+)", 1).cast("long")
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), "width", "height",
                     F.when(F.pmod(number, F.lit(3)) == 2, "30000/1001").when(F.pmod(number, F.lit(3)) == 1, "25/1").otherwise("0/0").alias("r_frame_rate"))
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), none("width", "int"), none("height", "int"), none("r_frame_rate", "string"))
    streams = F.when(F.col("has_audio"), F.array(audio, video)).otherwise(F.array(video))
    size = F.struct(F.lit("720.0004").alias("duration"), (number * 1000000).cast("string").alias("size"))
    content = F.to_json(F.struct(size.alias("format"), streams.alias("streams")))
    return a.select("filepath", F.when(F.pmod(number, F.lit(5)) == 4, F.substring(content, 1, 20)).otherwise(content).alias("content"))


view("probed", "assets", """
  SELECT source AS filepath, user_id % 5 = 4 AS broken, round_even(user_id * 1000000 / 1048576.0::DOUBLE, 2) AS size_mb, width, height,
    CASE user_id % 3 WHEN 2 THEN 29.97 WHEN 1 THEN 25.0 END::DOUBLE AS fps, has_audio FROM assets""")


@query("S2_parse_probe_json", with_views("probed") + """
  SELECT filepath, CASE WHEN broken THEN 0 ELSE size_mb END AS size_mb, CASE WHEN broken THEN 0 ELSE 720.0 END AS duration, CASE WHEN NOT broken THEN width END AS width,
    CASE WHEN NOT broken THEN fps END AS fps, has_audio AND NOT broken AS has_audio, CASE WHEN broken THEN 'error' ELSE 'ok' END AS status FROM probed""")
def parse_probe_json(spark, sf):
    return M.parse_probe_json(_probes(spark, sf)).select("filepath", "size_mb", "duration", "width", "fps", "has_audio", "status")


@query("S3_build_inventory", with_views("probed") + """
  SELECT count(*) AS count, 0 AS skipped, round(sum(CASE WHEN broken THEN 0 ELSE 720 END), 3) AS total_duration,
    round(sum(CASE WHEN broken THEN 0 ELSE size_mb END), 2) AS total_size_mb FROM probed""")
def build_inventory(spark, sf):
    return M.build_inventory(M.parse_probe_json(_probes(spark, sf)))[1]


# -- logs: the lines an analysis tool would have printed for the events of a source -------------

def _clock(column="t_ms"):
    c = F.col(column)
    return F.concat(F.floor(c / 1000).cast("string"), F.lit("."), F.lpad((c % 1000).cast("string"), 3, "0"))


def _log(spark, sf):
    """Two lines per event.  Signups open a silence, errors close one; times and levels alternate."""
    ev = B.events(spark, sf)
    cents = F.round(F.col("value") * 100).cast("long")
    level = F.when(F.pmod("event_id", F.lit(11)) == 0, "-inf").otherwise(F.concat(F.lit("-"), (cents % 120).cast("string"), F.lit(".25")))
    first = F.when(F.col("event_type") == "signup", F.concat(F.lit("[silence] silence_start: "), _clock())).when(
        F.col("event_type") == "error", F.concat(F.lit("[silence] silence_end: "), _clock(), F.lit(" | silence_duration: 1"))).otherwise(
        F.concat(F.lit("frame:1 pts:7 pts_time:"), _clock()))
    second = F.concat(F.lit("lavfi.astats.Overall.RMS_level="), level)
    return ev.select("source", F.posexplode(F.array(first, second)).alias("k", "line"), "event_id").select(
        "source", (F.col("event_id") * 2 + F.col("k")).alias("line_no"), "line")


SEC = "(t_ms / 1000.0::DOUBLE)"


@query("S4_parse_scene_log", with_views("ev") + f"""
  SELECT DISTINCT source, {SEC} AS time FROM ev WHERE event_type NOT IN ('signup', 'error')""")
def parse_scene_log(spark, sf):
    return L.parse_scene_log(_log(spark, sf))


view("silence_log", "ev", f"""
  SELECT source, event_id, {SEC} AS t_at, event_type = 'signup' AS opens, lag({SEC}) OVER w AS prev_at, lag(event_type) OVER w = 'signup' AS prev_opens,
    lead(event_id) OVER w IS NULL AS is_last
  FROM ev WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY source ORDER BY event_id)""")


@query("S5_parse_silence_log", with_views("silence_log") + """
  SELECT source, prev_at AS "start", t_at AS "end" FROM silence_log WHERE NOT opens AND prev_opens AND t_at > prev_at
  UNION ALL SELECT source, t_at, 720.0 FROM silence_log WHERE opens AND is_last AND 720.0 > t_at""")
def parse_silence_log(spark, sf):
    durations = B.assets(spark, sf).select(F.col("filepath").alias("source"), "duration")
    return L.parse_silence_log(_log(spark, sf), durations)


@query("S6_parse_level_log", with_views("ev") + f"""
  SELECT source, time, rms_db FROM (
    SELECT source, last_value(CASE WHEN event_type NOT IN ('signup', 'error') THEN {SEC} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY event_id) AS time,
      CASE WHEN event_id % 11 = 0 THEN -120.0::DOUBLE ELSE -(CAST(round(value * 100) AS BIGINT) % 120 + 0.25::DOUBLE) END AS rms_db FROM ev)
  WHERE time IS NOT NULL""")
def parse_level_log(spark, sf):
    return L.parse_level_log(_log(spark, sf))


@query("S7_silence_from_levels", with_views("levels") + """
, marked AS (SELECT *, rms_db <= -30 AS quiet, min(CASE WHEN rms_db > -30 THEN time END) OVER (PARTITION BY source ORDER BY time ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM levels)
  SELECT source, round("start", 4) AS "start", round("end", 4) AS "end" FROM (
    SELECT source, min(time) AS "start", coalesce(stop, max(time)) AS "end" FROM marked WHERE quiet GROUP BY source, stop) WHERE "end" - "start" >= 1""")
def silence_from_levels(spark, sf):
    return L.silence_from_levels(B.levels(B.events(spark, sf))).select("source", r4("start"), r4("end"))


# -- transcripts -------------------------------------------------------------------------------

@query("S8_find_transcript", with_views("assets") + """
  SELECT '/media/' || source AS source, CASE WHEN user_id % 3 = 0 THEN '/scripts/user_' || user_id || '.vtt' ELSE '/media/user_' || user_id || '.srt' END AS transcript FROM assets""")
def find_transcript(spark, sf):
    """Every file has a neighbour in srt and txt; each third also has a vtt in the transcript folder."""
    a = B.assets(spark, sf)
    stem = F.regexp_replace("filepath", r"\.mp4$", "")
    third = F.pmod(F.regexp_extract("filepath", r"(\d+)", 1).cast("int"), F.lit(3)) == 0
    files = a.select(F.explode(F.array_compact(F.array(
        F.concat(F.lit("/media/"), stem, F.lit(".txt")), F.concat(F.lit("/media/"), stem, F.lit(".srt")),
        F.when(third, F.concat(F.lit("/scripts/"), stem, F.lit(".vtt")))))).alias("path"))
    return X.find_transcript(a.withColumn("filepath", F.concat(F.lit("/media/"), "filepath")), files, "/scripts/")


def _subtitles(spark, sf):
    """Each conversation turn as a subtitle file of three cues: its words, an empty-ish one, a tagged one."""
    cues = B.cues(spark, sf)
    block = lambda a, b, text: F.concat(F.format_string("00:%02d:%02d,250 --> 00:%02d:%02d.500 align:start\n", F.lit(a), F.col("cue_index"), F.lit(b), F.col("cue_index")), text)
    line = F.regexp_replace("text", r"\s+", " ")
    content = F.concat(F.lit("1\n"), block(0, 1, line), F.lit("\n\n2\n"), block(2, 3, F.lit("<b>zebra</b>\ncrossing")), F.lit("\n \n3\n"), block(4, 5, F.lit("plain")), F.lit("\n"))
    return cues.select(F.concat_ws("#", "source", F.col("cue_index").cast("string")).alias("source"), content.alias("content"))


view("parsed_cues", "cues", """
  SELECT source || '#' || cue_index AS source, u.k AS cue_index, u.k * 120.0 + cue_index + 0.25 AS "start", u.k * 120.0 + 60 + cue_index + 0.5 AS "end",
    CASE u.k WHEN 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) WHEN 1 THEN 'zebra crossing' ELSE 'plain' END AS text
  FROM cues, (VALUES (0), (1), (2)) u(k)""")


@query("S9_parse_cues", with_views("parsed_cues") + 'SELECT source, cue_index, "start", "end", text FROM parsed_cues')
def parse_cues(spark, sf):
    return X.parse_cues(_subtitles(spark, sf))


MATCHED = "list_filter(['the', 'that', 'with', 'zebra'], lambda w: contains(lower(text), w))"


@query("S10_transcript_hits", with_views("cues") + f"""
  SELECT source, cue_index, array_to_string({MATCHED}, '|') AS keywords FROM cues WHERE len({MATCHED}) > 0""")
def transcript_hits(spark, sf):
    return X.transcript_hits(B.cues(spark, sf), WORDS).select("source", "cue_index", flat("keywords"))


_DICTIONARY = r"""
, dictionary AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM benchmark)
, words AS (SELECT keyword FROM dictionary WHERE length(keyword) BETWEEN 4 AND 9)
, found AS (SELECT source, cue_index, string_agg(keyword, '|' ORDER BY keyword) AS keywords FROM cues JOIN words ON {test} GROUP BY source, cue_index)
  SELECT * FROM found"""


def _dictionary(spark, sf):
    """Every word of four to nine letters of the benchmark passages, in alphabetical order."""
    words = B.table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).distinct()
    kept = words.where(F.length("keyword").between(4, 9))
    return global_rank(kept, [F.asc("keyword")], "place")


@query("S10_dictionary_hits", with_views("cues") + _DICTIONARY.format(test="contains(lower(text), keyword)"))
def dictionary_hits(spark, sf):
    return X.transcript_hits(B.cues(spark, sf), _dictionary(spark, sf)).select("source", "cue_index", flat("keywords"))


@query("F6_dictionary_words", with_views("cues") + _DICTIONARY.format(test="regexp_matches(lower(text), '(^|[^A-Za-z0-9])' || keyword || '($|[^A-Za-z0-9])')"))
def dictionary_words(spark, sf):
    """Joined, as a dictionary too large to ship would be."""
    rows = find_keywords(B.cues(spark, sf), "text", _dictionary(spark, sf), whole_words=True, most=0)
    return rows.where(F.size("keywords") > 0).select("source", "cue_index", flat("keywords"))


TEXT_HITS = f"""
  SELECT 'doc_' || doc_id AS source, least(doc_id % 40, 20.0) AS "end", {{text}} AS text, array_to_string({MATCHED}, '|') AS keywords
  FROM documents WHERE len({MATCHED}) > 0"""


@query("S11_text_transcript_hits", TEXT_HITS.format(text="text"))
def text_transcript_hits(spark, sf, shown=None):
    docs = B.table(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), "text", F.pmod("doc_id", F.lit(40)).cast("double").alias("duration"))
    return X.text_transcript_hits(docs, WORDS, shown=shown).select("source", "end", "text", flat("keywords"))


@query("S11_opening_characters", TEXT_HITS.format(text="substring(text, 1, 500)"))
def opening_characters(spark, sf):
    return text_transcript_hits(spark, sf, 500)


# -- signal documents ----------------------------------------------------------------------------

def _doc(df, content):
    return df.select(F.concat(F.lit("/signals/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(content).alias("content"))


def _visual_docs(spark, sf, every=False):
    h = B.object_hits(B.events(spark, sf), every)
    good = F.struct("class_name", "class_id", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), F.col("count").alias("detection_count"),
                    F.col("confidence").alias("average_confidence"))
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    bad = F.struct(F.lit("ghost").alias("class_name"), none("class_id", "int"), F.lit(9.0).alias("start_seconds"), F.lit(3.0).alias("end_seconds"), none("detection_count", "int"), none("average_confidence", "double"))
    return _doc(h, F.struct(F.array(F.struct("source", F.array(good, bad).alias("segments"))).alias("sources")))


@query("S13_read_visual_objects", with_views("every_object") + 'SELECT source, round(h_start, 4) AS "start", round(h_end, 4) AS "end", class_name, class_id, cnt AS count, confidence FROM every_object')
def read_visual_objects(spark, sf):
    return D.read_visual_objects(_visual_docs(spark, sf, True)).select("source", r4("start"), r4("end"), "class_name", "class_id", "count", "confidence")


def _advanced(spark, sf, kind, every):
    """Every event as a hit of a kind, or the hits that the signals have of it."""
    hits = B.advanced_hits(B.events(spark, sf), kind if every else None)
    return hits.where(F.col("kind") == kind)


def _ocr_docs(spark, sf, every=False):
    rows = _advanced(spark, sf, "ocr_signage", every)
    hit = lambda source, text: F.struct(source.alias("source"), text.alias("text"))
    return _doc(rows, F.struct(F.array(hit(F.col("source"), F.concat(F.lit("  SALE "), F.col("event_id").cast("string"), F.lit(" "))), hit(F.col("source"), F.lit("   ")),
                                       hit(F.lit(""), F.lit("lost"))).alias("hits")))


@query("S14_read_ocr_hits", with_views("every_ocr_signage") + "SELECT source, 'SALE ' || event_id AS text, true AS source_wide FROM every_ocr_signage")
def read_ocr_hits(spark, sf):
    return D.read_ocr_hits(_ocr_docs(spark, sf, True)).select("source", "text", "source_wide")


def _face_docs(spark, sf, every=False):
    rows = _advanced(spark, sf, "face_person", every)
    return _doc(rows, F.struct(F.array(F.struct("source", "face_count", F.when(F.col("person_count") > 0, F.col("person_count")).alias("person_count"))).alias("hits")))


@query("S15_read_face_person_hits", with_views("every_face_person") + "SELECT source, face_count, person_count, count(*) AS n FROM every_face_person GROUP BY ALL")
def read_face_person_hits(spark, sf):
    return D.read_face_person_hits(_face_docs(spark, sf, True)).groupBy("source", "face_count", "person_count").agg(F.count("*").alias("n"))


def _event_docs(spark, sf, every=False):
    rows = _advanced(spark, sf, "motorsports_event", every)
    return _doc(rows, F.struct(F.array(F.struct("source", F.col("start").alias("start_seconds"), F.lit("00:11:40").alias("end"), "event_type", "confidence",
                                                F.array(F.lit("pass")).alias("evidence"))).alias("events")))


@query("S16_read_event_hits", with_views("every_motorsports_event") + """
  SELECT source, round(h_start, 4) AS "start", 700.0 AS "end", event_type, conf AS confidence, 'pass' AS evidence FROM every_motorsports_event""")
def read_event_hits(spark, sf):
    return D.read_event_hits(_event_docs(spark, sf, True)).select("source", r4("start"), "end", "event_type", "confidence", flat("evidence"))


def _topic_docs(spark, sf, every=False):
    rows = _advanced(spark, sf, "topic_cluster", every)
    hit = F.struct("source", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), F.array(F.lit("win"), F.lit("lap")).alias("keywords"), F.lit("text").alias("text"))
    return _doc(rows, F.struct(F.array(F.struct("topic", F.array(hit, hit).alias("hits"))).alias("topics")))


@query("S17_read_topic_hits", with_views("every_topic_cluster") + """
  SELECT source, topic, round(h_start, 4) AS "start", 'win|lap' AS keywords, 2 AS n FROM every_topic_cluster""")
def read_topic_hits(spark, sf):
    rows = D.read_topic_hits(_topic_docs(spark, sf, True)).select("source", "topic", r4("start"), flat("keywords"))
    return rows.groupBy("source", "topic", "start", "keywords").agg(F.count("*").alias("n"))


def _frame_docs(spark, sf, every=False):
    rows = _advanced(spark, sf, "ai_frame_score", every)
    frame = F.struct("time_seconds", "top_score", "top_label", "labels")
    return _doc(rows, F.struct(F.array(F.struct("source", F.array(frame).alias("frames"))).alias("sources")))


@query("S18_read_ai_frame_hits", with_views("every_ai_frame_score") + """
  SELECT source, round(greatest(0, h_start - 0.5), 4) AS "start", round(h_start + 0.5, 4) AS "end", conf AS top_score, model_label AS labels FROM every_ai_frame_score""")
def read_ai_frame_hits(spark, sf):
    return D.read_ai_frame_hits(_frame_docs(spark, sf, True)).select("source", r4("start"), r4("end"), "top_score", flat("labels"))


@query("S19_load_signals", with_views("object_hits", "advanced_hits") + """
  SELECT '/media/' || source AS source, kind, count(*) AS n FROM (SELECT source, kind FROM advanced_hits UNION ALL SELECT source, 'object' FROM object_hits
    UNION ALL SELECT source, 'topic_cluster' FROM advanced_hits WHERE kind = 'topic_cluster') GROUP BY ALL""")
def load_signals(spark, sf):
    """Documents name files by basename only; the media folder knows each basename once."""
    known = B.assets(spark, sf).select(F.concat(F.lit("/media/"), "filepath").alias("source"))
    objects, advanced = D.load_signals({
        "visual-objects": _visual_docs(spark, sf), "ocr_signage": _ocr_docs(spark, sf), "face_person_presence": _face_docs(spark, sf),
        "motorsports_events": _event_docs(spark, sf), "topic_clusters": _topic_docs(spark, sf), "ai_frame_scores": _frame_docs(spark, sf)}, known)
    rows = advanced.select("source", "kind").unionByName(objects.select("source", F.lit("object").alias("kind")))
    return rows.groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("S20_validate_artifacts", with_views("ev") + """
  SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN 'unknown' WHEN 3 THEN 'ocr_signage' WHEN 2 THEN 'motorsports_events' WHEN 1 THEN 'ai_frame_scores' ELSE 'face_person' END AS kind,
    CASE WHEN event_id % 6 IN (2, 4, 5) THEN 'error' ELSE 'ok' END AS status,
    CASE event_id % 6 WHEN 5 THEN 'artifact is missing or not valid JSON' WHEN 4 THEN 'could not infer signal artifact kind' WHEN 2 THEN 'motorsports_events artifact requires events list' ELSE '' END AS errors,
    CASE event_id % 6 WHEN 0 THEN 'unexpected schema_version: v9|careful' WHEN 1 THEN 'unexpected schema_version: x.ai_frame_scores.v1|provider is missing' WHEN 2 THEN 'provider is missing'
      WHEN 4 THEN 'provider is missing' ELSE '' END AS warnings
  FROM ev""")
def validate_artifacts(spark, sf):
    """Six shapes of documents in turn, one per event."""
    ev = B.events(spark, sf)
    shapes = F.array(
        F.lit('{"artifact_kind": "face-person-presence", "hits": [], "schema_version": "v9", "provider": "x", "warnings": ["careful"]}'),
        F.lit('{"sources": [], "schema_version": "x.ai_frame_scores.v1"}'), F.lit('{"events": {"a": 1}}'),
        F.lit('{"provider": "Tesseract-OCR", "hits": []}'), F.lit('{"other": 1}'), F.lit('{"sources": [1, '))
    docs = ev.select("event_id", F.concat(F.lit("/signals/doc-"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"),
                     F.element_at(shapes, (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("content"))
    rows = D.validate_artifacts(docs)
    return rows.select(F.regexp_extract("path", r"doc-(\d+)", 1).cast("long").alias("event_id"), "kind", "status", flat("errors"), flat("warnings"))


# -- detections ------------------------------------------------------------------------------------

def _label_lines(spark, sf):
    """Four lines per event: a good one, one without confidence, two broken ones."""
    ev = B.events(spark, sf)
    frame = F.floor(F.col("t_ms") * 30 / 1000) + 1
    cls = F.pmod("event_id", F.lit(83)).cast("string")
    conf = F.concat(F.lit("0."), F.lpad((F.pmod("event_id", F.lit(100))).cast("string"), 2, "0"))
    lines = F.array(F.concat(cls, F.lit(" 0.5 0.5 0.25 0.125 "), conf), F.concat(cls, F.lit("  0.5 0.5 0.25 0.125")), F.lit("1 0.5 x 0.1 0.1"), F.lit("7 0.5"))
    return ev.select("source", F.concat(F.lit("/runs/clip_"), frame.cast("long").cast("string"), F.lit(".txt")).alias("label_file"), F.posexplode(lines).alias("line", "text"))


def _media(spark, sf):
    return B.assets(spark, sf).select(F.col("filepath").alias("source"), F.lit(30.0).alias("fps"), "duration")


def detections(spark, sf):
    return D.parse_detections(_label_lines(spark, sf), _media(spark, sf))


view("detections", "ev", """
  SELECT e.source, e.event_id, CAST(floor(t_ms * 30 / 1000) AS BIGINT) + 1 AS frame, event_id % 83 AS class_id, u.k, CASE u.k WHEN 0 THEN (event_id % 100) / 100.0::DOUBLE END AS confidence,
    round_even(floor(t_ms * 30 / 1000) / 30.0::DOUBLE, 3) AS time_seconds,
    CASE WHEN event_id % 83 = 0 THEN 'person' WHEN event_id % 83 = 79 THEN 'toothbrush' WHEN event_id % 83 >= 80 THEN 'class_' || event_id % 83 ELSE 'named' END AS class_name
  FROM ev e, (VALUES (0), (1)) u(k)""")


def _edge():
    return F.when(F.col("class_id").isin(0, 79) | (F.col("class_id") >= 80), F.col("class_name")).otherwise("named").alias("class_name")


@query("S21_parse_detections", with_views("detections") + "SELECT source, frame, class_id, class_name, confidence, time_seconds FROM detections")
def parse_detections(spark, sf):
    return detections(spark, sf).select("source", "frame", "class_id", _edge(), "confidence", "time_seconds")


@query("A12_class_summary", with_views("detections") + """
  SELECT source, class_id, count(*) AS count, count(DISTINCT frame) AS frame_count, round_even(avg(confidence), 4) AS average_confidence, min(time_seconds) AS first_seen_seconds,
    max(time_seconds) AS last_seen_seconds FROM detections GROUP BY source, class_id""")
def class_summary(spark, sf):
    return G.class_summary(detections(spark, sf)).drop("class_name")


def _coarse(spark, sf):
    """Few classes, so that detections of one class come close together."""
    return detections(spark, sf).withColumns({"class_id": F.pmod("class_id", F.lit(3)), "class_name": F.lit("x")})


@query("W2_detection_segments", with_views("detections") + """
, coarse AS (SELECT * REPLACE (class_id % 3 AS class_id) FROM detections)
, flagged AS (SELECT *, CASE WHEN time_seconds > lag(time_seconds) OVER w + 20 OR lag(time_seconds) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM coarse
    WINDOW w AS (PARTITION BY source, class_id ORDER BY time_seconds, event_id, k))
, numbered AS (SELECT *, sum(opens) OVER (PARTITION BY source, class_id ORDER BY time_seconds, event_id, k ROWS UNBOUNDED PRECEDING) AS seg FROM flagged)
  SELECT source, class_id, min(time_seconds) AS "start", round_even(least(720.0::DOUBLE, max(time_seconds) + 1 / 30.0::DOUBLE), 3) AS "end", count(*) AS detection_count,
    count(DISTINCT frame) AS frame_count, round(sum(confidence), 2) AS confidence
  FROM numbered GROUP BY source, class_id, seg""")
def detection_segments(spark, sf):
    """Sums of confidence, which every second detection has: SQL rounds a mean on its binary value."""
    return G.detection_segments(_coarse(spark, sf), _media(spark, sf), gap=20.0).withColumn("confidence", F.round(F.col("average_confidence") * F.col("detection_count") / 2, 2)).drop("class_name", "segment_rank", "average_confidence")


@query("W2_busiest_segments", f"""
SELECT source, class_id, "start", "end", detection_count FROM ({ORACLE["W2_detection_segments"]})
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY detection_count DESC, "start", class_id) <= 3""")
def busiest_segments(spark, sf):
    return G.detection_segments(_coarse(spark, sf), _media(spark, sf), gap=20.0, keep=3).select("source", "class_id", "start", "end", "detection_count")


@query("A13_listed_detections", with_views("detections") + """
  SELECT source, frame, row_number() OVER (PARTITION BY source ORDER BY frame) AS n FROM detections""")
def listed_detections(spark, sf):
    return G.listed_detections(detections(spark, sf)).select("source", "frame", "n")


@query("A13_source_summaries", with_views("every_object") + """
  SELECT source, sum(CASE WHEN cnt = 0 THEN 1 ELSE cnt END) AS count, 0 AS detection_count, 0 AS segment_count, 0 AS class_count, round_even(avg(confidence), 4) AS average_confidence
  FROM every_object GROUP BY source""")
def source_summaries(spark, sf):
    return G.source_summaries(B.object_hits(B.events(spark, sf), True))


# -- documents of review -----------------------------------------------------------------------------

def _selection_docs(spark, sf):
    """One selection per event: a clip by display time, one by seconds, one without source, one reversed."""
    ev = B.events(spark, sf)
    s = F.floor("t").cast("long")
    none = F.lit(None).cast("string")
    clip = lambda source, start, end, a, b, label: F.struct(
        source.alias("source"), start.alias("start"), end.alias("end"), a.alias("start_seconds"), b.alias("end_seconds"), label.alias("label"))
    nil = F.lit(None).cast("double")
    clips = F.array(
        clip(F.col("source"), F.lit("00:00:05"), F.lit("00:00:09.5"), F.lit(1.0), F.lit(2.0), F.lit("own")),
        clip(none, none, none, s.cast("double"), s + 7.5, none),
        clip(F.lit("mixed"), none, none, F.lit(1.0), F.lit(2.0), none), clip(none, F.lit("00:01:00"), F.lit("00:00:30"), nil, nil, none))
    return _doc(ev, F.struct(F.lit("show").alias("project"), F.lit("main.mp4").alias("source"), F.when(F.pmod("event_id", F.lit(2)) == 0, 24.0).alias("fps"), clips.alias("clips")))


@query("S22_load_selection", with_views("ev") + """
  SELECT '/signals/' || event_id || '.json' AS selection, u.k AS clip_index, CASE u.k WHEN 1 THEN source WHEN 3 THEN 'mixed' ELSE 'main.mp4' END AS source,
    CASE u.k WHEN 1 THEN 'own' ELSE format('clip_{:03d}', u.k) END AS label,
    CASE u.k WHEN 1 THEN '00:00:05' WHEN 3 THEN '00:00:01' WHEN 4 THEN '00:01:00' ELSE printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS "start",
    CASE u.k WHEN 1 THEN '00:00:09.5' WHEN 3 THEN '00:00:02' WHEN 4 THEN '00:00:30' ELSE printf('%02d:%02d:%02d', (s + 7) // 3600, (s + 7) % 3600 // 60, (s + 7) % 60) END AS "end",
    CASE WHEN event_id % 2 = 0 THEN 24.0 ELSE 30.0 END AS fps, CASE u.k WHEN 3 THEN 'missing source' WHEN 4 THEN 'non-positive duration' END AS error
  FROM (SELECT *, CAST(floor(t) AS BIGINT) AS s FROM ev), (VALUES (1), (2), (3), (4)) u(k)""")
def load_selection(spark, sf):
    rows = D.load_selection(_selection_docs(spark, sf))
    return rows.select("selection", "clip_index", "source", "label", "start", "end", "fps", "error")


def _annotation_docs(spark, sf):
    ev = B.events(spark, sf)
    clip = F.struct(F.concat(F.lit("x/"), "source").alias("source"), F.lit("00:00:10").alias("start"),
                    F.when(F.pmod("event_id", F.lit(7)) == 0, "5").otherwise("12.5").alias("end"),
                    F.element_at(F.array(*[F.lit(v) for v in (" Select", "BROLL", "ignore", "great")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("rating"),
                    F.when(F.pmod("event_id", F.lit(2)) == 0, '["quote","b roll"]').otherwise("quote, , wide").alias("tags"))
    return _doc(ev, F.struct(F.lit("cal").alias("project"), F.array(clip, clip).alias("clips")))


@query("S23_load_annotations", with_views("ev") + """
  SELECT source AS canonical_source, CASE WHEN event_id % 2 = 0 THEN 'quote|b roll' ELSE 'quote|wide' END AS tags, ['select', 'broll', 'ignore', 'great'][CAST(event_id % 4 AS INT) + 1] AS rating,
    format('annotation_{:04d}', u.k) AS id, CASE WHEN event_id % 4 = 3 THEN 'unsupported annotation rating: great' WHEN event_id % 7 = 0 THEN 'end must be after start' END AS error, count(*) AS n
  FROM ev, (VALUES (1), (2)) u(k) GROUP BY ALL""")
def load_annotations(spark, sf):
    known = B.assets(spark, sf).select(F.col("filepath").alias("source"))
    rows = D.load_annotations(_annotation_docs(spark, sf), known).withColumn("tags", F.array_join("tags", "|"))
    return rows.groupBy("canonical_source", "tags", "rating", "id", "error").agg(F.count("*").alias("n"))


def _decision_docs(spark, sf):
    d = B.decisions(spark, sf).withColumn("event_id", F.col("order"))
    listed = _doc(d.where(F.pmod("order", F.lit(3)) == 0), F.struct(F.array(F.struct("id", "decision", "order", "note")).alias("decisions")))
    word = d.where(F.pmod("order", F.lit(3)) == 1).select("event_id", F.create_map("id", "decision").alias("decisions"))
    full = d.where(F.pmod("order", F.lit(3)) == 2).select("event_id", F.create_map("id", F.struct("decision", F.col("order").alias("order"), "note")).alias("m"))
    return listed.unionByName(_doc(word, F.struct("decisions"))).unionByName(_doc(full, F.col("m")))


@query("S24_load_decisions", with_views("decisions") + """
  SELECT id, decision, CASE WHEN "order" % 3 <> 1 THEN "order" END AS "order", CASE WHEN "order" % 3 <> 1 THEN note ELSE '' END AS note FROM decisions""")
def load_decisions(spark, sf):
    return D.load_decisions(_decision_docs(spark, sf)).select("id", "decision", "order", "note")


def _judgment_docs(spark, sf):
    d = B.decisions(spark, sf).withColumn("event_id", F.col("order"))
    clip = lambda i, score, labels: F.struct(i.alias("clip_id"), score.alias("score"), F.create_map(F.lit("hook"), F.lit(0.5)).alias("score_dimensions"),
                                             F.lit("review").alias("suggested_action"), labels.alias("labels"), F.lit("clear").alias("reason"))
    return _doc(d, F.struct(F.lit("ok").alias("status"), F.array(
        clip(F.col("id"), F.pmod("order", F.lit(100)).cast("double"), F.array(F.lit("a"), F.lit("b"))), clip(F.lit(" "), F.lit(1.0), F.array(F.lit("c"))),
        clip(F.col("id"), F.lit(77.5), F.array(F.lit("d")))).alias("clips")))


@query("S25_load_clip_judgments", with_views("decisions") + """
  SELECT id, ("order" % 100)::DOUBLE AS first_score, 77.5 AS second_score, 'a|b' AS labels, 2 AS n FROM decisions""")
def load_clip_judgments(spark, sf):
    rows = D.load_clip_judgments(_judgment_docs(spark, sf))
    at = lambda i: F.element_at("ai_explanations", i)
    return rows.select("id", at(1)["score"].alias("first_score"), at(2)["score"].alias("second_score"), F.array_join(at(1)["labels"], "|").alias("labels"), F.size("ai_explanations").alias("n"))


# -- topics and events --------------------------------------------------------------------------------

TOPICS = {"common": ["the", "und", "les"], "rare": ["zebra", "with"], "spanish": ["que", "los"]}


def _word(w):
    return f"regexp_matches(text, '(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])')"


def _topic_sql():
    parts = " UNION ALL ".join(
        f"SELECT source, '{t}' AS topic, list_filter([{', '.join(f'CASE WHEN {_word(w)} THEN {chr(39)}{w}{chr(39)} END' for w in ws)}], lambda x: x IS NOT NULL) AS found FROM low"
        for t, ws in TOPICS.items())
    return with_views("cues") + f", low AS (SELECT source, lower(text) AS text FROM cues), t AS ({parts})"


@query("A14_topic_clusters", _topic_sql() + """
  SELECT topic, count(*) AS count, array_to_string(list_sort(list_distinct(flatten(list(found)))), '|') AS keywords FROM t WHERE len(found) > 0 GROUP BY topic""")
def topic_clusters(spark, sf):
    hits = B.cues(spark, sf).withColumn("keywords", F.array().cast("array<string>"))
    return G.topic_clusters(hits, TOPICS).select("topic", "count", flat("keywords"))


@query("F6_matched_keywords", _topic_sql() + "SELECT source, topic, array_to_string(found, '|') AS matched, count(*) AS n FROM t WHERE len(found) > 0 GROUP BY ALL")
def matched_keywords(spark, sf):
    hits = B.cues(spark, sf).withColumn("keywords", F.array().cast("array<string>"))
    rows = G.topic_hits(hits, TOPICS).withColumn("matched", F.array_join("matched", "|"))
    return rows.groupBy("source", "topic", "matched").agg(F.count("*").alias("n"))


def _event_sql():
    from clipsieve.functions.vocab import EVENT_KEYWORDS

    parts = " UNION ALL ".join(
        f"SELECT \"rank\", score, '{t}' AS event_type, list_filter([{', '.join(f'CASE WHEN {_word(w)} THEN {chr(39)}{w}{chr(39)} END' for w in ws)}], lambda x: x IS NOT NULL) AS evidence FROM low"
        for t, ws in EVENT_KEYWORDS.items())
    return with_views("cands") + f"""
, low AS (SELECT "rank", score, lower(concat_ws(' ', id, source, array_to_string(labels, ' '), array_to_string(reasons, ' '))) AS text FROM cands)
, found AS (SELECT * FROM ({parts}) WHERE len(evidence) > 0)
, inferred AS (SELECT "rank", score, CASE
    WHEN list_has_any(labels, ['object_car', 'object_truck', 'object_motorcycle']) AND list_contains(labels, 'audio_spike') THEN {{t: 'vehicle_action', e: ['object_vehicle', 'audio_spike']}}
    WHEN list_contains(labels, 'motorsports_event') THEN {{t: 'motorsports_context', e: ['motorsports_event']}}
    WHEN contains(lower(array_to_string(reasons, ' ')), 'engine') AND list_contains(labels, 'audio_spike') THEN {{t: 'mechanical', e: ['engine', 'audio_spike']}}
    WHEN list_contains(labels, 'audio_spike') AND list_has_any(labels, ['scene_change', 'scene_cluster']) THEN {{t: 'high_energy', e: ['audio_spike', 'scene_change']}}
    WHEN list_contains(labels, 'scene_cluster') THEN {{t: 'visual_activity', e: ['scene_cluster']}} END AS i FROM cands WHERE "rank" NOT IN (SELECT "rank" FROM found))
, every AS (SELECT * FROM found UNION ALL SELECT "rank", score, i.t, i.e FROM inferred WHERE i IS NOT NULL)
  SELECT * FROM (SELECT format('clip_{{:04d}}', "rank") AS id, event_type, array_to_string(evidence, '|') AS evidence,
    round_even(least(1.0, 0.35::DOUBLE + score / 200.0::DOUBLE + least(0.3::DOUBLE, len(evidence) * 0.1::DOUBLE)), 3) AS confidence FROM every) WHERE confidence >= 0.2"""


@query("A15_detect_events", _event_sql())
def detect_events(spark, sf):
    return G.detect_events(B.candidates(spark, sf)).select("id", "event_type", flat("evidence"), "confidence")


# -- incremental batches -------------------------------------------------------------------------------

@query("J18_incremental_sources", """
  SELECT '/media/user_' || user_id || '.mp4' AS path, n AS length FROM (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id)
  WHERE user_id % 3 = 0 OR last % 2 = 0""")
def incremental_sources(spark, sf):
    """State of an earlier run: two thirds of the files, half of them since changed."""
    files = B.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("length"), F.max("event_id").alias("modificationTime")).withColumn(
        "path", F.concat(F.lit("/media/user_"), F.col("user_id").cast("string"), F.lit(".mp4")))
    key = N.analysis_key(B.FULL)
    before = files.where(F.pmod("user_id", F.lit(3)) != 0).withColumn("modificationTime", F.col("modificationTime") + F.when(F.pmod("modificationTime", F.lit(2)) == 0, 1).otherwise(0))
    state = before.withColumn("signature", N.signature(key))
    return N.incremental_sources(files, state, key).select("path", "length")
