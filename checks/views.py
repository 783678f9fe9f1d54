"""SQL twins of the driver-table views and of the shared rating chain, as CTE texts.

``with_views("levels", ...)`` returns a ``WITH`` clause that holds the named views and
everything they need, in order.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (tuple(needs.split()), sql)


def with_views(*names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in VIEWS[name][0]:
            visit(need)
        order.append(name)

    for n in names:
        visit(n)
    body = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n"


def pick(values, divisor: int = 1) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"[{items}][CAST((event_id // {divisor}) % {len(values)} AS INT) + 1]"


SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'), ''), 'object')"


def slug(x: str) -> str:
    return SLUG.format(x)


view("ev", "", """
  SELECT event_id, 'user_' || user_id || '.mp4' AS source, user_id,
         (epoch_us(ts) - 1704067200000000) / CAST(3600000000 AS DOUBLE) AS t, value, event_type,
         (epoch_us(ts) - 1704067200000000) // 3600000 AS t_ms
  FROM events""")
view("assets", "", """
  SELECT 'user_' || user_id || '.mp4' AS source, user_id, CAST(n AS DOUBLE) AS size_mb,
         CAST(720 AS DOUBLE) AS duration,
         [3840, 1920, 1280, 640][CAST(user_id % 4 AS INT) + 1] AS width,
         [2160, 1080, 720, 480][CAST(user_id % 4 AS INT) + 1] AS height, 'h264' AS codec,
         CAST([60, 30, 24][CAST(user_id % 3 AS INT) + 1] AS DOUBLE) AS fps, user_id % 7 <> 0 AS has_audio,
         'ok' AS status
  FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""")
view("levels", "ev", "SELECT source, t AS time, value / 10.0::DOUBLE - 40.0::DOUBLE AS rms_db FROM ev WHERE event_type IN ('click', 'view')")
view("scenes", "ev", "SELECT source, t AS time FROM ev WHERE event_type = 'signup'")
view("silences", "ev", """
  SELECT source, t AS "start", least(t + value / 20.0::DOUBLE, 720.0::DOUBLE) AS "end" FROM ev WHERE event_type = 'error'""")
view("object_hits", "ev", f"""
  SELECT event_id, source, t AS h_start, t + value / 50.0::DOUBLE AS h_end,
         {pick(("person", "car", "truck", "dog", "bicycle"))} AS class_name, event_id % 5 AS class_id,
         event_id % 20 + 1 AS cnt, (event_id % 100) / 100.0::DOUBLE AS confidence
  FROM ev WHERE event_type = 'purchase'""")
view("interesting", "object_hits", "SELECT * FROM object_hits WHERE class_name IN ('person', 'car', 'truck', 'motorcycle', 'bicycle', 'bus', 'traffic light', 'stop sign')")
view("transcript_hits", "ev", f"""
  SELECT event_id, source, t AS h_start, t + 1.0::DOUBLE + value / 100.0::DOUBLE AS h_end,
         {pick(("pass", "lap", "win"))} AS word
  FROM ev WHERE event_type = 'view'""")
view("advanced_hits", "ev", f"""
  SELECT event_id, source, kind, wide, CASE WHEN wide THEN 0.0::DOUBLE ELSE t END AS h_start,
         CASE WHEN wide THEN 0.0::DOUBLE ELSE t + 1.0::DOUBLE END AS h_end,
         CASE WHEN kind = 'face_person' THEN event_id % 3 ELSE 0 END AS face_count,
         CASE WHEN kind = 'face_person' THEN event_id % 4 ELSE 0 END AS person_count,
         CASE WHEN kind = 'motorsports_event' THEN {pick(("pass", "incident", "pit"), 5)} END AS event_type,
         CASE WHEN kind = 'topic_cluster' THEN {pick(("racecraft", "results"), 5)} END AS topic,
         CASE WHEN kind = 'ai_frame_score' THEN {pick(("ai_broll_candidate", "ai_reel_opener", "ai_vehicle_action"), 5)} END AS model_label,
         (event_id % 97) / 100.0::DOUBLE AS conf
  FROM (SELECT *, kind IN ('ocr_signage', 'face_person') AS wide
        FROM (SELECT *, {pick(("ocr_signage", "face_person", "motorsports_event", "topic_cluster", "ai_frame_score"))} AS kind
              FROM ev WHERE event_type = 'error'))""")
# Every event as a detection, and as a hit of one kind.
view("every_object", "ev", VIEWS["object_hits"][1].replace("WHERE event_type = 'purchase'", ""))
KINDS = ("ocr_signage", "face_person", "motorsports_event", "topic_cluster", "ai_frame_score")
for _kind in KINDS:
    view(f"every_{_kind}", "ev", VIEWS["advanced_hits"][1].replace(pick(KINDS), f"'{_kind}'").replace("WHERE event_type = 'error'", ""))
view("technical", "assets", """
  SELECT source, least(20.0::DOUBLE, 5.0 + CASE WHEN width * height >= 3840 * 2160 THEN 6 WHEN width * height >= 1920 * 1080 THEN 5
           WHEN width * height >= 1280 * 720 THEN 3 ELSE 1 END
         + CASE WHEN fps >= 59 THEN 4 WHEN fps >= 29 THEN 3 ELSE 1 END
         + CASE WHEN duration BETWEEN 3 AND 3600 THEN 4 WHEN duration > 0 THEN 2 ELSE 0 END + 1) AS technical_score
  FROM assets""")
view("thresholds", "levels", """
  SELECT source, greatest(-35.0::DOUBLE, list_sort(list(rms_db))[CAST(floor((count(*) - 1) * 0.85::DOUBLE) AS BIGINT) + 1]) AS threshold
  FROM levels GROUP BY source""")
view("spikes", "levels thresholds", "SELECT l.* FROM levels l JOIN thresholds USING (source) WHERE rms_db >= threshold")
view("advanced_labels", "advanced_hits", """
  SELECT *, CASE WHEN kind = 'ai_frame_score' THEN coalesce(model_label, 'ai_frame_score') ELSE kind END AS main_label,
    list_distinct(list_filter([
      CASE WHEN kind = 'ai_frame_score' THEN coalesce(model_label, 'ai_frame_score') ELSE kind END,
      CASE WHEN face_count > 0 THEN 'face_presence' END, CASE WHEN person_count > 0 THEN 'person_presence' END,
      'motorsports_' || event_type, 'topic_' || topic, model_label], lambda x: x IS NOT NULL)) AS hit_labels
  FROM advanced_hits""")
view("seeds", "scenes spikes transcript_hits interesting advanced_labels", """
  SELECT source, time - 3 AS "start", time + 9 AS "end", ['scene_change'] AS labels FROM scenes
  UNION ALL SELECT source, time - 3, time + 9, ['audio_spike'] FROM spikes
  UNION ALL SELECT source, greatest(0, h_start - 3), h_end + 9, ['transcript_hit'] FROM transcript_hits
  UNION ALL SELECT source, greatest(0, h_start - 1), h_end + 2, ['object_presence', 'object_' || class_name] FROM interesting
  UNION ALL SELECT source, greatest(0, h_start - 3), h_end + 9, [main_label] FROM advanced_labels
            WHERE NOT wide""")
view("clamped", "seeds assets", """
  SELECT source, greatest(0, least("start", duration)) AS "start",
         greatest(greatest(0, least("start", duration)), least("end", duration)) AS "end", labels
  FROM (SELECT * FROM seeds UNION ALL
        SELECT source, 0.0, least(duration, 12.0), ['low_signal'] FROM assets
        WHERE source NOT IN (SELECT source FROM seeds)) JOIN assets USING (source)""")
MERGE = """
  SELECT {keys}, min("start") AS "start", max("end") AS "end", list_sort(list_distinct(flatten(list(labels)))) AS labels
  FROM (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end"
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS opens
              FROM {table}))
  GROUP BY {keys}, island"""
view("merged", "clamped", MERGE.format(keys="source", gap="4", table="clamped"))
view("windows", "merged", 'SELECT * FROM merged WHERE "end" - "start" >= 1.0')
view("w_scene", "windows scenes", """
  SELECT source, "start", count(*) AS scene_changes FROM windows JOIN scenes s USING (source)
  WHERE s.time BETWEEN "start" AND "end" GROUP BY ALL""")
view("w_level", "windows levels", """
  SELECT source, "start", max(rms_db) AS peak FROM windows JOIN levels l USING (source)
  WHERE l.time BETWEEN "start" AND "end" GROUP BY ALL""")
view("w_silence", "windows silences", """
  SELECT w.source, w."start", sum(greatest(0, least(w."end", s."end") - greatest(w."start", s."start"))) AS silence_overlap
  FROM windows w JOIN silences s ON w.source = s.source AND least(w."end", s."end") > greatest(w."start", s."start") GROUP BY ALL""")
view("w_transcript", "windows transcript_hits", """
  SELECT source, "start", count(*) AS transcript_hits, list_sort(list_distinct(list(word))) AS words
  FROM windows JOIN transcript_hits USING (source)
  WHERE h_start BETWEEN "start" AND "end" OR h_end BETWEEN "start" AND "end" GROUP BY ALL""")
view("w_object", "windows interesting", """
  SELECT source, "start", count(*) AS object_hits, list_sort(list_distinct(list(class_name))) AS classes,
         sum(greatest(1, cnt)) AS detections
  FROM windows JOIN interesting USING (source) WHERE least("end", h_end) > greatest("start", h_start) GROUP BY ALL""")
ADVANCED = """count(*) FILTER (kind = 'ocr_signage') AS ocr_hits, count(*) FILTER (kind = 'face_person') AS face_person_hits,
         count(*) FILTER (kind = 'motorsports_event') AS motorsports_events, count(*) FILTER (kind = 'topic_cluster') AS topic_hits,
         count(*) FILTER (kind = 'ai_frame_score') AS ai_frame_scores,
         sum(face_count) AS face_total, sum(person_count) AS person_total,
         coalesce(sum(conf) FILTER (kind = 'motorsports_event'), 0) AS event_confidence,
         coalesce(sum(conf) FILTER (kind = 'ai_frame_score'), 0) AS ai_confidence,
         list_sort(list_distinct(list(event_type) FILTER (event_type IS NOT NULL))) AS event_types,
         list_sort(list_distinct(list(topic) FILTER (topic IS NOT NULL))) AS topics,
         list_sort(list_distinct(list(model_label) FILTER (model_label IS NOT NULL))) AS ai_labels,
         list_sort(list_distinct(flatten(list(hit_labels)))) AS advanced_labels"""
view("w_advanced", "windows advanced_labels", f"""
  SELECT source, "start", {ADVANCED}
  FROM windows JOIN advanced_labels USING (source)
  WHERE wide OR least("end", h_end) > greatest("start", h_start) GROUP BY source, "start" """)
ADVANCED_SCORES = """least(8.0, ocr_hits * 4.0) AS ocr_signage_score,
         least(6.0, face_total * 1.5 + person_total * 0.75) AS face_person_score,
         least(12.0, motorsports_events * 5.0 + event_confidence * 4.0) AS motorsports_event_score,
         least(10.0, topic_hits * 5.0) AS topic_cluster_score,
         least(10.0, ai_frame_scores * 2.0 + ai_confidence * 6.0) AS ai_frame_score"""
view("facts", "windows w_scene w_level w_silence w_transcript w_object w_advanced technical", """
  SELECT w.source, w."start", w."end", w.labels AS seed_labels, t.technical_score, coalesce(scene_changes, 0) AS scene_changes,
         peak, coalesce(silence_overlap, 0) AS silence_overlap,
         coalesce(silence_overlap, 0) / greatest(0.1, w."end" - w."start") AS silence_ratio,
         coalesce(transcript_hits, 0) AS transcript_hits, coalesce(words, []) AS words,
         coalesce(object_hits, 0) AS object_hits, coalesce(classes, []) AS classes, coalesce(detections, 0) AS detections,
         coalesce(ocr_hits, 0) AS ocr_hits, coalesce(face_person_hits, 0) AS face_person_hits,
         coalesce(motorsports_events, 0) AS motorsports_events, coalesce(topic_hits, 0) AS topic_hits,
         coalesce(ai_frame_scores, 0) AS ai_frame_scores, coalesce(face_total, 0) AS face_total,
         coalesce(person_total, 0) AS person_total, coalesce(event_confidence, 0) AS event_confidence,
         coalesce(ai_confidence, 0) AS ai_confidence, coalesce(event_types, []) AS event_types, coalesce(topics, []) AS topics,
         coalesce(ai_labels, []) AS ai_labels, coalesce(advanced_labels, []) AS advanced_labels
  FROM windows w JOIN technical t USING (source)
  LEFT JOIN w_scene USING (source, "start") LEFT JOIN w_level USING (source, "start")
  LEFT JOIN w_silence USING (source, "start") LEFT JOIN w_transcript USING (source, "start")
  LEFT JOIN w_object USING (source, "start") LEFT JOIN w_advanced USING (source, "start")""")
AUDIO = """CASE WHEN silence_ratio > 0.6 THEN greatest(0, tier - 10) ELSE tier END"""
view("components", "facts", f"""
  SELECT *, least(25.0, scene_changes * 8.0) AS visual_activity_score, {AUDIO} AS audio_interest_score,
         least(20.0, transcript_hits * 10.0) AS transcript_score,
         least(10.0::DOUBLE, object_hits * 2.0 + len(classes) * 2.0 + least(6.0::DOUBLE, detections / 200.0::DOUBLE)) AS object_presence_score,
         {ADVANCED_SCORES}
  FROM (SELECT *, CASE WHEN peak IS NULL THEN 0.0 WHEN peak >= -18 THEN 30 WHEN peak >= -25 THEN 22 WHEN peak >= -35 THEN 14 ELSE 6 END AS tier
        FROM facts)""")
TOTAL = """CAST(round_even(least(100.0::DOUBLE, technical_score + visual_activity_score + audio_interest_score + transcript_score
         + object_presence_score + ocr_signage_score + face_person_score + motorsports_event_score + topic_cluster_score + ai_frame_score), 0) AS INT)"""
def scored_sql(classes="", names=""):
    """``classes`` and ``names`` cut the lists of a short report."""
    return f"""
  SELECT *, CASE WHEN score >= 85 THEN 'select' WHEN score >= 70 THEN 'review' WHEN score >= 55 THEN 'broll' ELSE 'cut' END AS action,
    list_sort(list_distinct(list_filter(seed_labels || advanced_labels || list_transform(classes{classes}, lambda c: 'object_' || c) || [
      CASE WHEN scene_changes > 1 THEN 'scene_cluster' WHEN scene_changes = 1 THEN 'scene_change' END,
      CASE WHEN peak >= -35 THEN 'audio_spike' WHEN peak IS NOT NULL THEN 'audio_present' END,
      CASE WHEN silence_ratio > 0.6 THEN 'mostly_silent' END,
      CASE WHEN transcript_hits > 0 THEN 'transcript_hit' END, CASE WHEN object_hits > 0 THEN 'object_presence' END],
      lambda x: x IS NOT NULL))) AS labels,
    list_filter([
      CASE WHEN scene_changes > 0 THEN scene_changes || ' scene change' || CASE WHEN scene_changes = 1 THEN '' ELSE 's' END || ' in window' END,
      CASE WHEN peak IS NOT NULL THEN 'audio peak ' || CAST(round_even(peak, 1) AS DECIMAL(20, 1)) || ' dB RMS' END,
      CASE WHEN silence_ratio > 0.6 THEN 'mostly silent window' END,
      CASE WHEN transcript_hits > 0 THEN 'transcript keywords: ' || array_to_string(words{names}, ', ') END,
      CASE WHEN object_hits > 0 THEN 'objects detected: ' || array_to_string(classes{names}, ', ') END,
      CASE WHEN ocr_hits > 0 THEN 'OCR/signage text detected' END,
      CASE WHEN face_total <> 0 OR person_total <> 0 THEN 'face/person presence detected (' || face_total || ' faces, ' || person_total || ' people)' END,
      CASE WHEN len(event_types) > 0 THEN 'motorsports events: ' || array_to_string(event_types{names}, ', ') END,
      CASE WHEN len(topics) > 0 THEN 'transcript topics: ' || array_to_string(topics{names}, ', ') END,
      CASE WHEN ai_frame_scores > 0 THEN 'AI frame matches: ' || array_to_string(ai_labels{names}, ', ') END,
      CASE WHEN list_contains(seed_labels, 'low_signal') THEN 'fallback candidate; no strong highlight signal found' END],
      lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, {TOTAL} AS score FROM components)"""


view("scored", "components", scored_sql())
view("scored_short", "components", scored_sql("[1:4]", "[1:6]"))
view("cands", "scored", """
  SELECT *, format('clip_{:04d}', "rank") AS id
  FROM (SELECT *, row_number() OVER (ORDER BY score DESC, source, "start") AS "rank" FROM scored)""")
view("cands_short", "scored_short", """
  SELECT * FROM (SELECT *, format('clip_{:04d}', "rank") AS id
  FROM (SELECT *, row_number() OVER (ORDER BY score DESC, source, "start") AS "rank" FROM scored_short)) WHERE "rank" <= 50""")
view("annotations", "ev", f"""
  SELECT event_id AS ann_index, format('annotation_{{:04d}}', event_id) AS id, source, greatest(0, t - 2) AS "start",
         least(720.0::DOUBLE, t + 6) AS "end", {pick(("select", "review", "broll", "reject", "ignore"))} AS rating, event_type AS tag
  FROM ev WHERE event_type IN ('signup', 'purchase')""")
view("decisions", "", """
  SELECT format('clip_{:04d}', doc_id + 1) AS id,
         CASE WHEN toxic = 1 THEN 'ignore' WHEN quality = 1 THEN 'approve' ELSE 'reject' END AS decision,
         CAST(doc_id AS INT) AS "order", 'note ' || doc_id AS note
  FROM labels""")
view("cues", "", """
  SELECT 'conv_' || conv_id || '.mp4' AS source, CAST(turn AS INT) AS cue_index, turn * 10.0::DOUBLE AS "start",
         turn * 10.0::DOUBLE + 8 AS "end", text FROM conversations""")
view("frame_vectors", "", """
  SELECT 'user_' || (vec_id % 20) || '.mp4' AS source, (vec_id // 20) * 10.0::DOUBLE AS time, embedding AS vector FROM embeddings""")
