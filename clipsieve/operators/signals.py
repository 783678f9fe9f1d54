"""Signals from detections and text: classes, segments, events, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators import intervals as I
from clipsieve.operators.ranking import rank_per_group, top_per_group


def class_summary(detections: DataFrame, keys: list[str] = ("source",)) -> DataFrame:
    """Per class: detections, distinct frames, mean confidence, first and last time seen."""
    return detections.groupBy(*keys, "class_id").agg(
        F.min("class_name").alias("class_name"), F.count("*").alias("count"), F.count_distinct("frame").alias("frame_count"),
        F.bround(F.avg("confidence"), 4).alias("average_confidence"),
        F.bround(F.min("time_seconds"), 3).alias("first_seen_seconds"), F.bround(F.max("time_seconds"), 3).alias("last_seen_seconds"),
    )


def detection_segments(
    detections: DataFrame, media: DataFrame, gap: float = 1.0, keep: int | None = None, width: float = I.CHUNK_SECONDS
) -> DataFrame:
    """Runs of one class: a new segment starts when the time since the previous detection exceeds ``gap``.

    Confidences are summed as decimals of six places, so their mean doesn't depend on the order of rows.

    ``media`` gives ``source, fps, duration``.  Segments of a source are ranked, the busiest first; with ``keep``, so many stay.
    """
    timed = detections.where(F.col("time_seconds").isNotNull())
    keys = ["source", "class_id"]
    # Detections of one instant count together before anything is ordered.
    instants = timed.groupBy(*keys, "time_seconds").agg(
        F.min("class_name").alias("class_name"), F.count("*").alias("n"), F.sum(F.col("confidence").cast("decimal(20,6)")).alias("conf"), F.count("confidence").alias("conf_n"),
        F.array_distinct(F.collect_set("frame")).alias("frames"),
    )
    islands = I.with_islands(instants, keys, F.lit(float(gap)), "time_seconds", "time_seconds", width)
    grouped = islands.groupBy(*keys, "island").agg(
        F.min("class_name").alias("class_name"), F.max("time_seconds").alias("last"), F.sum("n").alias("detection_count"),
        F.sum("conf").alias("conf"), F.sum("conf_n").alias("conf_n"),
        # Frames ascend with time, so an instant's frames belong to it alone.
        F.sum(F.size("frames")).alias("frame_count"),
    )
    rows = grouped.join(media.select("source", "fps", "duration"), "source", "left")
    step = F.when(F.col("fps") > 0, F.lit(1.0) / F.col("fps")).otherwise(0.0)
    raw_end = F.col("last") + step
    end = F.greatest(F.col("island"), F.when(F.col("duration") != 0, F.least("duration", raw_end)).otherwise(raw_end))
    rows = rows.select(
        "source", "class_id", "class_name", F.bround("island", 3).alias("start"), F.bround(end, 3).alias("end"), "detection_count", "frame_count",
        F.when(F.col("conf_n") > 0, F.bround(F.try_divide(F.col("conf").cast("double"), "conf_n"), 4)).alias("average_confidence"),
    )
    order = [F.desc("detection_count"), F.asc("start"), F.asc("class_id")]
    return rank_per_group(rows, ["source"], order, "segment_rank") if keep is None else top_per_group(rows, ["source"], order, keep, "segment_rank")


def listed_detections(detections: DataFrame, keep: int | None = None) -> DataFrame:
    """The detections of each source in frame order, with their place ``n``; with ``keep``, the first so many."""
    order = [F.coalesce("frame", F.lit(0)), F.asc("label_file"), F.asc("line")]
    return rank_per_group(detections, ["source"], order, "n") if keep is None else top_per_group(detections, ["source"], order, keep, "n")


def source_summaries(records: DataFrame) -> DataFrame:
    """Totals per source over records with any of ``count, detection_count, segments, class_counts, confidence, average_confidence``."""
    has = lambda n: n in records.columns
    number = lambda n, default: F.coalesce(F.col(n), F.lit(default)) if has(n) else F.lit(default)
    count = F.when(number("count", 1) == 0, 1).otherwise(number("count", 1))
    size = lambda n: F.greatest(F.lit(0), F.coalesce(F.size(n), F.lit(0))) if has(n) else F.lit(0)
    values = [F.col(n) for n in ("confidence", "average_confidence") if has(n)]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    filled = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    return records.where(F.length("source") > 0).groupBy("source").agg(
        F.sum(count).alias("count"), F.sum(number("detection_count", 0)).alias("detection_count"), F.sum(size("segments")).alias("segment_count"),
        F.max(size("class_counts")).alias("class_count"), F.sum(total).alias("_total"), F.sum(filled).alias("_filled"),
    ).withColumn("average_confidence", F.when(F.col("_filled") > 0, F.bround(F.try_divide("_total", "_filled"), 4))).drop("_total", "_filled")


def topic_hits(hits: DataFrame, topics: dict[str, list[str]] = V.TOPIC_KEYWORDS) -> DataFrame:
    """One row per (topic, hit): word-boundary keywords in the hit's text and keywords.

    The dictionary is fixed and small, so each row checks it in place; nothing is joined.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), S.joined("keywords", " ")))
    found = [F.struct(F.lit(t).alias("topic"), S.matched_keywords("_text", words).alias("matched")) for t, words in topics.items()]
    return (
        hits.withColumn("_text", text)
        .select(*hits.columns, F.inline(F.filter(F.array(*found), lambda t: F.size(t["matched"]) > 0)))
    )


def topic_clusters(hits: DataFrame, topics: dict[str, list[str]] = V.TOPIC_KEYWORDS) -> DataFrame:
    """Per topic: hit count and the set of keywords found."""
    return topic_hits(hits, topics).groupBy("topic").agg(
        F.count("*").alias("count"), S.flatten_set(F.collect_set("matched")).alias("keywords")
    )


def _confidence(matches: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.35) + F.col("score") / 200.0 + F.least(F.lit(0.3), matches * 0.1))


def _inferred() -> Column:
    """Event type and evidence from labels when no dictionary word matched; first rule wins."""
    has = lambda *names: F.arrays_overlap("labels", S.string_array(names))
    event = lambda kind, *evidence: F.struct(F.lit(kind).alias("event_type"), S.string_array(evidence).alias("evidence"))
    spike, clusters = has("audio_spike"), has("scene_cluster")
    engine = F.contains(F.lower(S.joined("reasons", " ")), F.lit("engine"))
    return (
        F.when(has("object_car", "object_truck", "object_motorcycle") & spike, event("vehicle_action", "object_vehicle", "audio_spike"))
        .when(has("motorsports_event"), event("motorsports_context", "motorsports_event"))
        .when(engine & spike, event("mechanical", "engine", "audio_spike"))
        .when(spike & has("scene_change", "scene_cluster"), event("high_energy", "audio_spike", "scene_change"))
        .when(clusters, event("visual_activity", "scene_cluster"))
    )


def detect_events(candidates: DataFrame, min_confidence: float = 0.2, dictionary: dict[str, list[str]] = V.EVENT_KEYWORDS) -> DataFrame:
    """Events of clips: every dictionary type found in the clip's text, else one inferred from labels."""
    text = F.lower(F.concat_ws(" ", F.coalesce("id", F.lit("")), F.coalesce("source", F.lit("")), S.joined("labels", " "), S.joined("reasons", " ")))
    found = F.filter(
        F.array(*[F.struct(F.lit(t).alias("event_type"), S.matched_keywords("_text", words).alias("evidence")) for t, words in dictionary.items()]),
        lambda e: F.size(e["evidence"]) > 0,
    )
    chosen = F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array_compact(F.array(_inferred())))
    rows = candidates.withColumn("_text", text).withColumn("_found", found).select(*candidates.columns, F.inline(chosen))
    return rows.withColumn("confidence", F.bround(_confidence(F.size("evidence")), 3)).where(F.col("confidence") >= min_confidence)


def event_order() -> list[Column]:
    return [F.desc("confidence"), F.desc("score"), F.asc("source"), F.asc("start")]
