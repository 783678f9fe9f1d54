"""The driver's tables seen as media signals.

Plain projections: one hour of ``events.ts`` plays one second, so thirty days make a
720-second source, and each event type plays one signal kind.  No event is left out.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipsieve.config import ScoringConfig
from clipsieve.operators.rating import Signals, ranked_candidates

DURATION = 720.0
EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
HOUR_MICROS = 3600000000
# Words and labels that play keywords, events and classes; fixed values, picked by event_id.
CLASSES = ("person", "car", "truck", "dog", "bicycle")
RATINGS = ("select", "review", "broll", "reject", "ignore")
KEYWORDS = ("pass", "lap", "win")
KINDS = ("ocr_signage", "face_person", "motorsports_event", "topic_cluster", "ai_frame_score")
EVENT_TYPES = ("pass", "incident", "pit")
TOPICS = ("racecraft", "results")
MODEL_LABELS = ("ai_broll_candidate", "ai_reel_opener", "ai_vehicle_action")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, divisor: int = 1):
    """``values[(event_id / divisor) mod n]``."""
    index = F.pmod(F.floor(F.col("event_id") / divisor), F.lit(len(values))).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)")
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("source"), "user_id",
        (micros / F.lit(float(HOUR_MICROS))).alias("t"), "value", "event_type",
        F.floor(micros / F.lit(HOUR_MICROS // 1000)).cast("long").alias("t_ms"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    u = F.col("user_id")
    at = lambda mod, values: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(u, F.lit(mod)).cast("int") + 1)
    name = F.concat(F.lit("user_"), u.cast("string"), F.lit(".mp4"))
    return users.select(
        name.alias("filename"), name.alias("filepath"), F.col("n").cast("double").alias("size_mb"),
        F.lit(DURATION).alias("duration"), at(4, (3840, 1920, 1280, 640)).alias("width"),
        at(4, (2160, 1080, 720, 480)).alias("height"), F.lit("h264").alias("codec"),
        at(3, (60.0, 30.0, 24.0)).alias("fps"), (F.pmod(u, F.lit(7)) != 0).alias("has_audio"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"),
    )


def _of(ev: DataFrame, *types: str) -> DataFrame:
    return ev.where(F.col("event_type").isin(*types))


def levels(ev: DataFrame) -> DataFrame:
    return _of(ev, "click", "view").select("source", F.col("t").alias("time"), (F.col("value") / 10.0 - 40.0).alias("rms_db"))


def scenes(ev: DataFrame) -> DataFrame:
    return _of(ev, "signup").select("source", F.col("t").alias("time"))


def silences(ev: DataFrame) -> DataFrame:
    return _of(ev, "error").select(
        "source", F.col("t").alias("start"), F.least(F.col("t") + F.col("value") / 20.0, F.lit(DURATION)).alias("end")
    )


def object_hits(ev: DataFrame, every: bool = False) -> DataFrame:
    """Detections: the purchases, or all events."""
    return (ev if every else _of(ev, "purchase")).select(
        "event_id", "source", F.col("t").alias("start"), (F.col("t") + F.col("value") / 50.0).alias("end"),
        pick(CLASSES).alias("class_name"), F.pmod("event_id", F.lit(5)).cast("int").alias("class_id"),
        (F.pmod("event_id", F.lit(20)) + 1).cast("int").alias("count"),
        (F.pmod("event_id", F.lit(100)) / 100.0).alias("confidence"),
    )


def transcript_hits(ev: DataFrame) -> DataFrame:
    word = pick(KEYWORDS)
    return _of(ev, "view").select(
        "event_id", "source", F.col("t").alias("start"), (F.col("t") + 1.0 + F.col("value") / 100.0).alias("end"),
        F.concat(F.lit("a "), word, F.lit(" moment")).alias("text"), F.array(word).alias("keywords"),
    )


def advanced_hits(ev: DataFrame, every: str | None = None) -> DataFrame:
    """Hits of all kinds from the errors, or every event as a hit of one kind."""
    kind = pick(KINDS) if every is None else F.lit(every)
    wide = kind.isin("ocr_signage", "face_person")
    when = lambda k, value: F.when(kind == k, value)
    none = lambda t: F.lit(None).cast(t)
    label = pick(MODEL_LABELS, 5)
    score = F.pmod("event_id", F.lit(97)) / 100.0
    return (_of(ev, "error") if every is None else ev).select(
        "event_id", "source", kind.alias("kind"), F.when(wide, 0.0).otherwise(F.col("t")).alias("start"),
        F.when(wide, 0.0).otherwise(F.col("t") + 1.0).alias("end"), wide.alias("source_wide"),
        when("ocr_signage", F.lit("sign")).alias("text"),
        when("face_person", F.pmod("event_id", F.lit(3))).cast("int").alias("face_count"),
        when("face_person", F.pmod("event_id", F.lit(4))).cast("int").alias("person_count"),
        when("motorsports_event", pick(EVENT_TYPES, 5)).alias("event_type"),
        when("motorsports_event", score).alias("confidence"), none("array<string>").alias("evidence"),
        when("topic_cluster", pick(TOPICS, 5)).alias("topic"), none("array<string>").alias("keywords"),
        when("ai_frame_score", F.col("t")).alias("time_seconds"),
        when("ai_frame_score", score).alias("top_score"), when("ai_frame_score", label).alias("top_label"),
        when("ai_frame_score", F.array(label)).alias("labels"),
    )


def signals(spark: SparkSession, sf_dir: str) -> Signals:
    ev = events(spark, sf_dir)
    return Signals(
        assets=assets(spark, sf_dir), scenes=scenes(ev), levels=levels(ev), silences=silences(ev),
        transcript_hits=transcript_hits(ev), object_hits=object_hits(ev), advanced_hits=advanced_hits(ev),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signup and purchase is a human-marked moment."""
    ev = _of(events(spark, sf_dir), "signup", "purchase")
    return ev.select(
        F.col("event_id").alias("ann_index"), F.format_string("annotation_%04d", "event_id").alias("id"), "source",
        F.greatest(F.lit(0.0), F.col("t") - 2.0).alias("start"), F.least(F.lit(DURATION), F.col("t") + 6.0).alias("end"),
        pick(RATINGS).alias("rating"), F.array("event_type").alias("tags"), F.lit("").alias("notes"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, "ignore").when(F.col("quality") == 1, "approve").otherwise("reject")
    return labels.select(
        F.format_string("clip_%04d", F.col("doc_id") + 1).alias("id"), verdict.alias("decision"),
        F.col("doc_id").cast("int").alias("order"), F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("note"),
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".mp4")).alias("source"),
        F.col("turn").cast("int").alias("cue_index"), (F.col("turn") * 10.0).alias("start"),
        (F.col("turn") * 10.0 + 8.0).alias("end"), "text",
    )


def frame_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("user_"), F.pmod("vec_id", F.lit(20)).cast("string"), F.lit(".mp4")).alias("source"),
        (F.floor(F.col("vec_id") / 20) * 10.0).alias("time"), F.col("embedding").alias("vector"),
    )


def prompt_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten prompts: the mean vector of each embedding label."""
    flat = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = flat.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    name = F.col("label").cast("string")
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pairs")).select(
        F.lit("bank").alias("profile"), F.concat(F.lit("p"), name).alias("id"),
        F.concat(F.lit("label_"), F.pmod("label", F.lit(4)).cast("string")).alias("label"),
        F.concat(F.lit("prompt "), name).alias("prompt"), F.lit("context").alias("intent"),
        F.transform("pairs", lambda p: p.m).alias("vector"),
    )


# Ranks every window: the evaluation and review queries keep all of them.
FULL = ScoringConfig(max_candidates=None)


@lru_cache(maxsize=None)
def _ranked(app_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_candidates(signals(spark, sf_dir), FULL)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ranked candidates.  Ranking materialises them once; queries of a session share that table."""
    return _ranked(spark.sparkContext.applicationId, spark, sf_dir)
