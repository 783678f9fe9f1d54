"""Named flows: the operators chained with a preset's parameters.

A flow returns its tables by name; nothing runs until one of them is read or written, and
``explain()`` on any of them shows the plan without running it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from clipsieve.config import ScoringConfig
from clipsieve.functions import scalars as S
from clipsieve.operators import ai, content, rating as R, review, signals as G, timeline as T
from clipsieve.operators.ranking import global_rank
from clipsieve.plans.flows import rate


@dataclass(frozen=True)
class Preset:
    about: str
    rating: dict = field(default_factory=dict)
    ai: dict | None = None
    steps: tuple[str, ...] = ()
    review_items: int = 50


# Parameters of the presets.
PRESETS = {
    "simple": Preset("Highlight detection and rating", {"transcript_mode": "off", "max_candidates": 50}),
    "reel": Preset("High-energy reel candidates", {"max_candidates": 40, "window_pre_roll": 3.0, "window_post_roll": 9.0}, steps=("timeline",)),
    "roughcut": Preset(
        "Review, default approvals, rough-cut plan and edit list",
        {"max_candidates": 50, "min_review_score": 0, "window_pre_roll": 3.0, "window_post_roll": 12.0}, steps=("review", "approve", "timeline", "plan"),
    ),
    "youtube": Preset("Longer highlight selections", {"max_candidates": 75, "window_pre_roll": 5.0, "window_post_roll": 20.0}, steps=("timeline",)),
    "documentary": Preset(
        "Transcript-forward selection", {"max_candidates": 100, "window_pre_roll": 8.0, "window_post_roll": 30.0}, steps=("transcript_highlights", "timeline"),
    ),
    "motorsports": Preset(
        "Racing footage with events and topics", {"max_candidates": 75, "window_pre_roll": 4.0, "window_post_roll": 14.0},
        steps=("events", "topics", "review", "timeline"), review_items=75,
    ),
    "vision_reel": Preset("Reel candidates with fused detector signals", {"max_candidates": 60}, steps=("review", "approve", "timeline"), review_items=60),
    "ai_reel": Preset(
        "Frame scoring plus rating for short reels", {"max_candidates": 60, "window_pre_roll": 3.0, "window_post_roll": 9.0},
        {"profile": "social_reel", "interval": 6.0, "max_frames": 12, "min_score": 0.22}, ("review", "approve", "timeline"), 60,
    ),
    "ai_garage_shop": Preset(
        "Shop work, vehicle details and build process", {"max_candidates": 75, "window_pre_roll": 4.0, "window_post_roll": 14.0},
        {"profile": "garage_shop", "interval": 8.0, "max_frames": 10, "min_score": 0.22}, ("content_map", "review", "approve", "timeline"), 75,
    ),
    "ai_event_recap": Preset(
        "Event recap with missed moments", {"max_candidates": 75, "window_pre_roll": 4.0, "window_post_roll": 16.0},
        {"profile": "event_recap", "interval": 8.0, "max_frames": 12, "min_score": 0.22}, ("missed", "review", "approve", "timeline"), 75,
    ),
}


def selection_clips(approved: DataFrame, selection: str = "approved") -> DataFrame:
    """Approved clips, or candidates, as the clips of one selection, in review order."""
    none = F.lit(None).cast("double")
    return global_rank(approved, [F.asc("sort_order"), F.asc("rank")], "_nth").withColumn("selection", F.lit(selection)).select(
        "selection", "source", F.col("_nth").cast("int").alias("clip_index"), "label", "start", "end", none.alias("start_seconds"), none.alias("end_seconds"),
        "score", "review_order", "labels", "reasons",
    )


def _candidate_clips(candidates: DataFrame) -> DataFrame:
    return selection_clips(candidates.select(
        "rank", "source", S.hhmmss("start").alias("start"), S.hhmmss("end").alias("end"), F.col("id").alias("label"), "score", "labels", "reasons",
        F.lit(None).cast("int").alias("review_order"), F.lit(0).alias("sort_order")), "selected")


def run_preset(
    name: str,
    signals: R.Signals,
    frames: DataFrame | None = None,
    prompts: DataFrame | None = None,
    decisions: DataFrame | None = None,
    cfg: ScoringConfig = ScoringConfig(),
    model=None,
) -> dict[str, DataFrame]:
    """Run a preset.  Presets with frame scoring need ``frames`` (vectors) and ``prompts`` (vectors)."""
    if name not in PRESETS:
        raise KeyError(f"unknown preset: {name}; available: {', '.join(PRESETS)}")
    preset = PRESETS[name]
    cfg = cfg.with_(**preset.rating)
    out: dict[str, DataFrame] = {}
    if preset.ai is not None:
        if frames is None or prompts is None:
            raise ValueError(f"preset {name} needs frame and prompt vectors")
        scored = ai.score_frames(frames, prompts, preset.ai["min_score"])
        out["ai_scores"] = scored
        hits = ai.as_advanced_hits(scored)
        advanced = hits if signals.advanced_hits is None else signals.advanced_hits.unionByName(hits, allowMissingColumns=True)
        for column in ("face_count", "person_count", "event_type", "confidence", "topic"):
            if column not in advanced.columns:
                advanced = advanced.withColumn(column, F.lit(None).cast({"event_type": "string", "topic": "string", "confidence": "double"}.get(column, "int")))
        signals = R.Signals(**{**signals.__dict__, "advanced_hits": advanced})
    candidates = rate(signals, cfg, model)
    out["candidates"] = candidates
    clips = _candidate_clips(candidates.where(F.col("action").isin("select", "review")))
    if "transcript_highlights" in preset.steps:
        out["transcript_highlights"] = review.filter_by_label(candidates, "transcript_hit")
        clips = _candidate_clips(out["transcript_highlights"])
    if "events" in preset.steps:
        out["events"] = G.detect_events(candidates)
    if "topics" in preset.steps and signals.transcript_hits is not None:
        out["topics"] = G.topic_clusters(signals.transcript_hits)
    if "content_map" in preset.steps:
        out["content_map"] = content.content_map(candidates)
    if "missed" in preset.steps:
        framed = out["ai_scores"].withColumn("frame_id", F.concat_ws("@", "source", F.col("time").cast("string")))
        out["missed"] = ai.missed_moments(framed, candidates)
        out["missed_review"] = ai.missed_review(out["missed"])
    if "review" in preset.steps:
        out["decisions"] = review.merge_decisions(candidates.where(F.col("rank") <= preset.review_items), decisions)
    if "approve" in preset.steps:
        kept = out["decisions"].select("id", "decision", F.col("order").cast("int").alias("order"), "note")
        out["approved"] = review.approve(candidates, kept)
        clips = selection_clips(out["approved"])
    if "plan" in preset.steps:
        out["plan"] = T.plan_roughcut(clips)
        out["plan_summary"] = T.plan_summary(out["plan"])
    if "timeline" in preset.steps:
        out["timeline"] = T.timeline_table(T.sequence_clips(T.planned_clips(clips), "review_order"))
    return out
