"""Sequencing of approved clips and the edit timeline.

Selections are independent; the places of a selection's clips come from a sort over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators import intervals as I
from clipsieve.operators.ranking import rank_per_group


def planned_clips(clips: DataFrame, handles: float = 0.0) -> DataFrame:
    """Whole clips with handles added: ``id, label, source, start_seconds, end_seconds, duration, score, review_order, source_order``."""
    h = F.lit(max(0.0, float(handles)))
    nth = F.format_string("clip_%03d", "clip_index")
    begin = F.greatest(F.lit(0.0), S.clip_seconds("start", "start_seconds") - h)
    rows = clips.withColumn("_begin", begin).withColumn(
        "_finish", F.greatest(F.col("_begin"), S.clip_seconds("end", "end_seconds") + h)
    )
    order = F.coalesce(F.nullif(F.col("review_order"), F.lit(0)), F.col("clip_index"))
    return rows.select(
        "selection", F.coalesce("label", nth).alias("id"), F.coalesce("label", nth).alias("label"), "source",
        F.bround("_begin", 3).alias("start_seconds"), F.bround("_finish", 3).alias("end_seconds"),
        F.bround(S.interval_duration("_begin", "_finish"), 3).alias("duration"), F.coalesce("score", F.lit(0)).alias("score"),
        order.cast("long").alias("review_order"), F.col("clip_index").cast("long").alias("source_order"), "labels", "reasons",
    )


def sequence_clips(clips: DataFrame, mode: str) -> DataFrame:
    """Add ``pos``, the 1-based place of each clip in its selection."""
    if mode not in V.SEQUENCES:
        raise ValueError(f"unsupported sequencing mode: {mode}")
    by_score = [F.desc("score"), F.asc("review_order"), F.asc("source_order")]
    order = {
        "review_order": [F.asc("review_order"), F.desc("score"), F.asc("source_order")],
        "score": by_score,
        "source_order": [F.asc("source"), F.asc("start_seconds"), F.asc("source_order")],
        # Round-robin: each source's n-th best in the n-th round, sources alphabetical inside it.
        "diversified": [F.asc("_round"), F.asc("source")],
    }[mode]
    rows = clips
    if mode == "diversified":
        rows = rank_per_group(rows, ["selection", "source"], by_score, "_round")
    placed = rank_per_group(rows, ["selection"], order, "pos").drop("_round")
    return placed.withColumn("pos", F.col("pos").cast("int"))


def fit_target_duration(clips: DataFrame, target: float | None) -> DataFrame:
    """Clips in order until the target is full, the overflowing one trimmed to what is left.

    Less than a second left is skipped over for shorter clips; the first clip is always taken.
    The rule carries state from clip to clip, so it is a fold over a selection's ordered clips.
    Only clips that start before the target can matter, and after those only clips shorter than
    the second that may be left; a running sum drops the rest before anything is gathered.
    """
    if target is None:
        return clips
    goal = max(0.0, float(target))
    if goal <= 0:
        return clips.limit(0)
    reach = I.running_sum(clips, ["selection"], "pos", F.col("duration"), "_before")
    clips = reach.where((F.col("_before") < goal) | (F.col("duration") < 1.0) | (F.col("pos") == 1)).drop("_before")
    fields = [c for c in clips.columns if c not in ("selection", "pos")]
    item = F.struct("pos", *fields)
    item_type = clips.select(item.alias("x")).schema["x"].dataType.simpleString()
    state0 = F.named_struct(
        F.lit("elapsed"), F.lit(0.0), F.lit("full"), F.lit(False), F.lit("out"), F.array().cast(f"array<{item_type}>")
    )

    def step(state: Column, clip: Column) -> Column:
        left = F.lit(goal) - state["elapsed"]
        fits = clip["duration"] <= left
        first = F.size(state["out"]) == 0
        trims = ~fits & (left >= 1.0)
        cut = clip.withField("duration", F.bround(left, 3)).withField("end_seconds", F.bround(clip["start_seconds"] + left, 3))
        taken = F.when(trims, cut).otherwise(clip)
        grown = lambda full: F.named_struct(
            F.lit("elapsed"), state["elapsed"] + taken["duration"], F.lit("full"), full,
            F.lit("out"), F.concat(state["out"], F.array(taken)),
        )
        return (
            F.when(state["full"] | (state["elapsed"] >= goal), state)
            .when(fits | first, grown(F.lit(False)))
            .when(trims, grown(F.lit(True)))
            .otherwise(state)
        )

    folded = F.aggregate(F.array_sort(F.collect_list(item)), state0, step, lambda s: s["out"])
    return clips.groupBy("selection").agg(folded.alias("_out")).select("selection", F.inline("_out"))


def plan_roughcut(
    clips: DataFrame,
    sequence: str = "review_order",
    target_duration: float | None = None,
    format_type: str = "original",
    handles: float = 0.0,
    max_clips: int | None = None,
    render_mode: str = "copy",
) -> DataFrame:
    """The edit plan of each selection, one row per clip in order."""
    if format_type not in V.FORMATS:
        raise ValueError(f"unsupported rough-cut format: {format_type}")
    if render_mode not in V.RENDER_MODES:
        raise ValueError(f"unsupported render mode: {render_mode}")
    rows = sequence_clips(planned_clips(clips, handles), sequence)
    if max_clips is not None:
        rows = rows.where(F.col("pos") <= max(0, int(max_clips)))
    rows = fit_target_duration(rows, target_duration)
    return rows.withColumns({
        "start": S.hhmmss("start_seconds"), "end": S.hhmmss("end_seconds"), "format": F.lit(format_type), "render_mode": F.lit(render_mode),
    })


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("selection").agg(
        F.count("*").alias("clips"), F.bround(F.sum("duration"), 3).alias("duration"), F.count_distinct("source").alias("sources")
    ).withColumn("duration_formatted", S.hhmmss("duration"))


def timeline(clips: DataFrame, fps: Column | float = 30.0) -> DataFrame:
    """Source and record positions of each clip, in seconds and in whole frames.

    ``clips`` carry ``selection, pos, start_seconds, end_seconds``; records follow each other.
    """
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    frame = lambda c: F.floor(F.col(c) * rate).cast("long")
    rows = clips.withColumns({
        "length": S.interval_duration("start_seconds", "end_seconds"), "in_frame": frame("start_seconds"), "out_frame": frame("end_seconds"),
    }).withColumn("frames", F.greatest(F.lit(0).cast("long"), F.col("out_frame") - F.col("in_frame")))
    rows = I.running_sum(rows, ["selection"], "pos", F.col("length"), "record_in")
    rows = I.running_sum(rows, ["selection"], "pos", F.col("frames").cast("double"), "record_in_frame")
    return rows.withColumns({
        "record_out": F.col("record_in") + F.col("length"),
        "record_in_frame": F.col("record_in_frame").cast("long"),
    }).withColumn("record_out_frame", F.col("record_in_frame") + F.col("frames"))


def timeline_table(clips: DataFrame, fps: Column | float = 30.0) -> DataFrame:
    """The edit list as a table: time codes and frames per clip."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    rows = timeline(clips, rate)
    code = lambda c: S.timecode(c, rate)
    return rows.select(
        "selection", "pos", "label", "source", code("start_seconds").alias("source_in"), code("end_seconds").alias("source_out"),
        code("record_in").alias("record_in_tc"), code("record_out").alias("record_out_tc"),
        "in_frame", "out_frame", "record_in_frame", "record_out_frame", "record_in", "record_out",
    )
