"""From timed signals to scored windows and ranked candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipsieve.config import ScoringConfig
from clipsieve.functions import scalars as S
from clipsieve.operators import intervals as I
from clipsieve.operators.ranking import ranked
from clipsieve.session import cut_lineage

SEEDING_KINDS = ("motorsports_event", "topic_cluster", "ai_frame_score")


@dataclass(frozen=True)
class Signals:
    """The tall signal tables of a run; every table but ``assets`` may be missing."""

    assets: DataFrame
    scenes: DataFrame | None = None
    levels: DataFrame | None = None
    silences: DataFrame | None = None
    transcript_hits: DataFrame | None = None
    object_hits: DataFrame | None = None
    advanced_hits: DataFrame | None = None


# -- per-asset and per-score projections ---------------------------------------------------

def technical_points(max_score: float) -> Column:
    pixels = F.col("width").cast("long") * F.col("height")
    has_size = (F.coalesce("width", F.lit(0)) != 0) & (F.coalesce("height", F.lit(0)) != 0)
    size = (
        F.when(~has_size, 0.0)
        .when(pixels >= 3840 * 2160, 6.0)
        .when(pixels >= 1920 * 1080, 5.0)
        .when(pixels >= 1280 * 720, 3.0)
        .otherwise(1.0)
    )
    rate = F.coalesce("fps", F.lit(0.0))
    motion = F.when(rate == 0, 0.0).when(rate >= 59, 4.0).when(rate >= 29, 3.0).otherwise(1.0)
    length = F.when(F.col("duration").between(3, 3600), 4.0).when(F.col("duration") > 0, 2.0).otherwise(0.0)
    codec = F.when(F.length("codec") > 0, 1.0).otherwise(0.0)
    points = F.least(F.lit(float(max_score)), F.lit(5.0) + size + motion + length + codec)
    return F.when(F.col("status") == "ok", points).otherwise(0.0)


def technical_score(assets: DataFrame, cfg: ScoringConfig) -> DataFrame:
    return assets.withColumn("technical_score", technical_points(cfg.weight("technical")))


def action_for(score, select: Column | int, review: Column | int, broll: Column | int) -> Column:
    s = S.col(score)
    return F.when(s >= select, "select").when(s >= review, "review").when(s >= broll, "broll").otherwise("cut")


def action_for_score(score, cfg: ScoringConfig) -> Column:
    return action_for(score, cfg.min_select_score, cfg.min_review_score, cfg.min_broll_score)


def audio_points(peak, silence_ratio) -> Column:
    """Fixed tiers by peak level; a mostly silent window loses ten points."""
    p = S.col(peak)
    tier = F.when(p.isNull(), 0.0).when(p >= -18, 30.0).when(p >= -25, 22.0).when(p >= -35, 14.0).otherwise(6.0)
    return F.when(S.col(silence_ratio) > 0.6, F.greatest(F.lit(0.0), tier - 10.0)).otherwise(tier)


def audio_label(peak, floor_db: Column | float) -> Column:
    p = S.col(peak)
    return F.when(p >= floor_db, "audio_spike").when(p.isNotNull(), "audio_present")


def interesting_objects(hits: DataFrame, classes) -> DataFrame:
    """Case-insensitive class allow-list; an empty list keeps everything."""
    wanted = sorted({c.lower() for c in classes or ()})
    return hits.where(F.lower("class_name").isin(wanted)) if wanted else hits


def advanced_label(kind="kind", top_label="top_label") -> Column:
    """The main label of an advanced hit."""
    k = F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("advanced_signal"))
    return (
        F.when(k.isin("ocr_signage", "face_person", "motorsports_event", "topic_cluster"), k)
        .when(k == "ai_frame_score", F.coalesce(F.nullif(F.col(top_label), F.lit("")), F.lit("ai_frame_score")))
        .otherwise(S.slug(k))
    )


def advanced_labels() -> Column:
    """All labels of an advanced hit, by its kind."""
    kind = F.col("kind")
    extra = lambda name: F.when(F.length(name) > 0, S.slug(name))
    single = F.array(
        advanced_label(),
        F.when((kind == "face_person") & (F.col("face_count") > 0), F.lit("face_presence")),
        F.when((kind == "face_person") & (F.col("person_count") > 0), F.lit("person_presence")),
        F.when(kind == "motorsports_event", F.concat(F.lit("motorsports_"), extra("event_type"))),
        F.when(kind == "topic_cluster", F.concat(F.lit("topic_"), extra("topic"))),
    )
    model = F.when(kind == "ai_frame_score", F.filter(S.label_array("labels"), lambda x: F.length(x) > 0))
    return S.sorted_union(single, F.coalesce(model, S.empty_strings()))


# -- spike detection -----------------------------------------------------------------------

def finite_levels(levels: DataFrame) -> DataFrame:
    return levels.where(S.is_finite("rms_db"))


def spike_thresholds(levels: DataFrame, profiles: list[tuple[str, float, float]]) -> DataFrame:
    """Per source and ``(profile, percentile, floor_db)``: the floor-nearest-rank level, at least the floor.

    An exact order statistic without sorting a source: counts per thousandth of a decibel
    (a bounded number of cells, combined map-side) locate the cell that holds the rank, and
    only that cell's levels are grouped by value.
    """
    finite = finite_levels(levels).withColumn("_cell", F.floor(F.col("rms_db") * 1000.0).cast("long"))
    per_source = Window.partitionBy("source")
    up_to = per_source.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.inline(
        F.array(*[
            F.struct(
                F.lit(name).alias("profile"), F.lit(float(pct) / 100.0).alias("_p"), F.lit(float(floor)).alias("_floor")
            )
            for name, pct, floor in profiles
        ])
    )
    cells = (
        finite.groupBy("source", "_cell").agg(F.count("*").alias("_n"))
        .withColumn("_cum", F.sum("_n").over(up_to))
        .withColumn("_total", F.sum("_n").over(per_source))
        .select("*", wanted)
        .withColumn("_rank", F.floor((F.col("_total") - 1) * F.col("_p")).cast("long"))
        .where((F.col("_cum") > F.col("_rank")) & (F.col("_cum") - F.col("_n") <= F.col("_rank")))
        .select("profile", "source", "_cell", "_floor", (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_k"))
    )
    inside = Window.partitionBy("profile", "source").orderBy("rms_db").rowsBetween(Window.unboundedPreceding, 0)
    return (
        finite.join(cells, ["source", "_cell"])
        .groupBy("profile", "source", "rms_db").agg(F.count("*").alias("_n"), F.first("_k").alias("_k"), F.first("_floor").alias("_floor"))
        .withColumn("_cum", F.sum("_n").over(inside))
        .where(F.col("_cum") > F.col("_k"))
        .groupBy("profile", "source")
        .agg(F.greatest(F.min("rms_db"), F.first("_floor")).alias("threshold"))
    )


def audio_spikes(levels: DataFrame, percentile: float, floor_db: float) -> DataFrame:
    """Levels at or above their source's threshold."""
    limits = spike_thresholds(levels, [("run", percentile, floor_db)]).drop("profile")
    return finite_levels(levels).join(limits, "source").where(F.col("rms_db") >= F.col("threshold")).drop("threshold")


# -- one tall table for all signals --------------------------------------------------------

_TALL = {
    "source": "string", "kind": "string", "h_start": "double", "h_end": "double", "source_wide": "boolean",
    "rms_db": "double", "keywords": "array<string>", "class_name": "string", "amount": "long",
    "face_count": "long", "person_count": "long", "confidence": "double", "event_type": "string",
    "topic": "string", "model_labels": "array<string>", "hit_labels": "array<string>", "main_label": "string",
}


def _tall(df: DataFrame, **columns: Column | str) -> DataFrame:
    """``df`` in the tall layout; columns not named come out null."""
    def one(name: str, kind: str) -> Column | str:
        value = columns.get(name, "NULL")
        return f"CAST({value} AS {kind}) AS {name}" if isinstance(value, str) else value.cast(kind).alias(name)

    return df.select(*[F.expr(c) if isinstance(c, str) else c for c in (one(n, t) for n, t in _TALL.items())])


def tall_signals(signals: Signals, cfg: ScoringConfig) -> DataFrame:
    """Every signal as ``(source, kind, h_start, h_end, …)`` so one range join and one
    aggregation serve all of them."""
    parts = []
    point = {"source": "source", "h_start": "time", "h_end": "time"}
    span = {"source": "source", "h_start": "`start`", "h_end": "`end`"}
    if signals.scenes is not None:
        parts.append(_tall(signals.scenes, kind="'scene'", **point))
    if signals.levels is not None:
        parts.append(_tall(finite_levels(signals.levels), kind="'level'", rms_db="rms_db", **point))
    if signals.silences is not None:
        parts.append(_tall(signals.silences, kind="'silence'", **span))
    if signals.transcript_hits is not None:
        parts.append(_tall(signals.transcript_hits, kind="'transcript'", keywords="coalesce(keywords, array())", **span))
    if signals.object_hits is not None:
        hits = interesting_objects(signals.object_hits, cfg.object_interest_classes)
        parts.append(_tall(hits, kind="'object'", class_name="class_name", amount="greatest(1, coalesce(`count`, 1))", **span))
    if signals.advanced_hits is not None:
        parts.append(_tall(
            signals.advanced_hits, kind="kind", source_wide="coalesce(source_wide, false)", face_count="coalesce(face_count, 0)",
            person_count="coalesce(person_count, 0)", event_type="event_type", topic="topic",
            confidence="coalesce(if(kind = 'ai_frame_score', top_score, confidence), 0.0D)",
            model_labels="if(kind = 'ai_frame_score', coalesce(labels, array()), NULL)",
            hit_labels=advanced_labels(), main_label=advanced_label(), **span,
        ))
    if not parts:
        return _tall(signals.assets.selectExpr("filepath AS source"), source="source").limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of(kind: str) -> Column:
    return F.col("kind") == kind


def _set(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def _set_of_arrays(value: Column) -> Column:
    return S.flatten_set(F.collect_set(value))


def advanced_measures() -> dict[str, Column]:
    """Counts and sums that feed the advanced scores."""
    total = lambda kind, name: F.coalesce(F.sum(F.when(_of(kind), F.col(name))), F.lit(0))
    return {
        "ocr_hits": F.count_if(_of("ocr_signage")),
        "face_person_hits": F.count_if(_of("face_person")),
        "motorsports_events": F.count_if(_of("motorsports_event")),
        "topic_hits": F.count_if(_of("topic_cluster")),
        "ai_frame_scores": F.count_if(_of("ai_frame_score")),
        "face_total": total("face_person", "face_count"),
        "person_total": total("face_person", "person_count"),
        "event_confidence": total("motorsports_event", "confidence").cast("double"),
        "ai_confidence": total("ai_frame_score", "confidence").cast("double"),
        "event_types": _set(F.when(_of("motorsports_event") & (F.length("event_type") > 0), F.col("event_type"))),
        "topics": _set(F.when(_of("topic_cluster") & (F.length("topic") > 0), F.col("topic"))),
        "ai_labels": _set_of_arrays(F.col("model_labels")),
        "advanced_labels": _set_of_arrays(F.col("hit_labels")),
    }


def advanced_score_columns(cfg: ScoringConfig | None = None, weights: dict[str, Column] | None = None) -> dict[str, Column]:
    """The five advanced scores from ``advanced_measures`` columns, each capped by its weight."""
    w = weights or {k: F.lit(cfg.weight(k)) for k in ("ocr", "face_person", "motorsports", "topics", "ai")}
    c = F.col
    return {
        "ocr_signage_score": F.least(w["ocr"], c("ocr_hits") * 4.0),
        "face_person_score": F.least(w["face_person"], c("face_total") * 1.5 + c("person_total") * 0.75),
        "motorsports_event_score": F.least(w["motorsports"], c("motorsports_events") * 5.0 + c("event_confidence") * 4.0),
        "topic_cluster_score": F.least(w["topics"], c("topic_hits") * 5.0),
        "ai_frame_score": F.least(w["ai"], c("ai_frame_scores") * 2.0 + c("ai_confidence") * 6.0),
    }


def advanced_scores(hits: DataFrame, cfg: ScoringConfig, keys: list[str]) -> DataFrame:
    """Counts and capped scores of advanced hits per group."""
    tall = tall_signals(Signals(assets=hits, advanced_hits=hits), cfg)
    measured = tall.groupBy(*keys).agg(*[c.alias(n) for n, c in advanced_measures().items()])
    return measured.withColumns(advanced_score_columns(cfg))


# -- file-level scores ---------------------------------------------------------------------

def score_sources(signals: Signals, cfg: ScoringConfig) -> DataFrame:
    """File scores and reasons, one row per asset."""
    tall = tall_signals(signals, cfg)
    if signals.levels is not None:
        spikes = audio_spikes(signals.levels, cfg.audio_spike_percentile, cfg.audio_spike_floor_db)
        tall = tall.unionByName(
            _tall(spikes, source="source", kind="'spike'", h_start="time", h_end="time")
        )
    all_objects = None
    if signals.object_hits is not None:
        # Counted before the class allow-list; scored after it.
        all_objects = signals.object_hits.groupBy("source").agg(
            F.count("*").alias("object_hits"), _set(F.col("class_name")).alias("object_classes")
        )
    facts = tall.groupBy("source").agg(
        F.count_if(_of("scene")).alias("scene_count"),
        F.count_if(_of("spike")).alias("audio_spikes"),
        F.max(F.when(_of("level"), F.col("rms_db"))).alias("peak_rms_db"),
        F.count_if(_of("silence")).alias("silence_count"),
        F.coalesce(F.sum(F.when(_of("silence"), S.interval_duration("h_start", "h_end"))), F.lit(0.0)).alias("silent_seconds"),
        F.count_if(_of("transcript")).alias("transcript_count"),
        F.size(F.collect_set(F.when(_of("object"), F.col("class_name")))).alias("scored_classes"),
        F.coalesce(F.sum(F.when(_of("object"), F.col("amount"))), F.lit(0)).alias("detections"),
        _set(F.col("main_label")).alias("main_labels"),
        *[c.alias(n) for n, c in advanced_measures().items()],
    )
    rows = signals.assets.withColumn("source", F.col("filepath")).join(facts, "source", "left")
    if all_objects is not None:
        rows = rows.join(all_objects, "source", "left")
    else:
        rows = rows.withColumns({"object_hits": F.lit(0), "object_classes": S.empty_strings()})
    rows = _fill(rows, (
        "scene_count", "audio_spikes", "silence_count", "silent_seconds", "transcript_count", "scored_classes",
        "detections", "object_hits", *_ADVANCED_NUMBERS,
    )).withColumn("object_classes", S.label_array("object_classes"))
    duration = F.coalesce("duration", F.lit(0.0))
    rows = rows.withColumns({
        "scene_changes_per_minute": F.col("scene_count") / F.greatest(duration / 60.0, F.lit(0.1)),
        "non_silent_ratio": F.when(duration == 0, 1.0).otherwise(
            F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.try_divide(F.col("silent_seconds"), duration)))
        ),
        "technical_score": technical_points(cfg.weight("technical")),
    })
    heard = F.col("non_silent_ratio") * 15.0 + F.least(F.lit(20.0), F.col("audio_spikes") * 4.0)
    rows = rows.withColumns({
        "visual_activity_score": F.least(F.lit(cfg.weight("visual")), F.col("scene_changes_per_minute") * 5.0),
        "audio_interest_score": F.when(F.col("has_audio"), F.least(F.lit(cfg.weight("audio")), heard)).otherwise(0.0),
        "transcript_score": F.least(F.lit(cfg.weight("transcript")), F.col("transcript_count") * 8.0),
        "object_presence_score": F.when(F.col("detections") == 0, 0.0).otherwise(F.least(
            F.lit(cfg.weight("objects")),
            F.col("scored_classes") * 3.0 + F.least(F.lit(7.0), F.col("detections") / 8.0),
        )),
        **advanced_score_columns(cfg),
    })
    total = sum((F.col(n) for n in SCORE_NAMES[1:]), F.col(SCORE_NAMES[0]))
    return rows.withColumn("total_score", F.least(F.lit(100.0), total)).withColumn("reasons", file_reasons(cfg.shown_names))


SCORE_NAMES = (
    "technical_score", "visual_activity_score", "audio_interest_score", "transcript_score", "object_presence_score",
    "ocr_signage_score", "face_person_score", "motorsports_event_score", "topic_cluster_score", "ai_frame_score",
)
COUNT_NAMES = ("ocr_hits", "face_person_hits", "motorsports_events", "topic_hits", "ai_frame_scores")
_ADVANCED_NUMBERS = (*COUNT_NAMES, "face_total", "person_total", "event_confidence", "ai_confidence")
_ADVANCED_SETS = ("event_types", "topics", "ai_labels", "advanced_labels")


def _fill(df: DataFrame, names) -> DataFrame:
    return df.fillna(0, subset=list(names))


def _names(array: str, shown: int | None) -> Column:
    names = S.label_array(array)
    return F.array_join(names if shown is None else F.slice(names, 1, shown), ", ")


def _some(array: str) -> Column:
    return F.size(S.label_array(array)) > 0


def file_reasons(shown: int | None = None) -> Column:
    """Ordered reasons of a file, with the first ``shown`` names; a quiet file says so."""
    c = F.col
    count = lambda name, text: F.when(c(name) > 0, F.concat(c(name).cast("string"), F.lit(text)))
    reasons = F.array_compact(F.array(
        count("scene_count", " scene changes detected"),
        count("silence_count", " silence intervals detected"),
        count("audio_spikes", " audio spikes detected"),
        count("transcript_count", " transcript highlight hits"),
        F.when(_some("object_classes"), F.concat(F.lit("object detections: "), _names("object_classes", shown))),
        F.when(_some("main_labels"), F.concat(F.lit("advanced signal artifacts: "), _names("main_labels", shown))),
    ))
    return F.when(F.size(reasons) == 0, F.array(F.lit("no strong highlight signals detected"))).otherwise(reasons)


# -- windows -------------------------------------------------------------------------------

def _rolled(df: DataFrame, pre: float, post: float, labels: Column, start="start", end="end", floor_start=False) -> DataFrame:
    begin = F.col(start) - F.lit(float(pre))
    if floor_start:
        begin = F.greatest(F.lit(0.0), begin)
    return df.select("source", begin.alias("start"), (F.col(end) + F.lit(float(post))).alias("end"), labels.alias("labels"))


def seed_windows(signals: Signals, cfg: ScoringConfig, spikes: DataFrame | None = None) -> DataFrame:
    """UNION ALL of the seeds, each with its own roll and label.  Source-wide hits never seed."""
    pre, post = cfg.window_pre_roll, cfg.window_post_roll
    label = lambda text: F.array(F.lit(text))
    parts = []
    if signals.scenes is not None:
        parts.append(_rolled(signals.scenes, pre, post, label("scene_change"), "time", "time"))
    if spikes is None and signals.levels is not None:
        spikes = audio_spikes(signals.levels, cfg.audio_spike_percentile, cfg.audio_spike_floor_db)
    if spikes is not None:
        parts.append(_rolled(spikes, pre, post, label("audio_spike"), "time", "time"))
    if signals.transcript_hits is not None:
        parts.append(_rolled(signals.transcript_hits, pre, post, label("transcript_hit"), floor_start=True))
    if signals.object_hits is not None:
        hits = interesting_objects(signals.object_hits, cfg.object_interest_classes)
        names = F.array(F.lit("object_presence"), F.concat(F.lit("object_"), S.slug("class_name")))
        parts.append(_rolled(hits, cfg.object_window_pre_roll, cfg.object_window_post_roll, names, floor_start=True))
    if signals.advanced_hits is not None:
        hits = signals.advanced_hits.where(
            ~F.coalesce("source_wide", F.lit(False)) & F.col("kind").isin(*SEEDING_KINDS)
        )
        parts.append(_rolled(hits, pre, post, F.array(advanced_label()), floor_start=True))
    if not parts:
        return signals.assets.select(
            F.col("filepath").alias("source"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"),
            S.empty_strings().alias("labels"),
        ).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def playable_assets(assets: DataFrame) -> DataFrame:
    return assets.where((F.col("status") == "ok") & (F.col("duration") > 0))


def fallback_windows(assets: DataFrame, seeded: DataFrame) -> DataFrame:
    """Playable sources without any seed get their opening seconds."""
    return (
        playable_assets(assets)
        .withColumn("source", F.col("filepath"))
        .join(seeded.select("source").distinct(), "source", "left_anti")
        .select(
            "source", F.lit(0.0).alias("start"), F.least("duration", F.lit(12.0)).alias("end"),
            F.array(F.lit("low_signal")).alias("labels"),
        )
    )


def playable_seeds(assets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds of playable files, with the file's ``duration``."""
    return seeds.join(playable_assets(assets).select(F.col("filepath").alias("source"), "duration"), "source")


def clamped(seeds: DataFrame) -> DataFrame:
    """``playable_seeds`` cut to the file's extent."""
    kept = [c for c in seeds.columns if c not in ("start", "end", "duration")]
    return seeds.select(
        *kept, S.clamp_start("start", "duration").alias("start"), S.clamp_end("start", "end", "duration").alias("end")
    )


def clamped_seeds(assets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds of playable files, cut to the file's extent."""
    return clamped(playable_seeds(assets, seeds))


def candidate_windows(assets: DataFrame, seeds: DataFrame, gap: float, width: float = I.CHUNK_SECONDS) -> DataFrame:
    """Seeds clamped to the file and merged, plus fallbacks; each at least one second long.

    The runs merged inside each time chunk are materialised once: the chunk summaries, the
    final merge and the search for unseeded files all read them instead of the signals.
    """
    step = F.lit(float(gap))
    runs = cut_lineage(I.local_runs(clamped_seeds(assets, seeds), ["source"], step, width))
    merged = I.join_runs(runs, ["source"], step)
    return merged.unionByName(fallback_windows(assets, runs)).where(F.col("end") - F.col("start") >= 1.0)


# -- window scores -------------------------------------------------------------------------

def _hit_matches() -> Column:
    """The predicate of each signal kind against a window."""
    point = (F.col("start") <= F.col("h_start")) & (F.col("h_start") <= F.col("end"))
    overlap = S.strictly_overlaps("start", "end", "h_start", "h_end")
    return (
        F.when(F.col("kind").isin("scene", "level"), point)
        .when(_of("transcript"), I.endpoint_inside())
        .otherwise(overlap)
    )


def window_measures(floor_db: Column) -> dict[str, Column]:
    shared = S.overlap_seconds("start", "end", "h_start", "h_end")
    return {
        "scene_changes": F.count_if(_of("scene")),
        "peak": F.max(F.when(_of("level"), F.col("rms_db"))),
        "silence_overlap": F.coalesce(F.sum(F.when(_of("silence"), shared)), F.lit(0.0)),
        "transcript_hits": F.count_if(_of("transcript")),
        "words": _set_of_arrays(F.when(_of("transcript"), F.col("keywords"))),
        "object_hits": F.count_if(_of("object")),
        "object_classes": _set(F.when(_of("object"), F.col("class_name"))),
        "detections": F.coalesce(F.sum(F.when(_of("object"), F.col("amount"))), F.lit(0)),
        **advanced_measures(),
    }


def window_facts(windows: DataFrame, tall: DataFrame, id_cols: list[str], per_file: DataFrame) -> DataFrame:
    """Everything the score needs, one row per window; ``per_file`` adds its columns by source.

    One range join on ``(source, bucket)`` and one partial-then-final aggregation cover all
    signal kinds.  ``id_cols`` tell windows apart; windows of nothing else join the aggregation as rows without a signal, others are
    joined to their sums.  Source-wide hits are summed per source first and attached by source.
    """
    wide = F.coalesce("source_wide", F.lit(False))
    slim = windows.select(*id_cols, *[c for c in ("end",) if c not in id_cols])
    pairs = I.interval_join(slim, tall.where(~wide), ["source"], _hit_matches())
    alone = set(windows.columns) == set(id_cols)
    if alone:
        pairs = pairs.unionByName(windows, allowMissingColumns=True)
    measured = pairs.groupBy(*id_cols).agg(*[c.alias(n) for n, c in window_measures(F.lit(0.0)).items()])
    per_source = tall.where(wide).groupBy("source").agg(
        *[c.alias(f"wide_{n}") for n, c in advanced_measures().items()]
    )
    rows = measured if alone else windows.join(measured, id_cols, "left")
    rows = rows.join(per_file.join(per_source, "source", "left"), "source", "left")
    numbers = ("scene_changes", "silence_overlap", "transcript_hits", "object_hits", "detections")
    rows = _fill(rows, (*numbers, *_ADVANCED_NUMBERS, *[f"wide_{n}" for n in _ADVANCED_NUMBERS]))
    rows = rows.withColumns({n: F.col(n) + F.col(f"wide_{n}") for n in _ADVANCED_NUMBERS})
    rows = rows.withColumns({n: S.sorted_union(n, f"wide_{n}") for n in _ADVANCED_SETS})
    rows = rows.withColumns({n: S.label_array(n) for n in ("words", "object_classes")})
    return rows.drop(*[f"wide_{n}" for n in (*_ADVANCED_NUMBERS, *_ADVANCED_SETS)])


def advanced_in_windows(windows: DataFrame, hits: DataFrame) -> DataFrame:
    """Advanced hits per window and kind: source-wide ones always count, others by strict overlap.

    Source-wide hits are counted per source before they meet the windows.
    """
    wide = F.coalesce("source_wide", F.lit(False))
    spans = hits.where(~wide).select("source", "kind", F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    timed = I.overlapping_hits(windows.select("source", "start", "end"), spans, ["source"])
    timed = timed.groupBy("source", "start", "end", "kind").agg(F.count("*").alias("n"))
    always = hits.where(wide).groupBy("source", "kind").agg(F.count("*").alias("n"))
    everywhere = windows.select("source", "start", "end").join(always, "source")
    return (
        timed.unionByName(everywhere.select(*timed.columns))
        .groupBy("source", "start", "end", "kind").agg(F.sum("n").alias("n"))
    )


def silence_ratio() -> Column:
    return F.col("silence_overlap") / F.greatest(F.lit(0.1), F.col("end") - F.col("start"))


def score_columns(weights: dict[str, Column]) -> dict[str, Column]:
    """Window component scores from ``window_facts``.  ``weights`` may be literals or columns."""
    c = F.col
    return {
        "visual_activity_score": F.least(weights["visual"], c("scene_changes") * 8.0),
        "audio_interest_score": audio_points("peak", "silence_ratio"),
        "transcript_score": F.least(weights["transcript"], c("transcript_hits") * 10.0),
        "object_presence_score": F.least(
            weights["objects"],
            c("object_hits") * 2.0 + F.size("object_classes") * 2.0 + F.least(F.lit(6.0), c("detections") / 200.0),
        ),
        **advanced_score_columns(weights=weights),
    }


def total_score() -> Column:
    total = sum((F.col(n) for n in SCORE_NAMES[1:]), F.col(SCORE_NAMES[0]))
    return S.round_score(F.least(F.lit(100.0), total))


def window_labels(floor_db: float, classes: int | None = None) -> Column:
    """Seed labels, labels of what the window holds (its first object ``classes``), and those of its advanced hits, sorted."""
    own = F.expr(f"""array(
        CASE WHEN scene_changes > 1 THEN 'scene_cluster' WHEN scene_changes = 1 THEN 'scene_change' END,
        CASE WHEN peak >= {float(floor_db)}D THEN 'audio_spike' WHEN peak IS NOT NULL THEN 'audio_present' END,
        IF(silence_ratio > 0.6D, 'mostly_silent', NULL),
        IF(transcript_hits > 0, 'transcript_hit', NULL),
        IF(object_hits > 0, 'object_presence', NULL))""")
    objects = F.transform("object_classes" if classes is None else F.slice("object_classes", 1, classes), lambda x: F.concat(F.lit("object_"), S.slug(x)))
    return S.sorted_union("labels", own, objects, "advanced_labels")


def window_reasons(shown: int | None = None) -> Column:
    """Human-readable reasons in fixed order; name lists show their first ``shown``."""
    names = lambda c: f"array_join({c if shown is None else f'slice({c}, 1, {shown})'}, ', ')"
    # The expression of S.round_half_even("peak", 1).
    tenths = "CAST(rint(peak * 10D) / 10D AS DECIMAL(20, 1))"
    return F.expr(f"""array_compact(array(
        IF(scene_changes > 0, concat(scene_changes, ' scene change', IF(scene_changes = 1, '', 's'), ' in window'), NULL),
        IF(peak IS NOT NULL, concat('audio peak ', {tenths}, ' dB RMS'), NULL),
        IF(silence_ratio > 0.6D, 'mostly silent window', NULL),
        IF(transcript_hits > 0, concat('transcript keywords: ', {names('words')}), NULL),
        IF(object_hits > 0, concat('objects detected: ', {names('object_classes')}), NULL),
        IF(ocr_hits > 0, 'OCR/signage text detected', NULL),
        IF(face_total <> 0 OR person_total <> 0,
           concat('face/person presence detected (', face_total, ' faces, ', person_total, ' people)'), NULL),
        IF(size(event_types) > 0, concat('motorsports events: ', {names('event_types')}), NULL),
        IF(size(topics) > 0, concat('transcript topics: ', {names('topics')}), NULL),
        IF(ai_frame_scores > 0, concat('AI frame matches: ', {names('ai_labels')}), NULL),
        IF(array_contains(labels, 'low_signal'), 'fallback candidate; no strong highlight signal found', NULL)))""")


def signals_map() -> Column:
    """The stored ``signals`` map of a scored window."""
    two = lambda n: (n, f"bround({n}, 2)")
    plain = lambda n: (n, n)
    entries = [
        *[two(n) for n in SCORE_NAMES[:5]],
        plain("scene_changes"), ("peak_rms_db", "bround(peak, 2)"), ("silence_ratio", "bround(silence_ratio, 3)"),
        plain("object_hits"), ("object_class_count", "size(object_classes)"),
        *[two(n) for n in SCORE_NAMES[5:]],
        *[plain(n) for n in COUNT_NAMES],
    ]
    return F.expr("map(" + ", ".join(f"'{n}', CAST({x} AS DOUBLE)" for n, x in entries) + ")")


def literal_weights(cfg: ScoringConfig) -> dict[str, Column]:
    return {k: F.lit(cfg.weight(k)) for k in cfg.weights.keys() | {"ocr", "face_person", "motorsports", "topics", "ai"}}


def score_windows(windows: DataFrame, signals: Signals, cfg: ScoringConfig) -> DataFrame:
    """Component scores and total of each merged window; ``describe`` adds the texts."""
    technical = signals.assets.select(
        F.col("filepath").alias("source"), technical_points(cfg.weight("technical")).alias("technical_score")
    )
    facts = window_facts(windows, tall_signals(signals, cfg), ["source", "start", "end"], technical)
    rows = facts.fillna(0.0, subset=["technical_score"]).withColumn("silence_ratio", silence_ratio())
    return rows.withColumns(score_columns(literal_weights(cfg))).withColumn("score", total_score())


def describe(scored: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Action, reasons, signals map and labels of scored windows."""
    return scored.withColumns({
        "action": action_for_score("score", cfg),
        "reasons": window_reasons(cfg.shown_names),
        "signals": signals_map(),
        "labels": window_labels(cfg.audio_spike_floor_db, cfg.label_classes),
    })


# -- ranking and the flow ------------------------------------------------------------------

def rank_order() -> list[Column]:
    return [F.desc("score"), F.asc("source"), F.asc("start")]


def rank_candidates(scored: DataFrame, max_candidates: int | None) -> DataFrame:
    """Best first; ids follow the rank."""
    return ranked(scored, rank_order(), max_candidates).withColumn("id", F.format_string("clip_%04d", "rank"))


def scored_windows(signals: Signals, cfg: ScoringConfig) -> DataFrame:
    seeds = seed_windows(signals, cfg)
    return score_windows(candidate_windows(signals.assets, seeds, cfg.merge_gap), signals, cfg)


def generate_candidates(signals: Signals, cfg: ScoringConfig) -> DataFrame:
    """Every window, scored and described, in no order."""
    return describe(scored_windows(signals, cfg), cfg)


def ranked_candidates(signals: Signals, cfg: ScoringConfig) -> DataFrame:
    """Ranked candidates.  Only rows that survive the limit get their texts built."""
    best = ranked(scored_windows(signals, cfg), rank_order(), cfg.max_candidates)
    if cfg.max_candidates is not None:
        best = cut_lineage(best)  # a rank of everything is materialised already
    return describe(best, cfg).withColumn("id", F.format_string("clip_%04d", "rank"))


CANDIDATE_COLUMNS = ("rank", "id", "source", "start", "end", "score", "action", "labels", "reasons", "signals")


def rating_summary(candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: files, total duration, candidates and the count of each action."""
    files = assets.agg(F.count("*").alias("files"), F.bround(F.sum("duration"), 3).alias("total_duration"))
    counts = candidates.agg(
        F.count("*").alias("candidates"),
        *[F.count_if(F.col("action") == a).alias(a) for a in ("select", "review", "broll", "cut")],
    )
    # Two one-row aggregates side by side.
    return files.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")

