"""Parameter sweep: every scoring configuration in one job, the grid as a column.

Work that a parameter cannot change is shared: spikes depend on the audio profile (3),
windows on audio × roll (9), scores on windows × weights (54); thresholds and limits are
comparisons on top of a scored set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from clipsieve.config import DEFAULT_WEIGHTS, ScoringConfig
from clipsieve.operators import evaluate as E, intervals as I, rating as R
from clipsieve.operators.matching import greedy_pairs
from clipsieve.operators.ranking import rank_per_group, top_per_group
from clipsieve.session import cut_lineage

# The grid.  "base" entries come from the run's own configuration.
_NAMES = ("technical", "visual", "audio", "transcript", "objects", "ocr", "face_person", "motorsports", "topics", "ai")
WEIGHT_PROFILES = {
    "balanced": (20, 30, 30, 20, 10, 8, 6, 12, 10, 10),
    "audio": (15, 25, 40, 20, 8, 6, 4, 10, 8, 8),
    "visual": (15, 35, 30, 20, 12, 8, 8, 12, 8, 14),
    "transcript": (15, 20, 25, 40, 8, 8, 4, 10, 12, 8),
    "motorsports": (15, 25, 30, 20, 10, 8, 6, 18, 12, 12),
}
THRESHOLD_PROFILES = {"loose": (80, 62, 45), "review": (85, 65, 50), "strict": (90, 75, 60)}
ROLL_PROFILES = {"short": (2.0, 6.0, 2.0), "long": (4.0, 12.0, 6.0)}
AUDIO_PROFILES = {"sensitive": (75.0, -40.0), "strict": (90.0, -30.0)}
CANDIDATE_LIMITS = (50, 75, 100)

SET_KEYS = ["weight", "audio", "roll"]
#: Rows that a task gathers before it orders them.
PENDING = 65_536


def grid_axes(base: ScoringConfig) -> dict[str, dict]:
    """The five axes, base entries first."""
    weights = {**DEFAULT_WEIGHTS, **base.weights}
    limits = [*([None] if base.max_candidates is None else []), *sorted({base.max_candidates, *CANDIDATE_LIMITS} - {None})]
    return {
        "weight": {"base": tuple(weights[n] for n in _NAMES), **WEIGHT_PROFILES},
        "threshold": {"base": (base.min_select_score, base.min_review_score, base.min_broll_score), **THRESHOLD_PROFILES},
        "roll": {"base": (base.window_pre_roll, base.window_post_roll, base.merge_gap), **ROLL_PROFILES},
        "audio": {"base": (base.audio_spike_percentile, base.audio_spike_floor_db), **AUDIO_PROFILES},
        "limit": {"all" if n is None else str(n): (n,) for n in limits},
    }


def _axis(values: dict, names: tuple[str, ...], tag: str) -> Column:
    """An axis as an array of structs, its position and values included."""
    return F.array(*[
        F.struct(F.lit(i).alias(f"{tag}_no"), F.lit(name).alias(tag), *[(F.lit(None).cast("int") if v is None else F.lit(v)).alias(n) for n, v in zip(names, row)])
        for i, (name, row) in enumerate(values.items())
    ])


def _weight_names() -> tuple[str, ...]:
    return tuple(f"w_{n}" for n in _NAMES)


def config_grid(spark, base: ScoringConfig) -> DataFrame:
    """The grid, numbered in nesting order; rows equal in every value keep their first place."""
    axes = grid_axes(base)
    spec = [
        ("weight", _weight_names()), ("threshold", ("min_select", "min_review", "min_broll")),
        ("roll", ("pre_roll", "post_roll", "gap")), ("audio", ("percentile", "floor_db")), ("limit", ("max_candidates",)),
    ]
    rows = spark.range(1).drop("id")
    for tag, names in spec:
        rows = rows.select("*", F.inline(_axis(axes[tag], names, tag)))
    values = [n for _, names in spec for n in names]
    numbers = [f"{tag}_no" for tag, _ in spec]
    first = rows.groupBy(*values).agg(F.min(F.struct(*numbers, *[tag for tag, _ in spec])).alias("at")).select(*values, "at.*")
    # At most a few hundred rows, whatever the data.
    return first.withColumn("config_no", F.row_number().over(Window.orderBy(*numbers))).withColumn(
        "name", F.format_string("config_%03d", "config_no")
    )


def _profiles(axes: dict) -> list[tuple[str, str]]:
    """The (audio, roll) pairs; a window bears the place of its own."""
    return [(a, r) for a in axes["audio"] for r in axes["roll"]]


def _of_profile(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("profile") + 1)


def windows_by_profile(signals: R.Signals, base: ScoringConfig) -> DataFrame:
    """Merged windows of every (audio, roll) profile pair: ``profile, source, start, end``.

    Seeds meet their file before they are copied for the profiles; no profile reads the windows' labels, so none are carried.
    """
    axes = grid_axes(base)
    audio = [(str(i), *row) for i, row in enumerate(axes["audio"].values())]
    rolls = _axis(axes["roll"], ("pre_roll", "post_roll", "gap"), "roll")
    spikes = R.finite_levels(signals.levels).join(R.spike_thresholds(signals.levels, audio), "source").where(
        F.col("rms_db") >= F.col("threshold")
    )
    fixed = R.Signals(**{**signals.__dict__, "levels": None})
    still = base.with_(window_pre_roll=0.0, window_post_roll=0.0, object_window_pre_roll=0.0, object_window_post_roll=0.0)
    seeds = R.seed_windows(fixed, still).select(
        "source", "start", "end", F.array_contains("labels", "object_presence").alias("objects"), F.array(*[F.lit(i) for i in range(len(audio))]).alias("heard_by")
    )
    heard = spikes.select(
        "source", F.col("time").alias("start"), F.col("time").alias("end"), F.lit(False).alias("objects"), F.array(F.col("profile").cast("int")).alias("heard_by")
    )
    pre = F.when(F.col("objects"), F.lit(base.object_window_pre_roll)).otherwise(F.col("pre_roll"))
    post = F.when(F.col("objects"), F.lit(base.object_window_post_roll)).otherwise(F.col("post_roll"))
    rolled = (
        R.playable_seeds(signals.assets, seeds.unionByName(heard))
        .select("*", F.explode("heard_by").alias("audio_no")).select("*", F.inline(rolls))
        .select((F.col("audio_no") * len(axes["roll"]) + F.col("roll_no")).alias("profile"), "source", "duration",
                (F.col("start") - pre).alias("start"), (F.col("end") + post).alias("end"))
    )
    # The gap follows from the profile; as a key of its own, a double, it would move every seed once more.
    keys, gap = ["profile", "source"], _of_profile([axes["roll"][r][2] for _, r in _profiles(axes)])
    runs = cut_lineage(I.local_runs(R.clamped(rolled), keys, gap))
    merged = I.join_runs(runs, keys, gap)
    return merged.unionByName(_fallbacks(signals.assets, runs, axes)).where(F.col("end") - F.col("start") >= 1.0)


def _fallbacks(assets: DataFrame, runs: DataFrame, axes: dict) -> DataFrame:
    """Unseeded files, per profile pair."""
    profiles = F.array(*[F.lit(i) for i in range(len(_profiles(axes)))])
    every = R.playable_assets(assets).select(F.col("filepath").alias("source"), "duration", F.explode(profiles).alias("profile"))
    return every.join(runs.select("profile", "source").distinct(), ["profile", "source"], "left_anti").select(
        "profile", "source", F.lit(0.0).alias("start"), F.least("duration", F.lit(12.0)).alias("end"),
    )


def _leading(weights: list[str], keep: int, pending: int):
    """The best ``keep`` rows of each set among those of a task, in memory that its rows don't add to: a task has few sets.

    Columns ``s_`` hold the score by each weight.  A score below the last of ``keep`` better ones of its set goes at once; the
    others are ordered ``pending`` at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size, least, never = [], 0, {}, [-np.inf] * len(weights)
        for batch in batches:
            codes, pairs = pd.MultiIndex.from_frame(batch[["audio", "roll"]]).factorize()
            bounds = np.array([least.get(pair, never) for pair in pairs], float)
            scores = batch[[f"s_{n}" for n in weights]].to_numpy(float)
            row, weight = np.nonzero(~(scores < bounds[codes]))
            found = batch[["audio", "roll", "source", "start", "end"]].iloc[row]
            kept.append(found.assign(weight=np.array(weights, object)[weight], score=scores[row, weight]))
            size += len(row)
            if size >= pending:
                kept, size = [_first(pd.concat(kept), keep)], 0
                full = kept[0].groupby(SET_KEYS)["score"].agg(["size", "min"])
                least = {}
                for (name, *pair), last in full.loc[full["size"] >= keep, "min"].items():
                    least.setdefault(tuple(pair), list(never))[weights.index(name)] = last
        if kept:
            yield _first(pd.concat(kept), keep)

    return run


def _first(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    ordered = rows.sort_values(["score", "source", "start"], ascending=[False, True, True], kind="stable")
    return ordered.groupby(SET_KEYS, sort=False).head(keep)


def scored_sets(signals: R.Signals, base: ScoringConfig, keep: int | None) -> DataFrame:
    """The best ``keep`` windows of every (weight, audio, roll) set, with their rank; all of them without a limit.

    Technical points are the stored ones of the base run, so no profile changes them.
    """
    windows = windows_by_profile(signals, base)
    technical = signals.assets.select(
        F.col("filepath").alias("source"), R.technical_points(base.weight("technical")).alias("technical_score")
    )
    facts = R.window_facts(windows, R.tall_signals(signals, base), ["profile", "source", "start", "end"], technical)
    rows = facts.withColumn("silence_ratio", R.silence_ratio())
    weights = grid_axes(base)["weight"]
    for name, row in weights.items():
        rows = rows.withColumns(R.score_columns({n: F.lit(float(w)) for n, w in zip(_NAMES, row)})).withColumn(f"s_{name}", R.total_score())
    audio, roll = (_of_profile([pair[i] for pair in _profiles(grid_axes(base))]).alias(n) for i, n in enumerate(("audio", "roll")))
    place = [audio, roll, "source", "start", "end"]
    if keep is None:
        by_weight = F.inline(F.array(*[F.struct(F.lit(n).alias("weight"), F.col(f"s_{n}").alias("score")) for n in weights]))
        return rank_per_group(rows.select(*place, by_weight), SET_KEYS, R.rank_order())
    schema = "audio string, roll string, source string, start double, end double, weight string, score int"
    best = rows.select(*place, *[f"s_{n}" for n in weights]).mapInPandas(_leading(list(weights), keep, PENDING), schema)
    return top_per_group(best, SET_KEYS, R.rank_order(), keep)


def sweep_scoring(signals: R.Signals, annotations: DataFrame, base: ScoringConfig) -> DataFrame:
    """Evaluate every configuration of the grid; one row per configuration, best first.

    The limit of a configuration is a rank bound on its scored set and its thresholds decide
    which of those are positive; configurations of a set that come to the same candidates are matched once.
    """
    spark = annotations.sparkSession
    grid = config_grid(spark, base)
    limits = [row[0] for row in grid_axes(base)["limit"].values()]
    sets = cut_lineage(scored_sets(signals, base, None if None in limits else max(limits)))
    chosen = (
        sets.join(grid, SET_KEYS).where(F.col("max_candidates").isNull() | (F.col("rank") <= F.col("max_candidates")))
        .withColumn("action", R.action_for("score", F.col("min_select"), F.col("min_review"), F.col("min_broll")))
    )
    counts = chosen.groupBy("config_no").agg(F.count("*").alias("candidate_count"))
    predicted = E.predicted_positive(chosen)
    positives = E.positive_annotations(annotations)
    # Ranks follow scores, so what a configuration predicts is the first of its set: equal cut-offs share a matching.
    cutoffs = cut_lineage(predicted.groupBy("config_no", *SET_KEYS).agg(F.max("rank").alias("cutoff")))
    runs = sets.join(cutoffs.select(*SET_KEYS, "cutoff").distinct(), SET_KEYS).where(F.col("rank") <= F.col("cutoff"))
    found = greedy_pairs(positives, runs, [*SET_KEYS, "cutoff"])
    matches = found.join(cutoffs, [*SET_KEYS, "cutoff"]).select("config_no", "cand_rank")
    ignored = E._as_hits(annotations.where(F.col("rating").isin(*E.IGNORE_RATINGS)), "i_")
    excused = I.overlapping_hits(sets.select(*SET_KEYS, "rank", "source", "start", "end"), ignored, ["source"]).select(
        *SET_KEYS, "rank"
    ).distinct()
    wrong = (
        predicted.join(matches.select("config_no", F.col("cand_rank").alias("rank")), ["config_no", "rank"], "left_anti")
        .join(excused, [*SET_KEYS, "rank"], "left_anti")
        .groupBy("config_no").agg(F.count("*").alias("false_positives"))
    )
    right = matches.groupBy("config_no").agg(F.count("*").alias("true_positives"))
    total = positives.agg(F.count("*").alias("positive_annotations")).withColumn("_one", F.lit(1))
    rows = (
        grid.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")  # one row
        .join(counts, "config_no", "left").join(right, "config_no", "left").join(wrong, "config_no", "left")
        .fillna(0, ["candidate_count", "true_positives", "false_positives"])
        .withColumns(E.prf("true_positives", "false_positives", "positive_annotations"))
        .withColumn("missed", F.col("positive_annotations") - F.col("true_positives"))
    )
    order = [F.desc("f1"), F.desc("recall"), F.desc("precision"), F.asc("candidate_count"), F.asc("config_no")]
    # The grid has a fixed, small number of rows.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def weights_json() -> Column:
    return F.to_json(F.struct(*[F.col(f"w_{n}").alias(n) for n in sorted(_NAMES)]))

