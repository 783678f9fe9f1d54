"""A small inspectable linear scorer learned from review decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from clipsieve.config import ScoringConfig
from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators.rating import action_for_score, rank_candidates
from clipsieve.session import cut_lineage

# A model with more weights than this is joined by feature name instead of being shipped whole.
MAX_SHIPPED_WEIGHTS = 100_000


def _flags(names: Column, prefix: str) -> Column:
    """``prefix + name -> 1`` entries."""
    return F.transform(names, lambda n: F.struct(F.concat(F.lit(prefix), S.feature_name(n)).alias("key"), F.lit(1.0).alias("value")))


def _last_wins(entries: Column) -> Column:
    """A map from entries; of entries with one key the last counts."""
    def build(all_entries: Column) -> Column:
        keys = F.array_distinct(F.transform(all_entries, lambda e: e["key"]))
        last = lambda k: F.element_at(F.filter(all_entries, lambda e: e["key"] == k), -1)["value"]
        rounded = F.transform(all_entries, lambda e: F.struct(e["key"].alias("key"), F.bround(e["value"], 6).alias("value")))
        # Only repeated keys need the search.
        return F.when(F.size(all_entries) == F.size(keys), F.map_from_entries(rounded)).otherwise(
            F.map_from_arrays(keys, F.transform(keys, lambda k: F.bround(last(k), 6))))

    return S.let(entries, build)


def feature_entries(with_explanations: bool) -> Column:
    base = F.array(
        F.struct(F.lit("deterministic_score").alias("key"), F.coalesce("score", F.lit(0)).cast("double").alias("value")),
        F.struct(F.lit("duration_seconds").alias("key"), S.interval_duration("start", "end").alias("value")),
    )
    signals = F.transform(
        F.filter(F.coalesce(F.map_entries("signals"), F.array().cast("array<struct<key:string,value:double>>")), lambda e: e["value"].isNotNull()),
        lambda e: F.struct(S.feature_name(e["key"]).alias("key"), e["value"].cast("double").alias("value")),
    )
    parts = [base, signals, _flags(S.label_array("labels"), "label_")]
    if with_explanations:
        notes = F.coalesce("ai_explanations", F.array().cast("array<struct<score:double,suggested_action:string,labels:array<string>>>"))
        best = F.array_max(F.transform(notes, lambda e: e["score"]))
        judged = F.when(best.isNotNull(), F.array(F.struct(F.lit("ai_clip_judge_score").alias("key"), F.greatest(F.lit(0.0), best).alias("value"))))
        actions = F.filter(F.transform(notes, lambda e: F.trim(F.coalesce(e["suggested_action"], F.lit("")))), lambda a: F.length(a) > 0)
        labels = F.flatten(F.transform(notes, lambda e: S.label_array(e["labels"])))
        parts += [
            F.coalesce(judged, F.array().cast("array<struct<key:string,value:double>>")),
            _flags(actions, "ai_suggested_"), _flags(labels, "ai_label_"),
        ]
    return F.concat(*parts)


def candidate_features(candidates: DataFrame) -> DataFrame:
    """Add the ``features`` map of a candidate, rounded to six places."""
    return candidates.withColumn("features", _last_wins(feature_entries("ai_explanations" in candidates.columns)))


def training_label(decision="decision", action="action") -> tuple[Column, Column]:
    """(word, target): 1 keep, 0 drop, null for ignored; the caller handles unknown words."""
    word = F.lower(F.trim(F.coalesce(F.nullif(S.col(decision), F.lit("")), S.col(action), F.lit(""))))
    target = F.when(word.isin(*V.LEARN_POSITIVE), 1).when(word.isin(*V.LEARN_NEGATIVE), 0)
    return word, target


def build_review_dataset(
    decisions: DataFrame, candidates: DataFrame, project: str = "clip_project", profile: str = "default", include_source_paths: bool = False
) -> DataFrame:
    """Training records of the decisions whose clip is known.  Unknown words fail the job."""
    own = decisions.select("id", "decision", F.col("order").alias("d_order"), F.coalesce("note", F.lit("")).alias("d_note"))
    rows = candidate_features(candidates.join(own, "id"))  # features of the decided clips only
    word, target = training_label()
    known = word.isin(*V.LEARN_POSITIVE, *V.LEARN_NEGATIVE, *V.LEARN_IGNORE)
    checked = F.when(known, word).otherwise(
        F.raise_error(F.concat(F.lit("unsupported review decision for dataset: "), word)).cast("string")
    )
    clip = [
        "id", S.source_id("source").alias("source_id"), S.basename("source").alias("source_name"),
        S.hhmmss("start").alias("start"), S.hhmmss("end").alias("end"),
        F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"),
    ]
    if include_source_paths:
        clip.append(F.col("source").alias("source_path"))
    return rows.withColumns({"_rating": checked, "_target": target}).where(
        ~F.col("_rating").isin(*V.LEARN_IGNORE)
    ).select(
        F.struct(F.lit(project).alias("name"), S.feature_name(F.lit(project)).alias("id"), F.lit(profile).alias("profile")).alias("project"),
        F.struct(*clip).alias("clip"), "features",
        F.struct(F.col("_rating").alias("rating"), F.col("_target").alias("target")).alias("label"),
        F.struct("decision", F.col("d_order").alias("order"), F.col("d_note").alias("note")).alias("decision"),
        F.struct("action", "labels").alias("metadata"),
    )


@dataclass(frozen=True)
class Model:
    """``weights``: feature, weight, statistics.  ``summary``: one row with threshold, intercept and counts."""

    weights: DataFrame
    summary: DataFrame

    def packed(self) -> DataFrame:
        """The model as one row: a weight map and its scalars."""
        live = self.weights.where(F.col("weight") != 0)
        packed = live.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "weight")))).alias("weight_map"))
        return packed.withColumn("_one", F.lit(1)).join(self.summary.withColumn("_one", F.lit(1)), "_one")


def feature_values(rows: DataFrame) -> DataFrame:
    """``target, feature, value``.

    The outer form: a plain one's test for empty maps runs below the join with the decisions, on every candidate.
    """
    return rows.select("target", F.explode_outer("features").alias("feature", "value")).where(F.col("feature").isNotNull())


def train_scorer(dataset: DataFrame) -> Model:
    """Weight of a feature: difference of class means over its range, absent values counting as 0.

    Records are reduced to per-feature sums before the shuffle.  Mean raw scores are linear
    in the means, so the threshold needs no second pass over the records.
    """
    rows = dataset.where(F.col("label.target").isin(0, 1)).select("features", F.col("label.target").alias("target"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("target") == 1).alias("n_pos"), F.count_if(F.col("target") == 0).alias("n_neg"))
    both = F.assert_true((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.lit("training dataset must include both positive and negative review decisions"))
    sizes = sizes.withColumn("_ok", both).where(F.col("_ok").isNull()).drop("_ok").withColumn("_one", F.lit(1))
    value = F.coalesce("value", F.lit(0.0))
    facts = feature_values(rows).groupBy("feature").agg(
        F.count("*").alias("seen"), F.sum(F.when(F.col("target") == 1, value).otherwise(0.0)).alias("sum_pos"),
        F.sum(F.when(F.col("target") == 0, value).otherwise(0.0)).alias("sum_neg"),
        F.min(value).alias("lo"), F.max(value).alias("hi"),
    ).withColumn("_one", F.lit(1)).join(F.broadcast(sizes), "_one")  # one row
    zero = F.lit(0.0)
    lo = F.when(F.col("seen") < F.col("n"), F.least("lo", zero)).otherwise(F.col("lo"))
    hi = F.when(F.col("seen") < F.col("n"), F.greatest("hi", zero)).otherwise(F.col("hi"))
    stats = facts.select(
        "feature", (F.col("sum_pos") / F.col("n_pos")).alias("pm"), (F.col("sum_neg") / F.col("n_neg")).alias("nm"), lo.alias("lo"), hi.alias("hi"),
    ).withColumn("scale", F.greatest(F.lit(1.0), F.col("hi") - F.col("lo")))
    stats = cut_lineage(stats.withColumn("weight", F.bround((F.col("pm") - F.col("nm")) / F.col("scale"), 6)))
    centre = stats.agg(
        F.bround((F.sum(F.col("weight") * F.col("pm")) + F.sum(F.col("weight") * F.col("nm"))) / 2.0, 6).alias("threshold"),
        F.count_if(F.col("weight") != 0).alias("features"),
    ).withColumn("_one", F.lit(1))
    summary = centre.join(sizes, "_one").select(
        "threshold", F.lit(0.0).alias("intercept"), "features", F.col("n").alias("records"), F.col("n_pos").alias("positives"), F.col("n_neg").alias("negatives")
    )
    six = lambda n, alias: F.bround(n, 6).alias(alias)
    weights = stats.select("feature", "weight", six("pm", "positive_mean"), six("nm", "negative_mean"), six("lo", "min"), six("hi", "max"), six("scale", "scale"))
    return Model(weights, cut_lineage(summary))


def with_raw_score(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``raw_score`` (intercept + Σ feature · weight) and ``threshold`` to rows with a ``features`` map.

    A model of bounded size travels to the rows as one map.  A larger one is joined by
    feature name, with the rows' features salted because some features occur in every row.
    """
    size = model.weights.where(F.col("weight") != 0).limit(MAX_SHIPPED_WEIGHTS + 1).count()
    if size <= MAX_SHIPPED_WEIGHTS:
        total = F.aggregate(
            F.map_entries("features"), F.col("intercept"),
            lambda acc, e: acc + F.coalesce(e["value"], F.lit(0.0)) * F.coalesce(F.try_element_at("weight_map", e["key"]), F.lit(0.0)),
        )
        packed = model.packed().select("_one", "weight_map", "threshold", "intercept")
        return (
            rows.withColumn("_one", F.lit(1)).join(F.broadcast(packed), "_one")
            .withColumn("raw_score", total).drop("_one", "weight_map", "intercept")
        )
    salts = 64
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    keyed = cut_lineage(keyed)
    parts = keyed.select("_row", F.explode("features").alias("feature", "_v")).withColumn("_salt", F.pmod("_row", F.lit(salts)))
    spread = model.weights.where(F.col("weight") != 0).select("feature", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    sums = parts.join(spread, ["feature", "_salt"]).groupBy("_row").agg(F.sum(F.col("_v") * F.col("weight")).alias("_sum"))
    scalars = model.summary.select(F.lit(1).alias("_one"), "threshold", "intercept")
    return (
        keyed.join(sums, "_row", "left").withColumn("_one", F.lit(1)).join(F.broadcast(scalars), "_one")
        .withColumn("raw_score", F.col("intercept") + F.coalesce("_sum", F.lit(0.0))).drop("_row", "_sum", "_one", "intercept")
    )


def training_accuracy(dataset: DataFrame, model: Model) -> DataFrame:
    rows = with_raw_score(dataset.where(F.col("label.target").isin(0, 1)), model)
    guess = F.when(F.col("raw_score") >= F.col("threshold"), 1).otherwise(0)
    return rows.agg(
        F.count("*").alias("records"), F.bround(F.count_if(guess == F.col("label.target")) / F.greatest(F.lit(1), F.count("*")), 4).alias("accuracy")
    )


def score_with_model(candidates: DataFrame, model: Model) -> DataFrame:
    """Add the learned signals, label and reason."""
    rows = with_raw_score(candidate_features(candidates), model)
    learned = F.bround(S.sigmoid(F.col("raw_score") - F.col("threshold")) * 100.0, 2)
    rows = rows.withColumn("learned_score", learned).withColumn("learned_raw_score", F.bround("raw_score", 6))
    verdict = F.when(F.col("learned_score") >= 50.0, "learned_positive").otherwise("learned_negative")
    old = F.map_filter("signals", lambda k, v: ~k.isin("learned_score", "learned_raw_score"))
    return rows.withColumns({
        "labels": S.sorted_union("labels", F.array(verdict)),
        "reasons": F.concat("reasons", F.array(F.concat(F.lit("learned scorer score "), F.col("learned_score").cast("string")))),
        "signals": F.map_concat(old, S.numeric_map([("learned_score", F.col("learned_score")), ("learned_raw_score", F.col("learned_raw_score"))])),
    }).drop("raw_score", "threshold", "features")


def apply_learned(candidates: DataFrame, model: Model, cfg: ScoringConfig) -> DataFrame:
    """Blend the learned score in, act on the new score, rank again."""
    rows = score_with_model(candidates, model)
    blended = F.greatest(F.lit(0), F.least(F.lit(100), S.round_score((F.col("score") + F.col("learned_score")) / 2.0)))
    rows = rows.withColumn("score", blended).withColumn("action", action_for_score("score", cfg))
    return rank_candidates(rows.drop("rank", "id"), cfg.max_candidates)
