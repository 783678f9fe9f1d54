"""Evaluation of ranked candidates against human annotations."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from clipsieve.functions import scalars as S
from clipsieve.operators import intervals as I
from clipsieve.operators.matching import greedy_pairs
from clipsieve.operators.ranking import global_rank
from clipsieve.session import cut_lineage

# Rating vocabularies and report cut-offs.
POSITIVE_RATINGS = ("select", "review", "broll")
NEGATIVE_RATINGS = ("reject", "cut")
IGNORE_RATINGS = ("ignore",)
SUPPORTED_RATINGS = POSITIVE_RATINGS + NEGATIVE_RATINGS + IGNORE_RATINGS
POSITIVE_ACTIONS = ("select", "review", "broll")
RECALL_AT = (5, 10, 25, 50)


def _as_hits(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """``start, end`` become ``h_start, h_end``; every other kept column gets ``prefix``."""
    names = {c: f"{prefix}{c}" for c in keep}
    return df.select(
        "source", F.col("start").alias("h_start"), F.col("end").alias("h_end"), *[F.col(c).alias(n) for c, n in names.items()]
    )


def positive_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.col("rating").isin(*POSITIVE_RATINGS))


def predicted_positive(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("action").isin(*POSITIVE_ACTIONS))


# -- greedy one-to-one matching ------------------------------------------------------------

def greedy_match(annotations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches with shared seconds and their share of the annotation."""
    matches = greedy_pairs(positive_annotations(annotations), predicted_positive(candidates))
    ann = annotations.select("ann_index", F.col("id").alias("annotation_id"), "source", "start", "end", "rating", "tags")
    cand = candidates.select(F.col("rank").alias("cand_rank"), F.col("id").alias("candidate_id"), "score", "action")
    length = S.interval_duration("start", "end")
    return matches.join(ann, "ann_index").join(cand, "cand_rank").withColumn("overlap_ratio", S.safe_ratio("overlap", length))


# -- nearest rows --------------------------------------------------------------------------

CANDIDATE_PAYLOAD = ("rank", "id", "action", "score")
ANNOTATION_PAYLOAD = ("ann_index", "id", "rating")


def nearest_candidate(annotations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per annotation the candidate of its source with the least gap, then best score, then rank."""
    right = _as_hits(candidates, "near_", *CANDIDATE_PAYLOAD)
    near = I.nearest_interval(
        annotations, right, ["source"], ["ann_index"], [F.col("near_score"), -F.col("near_rank")],
        [f"near_{c}" for c in CANDIDATE_PAYLOAD],
    ).drop("shared", "source")
    return annotations.join(near, "ann_index", "left")


def nearest_annotation(candidates: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per candidate the annotation with the least gap, then most shared time, then order."""
    right = _as_hits(annotations, "near_", *ANNOTATION_PAYLOAD)
    near = I.nearest_interval(
        candidates, right, ["source"], ["rank"], [-F.col("near_ann_index")],
        [f"near_{c}" for c in ANNOTATION_PAYLOAD], prefer_overlap=True,
    ).drop("source")
    return candidates.join(near, "rank", "left")


def nearest_to_point(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per ``frame_id`` at ``time``: the candidate at the least distance, then best score, then rank."""
    right = _as_hits(candidates, "near_", "rank", "id", "action", "score", "labels", "start", "end")
    near = I.nearest_interval(
        frames.withColumns({"start": F.col("time"), "end": F.col("time")}), right, ["source"], ["frame_id"],
        [F.col("near_score"), -F.col("near_rank")],
        [f"near_{c}" for c in ("rank", "id", "action", "score", "labels", "start", "end")], closed_points=True,
    ).drop("shared", "source")
    return frames.join(near, "frame_id", "left")


def best_overlap(candidates: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per candidate the rating of the annotation sharing most time, or ``unmatched``."""
    hits = _as_hits(annotations, "a_", "ann_index", "rating")
    shared = S.overlap_seconds("start", "end", "h_start", "h_end")
    best = (
        I.overlapping_hits(candidates.select("source", "rank", "start", "end"), hits, ["source"])
        .groupBy("rank")
        .agg(F.max(F.struct(shared.alias("shared"), (-F.col("a_ann_index")).alias("order"), F.col("a_rating").alias("rating"))).alias("best"))
        .select("rank", F.col("best.rating").alias("actual"))
    )
    return candidates.join(best, "rank", "left").withColumn("actual", F.coalesce("actual", F.lit("unmatched")))


def outside_ignored(predicted: DataFrame, annotations: DataFrame) -> DataFrame:
    """Candidates that share no time with an ignored annotation."""
    ignored = _as_hits(annotations.where(F.col("rating").isin(*IGNORE_RATINGS)), "i_")
    hit = I.overlapping_hits(predicted.select("source", "rank", "start", "end"), ignored, ["source"]).select("rank").distinct()
    return predicted.join(hit, "rank", "left_anti")


# -- metrics -------------------------------------------------------------------------------

def prf(true_positives, false_positives, positives) -> dict[str, Column]:
    """Precision, recall and F1 from unrounded ratios; empty denominators give 0."""
    tp, fp, pos = S.col(true_positives), S.col(false_positives), S.col(positives)
    precision, recall = S.safe_ratio(tp, tp + fp), S.safe_ratio(tp, pos)
    f1 = S.safe_ratio(precision * recall * 2, precision + recall)
    return {n: S.round_half_even(c, 4) for n, c in (("precision", precision), ("recall", recall), ("f1", f1))}


def recall_at_k(annotations: DataFrame, candidates: DataFrame, ks=RECALL_AT) -> DataFrame:
    """Share of positive annotations touched by the positive ones among the first ``k`` candidates.

    The limit comes before the action filter.  An annotation's best-ranked touching candidate
    decides every ``k`` at once.  At most ``max(ks)`` candidates are compared with annotations.
    """
    positives = positive_annotations(annotations)
    top = _as_hits(predicted_positive(candidates.where(F.col("rank") <= max(ks))), "c_", "rank")
    touching = I.overlapping_hits(positives.select("source", "ann_index", "start", "end"), top, ["source"])
    first = touching.groupBy("ann_index").agg(F.min("c_rank").alias("first"))
    rows = positives.join(first, "ann_index", "left")
    # Counts distinct ids of a document, as two annotations may share one.
    name = F.struct("path", "id") if "path" in annotations.columns else F.col("id")
    measures = [F.count_distinct(F.when(F.col("first") <= k, name)).alias(f"k{k}") for k in ks]
    totals = rows.agg(F.count("*").alias("total"), *measures)
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("matched")) for k in ks]))
    return totals.select("total", pairs).select("k", "matched", F.bround(S.safe_ratio("matched", "total"), 4).alias("recall"))


def recall_by_tag(annotations: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched and total positive annotations per tag; tagless ones count as ``untagged``."""
    tags = F.when(F.size(S.label_array("tags")) > 0, F.col("tags")).otherwise(F.array(F.lit("untagged")))
    rows = positive_annotations(annotations).join(
        matches.select("ann_index", F.lit(1).alias("hit")), "ann_index", "left"
    )
    return (
        rows.withColumn("tag", F.explode(tags)).groupBy("tag")
        .agg(F.count("*").alias("total"), F.count("hit").alias("matched"))
        .withColumn("recall", F.bround(S.safe_ratio("matched", "total"), 4))
    )


def action_confusion(candidates: DataFrame, annotations: DataFrame) -> DataFrame:
    return best_overlap(candidates, annotations).groupBy("action", "actual").agg(F.count("*").alias("n"))


def signal_breakdown(candidates: DataFrame, shown: int | None = None) -> DataFrame:
    """Non-zero ``*_score`` signals, best first, the other non-zero signals, and the reasons; of scores and reasons the first ``shown``."""
    live = F.map_filter("signals", lambda k, v: v.isNotNull() & (v != 0))
    is_score = lambda k: F.endswith(k, F.lit("_score"))
    entries = F.map_entries(F.map_filter(live, lambda k, v: is_score(k)))
    # Descending by value, then by name: sort on the negated value.
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct((-e.value).alias("down"), e.key.alias("name"), e.value.alias("value"))))
    first = lambda array: array if shown is None else F.slice(array, 1, shown)
    top = F.transform(first(keyed), lambda e: F.struct(e["name"].alias("name"), e.value.alias("value")))
    return candidates.withColumns({
        "top_scores": top,
        "counts": F.map_filter(live, lambda k, v: ~is_score(k)),
        "first_reasons": first(F.col("reasons")),
    })


def scoring_modes(candidates: DataFrame, ai_configured: bool = False, learned_configured: bool = False) -> DataFrame:
    """Which scorers took part: one row with the list of modes."""
    has = lambda key: F.coalesce(F.bool_or(F.element_at("signals", key).isNotNull()), F.lit(False))
    explained = F.lit(False)
    if "ai_explanations" in candidates.columns:
        explained = F.coalesce(F.bool_or(F.size("ai_explanations") > 0), F.lit(False))
    return candidates.agg(
        (has("ai_frame_score") | explained | F.lit(ai_configured)).alias("ai"),
        (has("learned_score") | F.lit(learned_configured)).alias("learned"),
    ).select(F.array_compact(F.array(
        F.lit("deterministic"), F.when(F.col("ai"), "ai-assisted"), F.when(F.col("learned"), "learned"),
    )).alias("modes"))


# -- the whole report ----------------------------------------------------------------------

class Evaluation:
    """The parts of a report; each is planned when first asked for."""

    def __init__(self, annotations: DataFrame, candidates: DataFrame):
        self.annotations, self.candidates = annotations, candidates
        self.positives = positive_annotations(annotations)

    @cached_property
    def matches(self) -> DataFrame:
        return cut_lineage(greedy_match(self.annotations, self.candidates))

    @cached_property
    def _missed(self) -> DataFrame:
        # Read by the counts and by every branch of the nearest search, as the next one.
        return cut_lineage(self.positives.join(self.matches.select("ann_index"), "ann_index", "left_anti"))

    @cached_property
    def _false_positives(self) -> DataFrame:
        used = self.matches.select(F.col("cand_rank").alias("rank"))
        unused = predicted_positive(self.candidates).join(used, "rank", "left_anti")
        return cut_lineage(outside_ignored(unused, self.annotations))

    @cached_property
    def missed(self) -> DataFrame:
        return nearest_candidate(self._missed, self.candidates)

    @cached_property
    def false_positives(self) -> DataFrame:
        return nearest_annotation(self._false_positives, self.annotations)

    @cached_property
    def confusion(self) -> DataFrame:
        return action_confusion(self.candidates, self.annotations)

    @cached_property
    def recall_at(self) -> DataFrame:
        return recall_at_k(self.annotations, self.candidates)

    @cached_property
    def recall_by_tag(self) -> DataFrame:
        return recall_by_tag(self.annotations, self.matches)

    @cached_property
    def metrics(self) -> DataFrame:
        kinds = (("true_positives", self.matches), ("false_positives", self._false_positives), ("missed", self._missed),
                 ("positive_annotations", self.positives))
        tallies = [df.select(F.lit(name).alias("kind")) for name, df in kinds]
        rows = reduce(DataFrame.unionByName, tallies)
        counts = rows.agg(*[F.count_if(F.col("kind") == name).alias(name) for name, _ in kinds])
        return counts.withColumns(prf("true_positives", "false_positives", "positive_annotations"))


def over_documents(rows: DataFrame, number: str, first: str, second: str) -> DataFrame:
    """``number``, which starts anew in every document, as one numbering over all of them."""
    return global_rank(rows.drop("_doc_number").withColumnRenamed(number, "_doc_number"), [F.col(first), F.col(second)], number).drop("_doc_number")


def evaluate(annotations: DataFrame, candidates: DataFrame) -> Evaluation:
    """``candidates`` carry ``rank, id, source, start, end, score, action``; sources already resolved.

    Rows of several documents, told apart by ``path``, are one evaluation: annotations count on from document to
    document, candidates by their rank in their own document first.
    """
    if "path" in annotations.columns:
        annotations = over_documents(annotations, "ann_index", "path", "_doc_number")
    if "path" in candidates.columns:
        candidates = over_documents(candidates, "rank", "_doc_number", "path")
    return Evaluation(annotations, candidates)


def compare_runs(runs: DataFrame, baseline: str) -> DataFrame:
    """Every run minus the baseline run, best first.  ``runs``: ``run`` and the metric columns."""
    numbers = ("precision", "recall", "f1")
    base = runs.where(F.col("run") == baseline).select(
        F.lit(1).alias("_one"), *[F.col(n).alias(f"_{n}") for n in (*numbers, "missed", "false_positives")]
    )
    rows = runs.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")  # one row
    rows = rows.withColumns({
        **{f"delta_{n}": F.bround(F.col(n) - F.col(f"_{n}"), 4) for n in numbers},
        "missed_delta": F.col("missed") - F.col("_missed"),
        "false_positive_delta": F.col("false_positives") - F.col("_false_positives"),
    })
    order = [F.desc("f1"), F.desc("recall"), F.desc("precision"), F.asc("missed"), F.asc("false_positives"), F.asc("run")]
    return global_rank(rows.drop("_one", *[f"_{n}" for n in (*numbers, "missed", "false_positives")]), order)
