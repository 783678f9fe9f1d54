"""Content planning: ranking for labels, pillars, series plans, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators.ranking import rank_per_group, ranked, top_per_group


def label_rank_order(preferred: list[str] = ()) -> list[Column]:
    """Score (+20 with any preferred label), number of preferred labels, id: all descending."""
    shared = F.size(F.array_intersect(S.label_array("labels"), S.string_array(preferred)))
    return [F.desc(F.col("score") + F.when(shared > 0, 20).otherwise(0)), F.desc(shared), F.desc("id")]


def rank_for_labels(candidates: DataFrame, preferred: list[str], n: int | None = None) -> DataFrame:
    """Candidates ranked for the preferred labels; with ``n``, the first so many."""
    return ranked(candidates.drop("rank"), label_rank_order(preferred), n)


def in_pillar(pillar: dict) -> Column:
    by_label = F.arrays_overlap(S.label_array("labels"), S.string_array(pillar["labels"])) if pillar["labels"] else F.lit(False)
    return by_label | S.any_substring("_text", pillar["keywords"])


def content_map(candidates: DataFrame, per_pillar: int | None = None) -> DataFrame:
    """The candidates of each pillar, best first: ``pillar, title, rank, …``."""
    members = F.array_compact(F.array(*[
        F.when(in_pillar(p), F.struct(F.lit(key).alias("pillar"), F.lit(p["title"]).alias("title"))) for key, p in V.PILLARS.items()
    ]))
    rows = candidates.drop("rank").withColumn("_text", S.candidate_search_text()).select("*", F.inline(members)).drop("_text")
    order = label_rank_order()
    return rank_per_group(rows, ["pillar"], order, "rank") if per_pillar is None else top_per_group(rows, ["pillar"], order, per_pillar)


def top_candidates(candidates: DataFrame, n: int | None = None) -> DataFrame:
    return rank_for_labels(candidates, [], n)


def series_hook(hooks: list[str], rank="rank") -> Column:
    """Hooks in turn."""
    if not hooks:
        return F.lit("Clip candidate")
    return F.element_at(S.string_array(hooks), (F.pmod(S.col(rank) - 1, F.lit(len(hooks))) + 1).cast("int"))


def edit_note() -> Column:
    labels = F.coalesce(F.nullif(S.joined("labels", ", "), F.lit("")), F.lit("rated candidate"))
    reasons = F.array_join(F.slice(S.label_array("reasons"), 1, 2), "; ")
    return F.trim(F.concat(labels, F.lit(". "), reasons))


def list_series_templates(spark: SparkSession) -> DataFrame:
    """The known series: ``template, name, description, duration, hashtags, hooks, labels``."""
    fields = ("name", "description", "duration", "hashtags", "hooks", "labels")
    rows = [(key, *(t[f] for f in fields)) for key, t in V.SERIES_TEMPLATES.items()]
    return spark.createDataFrame(rows, "template string, name string, description string, duration string, hashtags array<string>, hooks array<string>, labels array<string>")


def series_supply(candidates: DataFrame) -> DataFrame:
    """Every known series with the number of candidates that have one of its labels, and their best score."""
    templates = list_series_templates(candidates.sparkSession)
    wanted = F.broadcast(templates.select("template", F.explode("labels").alias("label")))  # a row for each label of a template
    one = ["rank", "score", F.explode(F.array_distinct(S.label_array("labels"))).alias("label")]
    found = candidates.select(*one).join(wanted, "label").groupBy("template", "rank").agg(F.max("score").alias("score"))
    counts = found.groupBy("template").agg(F.count("*").alias("candidates"), F.max("score").alias("best_score"))
    return templates.join(counts, "template", "left").fillna(0, ["candidates"])


def series_plan(candidates: DataFrame, template: str = "team_tuesday", n: int | None = None) -> DataFrame:
    """The clips of a content series with hook, caption and edit note."""
    if template not in V.SERIES_TEMPLATES:
        raise KeyError(f"unknown series template: {template}")
    t = V.SERIES_TEMPLATES[template]
    rows = rank_for_labels(candidates, t["labels"], None if n is None else max(0, n)).withColumn("hook", series_hook(t["hooks"]))
    return rows.withColumns({
        "series": F.lit(t["name"]), "caption": F.concat_ws(" ", "hook", F.lit(" ".join(t["hashtags"]))), "edit_note": edit_note(),
    })


QUOTE_WORDS = ("transcript", "quote", "says", "interview")


def quote_candidates(candidates: DataFrame, n: int | None = None) -> DataFrame:
    rows = candidates.withColumn("_text", S.candidate_search_text())
    kept = rows.where(F.array_contains("labels", "transcript_hit") | S.any_substring("_text", QUOTE_WORDS))
    return rank_for_labels(kept.drop("_text"), [], n)


def quote_hits(hits: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """The queue of transcript hits, white space collapsed."""
    rows = hits.withColumns({
        "text": F.trim(F.regexp_replace("text", r"\s+", " ")), "source_name": S.basename("source"),
        "start_tc": S.hhmmss("start"), "end_tc": S.hhmmss("end"),
    })
    return ranked(rows, order, n)
