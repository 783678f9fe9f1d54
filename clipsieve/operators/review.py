"""Review: approvals, decisions, review rows, filters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators import intervals as I
from clipsieve.operators.ranking import global_rank


#: Hits of a clip that its review row lists; all of them are counted.
LISTED_HITS = 20


def filter_by_label(candidates: DataFrame, label: str = "audio_spike") -> DataFrame:
    return candidates.where(F.array_contains("labels", label))


def order_of(column="order") -> Column:
    """A usable review order, or the unset mark."""
    return F.coalesce(S.col(column).try_cast("int"), F.lit(V.ORDER_UNSET))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision per id; ``pos`` is the place in the document (the order when absent)."""
    place = F.coalesce(F.col("pos") if "pos" in decisions.columns else F.col("order"), F.lit(-1))
    rest = [c for c in decisions.columns if c != "id"]
    return (
        decisions.where(F.length("id") > 0)
        .groupBy("id").agg(F.max_by(F.struct(*rest), place).alias("d")).select("id", "d.*")
    )


def approve(
    candidates: DataFrame,
    decisions: DataFrame | None = None,
    ids: list[str] = (),
    actions: list[str] = ("select", "review"),
    min_score: int | None = None,
) -> DataFrame:
    """Approved clips.  A decision word wins; otherwise listed ids, or action and score.

    Times are re-emitted as whole-second display values, as every later step reads them.
    """
    wanted = sorted({i.strip() for i in ids if i.strip()})
    allowed = sorted({a.strip() for a in actions if a.strip()})
    if wanted:
        keep = F.col("id").isin(wanted)
    else:
        keep = F.col("action").isin(allowed)
        if min_score is not None:
            keep = keep & (F.col("score") >= int(min_score))
    if decisions is not None:
        d = latest_decisions(decisions).select(
            "id", F.col("decision").alias("review_decision"), order_of("order").alias("review_order"),
            F.nullif(F.trim(F.coalesce("note", F.lit(""))), F.lit("")).alias("review_note"),
        )
        rows = candidates.join(d, "id", "left")
        word = F.lower(F.trim(F.coalesce("review_decision", F.lit(""))))
        keep = F.when(word.isin(*V.APPROVE_WORDS), True).when(word.isin(*V.DECLINE_WORDS), False).otherwise(keep)
    else:
        none = lambda t: F.lit(None).cast(t)
        rows = candidates.withColumns({"review_decision": none("string"), "review_order": none("int"), "review_note": none("string")})
    order = F.coalesce("review_order", F.lit(V.ORDER_UNSET)) if decisions is not None else F.lit(0)
    return rows.where(keep).select(
        "rank", "source", S.hhmmss("start").alias("start"), S.hhmmss("end").alias("end"), F.col("id").alias("label"),
        "score", F.lit("approved").alias("action"), F.col("action").alias("original_action"), "labels", "reasons",
        "review_decision", "review_order", "review_note", order.alias("sort_order"),
    )


def default_decision(action="action") -> Column:
    a = S.col(action)
    return F.when(a.isin("select", "review"), "approve").when(a.isin("broll", "b-roll", "b_roll"), "broll").otherwise("reject")


def merge_decisions(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Upsert of decision rows: known ids keep decision, note and order; new ones queue behind.

    New rows follow the highest active order in rank order, or keep their own rank when no
    active order exists.
    """
    if existing is None:
        return rows.withColumns({"decision": default_decision(), "order": F.col("rank"), "note": F.lit("")})
    old = latest_decisions(existing).select(
        "id", F.col("decision").alias("_decision"), order_of("order").alias("_order"), F.col("note").alias("_note"),
        F.lit(True).alias("_known"),
    )
    joined = rows.join(old, "id", "left")
    highest = joined.agg(
        F.max(F.when(F.col("_order") != V.ORDER_UNSET, F.col("_order"))).alias("_highest")
    ).withColumn("_one", F.lit(1))
    known = joined.where(F.col("_known"))
    new = global_rank(joined.where(F.col("_known").isNull()), [F.asc("rank")], "_queue")
    all_rows = known.withColumn("_queue", F.lit(None).cast("long")).unionByName(new)
    order = F.when(F.col("_known"), F.col("_order")).when(
        F.col("_highest").isNull(), F.col("rank")
    ).otherwise(F.col("_highest") + F.col("_queue"))
    return (
        all_rows.withColumn("_one", F.lit(1)).join(F.broadcast(highest), "_one")  # one row
        .withColumns({
            "decision": F.coalesce(F.nullif(F.col("_decision"), F.lit("")), default_decision()),
            "order": order.cast("long"),
            "note": F.coalesce("_note", F.lit("")),
        })
        .drop("_one", "_decision", "_order", "_note", "_known", "_highest", "_queue")
    )


def update_decision(rows: DataFrame, clip_id: str, decision=None, note=None, order=None) -> DataFrame:
    """Change one clip's fields; the others stay."""
    hit = F.col("id") == clip_id
    changes = {n: v for n, v in (("decision", decision), ("note", note), ("order", order)) if v is not None}
    return rows.withColumns({n: F.when(hit, F.lit(v)).otherwise(F.col(n)) for n, v in changes.items()})


def filter_review(
    clips: DataFrame, query: str = "", action: str = "", label: str = "", source: str = "", decision: str = "", calibration: str = ""
) -> DataFrame:
    """AND of the given predicates; read in ``(order, score descending)``."""
    status = F.coalesce("calibration_status", F.lit("unreviewed"))
    text = F.lower(F.concat_ws(" ", "id", "source_name", "decision", status, S.joined("labels", " "), S.joined("reasons", " ")))
    rows = clips
    if query.strip():
        rows = rows.where(F.contains(text, F.lit(query.strip().lower())))
    if action.strip():
        rows = rows.where(F.col("action") == action.strip())
    if label.strip():
        rows = rows.where(F.array_contains("labels", label.strip()))
    if source.strip():
        rows = rows.where(F.contains(F.lower("source_name"), F.lit(source.strip().lower())))
    if decision.strip():
        rows = rows.where(F.col("decision") == decision.strip())
    if calibration.strip():
        rows = rows.where(status == calibration.strip())
    return rows.orderBy(F.asc(order_of("order")), F.desc("score"))


def annotation_rating(decision="decision", action="action") -> Column:
    """Six-way rating of a decision word; unknown words come out null."""
    word = F.lower(F.coalesce(F.nullif(S.col(decision), F.lit("")), F.nullif(S.col(action), F.lit("")), F.lit("review")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rating, words in V.ANNOTATION_WORDS.items():
        out = out.when(word.isin(*words), rating)
    return out


def decision_join(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions as annotation rows: their own fields override the candidate's.

    ``error`` names what is wrong with a row; good rows have null there.
    """
    known = candidates.select(
        F.col("id"), F.col("source").alias("c_source"), F.col("start").alias("c_start"), F.col("end").alias("c_end"),
        F.col("score").alias("c_score"), F.col("action").alias("c_action"), F.col("labels").alias("c_labels"),
    )
    own = lambda name, kind: F.col(name) if name in decisions.columns else F.lit(None).cast(kind)
    rows = decisions.withColumns({n: own(n, t) for n, t in (
        ("source", "string"), ("start", "double"), ("end", "double"), ("tags", "array<string>"), ("current_action", "string"))})
    joined = rows.join(known, "id", "left").select(
        "id", F.coalesce("source", "c_source").alias("source"), F.coalesce("start", "c_start", F.lit(0.0)).alias("start"),
        F.coalesce("end", "c_end", F.lit(0.0)).alias("end"), annotation_rating("decision", "c_action").alias("rating"),
        F.coalesce("tags", "c_labels", S.empty_strings()).alias("tags"), F.coalesce("note", F.lit("")).alias("notes"),
        F.col("c_score").alias("score"), F.coalesce("current_action", "c_action").alias("original_action"), "decision", "order",
    )
    return joined.withColumn("error", F.when(F.col("source").isNull(), "missing source")
                             .when(F.col("end") <= F.col("start"), "end must be after start")
                             .when(F.col("rating").isNull(), F.concat(F.lit("unsupported review decision: "), F.col("decision"))))


# -- review rows ---------------------------------------------------------------------------

def _window_hits(clips: DataFrame, hits: DataFrame, order: str, keep: int, name: str, wide: Column | None = None) -> DataFrame:
    """First ``keep`` hits of each clip in original order, as an array.

    Source-wide hits belong to every clip of a source; only their first ``keep`` can appear,
    so no more than that many per source ever meet the clips.
    """
    item = F.struct(*[c for c in hits.columns if c not in ("source", "h_start", "h_end")])
    slim = hits.select("source", "h_start", "h_end", F.col(order).alias("_order"), item.alias("_hit"), (wide if wide is not None else F.lit(False)).alias("_wide"))
    c = clips.select("rank", "source", "start", "end")
    found = I.overlapping_hits(c, slim.where(~F.col("_wide")), ["source"]).select("rank", "_order", "_hit")
    if wide is not None:
        first = Window.partitionBy("source").orderBy("_order")
        always = slim.where("_wide").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep)
        found = found.unionByName(c.join(always, "source").select("rank", "_order", "_hit"))
    spec = Window.partitionBy("rank").orderBy("_order")
    return (
        found.withColumn("_n", F.row_number().over(spec)).where(F.col("_n") <= keep)
        .groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("_order", "_hit"))).alias("_all"))
        .select("rank", F.transform("_all", lambda x: x["_hit"]).alias(name))
    )


def _class_of(name: Column) -> Column:
    return F.coalesce(name, F.lit("object"))


def _detections_of(count: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(count, F.lit(1))).cast("long")


def _totals(found: DataFrame, name: str) -> DataFrame:
    """``rank, name, n, hits`` rows summed to one array of (name, n) for each clip, with the number of its hits."""
    sums = found.groupBy("rank", "name").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return sums.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias(f"{name}_totals"), F.sum("hits").alias(f"{name}_hit_count"))


def object_totals(clips: DataFrame, hits: DataFrame) -> DataFrame:
    """Per clip the detections of each object class, over all its hits, as sorted (name, n)."""
    slim = hits.select("source", "h_start", "h_end", _class_of(F.col("class_name")).alias("name"), _detections_of(F.col("count")).alias("n"))
    slim = slim.groupBy("source", "h_start", "h_end", "name").agg(F.sum("n").alias("n"), F.count("*").alias("hits"))
    return _totals(I.overlapping_hits(clips.select("rank", "source", "start", "end"), slim, ["source"]), "object")


def advanced_totals(clips: DataFrame, hits: DataFrame) -> DataFrame:
    """Per clip the number of advanced hits of each kind, over all of them, and the labels that a model gave.

    Source-wide hits are counted once per source, and only the counts meet the clips.
    """
    wide = F.coalesce("source_wide", F.lit(False))
    labels = F.when(F.col("kind") == "ai_frame_score", F.filter(S.label_array("labels"), lambda x: F.length(x) > 0))
    marks = F.explode(F.concat(
        F.array(F.struct(F.coalesce("kind", F.lit("advanced")).alias("name"), F.lit(False).alias("label"))),
        F.coalesce(F.transform(labels, lambda x: F.struct(x.alias("name"), F.lit(True).alias("label"))), F.array()),
    ))
    rows = hits.select("source", "h_start", "h_end", wide.alias("wide"), marks.alias("m")).select("source", "h_start", "h_end", "wide", "m.*")
    c = clips.select("rank", "source", "start", "end")
    place = ["source", "h_start", "h_end", "name", "label"]
    near = I.overlapping_hits(c, rows.where("not wide").groupBy(*place).agg(F.count("*").alias("n")), ["source"])
    always = c.join(rows.where("wide").groupBy("source", "name", "label").agg(F.count("*").alias("n")), "source")
    found = near.select("rank", "name", "label", "n").unionByName(always.select("rank", "name", "label", "n"))
    kinds = _totals(found.where("not label").withColumn("hits", F.col("n")), "advanced")
    named = found.where("label").groupBy("rank").agg(F.array_sort(F.collect_set("name")).alias("model_labels"))
    return kinds.join(named, "rank", "left")


def calibration_status(matches: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Candidate id to status; a false positive overrides a match."""
    none = lambda t: F.lit(None).cast(t)
    good = matches.select(
        F.col("candidate_id").alias("id"), F.lit(0).alias("_p"), F.lit("matched").alias("status"), "annotation_id",
        F.col("rating").alias("annotation_rating"), F.bround("overlap", 3).alias("overlap_seconds"),
        F.bround("overlap_ratio", 4).alias("overlap_ratio"), none("double").alias("nearest_gap_seconds"),
    )
    bad = false_positives.select(
        "id", F.lit(1).alias("_p"), F.lit("false_positive").alias("status"), F.col("near_id").alias("annotation_id"),
        F.col("near_rating").alias("annotation_rating"), none("double").alias("overlap_seconds"),
        none("double").alias("overlap_ratio"), F.bround("gap", 3).alias("nearest_gap_seconds"),
    )
    rows = good.unionByName(bad)
    rest = [c for c in rows.columns if c not in ("id", "_p")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "_p").alias("calibration"))


def review_rows(
    candidates: DataFrame,
    file_scores: DataFrame,
    object_hits: DataFrame | None = None,
    advanced_hits: DataFrame | None = None,
    calibration: DataFrame | None = None,
    judgments: DataFrame | None = None,
    max_items: int | None = None,
    listed: int = LISTED_HITS,
) -> DataFrame:
    """Candidates with file metadata and scores, their hits, calibration and judgments.

    All hits of a clip are counted (``hit_totals``); its first ``listed`` ones are there to be shown.
    """
    rows = candidates if max_items is None else candidates.where(F.col("rank") <= max(0, max_items))
    rows = rows.withColumns({
        "source_name": S.basename("source"), "start_tc": S.hhmmss("start"), "end_tc": S.hhmmss("end"),
        "duration": S.interval_duration("start", "end"),
    })
    out = rows.join(file_scores, "source", "left")
    if object_hits is not None:
        out = out.join(_window_hits(rows, object_hits, "hit_order", listed, "object_hit_rows"), "rank", "left")
        out = out.join(object_totals(rows, object_hits), "rank", "left")
    if advanced_hits is not None:
        wide = F.coalesce("source_wide", F.lit(False))
        out = out.join(_window_hits(rows, advanced_hits, "hit_order", listed, "advanced_hit_rows", wide), "rank", "left")
        out = out.join(advanced_totals(rows, advanced_hits), "rank", "left")
    if calibration is not None:
        out = out.join(calibration, "id", "left")
        out = out.withColumn("calibration_status", F.coalesce("calibration.status", F.lit("unreviewed")))
    else:
        out = out.withColumn("calibration", F.lit(None).cast("struct<status:string,annotation_id:string,overlap_ratio:double>"))
        out = out.withColumn("calibration_status", F.lit("unreviewed"))
    if judgments is not None:
        out = out.join(judgments, "id", "left")
    return out


# -- display summaries ---------------------------------------------------------------------

def _first(array: Column, shown: int | None) -> Column:
    return array if shown is None else F.slice(array, 1, shown)


def _counted(pairs: Column, shown: int | None) -> Column:
    """``name xN`` for the first entries of a sorted (name, n) array."""
    return F.array_join(F.transform(_first(pairs, shown), lambda p: F.concat(p["name"], F.lit(" x"), p["n"].cast("string"))), ", ")


def _tally(array: Column, name, amount) -> Column:
    """Sorted (name, n) pairs of a clip's listed hits."""
    names = F.array_sort(F.array_distinct(F.transform(array, name)))
    count = lambda n: F.aggregate(F.filter(array, lambda h: name(h) == n), F.lit(0).cast("long"), lambda a, h: a + amount(h))
    return F.transform(names, lambda n: F.struct(n.alias("name"), count(n).alias("n")))


def hit_summaries(rows: DataFrame, of_listed: bool = False, shown: int | None = None) -> DataFrame:
    """Object, advanced and signal summary texts per review row: over all its hits, or over the listed ones.

    Of object names and labels the first ``shown`` appear.
    """
    objects, advanced = F.col("object_hit_rows"), F.col("advanced_hit_rows")
    object_pairs = _tally(objects, lambda h: _class_of(h["class_name"]), lambda h: _detections_of(h["count"]))
    kind_pairs = _tally(advanced, lambda h: F.coalesce(h["kind"], F.lit("advanced")), lambda h: F.lit(1).cast("long"))
    model = F.filter(advanced, lambda h: h["kind"] == "ai_frame_score")
    labels = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(model, lambda h: S.label_array(h["labels"]))), lambda x: F.length(x) > 0)))
    if not of_listed:
        object_pairs, kind_pairs, labels = F.col("object_totals"), F.col("advanced_totals"), F.coalesce("model_labels", S.empty_strings())
    suffix = F.when(F.size(labels) > 0, F.concat(F.lit("; AI labels: "), F.array_join(_first(labels, shown), ", "))).otherwise("")
    return rows.withColumns({
        "object_summary": F.when(F.size(object_pairs) > 0, F.concat(F.lit("Objects: "), _counted(object_pairs, shown))).otherwise(""),
        "advanced_summary": F.when(F.size(kind_pairs) > 0, F.concat(F.lit("Advanced: "), _counted(kind_pairs, shown), suffix)).otherwise(""),
        "source_line": F.concat_ws(" | ", "resolution", F.when(F.col("fps") != 0, F.concat(F.col("fps").cast("string"), F.lit(" fps"))), "codec", "duration_formatted"),
        "calibration_line": calibration_line(),
    })


def signal_summary(names) -> Column:
    """``Signals: name value, …`` over the non-zero scores in fixed order."""
    shown = [
        F.when(F.element_at("signals", n) != 0, F.concat(F.lit(n.replace("_score", "").replace("_", " ") + " "), F.element_at("signals", n).cast("string")))
        for n in names
    ]
    text = F.concat_ws(", ", *shown)
    return F.when(F.length(text) > 0, F.concat(F.lit("Signals: "), text)).otherwise("")


def calibration_line() -> Column:
    status = F.col("calibration_status")
    return (
        F.when(status == "matched", F.concat(F.lit("Calibration: matched "), F.coalesce("calibration.annotation_id", F.lit("")),
                                             F.lit(" overlap "), F.coalesce(F.col("calibration.overlap_ratio").cast("string"), F.lit(""))))
        .when(status == "false_positive", F.concat(F.lit("Calibration: false positive nearest "), F.coalesce("calibration.annotation_id", F.lit(""))))
        .otherwise(F.concat(F.lit("Calibration: "), status))
    )


def explanation_summary(column: str = "ai_explanations", shown: int | None = None, labels: int | None = None) -> Column:
    """The first ``shown`` judgments that give a reason, each with score, action and its first ``labels``."""
    def line(e: Column) -> Column:
        extras = F.concat_ws("; ", F.when(e["score"].isNotNull(), F.concat(F.lit("score "), e["score"].cast("string"))),
                             F.when(F.length(e["suggested_action"]) > 0, F.concat(F.lit("suggested "), e["suggested_action"])),
                             F.nullif(F.array_join(_first(S.label_array(e["labels"]), labels), ", "), F.lit("")))
        return F.concat(F.trim(e["reason"]), F.when(F.length(extras) > 0, F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise(""))

    said = F.filter(column, lambda e: F.length(F.trim(e["reason"])) > 0)
    return F.coalesce(F.array_join(_first(F.transform(said, line), shown), " | "), F.lit(""))
