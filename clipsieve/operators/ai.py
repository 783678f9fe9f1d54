"""Model-assisted data work: frame scores, missed moments, clip judgments."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clipsieve import schemas
from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators import evaluate as E, intervals as I
from clipsieve.operators.ranking import global_rank
from clipsieve.session import cut_lineage

# Prompts shipped to every frame as one array; a larger bank is scored in blocks of this size.
PROMPT_BLOCK = 512
# Blocks, over all profiles, that may be broadcast.
MAX_SHIPPED_BLOCKS = 64
# Parts into which the frames of a profile are dealt, where blocks are joined.
FRAME_PARTS = 64


def profile_id(name: str) -> str:
    key = str(name).strip().lower().replace("-", "_")
    if key not in V.PROFILES:
        raise KeyError(f"unknown profile: {name}; available: {', '.join(sorted(V.PROFILES))}")
    return key


def prompt_bank(spark: SparkSession, name: str | None = None) -> DataFrame:
    """Prompts of one profile, or of all: ``profile, id, label, prompt, intent``."""
    wanted = [profile_id(name)] if name else sorted(V.PROFILES)
    rows = [(p, *prompt[:2], *prompt[2:]) for p in wanted for prompt in V.PROFILES[p][3]]
    return spark.createDataFrame(rows, "profile string, id string, label string, prompt string, intent string")


def profile_list(spark: SparkSession) -> DataFrame:
    rows = [(p, name, about, sorted({x[1] for x in bank}), len(bank), list(kinds)) for p, (name, about, kinds, bank) in sorted(V.PROFILES.items())]
    return spark.createDataFrame(rows, "id string, name string, description string, labels array<string>, prompt_count int, output_types array<string>")


def sample_timestamps(assets: DataFrame, interval: float = 10.0, max_frames: int = 8) -> DataFrame:
    """Sample times per asset: half an interval in, then every interval; an empty file gets 0."""
    step, most = max(0.5, float(interval or 10.0)), max(1, int(max_frames))
    d = F.greatest(F.lit(0.0), F.coalesce("duration", F.lit(0.0)))
    first = F.least(d / 2.0, F.lit(step / 2.0))
    grid = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: first + k * F.lit(step))
    times = F.when(d <= 0, F.array(F.lit(0.0))).otherwise(F.transform(F.filter(grid, lambda t: t < d), lambda t: F.bround(t, 3)))
    return assets.select(F.col("filepath").alias("source"), F.posexplode(times).alias("frame_no", "time"))


# -- frame scores --------------------------------------------------------------------------

def unit(vector: Column) -> Column:
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.try_divide(x, norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _prompt_blocks(prompts: DataFrame) -> DataFrame:
    """Each profile's prompts in id order, packed ``PROMPT_BLOCK`` at a time."""
    spec = Window.partitionBy("profile").orderBy("id")
    numbered = prompts.withColumn("_block", F.floor((F.row_number().over(spec) - 1) / PROMPT_BLOCK).cast("int"))
    item = F.struct("id", "label", "prompt", "intent", unit(F.col("vector")).alias("unit"))
    return numbered.groupBy("profile", "_block").agg(F.array_sort(F.collect_list(item)).alias("_prompts"))


def score_frames(frames: DataFrame, prompts: DataFrame, min_score: float = 0.22, profile: str | None = None) -> DataFrame:
    """Softmax of 100·cosine over a profile's prompts, per frame.

    ``frames``: ``source, time, vector`` (and ``profile`` unless given).  Prompts come as an
    array, so a frame is scored inside its own row: no pairs, no shuffle of frames.  A bank
    that fills more than one block, or profiles of more than ``MAX_SHIPPED_BLOCKS`` in all, are joined block
    by block to frames dealt evenly over ``FRAME_PARTS``, and the logits are combined per frame.  Either way
    gives the same rows.
    """
    if profile is not None:
        frames = frames.withColumn("profile", F.lit(profile))
    blocks = _prompt_blocks(prompts)
    sizes = prompts.groupBy("profile").count().agg(F.max("count").alias("most"), F.count("*").alias("profiles")).first()
    many = (sizes["most"] or 0) > PROMPT_BLOCK or sizes["profiles"] > MAX_SHIPPED_BLOCKS
    logits = F.transform("_prompts", lambda p: F.struct(
        p["id"].alias("id"), p["label"].alias("label"), p["prompt"].alias("prompt"), p["intent"].alias("intent"),
        (dot(F.col("_unit"), p["unit"]) * 100.0).alias("logit"),
    ))
    rows = frames.withColumn("_unit", unit(F.col("vector")))
    if not many:
        # At most MAX_SHIPPED_BLOCKS rows of at most PROMPT_BLOCK prompts.
        scored = rows.join(F.broadcast(blocks.drop("_block")), "profile").withColumn("_logits", logits)
    else:
        # Frames may be alike in all columns, so each has a number of its own, fixed before the join.
        keys = [*(c for c in frames.columns if c != "vector"), "_frame"]
        numbered = cut_lineage(rows.withColumn("_frame", F.monotonically_increasing_id()))
        dealt = numbered.withColumn("_part", F.pmod(F.xxhash64("_frame"), F.lit(FRAME_PARTS)).cast("int"))
        copies = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FRAME_PARTS - 1))))
        parts = dealt.join(copies, ["profile", "_part"]).withColumn("_logits", logits)
        scored = parts.groupBy(*keys).agg(F.flatten(F.collect_list("_logits")).alias("_logits"))
    # One struct computed in one place: later filters on its fields do not repeat the inner steps.
    return (
        scored.withColumn("_s", S.let(F.col("_logits"), lambda l: S.let(_softmax(l), lambda p: _frame_struct(p, min_score))))
        .select(*[c for c in frames.columns if c != "vector"], "_s.*")
    )


def _softmax(logits: Column) -> Column:
    """Prompts with their share of the softmax, strongest first, then by id."""
    def shares(peak: Column) -> Column:
        return S.let(F.transform(logits, lambda p: F.exp(p["logit"] - peak)), lambda e: S.let(
            F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.zip_with(logits, e, lambda p, x: F.struct(
                (-F.bround(x / total, 4)).alias("down"), p["id"].alias("id"), p["label"].alias("label"), p["prompt"].alias("prompt"), p["intent"].alias("intent")))))

    ordered = F.array_sort(S.let(F.array_max(F.transform(logits, lambda p: p["logit"])), shares))
    return F.transform(ordered, lambda p: F.struct(
        p["id"].alias("id"), p["label"].alias("label"), p["prompt"].alias("prompt"), p["intent"].alias("intent"), (-p["down"]).alias("score")))


def _frame_struct(prompts: Column, min_score: float) -> Column:
    top = F.try_element_at(prompts, F.lit(1))
    over = F.array_sort(F.array_distinct(F.transform(F.filter(prompts, lambda p: p["score"] >= min_score), lambda p: p["label"])))
    return F.struct(
        prompts.alias("prompt_scores"), F.coalesce(top["score"], F.lit(0.0)).alias("top_score"),
        F.coalesce(top["label"], F.lit("ai_frame_score")).alias("top_label"),
        F.when(F.size(over) > 0, over).otherwise(F.array_compact(F.array(top["label"]))).alias("labels"),
        F.concat(top["label"], F.lit(" from prompt: "), top["prompt"]).alias("explanation"),
    )


def frame_summaries(scored: DataFrame) -> DataFrame:
    """Per source: frames, all labels, best score."""
    return scored.groupBy("source").agg(
        F.count("*").alias("frame_count"), S.flatten_set(F.collect_set("labels")).alias("labels"), F.bround(F.max("top_score"), 4).alias("top_score"),
    )


def as_advanced_hits(scored: DataFrame) -> DataFrame:
    """Scored frames as ``ai_frame_score`` hits, half a second to each side."""
    return scored.select(
        "source", F.lit("ai_frame_score").alias("kind"), F.greatest(F.lit(0.0), F.col("time") - 0.5).alias("start"),
        (F.col("time") + 0.5).alias("end"), F.lit(False).alias("source_wide"), F.col("time").alias("time_seconds"),
        "top_score", "top_label", "labels", "prompt_scores", "explanation",
    )


# -- missed moments ------------------------------------------------------------------------

def _best_prompts(all_matches: Column) -> Column:
    """Best score per prompt key, strongest first, at most six; earlier entries win ties."""
    return S.let(all_matches, _best_of)


def _best_of(matches: Column) -> Column:
    key = lambda m: F.coalesce(F.nullif(m["id"], F.lit("")), F.nullif(m["prompt"], F.lit("")), m["label"])
    names = F.array_distinct(F.transform(matches, key))
    best = lambda n: F.aggregate(
        F.filter(matches, lambda m: key(m) == n),
        F.element_at(F.filter(matches, lambda m: key(m) == n), 1),
        lambda a, m: F.when(m["score"] > a["score"], m).otherwise(a),
    )
    kept = F.transform(names, best)
    keyed = F.array_sort(F.transform(kept, lambda m: F.struct((-m["score"]).alias("down"), m["id"].alias("id"), m.alias("match"))))
    return F.transform(F.slice(keyed, 1, 6), lambda k: k["match"])


def _fold_reasons(items: Column) -> Column:
    """Reasons joined pair by pair: each step sorts and joins the text so far with the next one."""
    def step(acc: Column, item: Column) -> Column:
        joined = F.array_join(F.array_sort(F.array_distinct(F.array(acc, item["reason"]))), "; ")
        return F.btrim(joined, F.lit("; "))

    head = F.element_at(items, 1)["reason"]
    return F.aggregate(F.slice(items, 2, F.greatest(F.lit(0), F.size(items) - 1)), head, step)


def missed_moments(
    frames: DataFrame, candidates: DataFrame, min_score: float = 0.35, pre_roll: float = 2.0, post_roll: float = 4.0, merge_gap: float = 5.0
) -> DataFrame:
    """High-scoring frames no positive candidate covers, merged into moments and ranked.

    ``frames``: scored frames with ``frame_id``; paths are compared as given.  A merged moment
    lasts at least as long as its frames, and frames are samples of the file, so a moment's
    frames are few whatever the size of the table.
    """
    strong = frames.where((F.col("top_score") >= min_score) & (F.size("labels") > 0))
    covering = E.predicted_positive(candidates).select("source", "start", "end")
    # Read by every branch below, so frames are scored once.
    open_frames = cut_lineage(I.uncovered_points(strong, covering, ["source"]))
    near = E.nearest_to_point(open_frames.select("frame_id", "source", "time"), candidates).select(
        "frame_id", F.when(F.col("near_id").isNotNull(), F.struct(
            F.col("near_id").alias("id"), F.col("near_action").alias("action"), F.col("near_score").alias("score"))).alias("existing")
    )
    rows = open_frames.join(near, "frame_id", "left").select(
        "source", F.greatest(F.lit(0.0), F.col("time") - pre_roll).alias("start"), (F.col("time") + post_roll).alias("end"),
        F.col("top_score").alias("confidence"), "labels", F.slice("prompt_scores", 1, 4).alias("matches"),
        F.coalesce(F.nullif(F.col("explanation"), F.lit("")), F.lit("AI frame score above threshold")).alias("reason"), "existing", "time",
    )
    rows = cut_lineage(rows)
    islands = I.with_islands(rows, ["source"], F.lit(float(merge_gap)))
    item = F.struct("start", "time", "matches", "reason", "existing")
    grouped = islands.groupBy("source", "island").agg(
        F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.count("*").alias("frame_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.array_sort(F.collect_list(item), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                     .when(a["time"] < b["time"], -1).when(a["time"] > b["time"], 1).otherwise(0)).alias("items"),
    )
    all_matches = F.flatten(F.transform("items", lambda i: i["matches"]))
    first_known = F.try_element_at(F.filter(F.transform("items", lambda i: i["existing"]), lambda e: e.isNotNull()), F.lit(1))
    moments = grouped.select(
        "source", F.col("island").alias("start"), "end", "confidence", "labels", "frame_count",
        F.when(F.col("frame_count") == 1, F.element_at("items", 1)["matches"]).otherwise(_best_prompts(all_matches)).alias("prompt_matches"),
        _fold_reasons(F.col("items")).alias("reason"), first_known.alias("existing_candidate"),
    )
    ranked = global_rank(moments, [F.desc("confidence"), F.asc("source"), F.asc("start")])
    return ranked.withColumns({"id": F.format_string("missed_%04d", "rank"), "start_tc": S.hhmmss("start"), "end_tc": S.hhmmss("end")})


def missed_review(moments: DataFrame) -> DataFrame:
    """Moments as review decisions, in rank order."""
    return moments.select(
        "id", F.lit("review").alias("decision"), F.col("rank").alias("order"), F.lit("").alias("note"), "source", "start", "end",
        F.col("confidence").alias("score"), F.col("labels").alias("tags"), F.array("reason").alias("reasons"), F.lit(True).alias("missed_moment"),
    )


# -- clip judgments ------------------------------------------------------------------------

def judge_requests(review_rows: DataFrame, profile: str) -> DataFrame:
    """One JSON request per clip for an outside judge."""
    p = profile_id(profile)
    name, about, kinds, bank = V.PROFILES[p]
    prompts = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(l).alias("label"), F.lit(t).alias("text"), F.lit(n).alias("intent")) for i, l, t, n in bank])
    present = lambda *names: [c for c in names if c in review_rows.columns]
    clip = F.struct(*present("id", "source", "source_name"), F.col("start_tc").alias("start"), F.col("end_tc").alias("end"),
                    F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), *present("duration", "score", "action", "labels"),
                    F.col("reasons").alias("deterministic_reasons"), *present("signals"))
    contract = F.struct(
        F.lit("json").alias("format"), S.string_array(["score_dimensions", "suggested_action", "labels", "reason"]).alias("required"),
        S.string_array(sorted(V.JUDGE_ACTIONS)).alias("actions"), F.lit("object of 0-1 numeric dimension scores").alias("score_dimensions"),
    )
    about_profile = F.struct(F.lit(p).alias("id"), F.lit(name).alias("name"), F.lit(about).alias("description"), S.string_array(kinds).alias("output_types"), prompts.alias("prompts"))
    request = F.to_json(F.struct(F.lit("clip_judge").alias("task"), about_profile.alias("profile"), clip.alias("clip"), contract.alias("response_contract")))
    return review_rows.select("id", "source", "start", "end", request.alias("request"))


_RESPONSE = (
    "judgment string, score_dimensions map<string,string>, scores map<string,string>, suggested_action string, action string, "
    "labels array<string>, reason string, explanation string, score string"
)


def normalize_judgment(responses: DataFrame) -> DataFrame:
    """Responses (``id, response``) as clean judgments; ``error`` says why a row is not usable."""
    outer = F.from_json("response", _RESPONSE)
    is_object = F.startswith(F.ltrim("response"), F.lit("{"))
    rows = responses.withColumn("_outer", outer)
    inner = F.when(F.startswith(F.col("_outer.judgment"), F.lit("{")), F.from_json("_outer.judgment", _RESPONSE)).otherwise(F.col("_outer"))
    rows = rows.withColumn("_d", inner)
    full = lambda m: F.when(F.size(m) > 0, m)
    raw = F.coalesce(full(F.col("_d.score_dimensions")), full(F.col("_d.scores")))
    number = lambda v: v.try_cast("double")
    scaled = lambda v: F.when(number(v) > 1.0, number(v) / 100.0).otherwise(number(v))
    numeric = F.map_filter("_raw", lambda k, v: number(v).isNotNull())
    dims = F.map_from_entries(F.transform(F.map_entries(numeric), lambda e: F.struct(
        S.file_slug(e["key"]), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled(e["value"]))), 4))))
    first = lambda a, b: F.coalesce(F.nullif(F.col(f"_d.{a}"), F.lit("")), F.col(f"_d.{b}"), F.lit(""))
    labels = F.filter(F.transform(S.label_array("_d.labels"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    rows = rows.withColumn("_raw", raw).withColumns({
        "score_dimensions": dims, "suggested_action": F.lower(F.trim(first("suggested_action", "action"))),
        "labels": F.when(F.size(labels) > 0, labels).otherwise(S.string_array(["ai_clip_judge"])), "reason": F.trim(first("reason", "explanation")),
        "_total": number(F.col("_d.score")),
    })
    values = F.map_values("score_dimensions")
    mean = F.bround(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values)) * 100.0, 2)
    given = F.when(F.col("_total") <= 1.0, F.col("_total") * 100.0).otherwise(F.col("_total"))
    error = (
        F.when(~is_object | F.col("_outer").isNull(), "response must be a JSON object")
        .when(F.col("_raw").isNull(), "response requires non-empty score_dimensions object")
        .when(F.size("score_dimensions") == 0, "score_dimensions must contain numeric values")
        .when(~F.col("suggested_action").isin(*V.JUDGE_ACTIONS), f"suggested_action must be one of {', '.join(sorted(V.JUDGE_ACTIONS))}")
        .when(F.length("reason") == 0, "response requires reason")
        .when(F.length(F.trim(F.coalesce("id", F.lit("")))) == 0, "clip id is required")
    )
    return rows.withColumns({
        "score": F.when(F.col("_total").isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), given)), 2)).otherwise(mean),
        "error": error,
    }).drop("_outer", "_d", "_raw", "_total")


def judge_clips(requests: DataFrame, judge: Callable[[dict], dict | str], retries: int = 1) -> DataFrame:
    """Call ``judge`` on every request inside the tasks, then normalise.

    A call that fails or answers with something unusable is repeated up to ``retries`` times;
    a clip that never gets a usable answer keeps its last one and shows up with an error.
    """
    attempts = max(0, int(retries)) + 1
    actions = set(V.JUDGE_ACTIONS)

    def usable(answer: dict) -> bool:
        data = answer.get("judgment") if isinstance(answer.get("judgment"), dict) else answer
        dims = data.get("score_dimensions") or data.get("scores")
        action = str(data.get("suggested_action") or data.get("action") or "").strip().lower()
        return isinstance(dims, dict) and bool(dims) and action in actions and bool(data.get("reason") or data.get("explanation"))

    def one(text: str) -> str:
        answer = ""
        for _ in range(attempts):
            reply = judge(json.loads(text))
            answer = reply if isinstance(reply, str) else json.dumps(reply)
            try:
                parsed = json.loads(answer)
            except ValueError:
                continue
            if isinstance(parsed, dict) and usable(parsed):
                break
        return answer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id", "source", "start", "end"]].assign(response=[one(t) for t in batch["request"]])

    return normalize_judgment(requests.mapInPandas(run, "id string, source string, start double, end double, response string"))


def encode_frames(frames: DataFrame, encode: Callable[[list[str]], list[list[float]]], path_column: str = "frame") -> DataFrame:
    """Frame files to vectors with a user's encoder, one call per Arrow batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = encode(batch[path_column].tolist())
            yield batch[["source", "time"]].assign(vector=[[float(x) for x in v] for v in vectors])

    return frames.select("source", "time", path_column).mapInPandas(run, schemas.FRAME_VECTORS)


def as_explanations(judgments: DataFrame, provider: str = "command") -> DataFrame:
    """Judgments as ``ai_explanations`` arrays by clip id."""
    item = F.struct(
        F.lit("ai_clip_judge").alias("kind"), F.lit(provider).alias("provider"), F.col("score").cast("double").alias("score"), "score_dimensions",
        "suggested_action", "labels", "reason",
    )
    pos = F.col("pos") if "pos" in judgments.columns else F.lit(0)
    rows = judgments.where(F.length(F.trim("id")) > 0).select("id", F.struct(pos.alias("pos"), item.alias("e")).alias("x"))
    # A clip's judgments are as many as judges, not as rows.
    ordered = F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    return rows.groupBy("id").agg(F.transform(ordered, lambda x: x["e"]).alias("ai_explanations"))
