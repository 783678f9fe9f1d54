"""JSON documents as tables.  Every reader takes ``path, content`` rows, one document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clipsieve import schemas
from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators.evaluate import SUPPORTED_RATINGS
from clipsieve.session import cut_lineage
from clipsieve.sources.identity import resolve_sources
from clipsieve.sources.logs import numbered_lines

# Kinds of signal documents and the schema tags they may carry.
ARTIFACT_KINDS = ("ai_frame_scores", "face_person", "motorsports_events", "ocr_signage", "topic_clusters", "visual_objects")
SIGNAL_TAG = "signal.v1"
FRAME_TAG = "ai_frame_scores.v1"


def documents(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def usable(docs: DataFrame) -> DataFrame:
    """Documents that are JSON objects and not marked unavailable; the others contribute nothing."""
    parsed = F.expr("try_parse_json(content)")
    status = F.coalesce(F.get_json_object("content", "$.status"), F.lit(""))
    return docs.where(F.startswith(F.ltrim("content"), F.lit("{")) & parsed.isNotNull() & (status != "unavailable"))


def _parse(docs: DataFrame, schema: str, *keep: str) -> DataFrame:
    return usable(docs).select(*keep, F.from_json("content", schema).alias("d"))


def _filled(name: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0


def _num(name: str, kind: str = "double") -> Column:
    return F.col(name).try_cast(kind)


# -- signal documents ----------------------------------------------------------------------

def read_visual_objects(docs: DataFrame) -> DataFrame:
    """Segments per source as object hits; an end before its start drops the segment."""
    seg = (
        "struct<start_seconds: string, start: string, end_seconds: string, end: string, class_name: string, label: string, class_id: string, "
        "detection_count: string, count: string, average_confidence: string>"
    )
    rows = _parse(docs, f"sources array<struct<source: string, segments: array<{seg}>>>").select(
        F.explode("d.sources").alias("s")
    ).where(_filled("s.source")).select("s.source", F.explode("s.segments").alias("x"))
    start = F.coalesce(_num("x.start_seconds"), _num("x.start"), F.lit(0.0))
    end = F.coalesce(_num("x.end_seconds"), _num("x.end"), start)
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "source", start.alias("start"), end.alias("end"), F.coalesce(named("x.class_name"), named("x.label"), F.lit("object")).alias("class_name"),
        _num("x.class_id", "int").alias("class_id"), F.coalesce(_num("x.detection_count", "int"), _num("x.count", "int"), F.lit(1)).alias("count"),
        _num("x.average_confidence").alias("confidence"),
    ).where(F.col("end") >= F.col("start"))


def read_ocr_hits(docs: DataFrame) -> DataFrame:
    rows = _parse(docs, "hits array<struct<source: string, text: string, frame: string>>").select(F.inline("d.hits"))
    return rows.where(_filled("source") & _filled("text")).select(
        "source", F.lit("ocr_signage").alias("kind"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit(True).alias("source_wide"),
        F.trim("text").alias("text"), "frame",
    )


def read_face_person_hits(docs: DataFrame) -> DataFrame:
    rows = _parse(docs, "hits array<struct<source: string, face_count: string, person_count: string, frame: string>>").select(F.inline("d.hits"))
    count = lambda c: F.coalesce(_num(c, "int"), F.lit(0)).alias(c)
    return rows.where(_filled("source")).select(
        "source", F.lit("face_person").alias("kind"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit(True).alias("source_wide"),
        count("face_count"), count("person_count"), "frame",
    )


_SPAN = "start: string, start_seconds: string, end: string, end_seconds: string"


def read_event_hits(docs: DataFrame) -> DataFrame:
    rows = _parse(docs, f"events array<struct<source: string, {_SPAN}, event_type: string, confidence: string, evidence: array<string>>>").select(F.inline("d.events"))
    return rows.where(_filled("source")).select(
        "source", F.lit("motorsports_event").alias("kind"), S.clip_seconds("start", "start_seconds").alias("start"),
        S.clip_seconds("end", "end_seconds").alias("end"), F.lit(False).alias("source_wide"), "event_type",
        _num("confidence").alias("confidence"), S.label_array("evidence").alias("evidence"),
    )


def read_topic_hits(docs: DataFrame) -> DataFrame:
    hit = f"struct<source: string, {_SPAN}, keywords: array<string>, text: string>"
    rows = _parse(docs, f"topics array<struct<topic: string, hits: array<{hit}>>>").select(F.inline("d.topics")).select("topic", F.inline("hits"))
    return rows.where(_filled("source")).select(
        "source", F.lit("topic_cluster").alias("kind"), S.clip_seconds("start", "start_seconds").alias("start"),
        S.clip_seconds("end", "end_seconds").alias("end"), F.lit(False).alias("source_wide"), "topic",
        S.label_array("keywords").alias("keywords"), F.coalesce("text", F.lit("")).alias("text"),
    )


def read_ai_frame_hits(docs: DataFrame) -> DataFrame:
    """A frame at t covers half a second to each side."""
    frame = (
        "struct<time_seconds: string, top_score: string, top_label: string, labels: array<string>, "
        f"prompt_scores: array<{schemas.PROMPT_SCORE}>, explanation: string, frame: string>"
    )
    rows = _parse(docs, f"sources array<struct<source: string, frames: array<{frame}>>>").select(F.inline("d.sources")).where(_filled("source"))
    rows = rows.select("source", F.inline("frames"))
    t = F.coalesce(_num("time_seconds"), F.lit(0.0))
    return rows.select(
        "source", F.lit("ai_frame_score").alias("kind"), F.greatest(F.lit(0.0), t - 0.5).alias("start"), (t + 0.5).alias("end"),
        F.lit(False).alias("source_wide"), t.alias("time_seconds"), F.coalesce(_num("top_score"), F.lit(0.0)).alias("top_score"), "top_label",
        S.label_array("labels").alias("labels"), "prompt_scores", F.coalesce("explanation", F.lit("")).alias("explanation"), "frame",
    )


_READERS = {
    "ocr_signage": read_ocr_hits, "face_person": read_face_person_hits, "motorsports_events": read_event_hits,
    "topic_clusters": read_topic_hits, "ai_frame_scores": read_ai_frame_hits,
}
ALIASES = {"face_person_presence": "face_person"}


def load_signals(artifacts: dict[str, DataFrame], sources: DataFrame, roots: list[str] = ()) -> tuple[DataFrame | None, DataFrame | None]:
    """(object hits, advanced hits) of all documents, keyed to the known sources.

    ``artifacts`` maps a kind to its documents.  Two spellings of one kind are refused.
    """
    chosen: dict[str, DataFrame] = {}
    for key, docs in artifacts.items():
        kind = str(key).strip().lower().replace("-", "_")
        kind = ALIASES.get(kind, kind)
        if kind not in ARTIFACT_KINDS:
            continue
        if kind in chosen:
            raise ValueError(f"signal documents given twice: {kind}")
        chosen[kind] = docs

    def keyed(df: DataFrame) -> DataFrame:
        return resolve_sources(df, sources, list(roots)).drop("source").withColumnRenamed("canonical_source", "source")

    objects = keyed(read_visual_objects(chosen["visual_objects"])) if "visual_objects" in chosen else None
    advanced = None
    for kind, reader in _READERS.items():
        if kind in chosen:
            part = reader(chosen[kind])
            advanced = part if advanced is None else advanced.unionByName(part, allowMissingColumns=True)
    if advanced is None:
        return objects, None
    full = advanced
    for field in schemas.ADVANCED_HITS.split(", "):
        name = field.split(" ")[0]
        if name in ("face_count", "person_count", "event_type", "confidence", "topic", "top_score", "top_label", "labels") and name not in full.columns:
            kind = {"face_count": "int", "person_count": "int", "confidence": "double", "top_score": "double", "labels": "array<string>"}.get(name, "string")
            full = full.withColumn(name, F.lit(None).cast(kind))
    return objects, keyed(full)


def validate_artifacts(docs: DataFrame) -> DataFrame:
    """One verdict per document: kind, status, errors, warnings."""
    at = lambda key: F.get_json_object("content", f"$.{key}")
    has = lambda key: F.expr(f"try_variant_get(_v, '$.{key}', 'variant')").isNotNull()
    kind_of = lambda key: F.expr(f"schema_of_variant(try_variant_get(_v, '$.{key}', 'variant'))")
    is_list = lambda key: F.startswith(kind_of(key), F.lit("ARRAY"))
    explicit, provider = S.normalize_key(F.coalesce(at("artifact_kind"), F.lit(""))), S.normalize_key(F.coalesce(at("provider"), F.lit("")))
    filename = S.normalize_key(S.basename("path"))
    tag = F.coalesce(at("schema_version"), F.lit(""))
    by_name = F.lit("unknown")
    for key in reversed(ARTIFACT_KINDS):
        by_name = F.when(F.contains(filename, F.lit(key)), key).otherwise(by_name)
    kind = (
        F.when(explicit == "face_person_presence", "face_person").when(explicit.isin(*ARTIFACT_KINDS), explicit)
        .when(has("sources"), F.when(F.endswith(tag, F.lit(FRAME_TAG)), "ai_frame_scores").otherwise("visual_objects"))
        .when(has("events"), "motorsports_events").when(has("topics"), "topic_clusters")
        .when(provider.isin("ocr_signage", "tesseract_ocr"), "ocr_signage")
        .when(provider.isin("face_person_presence", "opencv_face_person"), "face_person")
        .otherwise(by_name)
    )
    k = F.col("kind")
    needs = lambda kinds, key: F.when(k.isin(*kinds) & has(key) & ~is_list(key), F.concat(k, F.lit(f" artifact requires {key} list")))
    rows = docs.withColumn("_v", F.when(F.startswith(F.ltrim("content"), F.lit("{")), F.expr("try_parse_json(content)"))).withColumn("kind", F.when(F.col("_v").isNotNull(), kind))
    bad = F.col("_v").isNull() | (F.regexp_replace("content", r"\s", "") == "{}")
    errors = F.when(bad, S.string_array(["artifact is missing or not valid JSON"])).otherwise(F.array_compact(F.array(
        F.when(k == "unknown", "could not infer signal artifact kind"),
        needs(("visual_objects", "ai_frame_scores"), "sources"), needs(("ocr_signage", "face_person"), "hits"),
        needs(("motorsports_events",), "events"), needs(("topic_clusters",), "topics"),
        F.when(has("source_summaries") & ~is_list("source_summaries"), "source_summaries must be a list"),
    )))
    odd_tag = (tag != "") & ~F.endswith(tag, F.lit(SIGNAL_TAG))
    warnings = F.when(bad, S.empty_strings()).otherwise(F.concat(
        F.array_compact(F.array(F.when(odd_tag, F.concat(F.lit("unexpected schema_version: "), tag)),
                                F.when(provider == "", "provider is missing"))),
        F.coalesce(F.from_json(at("warnings"), "array<string>"), S.empty_strings()),
    ))
    return rows.select(
        "path", F.when(F.size(errors) > 0, "error").otherwise("ok").alias("status"), F.when(~bad, k).alias("kind"), at("schema_version").alias("schema_version"),
        at("provider").alias("provider"), errors.alias("errors"), warnings.alias("warnings"),
    )


# -- detector label files ------------------------------------------------------------------

def label_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Detector label files, of any size, as lines: ``label_file, line, text``."""
    lines = numbered_lines(spark, path, "*.txt")
    return lines.select(F.col("source").alias("label_file"), F.col("line_no").cast("int").alias("line"), F.col("line").alias("text"))


def class_name(class_id="class_id") -> Column:
    names = S.string_array(V.COCO_CLASSES)
    c = S.col(class_id)
    inside = c.between(0, len(V.COCO_CLASSES) - 1)
    return F.when(inside, F.element_at(names, F.when(inside, c + 1).otherwise(1))).otherwise(F.concat(F.lit("class_"), c.cast("string")))


def parse_detections(lines: DataFrame, media: DataFrame) -> DataFrame:
    """Label lines ``class x y w h [conf]`` (``source, label_file, line, text``); malformed lines drop out.

    ``media`` gives each source's ``fps``; without it a detection has no time.
    """
    parts = F.split(F.trim("text"), r"\s+")
    rows = lines.withColumn("_p", parts).where(F.size("_p") >= 5)
    at = lambda i: F.get("_p", F.lit(i)).try_cast("double")
    stem = S.file_stem("label_file")
    frame = F.coalesce(F.nullif(F.regexp_extract(stem, r"_(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(stem, r"^(\d+)$", 1), F.lit("")))
    # int() of the class field truncates.
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    good = at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull() & at(4).isNotNull()
    good = good & ((F.size("_p") < 6) | at(5).isNotNull())
    six = lambda i, n: F.bround(at(i), 6).alias(n)
    rows = rows.where(good).select(
        "source", "label_file", "line", frame.try_cast("int").alias("frame"), whole(at(0)).alias("class_id"),
        F.bround(F.when(F.size("_p") >= 6, at(5)), 4).alias("confidence"),
        F.struct(six(1, "x_center"), six(2, "y_center"), six(3, "width"), six(4, "height")).alias("bbox_norm"),
    )
    fps = media.select("source", "fps")
    time = F.when(F.col("fps") > 0, F.greatest(F.lit(0.0), (F.col("frame") - 1.0) / F.col("fps")))
    return rows.join(fps, "source", "left").withColumns({"class_name": class_name(), "time_seconds": F.bround(time, 3)}).drop("fps")


# -- ratings, annotations, selections, decisions, judgments ---------------------------------

_CLIP = (
    "id: string, label: string, source: string, start: string, end: string, start_seconds: string, end_seconds: string, score: string, "
    "action: string, labels: array<string>, reasons: array<string>"
)


def read_ratings(docs: DataFrame) -> dict[str, DataFrame]:
    """A nested rating report as tall tables: assets, scenes, silences, levels, hits, candidates.

    The documents are parsed once; all tables read what came of it.
    """
    asset = "struct<" + ", ".join(": ".join(f.split(" ", 1)) for f in schemas.ASSETS.split(", ")) + ">"
    obj = "struct<start: double, end: double, class_name: string, class_id: int, count: int, confidence: double>"
    adv = "struct<" + ", ".join(": ".join(f.split(" ", 1)) for f in _fields(schemas.ADVANCED_HITS)[1:]) + ">"
    signal = (
        f"struct<asset: {asset}, scene_changes: array<double>, silence_intervals: array<struct<start: double, end: double>>, "
        "audio_levels: array<struct<time: double, rms_db: double>>, "
        "transcript_hits: array<struct<start: double, end: double, text: string, keywords: array<string>>>, "
        f"object_hits: array<{obj}>, advanced_hits: array<{adv}>, scores: map<string, double>, reasons: array<string>>"
    )
    clip = f"struct<{_CLIP}, signals: map<string, double>, ai_explanations: array<{schemas.EXPLANATION}>>"
    rows = cut_lineage(_parse(docs, f"root string, signals array<{signal}>, candidates array<{clip}>", "path"))
    reports = rows.select("path", F.explode("d.signals").alias("s")).select("path", "s.*").withColumn("source", F.col("asset.filepath"))
    hits = lambda column: reports.select("path", "source", F.inline(column))
    clips = rows.select("path", F.posexplode("d.candidates").alias("pos", "c")).select("path", "pos", "c.*")
    return {
        "assets": reports.select("path", "asset.*"),
        "scenes": reports.select("path", "source", F.explode("scene_changes").alias("time")),
        "silences": hits("silence_intervals"), "levels": hits("audio_levels"), "transcript_hits": hits("transcript_hits"),
        "object_hits": hits("object_hits"), "advanced_hits": hits("advanced_hits"),
        "file_scores": reports.select("path", "source", "scores", "reasons"),
        "candidates": clips.select(
            "path", (F.col("pos") + 1).cast("long").alias("rank"), F.coalesce("id", "label", F.format_string("candidate_%04d", F.col("pos") + 1)).alias("id"),
            "source", S.clip_seconds("start", "start_seconds").alias("start"), S.clip_seconds("end", "end_seconds").alias("end"),
            F.coalesce(_num("score", "int"), F.lit(0)).alias("score"), F.lower(F.coalesce("action", F.lit("review"))).alias("action"),
            S.label_array("labels").alias("labels"), S.label_array("reasons").alias("reasons"), "signals", "ai_explanations",
        ),
    }


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def load_selection(docs: DataFrame, fps: float | None = None, default_fps: float = 30.0) -> DataFrame:
    """Selection clips; ``error`` tells what is wrong with a clip.  Display times win over seconds."""
    rows = _parse(docs, f"project string, name string, source string, fps string, clips array<struct<{_CLIP}, review_order: string>>", "path")
    rows = rows.select("path", F.coalesce("d.project", "d.name").alias("project"), F.col("d.source").alias("doc_source"),
                       _num("d.fps").alias("doc_fps"), F.posexplode("d.clips").alias("pos", "c")).select("*", "c.*").drop("c")
    shown = lambda a, b: F.when(_filled(a), F.col(a)).when(_num(b).isNotNull(), S.hhmmss(_num(b)))
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), "doc_source")
    rate = F.lit(float(fps)) if fps is not None else F.coalesce("doc_fps", F.lit(float(default_fps)))
    rows = rows.select(
        F.col("path").alias("selection"), "project", rate.alias("fps"), (F.col("pos") + 1).alias("clip_index"), source.alias("source"),
        shown("start", "start_seconds").alias("start"), shown("end", "end_seconds").alias("end"),
        F.coalesce("label", "id", F.format_string("clip_%03d", F.col("pos") + 1)).alias("label"), F.coalesce(_num("score", "int"), F.lit(0)).alias("score"),
        _num("review_order", "int").alias("review_order"), S.label_array("labels").alias("labels"), S.label_array("reasons").alias("reasons"),
    )
    error = (
        F.when(F.col("source").isNull() | (F.col("source") == "mixed"), "missing source")
        .when(F.col("start").isNull(), "missing start").when(F.col("end").isNull(), "missing end")
        .when(F.coalesce(S.seconds_of("end") <= S.seconds_of("start"), F.lit(True)), "non-positive duration")
    )
    return rows.withColumns({"start_seconds": F.lit(None).cast("double"), "end_seconds": F.lit(None).cast("double"), "error": error})


def load_annotations(docs: DataFrame, sources: DataFrame | None = None, roots: list[str] = ()) -> DataFrame:
    """Annotation clips with ids, tags, resolved sources and, for bad rows, an ``error``."""
    clip = "struct<id: string, label: string, source: string, start: string, end: string, rating: string, tags: string, notes: string>"
    rows = _parse(docs, f"project string, source_root string, clips array<{clip}>", "path").select(
        "path", "d.project", "d.source_root", F.posexplode("d.clips").alias("pos", "c")).select("path", "project", "pos", "c.*")
    tags = F.when(F.startswith("tags", F.lit("[")), F.from_json("tags", "array<string>")).otherwise(
        F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0))
    rows = rows.select(
        "path", "project", (F.col("pos") + 1).cast("long").alias("ann_index"),
        F.coalesce(F.nullif(F.col("id"), F.lit("")), F.nullif(F.col("label"), F.lit("")), F.format_string("annotation_%04d", F.col("pos") + 1)).alias("id"),
        F.trim(F.coalesce("source", F.lit(""))).alias("source"), F.coalesce(S.seconds_of("start"), F.lit(0.0)).alias("start"),
        F.coalesce(S.seconds_of("end"), F.lit(0.0)).alias("end"), F.lower(F.trim(F.coalesce("rating", F.lit("review")))).alias("rating"),
        F.coalesce(tags, S.empty_strings()).alias("tags"), F.coalesce("notes", F.lit("")).alias("notes"),
    )
    error = (
        F.when(~F.col("rating").isin(*SUPPORTED_RATINGS), F.concat(F.lit("unsupported annotation rating: "), F.col("rating")))
        .when(F.col("source") == "", "missing source").when(F.col("end") <= F.col("start"), "end must be after start")
    )
    rows = rows.withColumn("error", error)
    return resolve_sources(rows, sources, list(roots)) if sources is not None else rows.withColumn("canonical_source", F.col("source"))


def load_decisions(docs: DataFrame) -> DataFrame:
    """Decision rows of list documents and of mappings ``{id: word}`` or ``{id: {…}}``."""
    body = F.coalesce(F.get_json_object("content", "$.decisions"), F.col("content"))
    item = "struct<id: string, decision: string, rating: string, order: string, note: string, notes: string, source: string, start: double, end: double>"
    rows = usable(docs).select("path", body.alias("body"))
    listed = rows.where(F.startswith(F.ltrim("body"), F.lit("["))).select(
        "path", F.posexplode(F.from_json("body", f"array<{item}>")).alias("pos", "x")).select("path", "pos", "x.*")
    pairs = rows.where(F.startswith(F.ltrim("body"), F.lit("{"))).select(
        "path", F.posexplode(F.map_entries(F.from_json("body", "map<string,string>"))).alias("pos", "e"))
    nested = F.startswith(F.ltrim("e.value"), F.lit("{"))
    fields = F.when(nested, F.from_json("e.value", item))
    mapped = pairs.withColumn("x", fields).select(
        "path", "pos", F.coalesce("x.id", "e.key").alias("id"), F.when(nested, F.col("x.decision")).otherwise(F.col("e.value")).alias("decision"),
        *[F.col(f"x.{n}").alias(n) for n in ("rating", "order", "note", "notes", "source", "start", "end")],
    )
    both = listed.unionByName(mapped)
    return both.select(
        "path", "pos", "id", F.coalesce(F.nullif(F.col("decision"), F.lit("")), "rating").alias("decision"), _num("order", "int").alias("order"),
        F.coalesce(F.nullif(F.col("note"), F.lit("")), "notes", F.lit("")).alias("note"), "source", "start", "end",
    )


def load_clip_judgments(docs: DataFrame) -> DataFrame:
    """Judgment explanations by clip id, in document order; blank ids drop out."""
    clip = (
        "struct<clip_id: string, id: string, score: double, score_dimensions: map<string, double>, suggested_action: string, labels: array<string>, reason: string>"
    )
    from clipsieve.operators.ai import as_explanations

    rows = _parse(docs, f"provider string, clips array<{clip}>", "path").select(F.posexplode("d.clips").alias("pos", "c"))
    flat = rows.select("pos", F.trim(F.coalesce(F.nullif(F.col("c.clip_id"), F.lit("")), "c.id", F.lit(""))).alias("id"),
                       "c.score", "c.score_dimensions", "c.suggested_action", S.label_array("c.labels").alias("labels"),
                       F.coalesce("c.reason", F.lit("")).alias("reason"))
    return as_explanations(flat)


# -- training records ----------------------------------------------------------------------

REVIEW_RECORD = (
    "project struct<name: string, id: string, profile: string>, clip struct<id: string, source_id: string, source_name: string, start: string, "
    "end: string, start_seconds: double, end_seconds: double>, features map<string, double>, label struct<rating: string, target: int>, "
    "decision struct<decision: string, order: int, note: string>, metadata struct<action: string, labels: array<string>>"
)


def read_review_dataset(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines training records; blank lines are skipped."""
    return spark.read.schema(REVIEW_RECORD).json(path).where(F.col("label").isNotNull())


def write_review_dataset(dataset: DataFrame, path: str) -> None:
    """Keys of a record in sorted order, one record a line."""
    columns = sorted(dataset.columns)
    dataset.select(*columns).write.mode("overwrite").json(path)
