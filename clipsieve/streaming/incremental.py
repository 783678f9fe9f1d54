"""Incremental batches: only sources whose signature changed are analysed again."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clipsieve.config import ScoringConfig


def analysis_key(cfg: ScoringConfig, artifacts: dict[str, tuple[int, float]] | None = None) -> str:
    """What an analysis depends on besides the file: thresholds, keywords, signal documents.

    Scoring weights and the learned scorer are left out: they re-score without a new analysis.
    """
    return json.dumps({
        "scene_threshold": cfg.scene_threshold, "silence_threshold_db": cfg.silence_threshold_db,
        "min_silence_duration": cfg.min_silence_duration, "transcript_mode": cfg.transcript_mode, "keywords": list(cfg.keywords),
        "artifacts": {k: list(v) for k, v in sorted((artifacts or {}).items())},
    }, sort_keys=True)


def frame_key(profile: str, interval: float, max_frames: int, min_score: float, model: str) -> str:
    """The same for frame scores."""
    return json.dumps({"profile": profile, "interval": float(interval), "max_frames": int(max_frames), "min_score": float(min_score), "model": model}, sort_keys=True)


def signature(key: str) -> Column:
    """Hash of size, change time and analysis key."""
    return F.sha2(F.concat_ws("|", F.col("length").cast("string"), F.col("modificationTime").cast("string"), F.lit(key)), 256)


def incremental_sources(files: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Files (``path, length, modificationTime``) not yet processed under this signature."""
    signed = files.withColumn("signature", signature(key))
    return signed.join(processed.select("path", "signature"), ["path", "signature"], "left_anti")


# -- the state of earlier batches -----------------------------------------------------------
#
# ``rows/batch-N`` holds what batch N processed, ``rows/base-N`` the state after batch N, and ``commits`` one row for each of
# them that is whole.  What has no commit is never read, so a batch that was killed leaves no trace, and a batch
# written again replaces its own rows.

_ROWS = "path string, signature string, batch long"


def _committed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Kind and number of every whole part: a row for each batch since the last compaction, and older ones not yet dropped."""
    schema = "kind string, batch long"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        files.load(f"{path}/commits").select("path").limit(1).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    return sorted({(r["kind"], r["batch"]) for r in spark.read.schema(schema).parquet(f"{path}/commits").collect()})


def _commit(spark: SparkSession, path: str, kind: str, batch: int) -> None:
    # One row is one file, which appears whole or not at all.
    spark.createDataFrame([(kind, batch)], "kind string, batch long").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the last whole batch, 0 before the first."""
    return max((n for _, n in _committed(spark, path)), default=0)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """``path, signature`` of every processed file, as its last batch saw it; an absent state is empty."""
    parts = _committed(spark, path)
    base = max((n for kind, n in parts if kind == "base"), default=0)
    folders = [f"{path}/rows/{kind}-{n}" for kind, n in parts if (kind, n) == ("base", base) or (kind == "batch" and n > base)]
    if not folders:
        return spark.createDataFrame([], "path string, signature string")
    rows = spark.read.schema(_ROWS).parquet(*folders)
    return rows.groupBy("path").agg(F.max(F.struct("batch", "signature"))["signature"].alias("signature"))


def record_processed(done: DataFrame, path: str, batch: int) -> None:
    """Add batch number ``batch`` (from 1, ascending).  A whole one is left as it is, so a batch may be run again."""
    spark = done.sparkSession
    if batch <= max((n for kind, n in _committed(spark, path) if kind == "base"), default=0) or ("batch", batch) in _committed(spark, path):
        return
    done.select("path", "signature", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{path}/rows/batch-{batch}")
    _commit(spark, path, "batch", batch)


def compact(spark: SparkSession, path: str) -> None:
    """One row a file, its last signature, in place of all batches so far; later reads start from there."""
    last = last_batch(spark, path)
    if not last or ("base", last) in _committed(spark, path):
        return
    state = read_state(spark, path).withColumn("batch", F.lit(last).cast("long"))
    state.write.mode("overwrite").parquet(f"{path}/rows/base-{last}")
    _commit(spark, path, "base", last)
