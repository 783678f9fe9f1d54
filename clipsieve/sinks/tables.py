"""Report tables and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clipsieve.functions import scalars as S
from clipsieve.operators.sweep import weights_json


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


# -- inventory -----------------------------------------------------------------------------

def inventory_table(assets: DataFrame) -> DataFrame:
    """The nine display columns of an inventory."""
    shown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("N/A"))
    sized = (F.coalesce("width", F.lit(0)) != 0) & (F.coalesce("height", F.lit(0)) != 0)
    return assets.select(
        "filename", S.hhmmss("duration").alias("duration"),
        F.when(sized, F.concat_ws("x", "width", "height")).otherwise("N/A").alias("resolution"), shown("codec").alias("codec"),
        F.when(F.coalesce("fps", F.lit(0.0)) == 0, F.lit("N/A")).otherwise(F.col("fps").cast("string")).alias("fps"),
        "size_mb", "has_audio", "status", "filepath",
    )


def write_inventory(assets: DataFrame, base: str, summary: int | None = None) -> None:
    """The inventory as JSON, CSV and a sorted summary, of which ``summary`` keeps the first rows."""
    write_json(assets, f"{base}/json")
    table = inventory_table(assets)
    write_csv(table, f"{base}/csv")
    rows = table.orderBy("filepath")
    write_csv(rows if summary is None else rows.limit(summary), f"{base}/summary")


# -- candidates ----------------------------------------------------------------------------

def candidate_table(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "id", "source", S.hhmmss("start").alias("start"), S.hhmmss("end").alias("end"),
        F.bround(S.interval_duration("start", "end"), 2).alias("duration"), "score", "action",
        F.array_join("labels", ", ").alias("labels"), F.array_join("reasons", " | ").alias("reasons"),
    )


def selection_sets(candidates: DataFrame, actions: tuple[str, ...] | None = ("select", "review")) -> DataFrame:
    """One selection document per source, clips by start.

    A row becomes one document, so its clips are what one file holds.  ``actions=None`` keeps all.
    """
    rows = candidates if actions is None else candidates.where(F.col("action").isin(*actions))
    clip = F.struct("start", "rank", F.struct(
        S.hhmmss("start").alias("start"), S.hhmmss("end").alias("end"), F.col("id").alias("label"), "score", "action", "reasons").alias("clip"))
    return rows.groupBy("source").agg(
        F.transform(F.array_sort(F.collect_list(clip)), lambda c: c["clip"]).alias("clips")
    )


def write_selection_sets(candidates: DataFrame, path: str) -> None:
    """Clips laid out by source; each source's clips are sorted inside its files."""
    rows = candidates.where(F.col("action").isin("select", "review")).select(
        F.col("source"), S.hhmmss("start").alias("start"), S.hhmmss("end").alias("end"), F.col("id").alias("label"), "score", "action", "reasons"
    )
    rows.repartition("source").sortWithinPartitions("source", "start").write.mode("overwrite").partitionBy("source").json(path)


def top_candidate_table(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """Ranked candidates as report rows; with ``n``, the first so many."""
    return (candidates if n is None else candidates.where(F.col("rank") <= n)).select(
        "rank", "id", "score", "action", S.basename("source").alias("file"),
        F.concat(S.hhmmss("start"), F.lit(" - "), S.hhmmss("end")).alias("time"), F.array_join("reasons", "; ").alias("why"),
    )


def file_signal_table(file_scores: DataFrame) -> DataFrame:
    """Per file: status, length, size, total score and reasons."""
    return file_scores.select(
        "filename", "status", S.hhmmss("duration").alias("duration"), F.concat_ws("x", "width", "height").alias("resolution"),
        F.bround("total_score", 2).alias("total_score"), F.array_join("reasons", "; ").alias("reasons"),
    )


# -- evaluation ----------------------------------------------------------------------------

def missed_table(missed: DataFrame) -> DataFrame:
    return missed.select(
        "id", "source", S.hhmmss("start").alias("start"), S.hhmmss("end").alias("end"), "rating",
        F.array_join("tags", ", ").alias("tags"), "notes", F.coalesce("near_id", F.lit("")).alias("nearest_candidate"),
        F.bround("gap", 3).alias("nearest_gap_seconds"),
    )


def false_positive_table(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "source", S.hhmmss("start").alias("start"), S.hhmmss("end").alias("end"), "score", "action",
        F.array_join("labels", ", ").alias("labels"), F.array_join("reasons", " | ").alias("reasons"),
        F.coalesce("near_id", F.lit("")).alias("nearest_annotation"), F.coalesce("near_rating", F.lit("")).alias("nearest_rating"),
        F.bround("gap", 3).alias("nearest_gap_seconds"),
    )


def config_table(sweep: DataFrame) -> DataFrame:
    """Ranked configurations with their weights as JSON."""
    return sweep.select(
        "rank", "name", "f1", "precision", "recall", "true_positives", "false_positives", "missed", "candidate_count",
        F.col("min_select").alias("min_select_score"), F.col("min_review").alias("min_review_score"), F.col("min_broll").alias("min_broll_score"),
        "max_candidates", weights_json().alias("weights"),
    )
