"""Total orders: top-N and a global rank that never sorts the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipsieve.session import cut_lineage

_BEFORE = (Window.unboundedPreceding, -1)


def top_n(df: DataFrame, order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows with their 1-based rank; only those rows meet in one task."""
    return df.orderBy(*order).limit(n).withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1-based rank of every row.

    A range-partitioned sort is materialised, each partition numbers its own rows, and the
    per-partition counts (one row per partition) give the offsets.
    """
    numbered = cut_lineage(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_row", 33)
    offsets = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)))
        .drop("_n")
    )
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition: the size of this side is the partition count.
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, within + F.col("_offset") + 1)
        .drop("_row", "_part", "_offset")
    )


def ranked(df: DataFrame, order: list[Column], n: int | None, out: str = "rank") -> DataFrame:
    return global_rank(df, order, out) if n is None else top_n(df, order, n, out)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark prunes each map task to ``n`` per group before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(spec)).where(F.col(out) <= n)


def rank_per_group(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """1-based rank of every row in its group; a group of any size is sorted by several tasks."""
    total = global_rank(df, [*map(F.col, keys), *order], "_total")
    first = total.groupBy(*keys).agg(F.min("_total").alias("_first"))
    return total.join(first, keys).withColumn(out, F.col("_total") - F.col("_first") + 1).drop("_total", "_first")
