"""Mixing sources to target weights by hash thresholds.

A document's place in its source is a 48-bit hash of its doc_id.  Sizes are summed by source and hash bucket;
the bucket in which a source's budget runs out is found, and only that bucket is summed again, finer.  The threshold
that comes out takes all hashes below it: nothing is sorted, and larger budgets take supersets of smaller ones.

Defined results: a null text has size 0; a null source is a source of its own, the last; rows that repeat a doc_id
share one fate; sources without words have target 0; an empty table gives no row; other columns stay in ``copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clipsieve.llm.common import WORD, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all sizes
REPEATS = 2
_LEVELS, _BITS = 4, 12


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of each text and the hash that orders its source."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    place = F.conv(F.substring(F.md5(text), 1, _LEVELS * _BITS // 4), 16, 10).cast("long")
    return docs.withColumns({"size": size, "place": place})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target, epochs (whole passes), need (what is left of the target after them).

    ``sizes`` has one row for each source.  Targets are filled like water: a source is at its limit if filling
    all sources to that source's level needs no more than there is.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    numbered = sizes.withColumn("n", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("n") + 1).cast("double")
    level = numbered.select("source", "source_size", weight.alias("w"), (repeats * F.col("source_size")).cast("double").alias("most"))
    rising = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before, onward, everything = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = level.withColumn("total", total).withColumn(
        "full", F.coalesce(F.sum("most").over(before), F.lit(0.0)) + F.col("most") / F.col("w") * F.sum("w").over(onward) <= F.col("total")
    )
    spent = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise((F.col("total") - spent) * F.col("w") / open_weight)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return level.withColumn("target", target).select(
        "source", "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("need")
    )


def thresholds(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """``budget`` (source, need, ...) with ``threshold``: hashes below it sum to ``need`` at most, and it is the largest such.

    ``rows``: source, size, place.  Every level sums into ``2 ** 12`` buckets a source.
    """
    state = budget.withColumns({"path": F.lit(0).cast("long"), "open": F.lit(True)})
    for level in range(_LEVELS):
        shift = _BITS * (_LEVELS - 1 - level)
        own = F.shiftright("place", shift)
        inside = rows
        if level:
            edge = state.where("open").select(F.col("source").alias("s"), "path")
            inside = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift + _BITS) == F.col("path")))
        sums = inside.groupBy("source", own.alias("bucket")).agg(F.sum("size").alias("n"))
        rising = Window.partitionBy("source").orderBy("bucket")
        summed = sums.withColumn("upto", F.sum("n").over(rising)).withColumnRenamed("source", "s")
        over = state.where("open").join(summed, F.col("s").eqNullSafe(F.col("source"))).where(F.col("upto") > F.col("need"))
        edge = over.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("edge")).withColumnRenamed("source", "s")
        state = state.join(edge, F.col("s").eqNullSafe(F.col("source")), "left")
        found = F.col("edge").isNotNull()
        state = written(state.select(
            *(c for c in budget.columns if c != "need"), F.when(found, F.col("need") - F.col("edge.before")).otherwise(F.col("need")).alias("need"),
            F.when(found, F.col("edge.bucket")).otherwise(F.col("path")).alias("path"), (F.col("open") & found).alias("open"),
        ), "thresholds")
    return state.select(*budget.columns, F.when(F.col("open"), F.col("path")).otherwise(F.lit(1 << (_LEVELS * _BITS))).alias("threshold"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row for each source: source, source_size, target, epochs, threshold."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(rows, written(targets(sizes, weights, share, repeats), "targets")).drop("need")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted) of every row."""
    rows = written(sized(docs).select("doc_id", "source", "size", "place"), "sizes")
    return _with_copies(rows, plan(rows, weights, share, repeats)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def _with_copies(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    per_source = per_source.withColumnRenamed("source", "s")
    joined = rows.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("copies", F.col("epochs") + F.when(F.col("place") < F.col("threshold"), 1).otherwise(0))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: the columns of ``docs``, every document as often as the mix takes it."""
    rows = written(sized(docs).select("doc_id", "source", "size", "place"), "sizes")
    of = plan(rows, weights, share, repeats).select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs"), F.col("threshold").alias("__threshold"))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, _LEVELS * _BITS // 4), 16, 10).cast("long")
    taken = docs.join(of, F.col("source").eqNullSafe(F.col("__source")))
    n = F.col("__epochs") + F.when(place < F.col("__threshold"), 1).otherwise(0)
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), n))).select(*docs.columns)
