"""Interval work that stays even when one source holds a third of all rows.

Ordered per-source logic (running maxima, islands, nearest neighbours) is cut into time
chunks: a window runs inside one ``(source, chunk)``, and one summary row per chunk
carries the state across.  Range joins hash on ``(source, time bucket)``.  Neither ever
gathers a whole source in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipsieve.functions.scalars import overlap_seconds, strictly_overlaps

CHUNK_SECONDS = 120.0
BUCKET_SECONDS = 60.0

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO_HERE = (Window.unboundedPreceding, 0)


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


# -- running state over a long ordered group ----------------------------------------------

def running_max(
    df: DataFrame,
    keys: list[str],
    position: Column,
    order: list[Column],
    value: Column,
    out: str,
    inclusive: bool = False,
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """``max(value)`` over all earlier rows of the same keys (``inclusive`` adds the row itself).

    ``order`` must start with ``position``.  Null values are skipped.  Exact for any
    ``width``; the width only decides how finely a long group is split.
    """
    rows = df.withColumn("_chunk", _cell(position, width)).withColumn("_value", value)
    frame = _UP_TO_HERE if inclusive else _BEFORE
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*frame)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    carry = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max("_value").alias("_top"))
        .withColumn("_carry", F.max("_top").over(across))
        .drop("_top")
    )
    return (
        rows.withColumn("_local", F.max("_value").over(inside))
        .join(carry, [*keys, "_chunk"], "left")
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_chunk", "_value", "_local", "_carry")
    )


def running_total(df: DataFrame, keys: list[str], position: str, value: Column, out: str, width: float = CHUNK_SECONDS) -> DataFrame:
    """``sum(value)`` of whole numbers over all earlier positions of the same keys; a position is unique in its key."""
    rows = df.withColumn("_chunk", _cell(F.col(position), width)).withColumn("_value", value.cast("long"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(*_BEFORE)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    carry = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_n")).withColumn("_carry", F.sum("_n").over(across)).drop("_n")
    zero = F.lit(0).cast("long")
    return (
        rows.withColumn("_local", F.sum("_value").over(inside)).join(carry, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_local", zero) + F.coalesce("_carry", zero)).drop("_chunk", "_value", "_local", "_carry")
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    position: str,
    value: Column,
    out: str,
    rows_per_chunk: int = 4096,
) -> DataFrame:
    """``sum(value)`` over all earlier positions; ``position`` is a dense, unique 1-based rank."""
    rows = df.withColumn("_chunk", _cell(F.col(position), rows_per_chunk)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(*_BEFORE)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    carry = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_carry", F.sum("_total").over(across))
        .drop("_total")
    )
    zero = F.lit(0).cast("double")
    return (
        rows.withColumn("_local", F.sum("_value").over(inside))
        .join(carry, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_local", zero) + F.coalesce("_carry", zero))
        .drop("_chunk", "_value", "_local", "_carry")
    )


def with_islands(
    df: DataFrame,
    keys: list[str],
    gap: Column,
    start: str = "start",
    end: str = "end",
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """Add ``island``: the start of the merged run that each row belongs to.

    A row opens a new run when it starts later than everything before it ended, plus ``gap``.
    """
    order = [F.col(start), F.col(end)]
    reached = running_max(df, keys, F.col(start), order, F.col(end), "_reach", width=width)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap)
    headed = reached.withColumn("_head", F.when(opens, F.col(start))).drop("_reach")
    return running_max(
        headed, keys, F.col(start), order, F.col("_head"), "island", inclusive=True, width=width
    ).drop("_head")


def local_runs(windows: DataFrame, keys: list[str], gap: Column, width: float = CHUNK_SECONDS) -> DataFrame:
    """Runs merged inside each ``(keys, chunk)``: the only pass over the windows themselves.

    Windows move once, to their chunk; copies of a window collapse there before anything is ordered.
    Windows without ``labels`` give runs without them.
    """
    own = [c for c in ("labels",) if c in windows.columns]
    chunked = windows.select(*keys, "start", "end", *own).withColumn("_chunk", _cell(F.col("start"), width)).repartition(*keys, "_chunk")
    distinct = chunked.groupBy(*keys, "_chunk", "start", *own).agg(F.max("end").alias("end"))
    spec = Window.partitionBy(*keys, "_chunk").orderBy("start")
    reach = F.max("end").over(spec.rowsBetween(*_BEFORE))
    return (
        distinct.withColumn("_reach", reach)
        .withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), F.col("start")))
        .withColumn("_run", F.max("_opens").over(spec.rowsBetween(*_UP_TO_HERE)))
        .groupBy(*keys, "_chunk", "_run")
        .agg(F.max("end").alias("end"), *[_label_union().alias(c) for c in own])
        .withColumnRenamed("_run", "start")
    )


def _label_union() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels"))))


def join_runs(runs: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """Join ``local_runs`` across chunk borders.

    A run continues an earlier one when it starts within ``gap`` of the furthest end of all
    earlier chunks.  Runs of a chunk ascend, so if any of them opens a window the last does;
    one summary row per chunk is therefore enough to name the window that later runs continue.
    """
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*_BEFORE)
    chunks = (
        runs.groupBy(*keys, "_chunk").agg(F.max("end").alias("_end"), F.max("start").alias("_last"))
        .withColumn("_reach", F.max("_end").over(across))
        .withColumn("_open", F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach") + gap), F.col("_last")))
        .withColumn("_current", F.max("_open").over(across))
        .select(*keys, "_chunk", "_reach", "_current")
    )
    opens = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)
    return (
        runs.join(chunks, [*keys, "_chunk"])
        .withColumn("_window", F.when(opens, F.col("start")).otherwise(F.col("_current")))
        .groupBy(*keys, "_window")
        .agg(F.max("end").alias("end"), *[_label_union().alias(c) for c in ("labels",) if c in runs.columns])
        .withColumnRenamed("_window", "start")
    )


def merge_windows(windows: DataFrame, keys: list[str], gap: Column, width: float = CHUNK_SECONDS) -> DataFrame:
    """Merge overlapping or nearly touching windows (``start, end, labels``) per key."""
    return join_runs(local_runs(windows, keys, gap, width), keys, gap)


# -- range joins --------------------------------------------------------------------------

def _spread(df: DataFrame, start: str, end: str, width: float, tag: str) -> DataFrame:
    """One copy per time bucket touched; ``tag`` keeps the first bucket."""
    first = _cell(F.col(start), width)
    last = F.greatest(first, _cell(F.col(end), width))
    return df.withColumn(tag, first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    condition: Column,
    left_span: tuple[str, str] = ("start", "end"),
    right_span: tuple[str, str] = ("h_start", "h_end"),
    width: float = BUCKET_SECONDS,
) -> DataFrame:
    """Inner join of intervals that share time, hashed on ``keys`` and the time bucket.

    Both sides are copied to every bucket they touch; a pair survives only in the first
    bucket the two have in common, so it comes out once.
    """
    a = _spread(left, *left_span, width, "_first_l")
    b = _spread(right, *right_span, width, "_first_r")
    return (
        a.join(b, [*keys, "_bucket"])
        .where((F.col("_bucket") == F.greatest("_first_l", "_first_r")) & condition)
        .drop("_bucket", "_first_l", "_first_r")
    )


def points_in_windows(
    windows: DataFrame, points: DataFrame, keys: list[str], time: str = "time", width: float = BUCKET_SECONDS
) -> DataFrame:
    """Closed containment ``start <= time <= end``."""
    spread = _spread(windows, "start", "end", width, "_first_l").drop("_first_l")
    return (
        spread.join(points.withColumn("_bucket", _cell(F.col(time), width)), [*keys, "_bucket"])
        .where((F.col("start") <= F.col(time)) & (F.col(time) <= F.col("end")))
        .drop("_bucket")
    )


def overlapping_hits(windows: DataFrame, hits: DataFrame, keys: list[str], width: float = BUCKET_SECONDS) -> DataFrame:
    """Strict overlap of ``start, end`` with ``h_start, h_end``; zero-length hits never match."""
    return interval_join(windows, hits, keys, strictly_overlaps("start", "end", "h_start", "h_end"), width=width)


def endpoint_hits(windows: DataFrame, hits: DataFrame, keys: list[str], width: float = BUCKET_SECONDS) -> DataFrame:
    """A hit counts when one of its endpoints lies in the window; one enclosing the window does not."""
    return interval_join(windows, hits, keys, endpoint_inside(), width=width)


def endpoint_inside() -> Column:
    inside = lambda t: (F.col("start") <= F.col(t)) & (F.col(t) <= F.col("end"))
    return inside("h_start") | inside("h_end")


def uncovered_points(
    points: DataFrame, windows: DataFrame, keys: list[str], time: str = "time", width: float = BUCKET_SECONDS
) -> DataFrame:
    """Points inside no window (closed).  Each point sits in one bucket, so an anti join is exact."""
    spread = _spread(
        windows.select(*keys, F.col("start").alias("_w_start"), F.col("end").alias("_w_end")),
        "_w_start", "_w_end", width, "_first_r",
    )
    p = points.withColumn("_bucket", _cell(F.col(time), width)).alias("p")
    w = spread.alias("w")
    same = [F.col(f"p.{k}") == F.col(f"w.{k}") for k in [*keys, "_bucket"]]
    covered = (F.col("w._w_start") <= F.col(f"p.{time}")) & (F.col(f"p.{time}") <= F.col("w._w_end"))
    return p.join(w, [*same, covered], "left_anti").drop("_bucket")


# -- nearest neighbour --------------------------------------------------------------------

def nearest_interval(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: list[str],
    better: list[Column],
    payload: list[str],
    closed_points: bool = False,
    prefer_overlap: bool = False,
    width: float = CHUNK_SECONDS,
) -> DataFrame:
    """The right interval with the least gap to each left one, without pairing all of a group.

    ``left`` carries ``start, end`` and ``left_id``; ``right`` carries ``h_start, h_end`` and
    ``payload``.  ``better`` are numeric columns of ``right``, greater winning, that break
    ties and identify the right row.  Three sources of answers compete: intervals sharing
    time (range join), the last one ended before, and the first one started after (running
    maxima).  ``prefer_overlap`` ranks by shared seconds between gap and ``better``.
    Both sides need ``end >= start``.  Left rows whose key has no right row come out absent.
    """
    names = [f"_b{i}" for i in range(len(better))]
    r = right.select(
        *keys, "h_start", "h_end", *[c.cast("double").alias(n) for c, n in zip(better, names)], *payload
    )
    l = left.select(*keys, *left_id, "start", "end").dropDuplicates([*keys, *left_id])
    item = F.struct(*payload).alias("item")

    if closed_points:
        touch = (F.col("h_start") <= F.col("start")) & (F.col("start") <= F.col("h_end"))
        shared = F.lit(0.0)
    else:
        touch = strictly_overlaps("start", "end", "h_start", "h_end")
        shared = overlap_seconds("start", "end", "h_start", "h_end") if prefer_overlap else F.lit(0.0)
    here = interval_join(l, r, keys, touch).select(
        *keys, *left_id, F.struct(F.lit(0.0).alias("closeness"), shared.alias("shared"), *names, item).alias("best")
    )

    def neighbour(right_edge: Column, left_edge: Column) -> DataFrame:
        # Equal positions collapse on both sides first, so copies never pile up in one chunk.
        seen = F.struct(right_edge.alias("edge"), *names, item)
        marks = r.groupBy(*keys, right_edge.alias("_at")).agg(F.max(seen).alias("_seen")).withColumn("_probe", F.lit(0))
        probes = l.select(*keys, left_edge.alias("_at")).distinct().withColumn("_probe", F.lit(1))
        line = running_max(
            marks.unionByName(probes, allowMissingColumns=True), keys, F.col("_at"), [F.col("_at"), F.col("_probe")],
            F.col("_seen"), "_near", width=width,
        ).where((F.col("_probe") == 1) & F.col("_near").isNotNull()).select(*keys, "_at", "_near")
        return l.withColumn("_at", left_edge).join(line, [*keys, "_at"]).select(
            *keys, *left_id,
            F.struct(
                (F.col("_near.edge") - F.col("_at")).alias("closeness"), F.lit(0.0).alias("shared"),
                *[F.col(f"_near.{n}") for n in names], F.col("_near.item").alias("item"),
            ).alias("best"),
        )

    before = neighbour(F.col("h_end"), F.col("start"))
    after = neighbour(-F.col("h_start"), -F.col("end"))
    return (
        here.unionByName(before).unionByName(after)
        .groupBy(*keys, *left_id)
        .agg(F.max("best").alias("best"))
        .select(*keys, *left_id, (-F.col("best.closeness")).alias("gap"), "best.shared", "best.item.*")
        .withColumn("gap", F.when(F.col("gap") == 0, F.lit(0.0)).otherwise(F.col("gap")))
    )


