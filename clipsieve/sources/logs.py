"""Tool logs as tables.  Logs come in as ``source, line_no, line``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clipsieve.functions import scalars as S
from clipsieve.operators import intervals as I

LINES_PER_CHUNK = 4096.0
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
# The fields looked for.
PTS = rf"pts_time:{_NUMBER}"
SILENCE_START = rf"silence_start:\s*{_NUMBER}"
SILENCE_END = rf"silence_end:\s*{_NUMBER}"
RMS = r"lavfi\.astats\.Overall\.RMS_level=([-+a-zA-Z0-9.]+)"


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Lines of text files of any size: ``source`` (the file), ``line_no`` from 0, ``line``.

    A file is read in as many splits as its size asks for.  A line is numbered inside its split, by the order in which
    the split's task reads it, and counts per split, one row each, make the number that of the file.
    """
    files = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, **({"pathGlobFilter": glob} if glob else {}))
    rows = files.select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"),
    )
    ahead = Window.partitionBy("source").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("source", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    return rows.join(splits, ["source", "_split"]).select("source", (F.col("_id") - F.col("_first") + F.col("_ahead")).alias("line_no"), "line")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files, numbered per file."""
    return numbered_lines(spark, path)


def split_lines(files: DataFrame, text: str = "value") -> DataFrame:
    """Lines of texts that are rows (``source`` and the text)."""
    return files.select("source", F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).select(
        "source", F.col("pos").cast("long").alias("line_no"), "line"
    )


def _value(pattern: str):
    return F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).cast("double")


def parse_scene_log(lines: DataFrame) -> DataFrame:
    """Every ``pts_time`` once per source."""
    found = F.regexp_extract_all("line", F.lit(PTS), F.lit(1))
    rows = lines.where(F.contains("line", F.lit("pts_time:"))).select("source", F.explode(found).alias("t"))
    return rows.select("source", F.col("t").cast("double").alias("time")).distinct()


def parse_silence_log(lines: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Start/end pairs: an end pairs with the event right before it if that is a start.

    A start left open at the end of a log closes at the file's duration.
    """
    events = (
        lines.where(F.contains("line", F.lit("silence_")))
        .withColumn("opens", _value(SILENCE_START))
        .withColumn("closes", F.when(F.col("opens").isNull(), _value(SILENCE_END)))
        .where(F.col("opens").isNotNull() | F.col("closes").isNotNull())
        .select("source", "line_no", "opens", "closes")
    )
    state = F.struct(F.col("line_no").alias("at"), F.col("opens").alias("opens"))
    linked = I.running_max(events, ["source"], F.col("line_no"), [F.col("line_no")], state, "before", width=LINES_PER_CHUNK)
    pairs = linked.where(F.col("closes").isNotNull() & F.col("before.opens").isNotNull()).select(
        "source", F.col("before.opens").alias("start"), F.col("closes").alias("end")
    ).where(F.col("end") > F.col("start"))
    if durations is None:
        return pairs
    tails = events.groupBy("source").agg(F.max(state).alias("last")).join(durations, "source")
    open_tails = tails.where(F.col("duration") > F.col("last.opens")).select(
        "source", F.col("last.opens").alias("start"), F.col("duration").alias("end")
    )
    return pairs.unionByName(open_tails)


def parse_level_log(lines: DataFrame) -> DataFrame:
    """RMS levels with the time seen last before them; silence and non-numbers read as -120 dB."""
    rows = lines.withColumn("t", _value(PTS)).withColumn(
        "raw", F.when(F.col("t").isNull(), F.lower(F.nullif(F.regexp_extract("line", RMS, 1), F.lit(""))))
    ).where(F.col("t").isNotNull() | F.col("raw").isNotNull())
    mark = F.when(F.col("t").isNotNull(), F.struct(F.col("line_no").alias("at"), F.col("t").alias("t")))
    timed = I.running_max(rows, ["source"], F.col("line_no"), [F.col("line_no")], mark, "seen", width=LINES_PER_CHUNK)
    level = F.when(F.col("raw").isin("-inf", "inf", "+inf", "nan"), F.lit(-120.0)).otherwise(F.col("raw").try_cast("double"))
    return timed.where(F.col("raw").isNotNull() & F.col("seen").isNotNull()).select(
        "source", F.col("seen.t").alias("time"), level.alias("rms_db")
    ).where(S.is_finite("rms_db"))


def silence_from_levels(levels: DataFrame, threshold_db: float = -30.0, min_duration: float = 1.0) -> DataFrame:
    """Stretches of levels at or below the threshold, up to the next louder level.

    A quiet stretch is named by the louder level after it, found by a running minimum from
    the end; one that reaches the last level ends there.
    """
    quiet = F.col("rms_db") <= threshold_db
    loud_at = F.when(~quiet, -F.col("time"))
    back = I.running_max(_finite(levels), ["source"], -F.col("time"), [-F.col("time")], loud_at, "next_loud")
    return (
        back.where(quiet).groupBy("source", (-F.col("next_loud")).alias("stop"))
        .agg(F.min("time").alias("start"), F.max("time").alias("last"))
        .select("source", "start", F.coalesce("stop", "last").alias("end"))
        .where(F.col("end") - F.col("start") >= min_duration)
    )


def _finite(levels: DataFrame) -> DataFrame:
    return levels.where(S.is_finite("rms_db"))
