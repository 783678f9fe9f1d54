"""Media listings and probe documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipsieve.functions import scalars as S, vocab as V

_PROBE = (
    "format struct<duration: string, size: string>, "
    "streams array<struct<codec_type: string, codec_name: string, width: int, height: int, r_frame_rate: string>>"
)


def scan_media(spark: SparkSession, root: str, extensions=V.MEDIA_EXTENSIONS) -> DataFrame:
    """Media files below ``root``: path, size and change time; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])
    return files.select("path", "length", "modificationTime").where(wanted)


def parse_probe_json(probes: DataFrame) -> DataFrame:
    """Probe documents (``filepath, content``) as asset rows; broken ones get status ``error``."""
    doc = F.from_json("content", _PROBE)
    broken = ~F.startswith(F.ltrim(F.coalesce("content", F.lit(""))), F.lit("{")) | F.expr("try_parse_json(content)").isNull()
    rows = probes.withColumn("_broken", broken).withColumn("_d", F.when(~F.col("_broken"), doc))
    video = F.try_element_at(F.filter("_d.streams", lambda s: s["codec_type"] == "video"), F.lit(1))
    rate = F.split(F.col("_v.r_frame_rate"), "/", 2)
    fps = F.bround(F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.get(rate, F.lit(1)).try_cast("double")), 3)
    sound = F.exists("_d.streams", lambda s: s["codec_type"] == "audio")
    size = F.coalesce(F.col("_d.format.size").try_cast("double"), F.lit(0.0)) / F.lit(1024.0 * 1024.0)
    ok = lambda value, default: F.when(F.col("_broken"), F.lit(default)).otherwise(value)
    return rows.withColumn("_v", video).select(
        S.basename("filepath").alias("filename"), "filepath", ok(F.bround(size, 2), 0.0).alias("size_mb"),
        ok(F.bround(F.coalesce(F.col("_d.format.duration").try_cast("double"), F.lit(0.0)), 3), 0.0).alias("duration"),
        F.col("_v.width").alias("width"), F.col("_v.height").alias("height"), F.col("_v.codec_name").alias("codec"), fps.alias("fps"),
        F.coalesce(sound, F.lit(False)).alias("has_audio"), ok(F.lit("ok"), "error").alias("status"),
        F.when(F.col("_broken"), "probe document is not valid JSON").alias("error"),
    )


def build_inventory(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets that were probed, one summary row).  Rows without a path count as failures."""
    kept = assets.where(F.length("filepath") > 0)
    summary = assets.agg(
        F.count_if(F.length("filepath") > 0).alias("count"), F.count_if(F.coalesce(F.length("filepath"), F.lit(0)) == 0).alias("skipped"),
        F.bround(F.sum(F.when(F.length("filepath") > 0, F.coalesce("duration", F.lit(0.0)))), 3).alias("total_duration"),
        F.bround(F.sum(F.when(F.length("filepath") > 0, F.coalesce("size_mb", F.lit(0.0)))), 2).alias("total_size_mb"),
    )
    return kept, summary
