"""Fuzzy source identity: the same file under different spellings of its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipsieve.functions import scalars as S


def resolve_sources(left: DataFrame, sources: DataFrame, roots: list[str] = (), column: str = "source") -> DataFrame:
    """Add ``canonical_source``.

    In this order: the normalised path itself, the path under each root, the path relative to
    a root, and the basename if exactly one known source has it; else the spelling as given.
    Spellings are resolved once each, so a source's rows do not repeat the work.
    """
    roots = [r for r in roots if r]
    known = sources.select(F.col(column).alias("_known")).distinct()
    keys = known.select("_known", S.path_key("_known").alias("_key"))
    spelled = left.select(F.col(column).alias("_spelled")).where(F.length("_spelled") > 0).distinct()
    key = S.path_key("_spelled")

    def under(root: str) -> Column:
        return F.when(F.startswith("_spelled", F.lit("/")), key).otherwise(S.path_key(F.concat(F.lit(root + "/"), F.col("_spelled"))))

    def relative(root: str) -> Column:
        # "/" keeps the root of an absolute spelling; a known relative path matches what is left.
        prefix = root.rstrip("/") + "/"
        return F.when(F.startswith(key, F.lit(prefix)), F.substring(key, F.lit(len(prefix) + 1), F.length(key)))

    tries = [key, *[under(r) for r in roots], *[relative(r) for r in roots]]
    guesses = spelled.select("_spelled", F.posexplode(F.array(*tries)).alias("_rule", "_key")).where(F.col("_key").isNotNull())
    by_path = guesses.join(keys, "_key").groupBy("_spelled").agg(F.min(F.struct("_rule", "_known")).alias("_hit"))
    unique_names = (
        keys.groupBy(F.substring_index("_key", "/", -1).alias("_name"))
        .agg(F.count("*").alias("_n"), F.min("_known").alias("_only"))
        .where(F.col("_n") == 1)
    )
    resolved = (
        spelled.withColumn("_name", S.basename("_spelled"))
        .join(by_path, "_spelled", "left").join(unique_names, "_name", "left")
        .select("_spelled", F.coalesce("_hit._known", "_only", "_spelled").alias("canonical_source"))
    )
    return left.join(resolved.withColumnRenamed("_spelled", column), column, "left").withColumn(
        "canonical_source", F.coalesce("canonical_source", column)
    )
