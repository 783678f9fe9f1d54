"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def rounded4(value: str | Column) -> Column:
    """Four decimals of the scaled number, as the SQL's round; Spark's rounds the printed digits."""
    return F.round((F.col(value) if isinstance(value, str) else value) * F.lit(1e4)) / F.lit(1e4)


def r4(name: str, alias: str | None = None) -> Column:
    return rounded4(name).alias(alias or name.split(".")[-1])


def flat(name: str) -> Column:
    """An array as one comparable string."""
    return F.coalesce(F.array_join(F.col(name), "|"), F.lit("")).alias(name)
