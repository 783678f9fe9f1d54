"""Exact duplicates against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest, in storage that all executors share.  A batch is
reduced to one row for each digest, matched against the index by a sort-merge anti-join (the index side isn't
shuffled; its buckets, of several files each after several batches, are sorted for the merge), and what is new is appended with the doc_id that stays.

Texts are equal when identical after lower-casing A-Z.  Of equal texts in a batch the row with the largest
doc_id stays; a text the index already holds stays with the document named there.

Defined results: a null text is empty; rows that repeat doc_id and text are counted each and share one fate;
a null doc_id stays only where its whole group has none; an empty table appends nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipsieve.llm.common import ascii_lower, work_path, written

#: A group with one of so many parts of the batch's rows or more is hot.  A batch has ``HOT_SHARE`` of them at most, however
#: large the index, so they may be broadcast.
HOT_SHARE = 1000
_COLUMNS = "text_sha256 string, keep_id long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    text = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"))


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """Table name of the index at ``path``; it is made if it isn't there.  ``buckets`` must stay the same for one path."""
    name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_COLUMNS}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {n} BUCKETS"
    )
    return name


def append_new(groups: DataFrame, index: str) -> None:
    """Appends the digests that the index doesn't hold."""
    spark = groups.sparkSession
    known = spark.table(index).select("text_sha256").hint("merge")
    buckets = int(next(r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {index}").collect() if r["col_name"] == "Num Buckets"))
    new = groups.join(known, "text_sha256", "left_anti").repartition(buckets, "text_sha256")
    path = next(r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {index}").collect() if r["col_name"] == "Location")
    writer = new.select("text_sha256", "keep_id", "group_size").write.format("parquet").mode("append")
    writer.option("path", path).bucketBy(buckets, "text_sha256").sortBy("text_sha256").saveAsTable(index)


def deduplicate(docs: DataFrame, index: str) -> DataFrame:
    """Adds the documents' digests to the index; doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = written(digests(docs), "digests")
    groups = written(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
    append_new(groups, index)
    held = docs.sparkSession.table(index)
    common = groups.where(F.col("group_size") * HOT_SHARE >= rows.count()).select("text_sha256")
    hot = held.join(F.broadcast(common), "text_sha256")
    found = rows.join(F.broadcast(hot), "text_sha256", "left")
    warm = found.where("group_size is not null")
    cold = found.where("group_size is null").select("doc_id", "text_sha256").join(held.hint("merge"), "text_sha256")
    return warm.unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``deduplicate`` against a new index."""
    spark = docs.sparkSession
    return deduplicate(docs, open_index(spark, work_path(spark, "digest-index"), buckets))


def kept_rows(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row stands for; rows that repeat doc_id and text become one."""
    verdicts = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("__doc"), F.col("text_sha256").alias("__sha")).distinct()
    own = docs.withColumn("__own", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__sha"))
    return own.join(verdicts, same, "left_semi").dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
