"""Log-template tree over lines; recurring templates are dropped.

A line walks a tree of fixed depth: its number of tokens, then its first ``DEPTH`` tokens, a token with a digit standing
for any such.  In a leaf a word behind the first ``DEPTH`` counts as often as distinct lines have it at its place (copies
and repeated lines add nothing).  Each line is held against the upper median of its own counts: a word of a lower count is
a variable field, however often its value comes back.  So half of these words or more are constant, and lines of one
template, whose constant words have equal counts, get equal fields.  What remains is the line's template; one that
``MIN_DOCUMENTS`` documents share is dropped wherever it occurs, if it holds a letter and half of its tokens,
``MIN_WORDS`` at most, are constant: tokens with digits may be any share of the others.  With too few constant tokens the
line with its digits masked is the template.  A caller can ask for more: ``min_tokens``, and ``min_constant``, a share of all
tokens.  Leaves seen in one document are settled by a count, and equal lines meet once, so a line that a third of all documents repeat costs one row.

Tokens are runs without white space.  Defined results: a null text has no line, an empty one has one empty line that is
never dropped; a line repeated within one document doesn't recur across documents; rows that repeat doc_id and text
are reported once each and count as one document; a null doc_id counts as a document of its own; an empty table gives
no row; other columns are kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clipsieve.llm.common import batches, written

DEPTH = 3
MIN_TOKENS = 1
MIN_DOCUMENTS = 3
MIN_CONSTANT = 0.0
MIN_WORDS = 3
FIELD = "<*>"
#: White space that isn't one space, and a token with a digit once that is gone.
_SPACES = r"[ \t\x0b\f\r]{2,}|[\t\x0b\f\r]"
_VARIABLE = r"[^ \n]*[0-9][^ \n]*"


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    """doc_id, text_hash, line (number), leaf, masked (tokens with one space between, fields for digits) of every line with a letter and enough tokens."""

    def run(source):
        for batch in batches(source, "text"):
            text = pc.replace_substring_regex(batch.column("text"), _SPACES, " ")
            lists = pc.split_pattern(pc.replace_substring_regex(text, _VARIABLE, FIELD), "\n")
            row = np.asarray(pc.list_parent_indices(lists))
            masked = pc.utf8_trim(pc.list_flatten(lists), " ")
            n = np.asarray(pc.count_substring(masked, " ")) + 1
            keep = np.flatnonzero((n >= min_tokens) & np.asarray(pc.match_substring_regex(masked, r"\pL")))
            line = keep - np.searchsorted(row, row[keep])
            columns = [batch.column(c).take(pa.array(row[keep])) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(line, pa.int32()), pa.array(n[keep], pa.int32()), masked.take(pa.array(keep))],
                names=["doc_id", "text_hash", "line", "n", "masked"],
            )

    cut = docs.select("doc_id", "text", _text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, line int, n int, masked string")
    return cut.withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", DEPTH))).drop("n")


def _filled(lines: DataFrame, min_constant: float) -> DataFrame:
    """id, template of every line that may recur.  ``counts``: place and count of words that several lines have; others count 1."""

    def template(masked, counts, several):
        tokens = masked.split(" ")
        count = [0 if t == FIELD else 1 for t in tokens]
        for c in counts or ():
            count[c["at"]] = c["n"]
        need = max(1, min(len(tokens) // 2, MIN_WORDS), min_constant * len(tokens))
        behind = sorted(filter(None, count[DEPTH:]), reverse=True)
        if behind and behind[-1] < (median := behind[(len(behind) - 1) // 2]):
            kept = [t if k < DEPTH or count[k] >= median else FIELD for k, t in enumerate(tokens)]
            if len(kept) - kept.count(FIELD) >= need:
                return " ".join(kept)
        return masked if several and sum(map(bool, count)) >= need else None

    def run(source):
        for batch in source:
            out = list(map(template, *(batch.column(c).to_pylist() for c in ("masked", "counts", "several"))))
            made = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "template"])
            yield made.filter(pc.is_valid(made.column("template")))

    return lines.select("id", "masked", "counts", "several").mapInArrow(run, "id long, template string")


def recurring(
    docs: DataFrame, min_tokens: int = MIN_TOKENS, min_documents: int = MIN_DOCUMENTS, min_constant: float = MIN_CONSTANT,
) -> DataFrame:
    """doc_id, text_hash, line, template of every line to drop.  Lines, tokens at their places and templates meet by 64-bit hashes."""
    lines = written(_lines(docs, min_tokens), "cut-lines", "zstd")
    doc = F.xxhash64("doc_id", "text_hash")
    several = lines.groupBy("leaf").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")).where("lo < hi").select("leaf")
    live = written(lines.join(several, "leaf").withColumn("id", F.xxhash64("leaf", "masked")), "lines", "zstd")
    distinct = written(live.groupBy("id", "leaf", "masked").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")), "distinct-lines", "zstd")
    tokens = distinct.select("id", "leaf", F.posexplode(F.split("masked", " ", -1)).alias("at", "token"))
    tokens = tokens.where((F.col("at") >= DEPTH) & (F.col("token") != FIELD)).select("id", "at", F.xxhash64("leaf", "at", "token").alias("placed"))
    shared = tokens.groupBy("placed").agg(F.count("*").alias("n")).where("n > 1")
    counts = tokens.join(shared, "placed").groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
    known = distinct.select("id", "masked", (F.col("lo") < F.col("hi")).alias("several")).join(counts, "id", "left").where("several or counts is not null")
    templates = written(_filled(known, min_constant).withColumn("kind", F.xxhash64("template")), "templates", "zstd")
    placed = live.select("doc_id", "text_hash", "line", "id").join(templates, "id").drop("id")
    often = placed.select("kind", doc.alias("doc")).distinct().groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents)
    return placed.join(often.select("kind"), "kind").select("doc_id", "text_hash", "line", "template")


def _dropped(docs: DataFrame, **options) -> DataFrame:
    found = written(recurring(docs, **options), "dropped")
    lines = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    return lines.withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"})


def _with_dropped(rows: DataFrame, dropped: DataFrame, text_hash: Column) -> DataFrame:
    joined = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("__doc")) & (text_hash == F.col("__hash")), "left")
    return joined.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the numbers of the dropped lines, from 0, of every row."""
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    rows = docs.select("doc_id", _text_hash().alias("text_hash"), n.alias("n_lines"))
    return _with_dropped(rows, _dropped(docs, **options), F.col("text_hash")).select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the recurring lines taken out of the texts; a text of which nothing is left is empty."""
    dropped = _dropped(docs, **options).withColumnRenamed("dropped", "__lines")
    joined = docs.withColumn("__own", _text_hash()).join(dropped, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__hash")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__lines", i)), "\n")
    return joined.withColumn("text", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
