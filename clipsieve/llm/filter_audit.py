"""How filters interact: what each removes at every place of every order, and its Shapley value.

Which of the five filters a document fails is one pattern of five bits, so a part of the corpus is a table of at most 32
patterns.  The lattice of all subsets of filters has an edge (S, f) wherever filter f comes after exactly the
filters of S; the documents removed there fail f and none of S.  Counting paths forward from the empty set and backward from
the full one gives the orders that go through an edge, the weight of its removals in the Shapley value.  The steps of an
order are the edges of its path, so all 120 orders read the same 80 edges of a part.

Texts are read once.  A filter's verdict on copies needs the smallest doc_id of each text of the whole table; equal
texts collapse by their SHA-256 before they meet, so a hot text costs no more than any other.

Defined results: a null text is empty, fails A and no other filter but E (0 words and characters are below no share);
a null lang is the part ''; a null doc_id is smaller than none and fails no E by itself, has no label, and doesn't make other
rows copies; rows that repeat a doc_id count each, and a row is no copy of one with its own doc_id; a doc_id labelled more than
once is good or toxic if any label says so; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipsieve.llm.common import UPPER, written

#: The filters' letters; bit k of a pattern is filter k.
LETTERS = "ABCDE"
FULL = (1 << len(LETTERS)) - 1
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def path_counts() -> tuple[dict[int, int], dict[int, int]]:
    """For every subset: the orders of its filters that reach it, and those of the others that leave it for the full set."""
    bits = [1 << k for k in range(len(LETTERS))]
    forward, backward = {0: 1}, {FULL: 1}
    for s in range(1, FULL + 1):
        forward[s] = sum(forward[s ^ b] for b in bits if s & b)
    for s in range(FULL - 1, -1, -1):
        backward[s] = sum(backward[s | b] for b in bits if not s & b)
    return forward, backward


def edges() -> list[tuple[int, int, int]]:
    """(S, bit of f, number of orders through the edge) of the lattice."""
    forward, backward = path_counts()
    return [(s, 1 << k, forward[s] * backward[s | 1 << k]) for s in range(FULL + 1) for k in range(len(LETTERS)) if not s >> k & 1]


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, S, bit of f): the edges on the path of every order."""
    out = []
    for order in permutations(range(len(LETTERS))):
        name, s = "".join(LETTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            out.append((name, step, s, 1 << k))
            s |= 1 << k
    return out


def own_failures(text: Column) -> Column:
    """The pattern of the filters that need the text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    conditions = (n < 100, distinct * 100 < n * 80, capitals * 100 > F.length(text) * 10, text.rlike(r"[#$%&*|]"))
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0)).cast("int")


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, pattern, good, toxic and the number of documents, ``n``."""
    text = F.coalesce("text", F.lit(""))
    facts = written(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), own_failures(text).alias("own")), "facts", "zstd")
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    one = ["digest", "part", "own", "good", "toxic"]
    named = (
        facts.where("doc_id is not null").groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n"))
        .join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
        .groupBy(*one).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    )
    nameless = (
        facts.where("doc_id is null").groupBy("digest", "part", "own").agg(F.count("*").alias("n"))
        .select("part", "own", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n", F.lit(0).cast("long").alias("copies"))
    )
    # Rows of one text are at most parts x label kinds here.
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    stays = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    counted = named.withColumn("least", least).select("part", "own", "good", "toxic", "n", (F.col("n") - stays).alias("copies")).union(nameless)
    sums = counted.groupBy("part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    both = F.explode(F.array(
        F.struct(F.col("own").alias("pattern"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct(F.col("own").bitwiseOR(1 << LETTERS.index("E")).alias("pattern"), F.col("copies").alias("n")),
    ))
    return sums.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.*")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the six counts and shapley, for every part, order and step."""
    spark = docs.sparkSession
    lattice = F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges()]))
    pattern, before, this = F.col("pattern"), F.col("before"), F.col("filter")
    fails, gone = pattern.bitwiseAND(this) > 0, pattern.bitwiseAND(before) > 0
    removed = fails & ~gone
    measures = dict(zip(COUNTS, (~fails & ~gone, removed, fails & gone, pattern == this, removed & F.col("good"), removed & F.col("toxic"))))
    counts = (
        patterns(docs, labels).select("*", lattice.alias("e")).select("*", "e.*")
        .groupBy("part", "before", "filter", "orders").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long").alias(n) for n, c in measures.items()])
    )
    whole = Window.partitionBy("part", "filter")
    weighted = counts.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(whole))
    paths = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, before int, filter int"))  # 600 rows
    return weighted.join(paths, ["before", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
