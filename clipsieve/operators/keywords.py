"""Keyword dictionaries as tables: a text is read once, however many keywords there are.

A dictionary of up to ``MAX_SHIPPED`` characters becomes one automaton, built once in each worker.  A larger one is joined: a
whole word of letters and digits meets the equal words of the texts, any other keyword only the texts that hold its rarest
three characters, and is looked for in those.  Both give the same rows, and neither plan grows with the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from clipsieve.session import cut_lineage

MAX_SHIPPED = 4_000_000
GRAM = 3


def numbered(keywords: DataFrame | list[str], spark=None) -> DataFrame:
    """``place, keyword``: a list in its order, lower-cased."""
    if isinstance(keywords, DataFrame):
        return keywords.select(F.col("place").cast("long").alias("place"), F.lower("keyword").alias("keyword"))
    table = pa.table({"place": pa.array(range(len(keywords)), pa.int64()), "keyword": pa.array([k.lower() for k in keywords], pa.string())})
    return spark.createDataFrame(table) if len(keywords) else spark.createDataFrame([], "place long, keyword string")


@lru_cache(maxsize=4)
def _automaton(words: Broadcast):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    always: list[tuple[int, str]] = []
    places: dict[str, list[int]] = {}
    for place, word in words.value:
        places.setdefault(word, []).append(place)
    for word, own in places.items():
        if word:
            automaton.add_word(word, (word, own))
        else:
            always += [(p, "") for p in own]
    if len(automaton):
        automaton.make_automaton()
    return automaton, always


def _free(char: str) -> bool:
    return not (char.isascii() and char.isalnum())


def _shipped(rows: DataFrame, words: Broadcast, whole_words: bool, out: str) -> DataFrame:
    def found(text: str | None) -> list[str]:
        automaton, always = _automaton(words)
        if text is None:
            return []
        hits = dict(always)
        for end, (word, places) in automaton.iter(text) if len(automaton) else ():
            start = end - len(word) + 1
            if not whole_words or ((start == 0 or _free(text[start - 1])) and (end + 1 == len(text) or _free(text[end + 1]))):
                hits.update((p, word) for p in places)
        return [hits[p] for p in sorted(hits)]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = pa.array([found(t) for t in batch.column("_low").to_pylist()], pa.list_(pa.string()))
            kept = batch.drop_columns(["_low"])
            yield pa.RecordBatch.from_arrays([*kept.columns, lists], names=[*kept.schema.names, out])

    fields = [f for f in rows.schema.fields if f.name != "_low"]
    return rows.mapInArrow(run, StructType(fields).add(out, ArrayType(StringType())))


def _grams(text: str) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.array_distinct(F.transform(places, lambda k: F.substring(F.col(text), k, F.lit(GRAM))))


def _by_gram(rows: DataFrame, keywords: DataFrame, whole_words: bool) -> DataFrame:
    """``_row, place, keyword`` of the texts that hold a keyword, looked for where its rarest gram is."""
    in_texts = rows.where(F.length("_low") >= GRAM).select("_row", F.explode(_grams("_low")).alias("gram"))
    counts = in_texts.groupBy("gram").agg(F.count("*").alias("n"))
    keys = keywords.select("place", "keyword", F.explode(_grams("keyword")).alias("gram")).join(counts, "gram", "left")
    # A keyword with a gram that no text has is in none.
    rarest = keys.groupBy("place", "keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")).where("k.n > 0")
    maybe = in_texts.join(rarest.select("place", "keyword", F.col("k.gram").alias("gram")), "gram").select("_row", "place", "keyword")
    there = F.contains("_low", "keyword")
    if whole_words:  # a pattern of its own for each keyword, so only for texts that hold it
        quoted = F.concat(F.lit(r"(^|[^A-Za-z0-9])\Q"), F.replace("keyword", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(\z|[^A-Za-z0-9])"))
        there = F.when(there, F.rlike("_low", quoted)).otherwise(False)
    return maybe.join(rows.select("_row", "_low"), "_row").where(there).select("_row", "place", "keyword")


def _joined(rows: DataFrame, keywords: DataFrame, whole_words: bool, out: str) -> DataFrame:
    """For keywords of ``GRAM`` characters or more.  A whole word of letters and digits is a whole run of them, so it is joined as such."""
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    if whole_words:
        plain = F.rlike("keyword", F.lit(r"^[A-Za-z0-9]+\z"))
        runs = rows.select("_row", F.explode(F.array_distinct(F.split("_low", "[^A-Za-z0-9]+"))).alias("keyword"))
        hits = runs.join(keywords.where(plain).select("place", "keyword"), "keyword").select("_row", "place", "keyword")
        others = keywords.where(~plain)
        if not others.isEmpty():
            hits = hits.unionByName(_by_gram(rows, others, whole_words))
    else:
        hits = _by_gram(rows, keywords, whole_words)
    lists = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("place", "keyword"))).alias("_hits"))
    found = F.coalesce(F.transform("_hits", lambda h: h["keyword"]), F.array().cast("array<string>"))
    return rows.join(lists, "_row", "left").withColumn(out, found).drop("_row", "_hits", "_low")


def find_keywords(rows: DataFrame, text: str, keywords: DataFrame | list[str], whole_words: bool = False, out: str = "keywords", most: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the lower-cased keywords that the lower-cased text holds, by their ``place``.

    ``keywords``: a list, or a table of ``place`` (unique) and ``keyword``.  With ``whole_words``, no ASCII letter or digit may touch a
    keyword.  A null text holds none, an empty keyword is in every text.  ``most`` is the number of characters to be shipped.
    """
    most = MAX_SHIPPED if most is None else most
    words = numbered(keywords, rows.sparkSession).where("keyword is not null")
    low = rows.withColumn("_low", F.lower(text))
    context = rows.sparkSession.sparkContext

    def ship(part: DataFrame) -> Broadcast:
        return context.broadcast([(r["place"], r["keyword"]) for r in part.orderBy("place").collect()])

    if (words.agg(F.sum(F.length("keyword") + 8)).first()[0] or 0) <= most:  # what is collected is within the bound
        return _shipped(low, ship(words), whole_words, out)
    short = words.where(F.length("keyword") < GRAM)
    rest = _joined(low, words.where(F.length("keyword") >= GRAM).select("*"), whole_words, "_long")
    # Keywords of one or two characters are few, as there are few characters; each is found by the automaton.
    both = _shipped(rest.withColumn("_low", F.lower(text)), ship(short.groupBy("keyword").agg(F.min("place").alias("place"))), whole_words, "_short")
    order = cut_lineage(words.groupBy("keyword").agg(F.array_sort(F.collect_list("place")).alias("places")))
    return _merged(both, order, out)


def _merged(rows: DataFrame, order: DataFrame, out: str) -> DataFrame:
    """Both lists as one, each keyword as often and where the dictionary has it."""
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    every = rows.select("_row", F.explode(F.array_union("_long", "_short")).alias("keyword")).join(order, "keyword")
    placed = every.select("_row", "keyword", F.explode("places").alias("place"))
    lists = placed.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda h: h["keyword"]).alias(out))
    return rows.drop("_long", "_short").join(lists, "_row", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop("_row")
