"""Secret scan with multipart credential linking; DataFrame functions only.

Certain kinds stand alone: assigned secrets, access identifiers and long hexadecimal runs.  Weak candidates (a short
assigned secret, a mixed run of 32 characters or more, a user or client name, an endpoint) mean nothing alone: they are
reported only when a complementary part is within ``SCOPE`` characters of them in the same text, from the end of the one
to the start of the other, however long they are.  Parts of a role become one row for each
stretch of ``SCOPE`` characters.  A candidate reaches up to some place: of the stretches before that place's the largest end
decides, in its own the first start, so no part is paired with another, however many there are.

Defined results: a null text is empty; rows that repeat doc_id and text give equal rows; a null doc_id is kept and
linked by its text; an empty table gives no row; other columns are ignored.  Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clipsieve.llm.common import written

SCOPE = 200
RUN = 256

# Patterns of the three certain kinds, and the lengths from which a match counts.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Weak kinds, by the role that they play.
USER = r"""\b(?:[Uu]ser(?:[Nn]ame|_?[Ii][Dd])?|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii][Dd]|[Aa]ccess_?[Kk]ey(?:_?[Ii][Dd])?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+"""
BLOB = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"\b(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}\b"
KINDS = ("assign", "access", "hex", "assign_short", "user", "blob", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "assign_short": "secret", "user": "identifier", "blob": "secret", "endpoint": "endpoint"}
#: A part of the first role is confirmed by one of the others.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches of a pattern as (kind number, start, end, match); the pieces between them give the places.

    Places are running sums: first over runs of ``RUN`` matches, then inside each run, so the work grows with the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.transform(F.slice(between, 1, F.size(found)), lambda b: F.length(b)).alias("gap"))
    zero, none = F.lit(0), F.array().cast("array<struct<kind:int,start:int,end:int,match:string>>")

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.length(p["m"])
        one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), begin.alias("start"), end.alias("end"), p["m"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def runs(all_pairs: Column) -> Column:
        """Every run with its width and its matches."""
        numbers = F.sequence(zero, F.floor((F.size(all_pairs) - 1) / RUN).cast("int"))
        cut = F.transform(numbers, lambda k: F.slice(all_pairs, k * RUN + 1, RUN))
        return F.transform(cut, lambda r: F.struct(r.alias("run"), F.aggregate(r, zero, lambda n, p: n + p["gap"] + F.length(p["m"])).alias("width")))

    def placed(acc: Column, r: Column) -> Column:
        one = F.struct(acc["at"].alias("at"), r["run"].alias("run"))
        return F.struct((acc["at"] + r["width"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    empty = F.array().cast("array<struct<at:int,run:array<struct<m:string,gap:int>>>>")
    # As the element of an array the pairs are a variable, not an expression that every run would evaluate anew.
    cut = F.transform(F.array(pairs), runs)[0]
    starts = F.aggregate(cut, F.struct(zero.alias("at"), empty.alias("out")), placed, lambda acc: acc["out"])
    made = F.flatten(F.transform(starts, lambda r: F.aggregate(r["run"], F.struct(r["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))
    return F.when(text.rlike(pattern), made).otherwise(none)


def _value(match: Column) -> Column:
    """Group 2 of an assignment."""
    return F.regexp_extract(match, "^" + ASSIGN + "$", 1)


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a hash of the text, certain and weak spans.

    Hexadecimal and access runs are matched with their least length, which finds the same runs: a match that
    is too short can't hold a longer one.  An assignment that is too short does consume its text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("t"), F.xxhash64(text).alias("text_hash"))
    rows = rows.select(
        "doc_id", "text_hash", _spans(F.col("t"), ASSIGN, "assign").alias("assigned"),
        _spans(F.col("t"), f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "access").alias("access"), _spans(F.col("t"), f"[0-9a-f]{{{LEAST['hex']},}}", "hex").alias("hex"),
        F.concat(*(_spans(F.col("t"), p, k) for k, p in (("user", USER), ("blob", BLOB), ("endpoint", ENDPOINT)))).alias("other"),
    )
    long_enough = lambda s: F.length(_value(s["match"])) >= LEAST["assign"]
    short = F.transform(F.filter("assigned", lambda s: ~long_enough(s)), lambda s: F.struct(F.lit(KINDS.index("assign_short")).alias("kind"), s["start"], s["end"], s["match"]))
    return rows.select(
        "doc_id", "text_hash", F.concat(F.filter("assigned", long_enough), "access", "hex").alias("certain"), F.concat(short, "other").alias("weak")
    )


def _confirmed(parts: DataFrame) -> DataFrame:
    """Weak parts with a complementary part near: doc_id, text_hash, kind, start, end.

    ``parts``: doc_id, text_hash, kind, start, end, role, weak.
    """
    key = ["doc_id", "text_hash"]
    stretch = lambda at: F.floor(at / SCOPE).alias("stretch")
    known = parts.groupBy(*key, "role", stretch(F.col("start"))).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    needs = F.create_map(*(x for r, c in COMPLEMENTS.items() for x in (F.lit(r), F.array(*map(F.lit, c)))))
    wanted = parts.where("weak").select(*key, "kind", "start", "end", (F.col("end") + SCOPE).alias("to"), F.explode(needs[F.col("role")]).alias("role")).distinct()
    # A part that starts in the stretch of ``to`` or behind it can't end too early.
    by = Window.partitionBy(*key, "role").orderBy("stretch")
    before = F.max("last").over(by.rangeBetween(Window.unboundedPreceding, -1)) >= F.col("start") - SCOPE
    beside = F.min("first").over(by.rangeBetween(0, 0)) <= F.col("to")
    both = known.unionByName(wanted.withColumn("stretch", stretch(F.col("to"))), allowMissingColumns=True)
    met = both.withColumns({"before": before, "beside": beside}).where("kind is not null and (before or beside)")
    return met.select(*key, "kind", "start", "end").distinct()


def _text(spans: Column, kinds: int | None = None) -> Column:
    """kind:start:end, by start and then kind as listed, joined by commas."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"] < kinds)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("b"), s["end"].alias("c"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["b"] + 1), s["a"], s["c"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, certain (spans), linked (confirmed weak spans)."""
    base = written(candidates(docs), "secrets")
    live = base.where(F.size("weak") > 0)

    def tagged_as(column: str) -> Column:
        weak = F.lit(column == "weak").alias("weak")
        return F.transform(column, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), weak))

    tagged = live.select("doc_id", "text_hash", F.explode(F.concat(tagged_as("certain"), tagged_as("weak"))).alias("p")).select("doc_id", "text_hash", "p.*")
    roles = F.array(*(F.lit(ROLES[k]) for k in KINDS))
    found = _confirmed(tagged.withColumn("role", F.element_at(roles, F.col("kind") + 1)))
    spans = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    spans = spans.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    joined = base.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return joined.select("doc_id", plain(F.col("certain")).alias("certain"), F.coalesce("linked", none).alias("linked"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the certain kinds, digest of their spans, and all spans as text."""
    found = scan(docs)
    count = lambda kind: F.size(F.filter("certain", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias("n_" + kind)
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_text(F.col("certain")), 256).alias("base_sha256"),
        _text(F.concat("certain", "linked")).alias("spans"),
    )
