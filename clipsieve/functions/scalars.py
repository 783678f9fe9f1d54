"""Scalar column functions: time codes, slugs, paths, interval arithmetic, rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

ZERO = 0.0


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def to_double(value) -> Column:
    return col(value).try_cast("double")


def round_half_even(value, digits: int = 0) -> Column:
    """Half to even on the scaled number: 17 of 800 is 0.0213, and 25.15 - 40, which prints as -14.850000000000001, is -14.8."""
    scale = F.lit(10.0 ** digits)
    return F.rint(col(value) * scale) / scale


def round_score(value) -> Column:
    """Integer score: halves go to the even neighbour."""
    return F.bround(col(value), 0).cast("int")


def is_finite(value) -> Column:
    c = col(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


# -- time codes ---------------------------------------------------------------------------

def _whole_seconds(seconds) -> Column:
    return F.floor(F.greatest(F.lit(ZERO), F.coalesce(col(seconds).cast("double"), F.lit(ZERO)))).cast("long")


def _clock_parts(whole: Column) -> list[Column]:
    return [
        F.floor(whole / 3600).cast("long"),
        F.floor((whole % 3600) / 60).cast("long"),
        whole % 60,
    ]


def hhmmss(seconds) -> Column:
    """Floored seconds as ``HH:MM:SS``; hours are unbounded, null reads as zero."""
    return F.format_string("%02d:%02d:%02d", *_clock_parts(_whole_seconds(seconds)))


def timecode(seconds, fps) -> Column:
    """``HH:MM:SS:FF``.  The frame field wraps at the rounded rate and never carries."""
    whole = _whole_seconds(seconds)
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    fraction = F.greatest(F.lit(ZERO), F.coalesce(col(seconds).cast("double"), F.lit(ZERO))) - whole
    frames = F.bround(fraction * rate, 0).cast("long")
    modulus = F.greatest(F.lit(1), F.bround(rate, 0).cast("long"))
    return F.format_string("%02d:%02d:%02d:%02d", *_clock_parts(whole), F.pmod(frames, modulus))


def seconds_of(value) -> Column:
    """Seconds from a number, ``H:M:S.f``, or ``H:M:S:F`` (frames ignored); null when malformed."""
    text = F.trim(col(value).cast("string"))
    parts = F.split(text, ":")
    part = lambda i, kind: F.get(parts, F.lit(i)).try_cast(kind)
    head = part(0, "long") * 3600 + part(1, "long") * 60
    return (
        F.when(F.size(parts) == 3, head + part(2, "double"))
        .when(F.size(parts) == 4, (head + part(2, "long")).cast("double"))
        .otherwise(text.try_cast("double"))
    )


def clip_seconds(formatted, seconds) -> Column:
    """The numeric column when present, else the parsed display column, else zero."""
    return F.coalesce(to_double(seconds), seconds_of(formatted), F.lit(ZERO))


# -- intervals ----------------------------------------------------------------------------

def clamp_start(start, duration) -> Column:
    limit = F.greatest(F.lit(ZERO), F.coalesce(col(duration), F.lit(ZERO)))
    return F.greatest(F.lit(ZERO), F.least(col(start), limit))


def clamp_end(start, end, duration) -> Column:
    limit = F.greatest(F.lit(ZERO), F.coalesce(col(duration), F.lit(ZERO)))
    return F.greatest(clamp_start(start, duration), F.least(col(end), limit))


def interval_duration(start, end) -> Column:
    return F.greatest(F.lit(ZERO), col(end) - col(start))


def overlap_seconds(start_a, end_a, start_b, end_b) -> Column:
    return F.greatest(F.lit(ZERO), F.least(col(end_a), col(end_b)) - F.greatest(col(start_a), col(start_b)))


def strictly_overlaps(start_a, end_a, start_b, end_b) -> Column:
    """Positive shared length: a zero-length interval never overlaps anything."""
    return F.least(col(end_a), col(end_b)) > F.greatest(col(start_a), col(start_b))


def time_gap(start_a, end_a, start_b, end_b) -> Column:
    """Distance between two intervals, 0 when they share time."""
    return (
        F.when(overlap_seconds(start_a, end_a, start_b, end_b) > 0, F.lit(ZERO))
        .when(col(end_a) <= col(start_b), col(start_b) - col(end_a))
        .otherwise(col(start_a) - col(end_b))
    )


def point_gap(time, start, end) -> Column:
    inside = (col(start) <= col(time)) & (col(time) <= col(end))
    return F.when(inside, F.lit(ZERO)).otherwise(
        F.least(F.abs(col(time) - col(start)), F.abs(col(time) - col(end)))
    )


def safe_ratio(numerator, denominator) -> Column:
    top, bottom = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(bottom == 0, F.lit(ZERO)).otherwise(F.try_divide(top, bottom))


# -- text ---------------------------------------------------------------------------------

def _or_default(text: Column, default: str) -> Column:
    return F.when(F.length(text) > 0, text).otherwise(F.lit(default))


def _unless_plain(text: Column, cleaned: Column) -> Column:
    """``cleaned``, but names that cleaning leaves as they are skip it: it is dear inside array functions."""
    return F.when(F.rlike(text, F.lit(r"^[a-z0-9](?:[a-z0-9_]*[a-z0-9])?\z")), text).otherwise(cleaned)


def slug(value) -> Column:
    """Label slug: every character that is no letter or digit becomes ``_``."""
    cleaned = F.regexp_replace(F.lower(col(value)), r"[^\p{L}\p{N}]", "_")
    return _unless_plain(col(value), _or_default(F.btrim(cleaned, F.lit("_")), "object"))


def feature_name(value) -> Column:
    text = col(value).cast("string")
    cleaned = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9_]+", "_")
    return _unless_plain(text, _or_default(F.btrim(cleaned, F.lit("_")), "value"))


def file_slug(value, default: str = "item") -> Column:
    cleaned = F.regexp_replace(col(value).cast("string"), "[^A-Za-z0-9_.-]+", "_")
    return _or_default(F.btrim(cleaned, F.lit("_")), default)


def normalize_key(value) -> Column:
    return F.replace(F.lower(F.trim(col(value).cast("string"))), F.lit("-"), F.lit("_"))


def path_key(value) -> Column:
    """Normalised path: forward slashes, no empty or ``.`` parts, ``..`` folded."""
    text = F.replace(col(value), F.lit("\\"), F.lit("/"))
    absolute = F.startswith(text, F.lit("/"))
    parts = F.filter(F.split(text, "/"), lambda p: ~p.isin("", "."))

    def fold(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return (
            F.when((part == "..") & (F.size(done) > 0) & (last != ".."), F.slice(done, 1, F.size(done) - 1))
            .when((part == "..") & absolute & (F.size(done) == 0), done)
            .otherwise(F.concat(done, F.array(part)))
        )

    # Only paths that climb pay for the fold.
    climbed = F.aggregate(parts, F.array().cast("array<string>"), fold)
    joined = F.array_join(F.when(F.array_contains(parts, ".."), climbed).otherwise(parts), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(_or_default(joined, "."))


def basename(path) -> Column:
    return F.substring_index(path_key(path), "/", -1)


def file_stem(path) -> Column:
    name = F.substring_index(col(path), "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def source_id(path) -> Column:
    return F.substring(F.sha1(col(path)), 1, 16)


_REGEX_SPECIAL = set("\\.^$|?*+()[]{}")


def quote_regex(text: str) -> str:
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in text)


def word_boundary_match(text, keyword: str) -> Column:
    """The keyword stands free of ASCII letters and digits on both sides."""
    word = keyword.lower()
    pattern = f"(^|[^A-Za-z0-9]){quote_regex(word)}($|[^A-Za-z0-9])"
    return F.contains(col(text), F.lit(word)) & F.rlike(col(text), F.lit(pattern))


def string_array(values) -> Column:
    """A literal ``array<string>``; an empty one keeps its type."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def matched_keywords(text, keywords) -> Column:
    """Keywords found on word boundaries, in the given order.  ``text`` must be lower-cased."""
    return F.array_compact(F.array(*[F.when(word_boundary_match(text, k), F.lit(k)) for k in keywords]))


def substring_keywords(text, keywords) -> Column:
    """Lower-cased keywords found anywhere in the text, in the given order."""
    lowered = F.lower(col(text))
    words = string_array(k.lower() for k in keywords)
    return F.filter(words, lambda word: F.contains(lowered, word))


def any_substring(text, keywords) -> Column:
    tests = [F.contains(col(text), F.lit(k.lower())) for k in keywords]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def candidate_search_text(with_signals: bool = True) -> Column:
    """Lower-cased id, labels, reasons and (key names included) the JSON text of the signals."""
    parts = [F.coalesce(F.col("id"), F.lit("")), joined("labels", " "), joined("reasons", " ")]
    if with_signals:
        parts.append(F.coalesce(F.to_json("signals"), F.lit("{}")))
    return F.lower(F.concat_ws(" ", *parts))


def joined(array, separator: str) -> Column:
    return F.coalesce(F.array_join(col(array), separator), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- arrays, maps, numbers ----------------------------------------------------------------

def empty_strings() -> Column:
    return F.array().cast("array<string>")


def label_array(array) -> Column:
    return F.coalesce(col(array), empty_strings())


def sorted_union(*arrays) -> Column:
    merged = reduce(lambda a, b: F.array_union(a, b), [label_array(a) for a in arrays])
    return F.array_sort(F.array_compact(merged))


def flatten_set(array_of_arrays) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(array_of_arrays)))


def numeric_map(pairs: list[tuple[str, Column]]) -> Column:
    names = F.array(*[F.lit(name) for name, _ in pairs])
    return F.map_from_arrays(names, F.array(*[value.cast("double") for _, value in pairs]))


def sigmoid(value) -> Column:
    v = col(value)
    squashed = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), v))))
    return F.when(v >= 50, F.lit(1.0)).when(v <= -50, F.lit(ZERO)).otherwise(squashed)
