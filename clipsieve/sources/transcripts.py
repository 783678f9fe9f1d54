"""Transcripts: finding the file, cue blocks, keyword hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipsieve.functions import scalars as S, vocab as V
from clipsieve.operators import intervals as I
from clipsieve.operators.keywords import find_keywords
from clipsieve.sources.logs import LINES_PER_CHUNK, split_lines

MOST_LITERALS = 100

# Fixed value: a clock time of a cue.
_CLOCK = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path, content``."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def find_transcript(assets: DataFrame, files: DataFrame, transcript_dir: str | None = None) -> DataFrame:
    """Per asset the transcript with its stem: the transcript folder first, then beside it; srt, vtt, txt."""
    folder = lambda p: F.regexp_replace(F.col(p), "/[^/]*$", "")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    kinds = F.array_position(S.string_array(V.TRANSCRIPT_EXTENSIONS), ext)
    found = files.select("path", S.file_stem("path").alias("_stem"), folder("path").alias("_dir"), kinds.alias("_kind")).where(F.col("_kind") > 0)
    own = assets.select(F.col("filepath").alias("source"), S.file_stem("filepath").alias("_stem"), folder("filepath").alias("_home"))
    places = [F.col("_home")] if transcript_dir is None else [F.lit(transcript_dir.rstrip("/")), F.col("_home")]
    spots = own.select("source", "_stem", F.posexplode(F.array(*places)).alias("_place", "_dir"))
    best = spots.join(found, ["_stem", "_dir"]).groupBy("source").agg(F.min_by("path", F.struct("_place", "_kind")).alias("transcript"))
    return best


def parse_cues(files: DataFrame) -> DataFrame:
    """SRT and VTT cues of texts that are rows (``source, content``), tags stripped, one row per cue."""
    return parse_cue_lines(split_lines(files, "content"))


def parse_cue_lines(lines: DataFrame, width: float = LINES_PER_CHUNK) -> DataFrame:
    """Cues of numbered lines (``source, line_no, line``): source, cue_index, start, end, text.

    A line with two clock times opens a cue, unless it is inside one.  A cue goes on to a blank line, but the line right after
    its clock times doesn't end it.  Whether a line is inside a cue is state that runs through the whole file.  Between two
    blank lines at most one cue opens, and it outlives the second of them only if it opened right before; so of each such
    block two facts are enough, and runs of them tell who is inside by their parity.  All of it works in chunks of
    ``width`` lines, so the file may be of any size; a cue's own lines make one row.
    """
    heads = F.regexp_extract("line", rf"{_CLOCK}\s*-->\s*{_CLOCK}", 0) != ""
    marked = lines.select("source", "line_no", "line", heads.alias("_head"), F.col("line").rlike(r"^\s*\z").alias("_blank"))
    blank_at = F.when(F.col("_blank"), F.col("line_no"))
    rows = I.running_max(marked, ["source"], F.col("line_no"), [F.col("line_no")], blank_at, "_after", width=width)
    rows = rows.withColumn("_after", F.coalesce("_after", F.lit(-1)))
    # A block's lines come after the blank line ``_after``; the blank line that ends it is its own last line.
    blocks = rows.groupBy("source", "_after").agg(
        F.min(F.when(F.col("_head"), F.col("line_no"))).alias("_opens"), F.max(F.when(~F.col("_blank"), F.col("line_no"))).alias("_last"),
        F.bool_or("_blank").alias("_ended"),
    )
    blocks = blocks.withColumn("_late", F.coalesce((F.col("_opens") == F.col("_last")) & F.col("_ended"), F.lit(False)))
    counted = I.running_total(blocks, ["source"], "_after", F.col("_late"), "_n", width)
    settled = F.when(~F.col("_late"), F.col("_n"))
    known = I.running_max(counted, ["source"], F.col("_after"), [F.col("_after")], settled, "_base", width=width)
    state = known.select("source", "_after", "_opens", ((F.col("_n") - F.coalesce("_base", F.lit(0))) % 2 == 1).alias("_inside"))
    # A block that begins inside a cue belongs to the one of the block before, which is the latest opened.
    opened = F.when(~F.col("_inside"), F.col("_opens"))
    state = I.running_max(state, ["source"], F.col("_after"), [F.col("_after")], opened, "_earlier", width=width)
    placed = rows.join(state, ["source", "_after"])
    cue = F.when(F.col("_inside"), F.col("_earlier")).otherwise(F.col("_opens"))
    own = placed.withColumn("_cue", cue).where(F.col("line_no") >= F.col("_cue"))
    # The blank line that ends a cue is not its text; one right after the clock times is.
    own = own.where(~F.col("_blank") | (F.col("line_no") == F.col("_cue") + 1))
    body = F.array_sort(F.collect_list(F.when(F.col("line_no") > F.col("_cue"), F.struct("line_no", "line"))))
    cues = own.groupBy("source", F.col("_cue").alias("line_no")).agg(
        F.max(F.when(F.col("line_no") == F.col("_cue"), F.col("line"))).alias("_clocks"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("_body"),
    )
    ends = lines.groupBy("source").agg(F.max("line_no").alias("_end"))
    cues = cues.join(ends, "source").where(F.col("line_no") < F.col("_end"))
    clock = lambda k: S.seconds_of(F.replace(F.regexp_extract("_clocks", rf"{_CLOCK}\s*-->\s*{_CLOCK}", k), F.lit(","), F.lit(".")))
    return I.running_total(cues, ["source"], "line_no", F.lit(1), "cue_index", width).select(
        "source", F.col("cue_index").cast("int").alias("cue_index"), clock(1).alias("start"), clock(2).alias("end"),
        F.trim(F.replace(F.regexp_replace("_body", "<[^>]+>", ""), F.lit("\n"), F.lit(" "))).alias("text"),
    )


def transcript_hits(cues: DataFrame, keywords) -> DataFrame:
    """Cues that contain a keyword anywhere, with the keywords in configured order: a list, or a table of ``place, keyword``."""
    return _with_keywords(cues, keywords).where(F.size("keywords") > 0)


def _with_keywords(rows: DataFrame, keywords) -> DataFrame:
    """A short list is part of the plan, a longer one and a table are not."""
    if isinstance(keywords, DataFrame) or len(keywords) > MOST_LITERALS:
        return find_keywords(rows, "text", keywords)
    return rows.withColumn("keywords", S.substring_keywords("text", keywords))


def text_transcript_hits(docs: DataFrame, keywords, durations: DataFrame | None = None, shown: int | None = None) -> DataFrame:
    """Plain text: the whole text is searched; one hit at the opening seconds, with the text or its first ``shown`` characters."""
    text = F.col("text") if shown is None else F.substring("text", 1, shown)
    rows = docs if durations is None else docs.join(durations, "source")
    return _with_keywords(rows, keywords).where(F.size("keywords") > 0).select(
        "source", F.lit(0.0).alias("start"), F.least("duration", F.lit(20.0)).alias("end"), text.alias("text"), "keywords"
    )

