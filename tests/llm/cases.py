"""Small document tables and plain reimplementations to hold the operators against."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("size", "place", "task", "length", "rank", "node", "key", "component", "digest", "bands", "kept", "score", "line", "leaf", "source_size", "target", "features")


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """Prose, exact and near copies, repeated rows, nulls, empty and long texts, odd white space and characters."""
    rng = random.Random(seed)
    out: list[tuple] = []

    def add(text, source="a"):
        out.append((len(out), text, "en", source, None if text is None else len(text)))

    base = sentence(rng, 120)
    for k in range(6):
        words = base.split(" ")
        for j in range(k):
            words[7 * j + 3] = f"new{k}"
        add(" ".join(words), "b")
    for _ in range(5):
        add(base.upper(), None)
    for text in (None, "", " ", "\n\n", "\t x \r\n y z ", "one", "One", "a b c d", "A b c d", "a b c d e", "\x00 \x1c", "é" * 30, "trail \n", "  lead", "<|endoftext|>"):
        add(text, rng.choice(["a", "b", None, "ä"]))
    for n in (1, 4, 5, 6, 30, 200):
        add("\n".join(sentence(rng, max(1, n // 3)) for _ in range(3)), "c")
    add(sentence(rng, 6000, 5000), "a")
    add("spam " * 300, "a")
    add("x" * 5000, "d")
    for _ in range(30):
        add(sentence(rng, rng.randrange(5, 90)), rng.choice(["a", "a", "a", "b", "c"]))
    out += [out[0], out[11], out[40]]  # rows in full again
    out.append((None, base, "en", "a", 1))
    out.append((None, None, None, None, None))
    return out


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def clashing(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


def got(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
