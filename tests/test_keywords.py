"""Dictionaries of any size against a loop over their keywords."""

import random
import re

from pyspark.sql import functions as F

from clipsieve.operators import keywords as K
from clipsieve.sources import transcripts as X

TEXTS = [None, "", "a", "The pass, THE win", "x-ray pass2 2pass pass", "ab abc abcd", "été ÉTÉ", r"a\Eb (x) [y]", "line\nend win\n", "win"]
WORDS = ["pass", "Win", "", "ab", "abc", "bcd", "été", r"\eb", "(x)", "y]", "pass", "zebra", "e", "line", "a"]


def loop(text, words, whole):
    low = (text or "").lower()
    out = []
    for w in (w.lower() for w in words):
        pattern = rf"(?:^|(?<=[^A-Za-z0-9])){re.escape(w)}(?:\Z|(?=[^A-Za-z0-9]))"
        if text is not None and (w == "" or (re.search(pattern, low) if whole else w in low)):
            out.append(w)
    return out


def test_shipped_and_joined_equal_the_loop(spark):
    rng = random.Random(3)
    words = [w for w in WORDS] + ["".join(rng.choices("abc ", k=rng.randrange(1, 6))) for _ in range(60)]
    texts = TEXTS + ["".join(rng.choices("abc d-", k=rng.randrange(1, 80))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)
    for whole in (False, True):
        want = {k: loop(t, words, whole) for k, t in enumerate(texts)}
        for most in (None, 0):
            found = K.find_keywords(rows, "text", words, whole, most=most)
            assert found.columns == ["n", "text", "keywords"]
            assert {r.n: r.keywords for r in found.collect()} == want, (whole, most)


def test_plan_does_not_grow_with_the_dictionary(spark):
    rows = spark.createDataFrame([("s", 0, 0.0, 1.0, "word7 and word99999x")], "source string, cue_index int, start double, end double, text string")
    plans = []
    for n in (200, 100_000):
        hits = X.transcript_hits(rows, [f"word{k}" for k in range(n)])
        plans.append(len(hits._jdf.queryExecution().executedPlan().toString()))
        assert set(hits.first().keywords) == {f"word{k}" for k in (7, 9, 99, 999, 9999, 99999) if k < n}
    assert abs(plans[0] - plans[1]) < 50
    assert K.find_keywords(rows, "text", []).first().keywords == []


def test_whole_words_compare_no_pattern_with_each_text(spark):
    """Patterns of a keyword run only where it occurs; plain words meet equal words."""
    rows = spark.createDataFrame([(k, f"word{k} b-roll{k} the") for k in range(50)], "n int, text string")
    kept = K.cut_lineage(rows.withColumn("_low", F.lower("text")))
    words = K.numbered(["the", "word7", "roll7"], spark)
    found = K.find_keywords(rows, "text", ["the", "word7", "b-roll7", "roll", "ord7"], whole_words=True, most=0)
    assert {r.n: r.keywords for r in found.collect()} == {k: ["the"] + (["word7", "b-roll7"] if k == 7 else []) for k in range(50)}
    plan = K._joined(kept, words, True, "out")._jdf.queryExecution().optimizedPlan().toString()
    assert r"(^|[^A-Za-z0-9])\Q" not in plan
