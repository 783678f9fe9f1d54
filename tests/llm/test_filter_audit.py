from collections import Counter
from itertools import permutations
import math

from pyspark.sql import functions as F

from clipsieve.llm import filter_audit as A

from cases import WORD, clashing, documents, got, rows, sentence
import random


def fails(text):
    text = text or ""
    words = WORD.findall(text)
    out = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
    out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
    return set(out + "D" * any(c in "#$%&*|" for c in text))


def brute(data, marks):
    good = {i for i, q, t in marks if i is not None and q == 1}
    toxic = {i for i, q, t in marks if i is not None and t == 1}
    docs = []
    for i, text, lang, *_ in data:
        bad = fails(text)
        if i is not None and any(o is not None and o < i and (t or "") == (text or "") for o, t, *_ in data):
            bad.add("E")
        docs.append((lang or "", bad, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        sums, got_rows = Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                sums[f] += len(gone)
                got_rows.append((part, "".join(order), step, len(kept), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
                left = kept
        out += [(*r[:-1], sums[r[-1]]) for r in got_rows]
    return sorted(out, key=repr)


def test_equals_filtering(spark):
    rng = random.Random(5)
    data = [(i, t, rng.choice(["en", "de", None, ""]), s, n) for i, t, _, s, n in rows()]
    for k in range(60):
        words = [rng.choice(["Aa", "BB", "c", "d%", "é"]) + str(rng.randrange(400)) for _ in range(rng.randrange(80, 200))]
        data += [(200 + k, " ".join(words), rng.choice(["en", "de"]), "a", 1)] * (1 + k % 2)
        data.append((rng.choice([100 + k, 300 + k, None]), " ".join(words), "de", "a", 1))
    marks = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 330, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    want = brute(data, marks)
    columns = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    for docs in (documents(spark, data), clashing(documents(spark, data)).withColumns({c: F.lit("clash") for c in ("part", "pattern", "n", "good", "toxic", "own", "first", "digest")})):
        found = A.audit(docs, labels)
        assert found.columns == columns and got(found) == want
    assert A.audit(documents(spark, []), labels).count() == 0


def test_a_hot_text(spark):
    data = [(k, "same text", "en", "a", 1) for k in range(3000)] + [(5, "other", "en", "a", 1)]
    found = A.audit(documents(spark, data), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    r = found.where("filter_order = 'EABCD' and step = 1").first()
    assert (r["removed"], r["kept"]) == (2999, 2)


def test_path_counts():
    forward, backward = A.path_counts()
    for s in range(32):
        size = bin(s).count("1")
        assert (forward[s], backward[s]) == (math.factorial(size), math.factorial(5 - size))
    assert len(A.edges()) == 80 and len(A.steps()) == 600
    through = Counter((s, f) for _, _, s, f in A.steps())
    assert all(through[s, f] == n for s, f, n in A.edges())
