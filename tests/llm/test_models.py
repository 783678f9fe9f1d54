import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clipsieve.llm import line_labelling, mixing, toxicity

from cases import WORD, clashing, documents, got, lower, rows, sentence


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def quality_brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def junk(rng):
    return "\n".join(" ".join(f"W{rng.randrange(400)}X!!".upper() for _ in range(15)) for _ in range(4))


def sample(seed=3):
    rng = random.Random(seed)
    data = list(rows())
    for k in range(60):
        text = junk(rng) if k % 2 else "\n".join(sentence(rng, 15) + "." for _ in range(4))
        data.append((2000 + k, text, "en", "a", 1))
    twice = sentence(rng, 15)
    data.append((3000, f"{twice}\n{twice}\n{sentence(rng, 60)}\n \n ", "en", "a", 1))
    return data


def test_line_labelling(spark):
    data = sample()
    marks = labels(spark, [(2000 + k, 1 - k % 2, 0) for k in range(40)] + [(2000, 1, 0), (1, None, None), (None, 1, 1)])
    field = line_labelling.train(documents(spark, data), marks)
    for docs in (documents(spark, data), clashing(documents(spark, data))):
        found = line_labelling.judge(docs, field).collect()
        assert sorted((tuple(r)[:7] for r in found), key=repr) == sorted(((r[0], *quality_brute(r[1])) for r in data), key=repr)
        kept = {r["doc_id"]: r["kept"] for r in found}
        assert all(kept[2000 + k] is (k % 2 == 0) for k in range(40, 60))  # not in the labelled rows
        assert not any(r["kept"] and r["base_failed"] for r in found)
    assert line_labelling.train(documents(spark, data), labels(spark, [])) is None
    assert all(r["kept"] is not r["base_failed"] for r in line_labelling.judge(documents(spark), None).collect())
    assert line_labelling.judge(documents(spark, []), None).count() == 0


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    per_text = np.array([1, 4, 2, 6])
    x = rng.normal(size=(13, 3))
    field = line_labelling.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    found, at = field.viterbi(x, per_text), 0
    for n in per_text:
        def total(path):
            return sum(x[at + t] @ field.emission * path[t] for t in range(n)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))
        assert tuple(found[at : at + n]) == max(itertools.product((0, 1), repeat=int(n)), key=total)
        at += n


def test_mixed_text_is_labelled_by_line(spark):
    data = sample()
    field = line_labelling.train(documents(spark, data), labels(spark, [(2000 + k, 1 - k % 2, 0) for k in range(60)]))
    rng = random.Random(9)
    text = "\n".join(["\n".join(sentence(rng, 15) + "." for _ in range(5)), junk(rng)])
    x = line_labelling.lines(pa.array([text]))
    assert field.viterbi(x.features, x.per_text).tolist() == [1] * 5 + [0] * 4


def test_bounds_of_the_samples_hold(spark):
    """A row repeated thousands of times and a text of a million lines stay within the documented bounds."""
    rng = random.Random(6)
    data = [(1, "the same row " * 20, "en", "a", 1)] * 5000 + [(2, "\n".join(["a line of words"] * 1_000_000), "en", "a", 1)]
    data += [(10 + k, junk(rng) if k % 2 else sentence(rng, 60) + ".", "en", "a", 1) for k in range(40)]
    docs = documents(spark, data)
    marks = labels(spark, [(1, 1, 0), (2, 0, 1), *((10 + k, 1 - k % 2, k % 2) for k in range(40))])
    from clipsieve.llm.common import sampled_rows

    assert sampled_rows(docs, marks, 10).count() == 10
    assert line_labelling.train(docs, marks, max_sample=30, max_lines=50) is not None
    assert toxicity.train(docs, marks, 30, 30, 100) is not None


def mix_brute(data):
    def place(doc):
        import hashlib

        return int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:12], 16)

    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[3] for r in data}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size(r[1]) for r in data if r[3] == s) for s in sources}
    budget, capped = 1.5 * sum(total.values()), set()
    while True:
        open_ = [s for s in sources if s not in capped]
        left = budget - sum(2.0 * total[s] for s in capped)
        target = {s: 2.0 * total[s] if s in capped else left * weight[s] / sum(weight[o] for o in open_) for s in sources}
        over = {s for s in open_ if target[s] >= 2 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        epochs = int(target[s] // total[s]) if total[s] else 0
        need = target[s] - epochs * total[s]
        by = defaultdict(list)
        for r in data:
            if r[3] == s:
                by[place(r[0])].append(r)
        upto, on = 0, True
        for p in sorted(by):
            upto += sum(size(r[1]) for r in by[p])
            on = on and upto <= need
            out += [(r[0], size(r[1]), total[s], round(target[s], 6), size(r[1]) * (epochs + on)) for r in by[p]]
    return sorted(out, key=repr)


def test_mixing(spark):
    want = mix_brute(rows())
    for docs in (documents(spark), clashing(documents(spark))):
        found = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in found), key=repr) == want
    mixed = mixing.copies(clashing(documents(spark)))
    assert mixed.columns == clashing(documents(spark)).columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect())
    assert words == sum(w[4] for w in want)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(documents(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])).collect()} == {0}


def toxic_sample(seed=8):
    rng = random.Random(seed)
    data, marks = list(rows()), []
    for k in range(900):
        words = sentence(rng, 40).split(" ")
        bad = k % 5 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(40)] = rng.choice(["grobian", "Schuft,", "canaille"])
        data.append((5000 + k, " ".join(words), "en", "a", 1))
        if k % 2 == 0:
            marks.append((5000 + k, 1, int(bad)))
    return data, marks


def test_toxicity_on_held_out_documents(spark):
    data, marks = toxic_sample()
    bad = {5000 + k for k in range(900) if k % 5 == 0}
    held = {r[0] for r in data if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1}
    model = toxicity.train(documents(spark, data), labels(spark, marks))
    # The labels of held-out rows are never read.
    flipped = labels(spark, [(d, q, 1 - t if d in held else t) for d, q, t in marks])
    again = toxicity.train(documents(spark, data).repartition(5), flipped)
    assert (again.keys == model.keys).all() and np.allclose(again.weights, model.weights)
    for docs in (documents(spark, data), clashing(documents(spark, data))):
        found = toxicity.score(docs, model).collect()
        assert {r["doc_id"] for r in found if r["held_out"]} == held
        caught = {r["doc_id"] for r in found if r["predicted"]}
        assert caught <= bad and len(caught) >= 0.8 * len(bad)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    left = toxicity.keep_clean(clashing(documents(spark, data)), model)
    assert not caught & {r["doc_id"] for r in left.collect()} and left.count() == len(data) - len(caught)


def test_toxicity_without_labels(spark):
    model = toxicity.train(documents(spark), labels(spark, []))
    assert {r["score"] for r in toxicity.score(documents(spark), model).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_risk_is_not_explained_away():
    """With a prior of one half, unlabelled texts that look positive don't become negative examples."""
    rng = np.random.default_rng(2)
    mark = lambda p: np.unique(np.concatenate([rng.integers(10, 2000, 20), [1] if rng.random() < p else [2]])).astype(np.uint64)
    model = toxicity.fit([mark(1.0) for _ in range(300)], [mark(0.5) for _ in range(900)], 0.5)
    weight = dict(zip(model.keys.tolist(), model.weights))
    assert weight[1] + model.bias > 1 and model.bias < -1


@pytest.mark.parametrize("size", [1, 5, 400])
def test_words_across_text_bounds(size):
    from clipsieve.llm.shingles import shingle_sets, words

    texts = ["a", "b c", "", None, "a b", "é x y", " a", "a "] * size
    hashes, counts = words(pa.array(texts))
    assert counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    flat = [lower(w) for t in texts for w in WORD.findall(t or "")]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    assert [s.size for s in shingle_sets(pa.array(texts))] == [int(bool(WORD.findall(t or ""))) for t in texts]
