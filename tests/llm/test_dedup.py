import hashlib
import re
from collections import defaultdict

import pytest

from clipsieve.llm import exact_dedup, line_templates, near_dedup
from clipsieve.llm.components import components

from cases import WORD, clashing, documents, got, lower, rows, sentence
import random


def sets_of(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_brute(data):
    """Smallest doc_id reachable, by node; rows that repeat a doc_id are one node."""
    sets = [(r[0], sets_of(r[1])) for r in data]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    names = {s: root(d) for d, s in sets if d is not None and s}
    out = []
    for d, s in sets:
        c = (root(d) if s else d) if d is not None else names.get(s)
        out.append((d, len(s), c, d == c))
    return sorted(out, key=repr)


def group(rng, n, changes, words=150):
    base = sentence(rng, words, 5000).split(" ")
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(words), rng.randrange(changes)):
            own[k] = f"n{rng.randrange(10**6)}"
        yield " ".join(own)


def test_near_duplicates_equal_brute_force(spark):
    docs = documents(spark)
    assert got(near_dedup.near_duplicates(docs)) == near_brute(rows())
    assert got(near_dedup.near_duplicates(clashing(docs))) == near_brute(rows())
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_large_near_group_over_several_blocks(spark):
    rng = random.Random(5)
    texts = [t for n, c in ((60, 8), (25, 3), (12, 14)) for t in group(rng, n, c)] + [sentence(rng, 80, 5000) for _ in range(40)]
    rng.shuffle(texts)
    data = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    docs = documents(spark, data)
    want = near_brute(data)
    assert got(near_dedup.near_duplicates(docs)) == want
    assert got(near_dedup.near_duplicates(docs, block=7)) == want


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        s = near_dedup.sketch(a, 210)
        assert (s != np.iinfo(np.uint64).max).all() and (s == near_dedup.sketch(a[::-1].copy(), 210)).all()
    errors = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 800).astype(np.uint64)
        b = np.concatenate([a[:640], rng.integers(0, 2**63, 160).astype(np.uint64)])
        errors.append((near_dedup.sketch(a, 210) == near_dedup.sketch(b, 210)).mean() - 640 / 960)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def kept_brute(data):
    """Of each group of rows, linked by their texts alone, those with the smallest (doc_id, hash)."""
    sets = [sets_of(r[1]) for r in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(data):
        groups[root(i)].append(r)
    return groups


def test_kept_rows_of_near_groups(spark):
    data = rows() + [(900, None, "en", "a", 1), (None, "lonely words of a row without any number", "en", "a", 1)]
    left = near_dedup.kept_rows(clashing(documents(spark, data)))
    assert left.columns == clashing(documents(spark, data)).columns
    found = [(r["doc_id"], r["text"]) for r in left.collect()]
    for members in kept_brute(data).values():
        stays = [m for m in members if (m[0], m[1]) in found]
        least = min(members, key=lambda m: (m[0] is None, m[0] or 0))
        assert {m[0] for m in stays} == {least[0]} and len({m[1] for m in stays}) == 1
    assert len(found) == sum(len([m for m in g if (m[0], m[1]) in found]) for g in kept_brute(data).values())


def test_one_number_for_several_texts(spark):
    """An id that stands for several texts links their groups; none of its texts is lost by the others."""
    rng = random.Random(2)
    a, c, d, e = (sentence(rng, 60, 5000) for _ in range(4))
    data = [(3, c, "en", "a", 1), (5, a, "en", "a", 1), (5, c, "en", "a", 1), (8, d, "en", "a", 1), (8, e, "en", "a", 1), (9, d, "en", "a", 1), (2, e + " x", "en", "a", 1), (None, a, "en", "a", 1), (None, a + " y", "en", "a", 1), (5, "", "en", "a", 1)]
    docs = documents(spark, data)
    assert got(near_dedup.near_duplicates(docs.where("doc_id is not null"))) == near_brute([r for r in data if r[0] is not None])
    left = sorted((r["doc_id"], r["text"]) for r in near_dedup.kept_rows(docs).collect())
    assert left == sorted([(3, c), (5, a), (8, d), (2, e + " x"), (5, "")])


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = dict(got(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def exact_brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[lower(r[1] or "")].append(r[0])
    out = []
    for r in data:
        own = groups[lower(r[1] or "")]
        keep = max((d for d in own if d is not None), default=None)
        out.append((r[0], keep, len(own), r[0] == keep, hashlib.sha256(lower(r[1] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_duplicates(spark):
    for docs in (documents(spark), clashing(documents(spark))):
        assert got(exact_dedup.exact_duplicates(docs)) == exact_brute(rows())
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0
    left = exact_dedup.kept_rows(documents(spark)).collect()
    assert sorted(map(repr, {(r["doc_id"], r["text"]) for r in left})) == sorted(map(repr, {(r[0], r[1]) for r, v in zip(rows(), [x for x in rows()]) if (r[0], True) in {(e[0], e[3]) for e in exact_brute([*rows()]) if e[4] == hashlib.sha256(lower(r[1] or "").encode()).hexdigest()}}))
    assert len(left) == len({(r["doc_id"], r["text"]) for r in left})


def test_index_persists_and_names_earlier_documents(spark, tmp_path):
    index = exact_dedup.open_index(spark, f"{tmp_path}/index", 3)
    first = documents(spark, [(1, "One", None, None, 3), (2, "two", None, None, 3)])
    exact_dedup.deduplicate(first, index).count()
    second = documents(spark, [(7, "ONE", None, None, 3), (8, "three", None, None, 3), (9, "Three", None, None, 3)])
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(second, index).collect()}
    assert found == {7: (1, False), 8: (9, False), 9: (9, True)}
    spark.sql(f"DROP TABLE {index}")  # the files stay
    again = exact_dedup.open_index(spark, f"{tmp_path}/index", 3)
    assert spark.table(again).count() == 3
    new = exact_dedup.digests(documents(spark)).groupBy("text_sha256").count().repartition(3, "text_sha256")
    plan = new.join(spark.table(again).hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Bucketed: true" in physical and "SortMergeJoin" in physical and physical.count("Exchange hashpartitioning(text_sha256") <= 2


def templates_brute(data):
    """Line numbers to drop by (doc_id, text), from the definition."""

    entries = []
    for doc, text in {(r[0], r[1]) for r in data if r[1] is not None}:
        for n, line in enumerate(text.split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\n\x0b\f\r]+", line.strip(" \t\n\x0b\f\r"))]
            if len(tokens) >= 6:
                entries.append(((doc, text), n, (len(tokens), *tokens[:3]), tokens))
    seen = defaultdict(set)
    for doc, _, leaf, tokens in entries:
        for at, t in enumerate(tokens):
            seen[leaf, at, t].add(doc)
    templates = defaultdict(set)
    named = []
    for doc, n, leaf, tokens in entries:
        out = [t if len(seen[leaf, at, t]) > 1 else "<*>" for at, t in enumerate(tokens)]
        if sum(t != "<*>" for t in out) >= 0.75 * len(out):
            templates[" ".join(out)].add(doc)
            named.append((doc, n, " ".join(out)))
    drop = defaultdict(set)
    for doc, n, template in named:
        if len(templates[template]) >= 3:
            drop[doc].add(n)
    return drop


def test_line_templates(spark):
    rng = random.Random(2)
    data = list(rows())
    for k in range(8):
        log = f"worker {k} on host-{k * 7} has finished the job called {['red', 'blue'][k % 2]} after a while"
        note = "please read all the terms before you go on"
        text = "\n".join([sentence(rng, 12), log, note if k < 4 else sentence(rng, 9), "the end", "the end"])
        data.append((1000 + k, text.replace("x", "y") if k % 2 else text, "en", "a", 1))
    drop, older = templates_brute(data), {"min_tokens": 6, "min_constant": 0.75}
    assert any(drop.values())
    for docs in (documents(spark, data), clashing(documents(spark, data))):
        found = line_templates.report(docs, **older).collect()
        want = sorted(((r[0], 0 if r[1] is None else len(r[1].split("\n")), len(drop[r[0], r[1]]), sorted(drop[r[0], r[1]])) for r in data), key=repr)
        assert sorted((tuple(r) for r in found), key=repr) == want
    cleaned = {(r["doc_id"], r["text"]) for r in line_templates.clean(documents(spark, data), **older).collect()}
    assert cleaned == {(r[0], None if r[1] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in drop[r[0], r[1]])) for r in data}
    assert line_templates.report(documents(spark, [])).count() == 0


def dropped_lines(spark, texts, **options):
    data = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    return {r["doc_id"]: r["dropped"] for r in line_templates.report(documents(spark, data), **options).collect()}


def median_brute(data):
    """The rule of the query, line by line: a word is constant if it is as common at its place as the upper median of its line's words."""
    where = defaultdict(list)
    for doc, text in {(r[0], r[1]) for r in data if r[1] is not None}:
        for n, line in enumerate(re.sub(r"[ \t\x0b\f\r]+", " ", text).split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in line.strip(" ").split(" "))
            if any(c.isalpha() for c in "".join(tokens)):
                where[tokens].append(((doc, text), n))
    leaf = lambda t: (len(t), t[:3])
    in_leaf, common = defaultdict(set), defaultdict(int)
    for tokens, places in where.items():
        in_leaf[leaf(tokens)] |= {d for d, _ in places}
        for at, t in enumerate(tokens[3:], 3):
            common[leaf(tokens), at, t] += 1
    templates = defaultdict(list)
    for tokens, places in where.items():
        several = len({d for d, _ in places}) > 1
        counts = [0 if t == "<*>" else 1 if at < 3 else common[leaf(tokens), at, t] for at, t in enumerate(tokens)]
        if len(in_leaf[leaf(tokens)]) < 2 or not (several or max(counts[3:], default=0) > 1):
            continue
        need = max(1, min(len(tokens) // 2, 3))
        words = sorted((c for c in counts[3:] if c), reverse=True)
        median = words[(len(words) - 1) // 2] if words else 0
        made = tuple(t if at < 3 or counts[at] >= median else "<*>" for at, t in enumerate(tokens))
        if words and words[-1] < median and len(made) - made.count("<*>") >= need:
            templates[made] += places
        elif several and sum(map(bool, counts)) >= need:
            templates[tokens] += places
    drop = defaultdict(set)
    for places in templates.values():
        if len({d for d, _ in places}) >= 3:
            for doc, n in places:
                drop[doc].add(n)
    return drop


def test_the_rule_of_the_query_equals_a_loop(spark):
    rng = random.Random(12)
    data = list(rows())
    shapes = ["job {a} of user {b} ended with state {c} after {n} ms", "get {a} from {b}", "{a} {n}", "the {a} of {b} is {c} and {a} too", "Page {n}", "all rights are reserved"]
    for k in range(40):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            word = lambda: rng.choice(["red", "green", "blue", "été", rng.choice("abcdefghijk") * 3])
            lines.append(rng.choice(shapes).format(a=word(), b=word(), c=word(), n=rng.randrange(900)))
        data.append((2000 + k, rng.choice(["\n", " \t\n"]).join(lines), "en", "a", 1))
    drop = median_brute(data)
    assert sum(map(len, drop.values())) > 40
    want = sorted(((r[0], sorted(drop[r[0], r[1]])) for r in data), key=repr)
    assert sorted(((r["doc_id"], r["dropped"]) for r in line_templates.report(documents(spark, data)).collect()), key=repr) == want


def test_fields_whose_values_come_back(spark):
    names, cities = ([f"{c}{a}{b}" for a in "abcde" for b in "vwxyz"] for c in "nc")
    # Every name and every city occurs in two documents, every pair in one; the last line exists twice, another template of the leaf once.
    pairs = [(k, (7 * k + j) % 25) for k in range(25) for j in (0, 1)]
    texts = [f"sign in of user {names[a]} from the city {cities[b]} again" for a, b in pairs]
    alone = "sign in of nobody else is wanted in town today"
    found = dropped_lines(spark, [*texts, texts[-1], alone], min_constant=0.75)
    assert found == {k: [0] for k in range(len(texts) + 1)} | {len(texts) + 1: []}


def test_prose_of_one_leaf_stays(spark):
    texts = ["in this paper we ask how bees find home", "in this paper they show why rivers turn north", "in this paper we learn what old towns eat"]
    assert not any(dropped_lines(spark, texts, min_constant=0).values())


def test_log_lines_and_short_lines(spark):
    log = [f"2024-05-0{k} 12:00:0{k} INFO worker 1{k} finished job 99{k} in 2{k} ms" for k in range(4)]
    address = [f"10.0.0.{k}:80 GET /item/{k} 200 {k}3 bytes by agent{k}" for k in range(4)]
    short = ["All rights reserved.", "Released under the MIT License", "Licensed under CC BY-NC 4.0.", "Page 7", "Contents"]
    texts = ["\n".join([log[k], address[k], *short, f"{k} 1{k} 2{k}", "---", "", f"only {'abcd'[k]}"]) for k in range(4)]
    assert dropped_lines(spark, texts) == {k: list(range(7)) for k in range(4)}


def test_query_takes_every_line(spark, tmp_path):
    from clipsieve.llm.queries import op4_line_templates

    documents(spark, [(k, "All rights reserved.", "en", "a", 1) for k in range(3)]).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["dropped"] for r in op4_line_templates(spark, str(tmp_path)).collect()] == [[0]] * 3


def test_small_batches_against_a_larger_index(spark, tmp_path, monkeypatch):
    index = exact_dedup.open_index(spark, f"{tmp_path}/index", 3)
    exact_dedup.deduplicate(documents(spark, [(k, f"text {k}", None, None, 1) for k in range(50)]), index).count()
    shipped = []
    broadcast = exact_dedup.F.broadcast
    monkeypatch.setattr(exact_dedup.F, "broadcast", lambda df: shipped.append(df.count()) or broadcast(df))
    assert exact_dedup.deduplicate(documents(spark, []), index).count() == 0
    assert not any(shipped)
    found = exact_dedup.deduplicate(documents(spark, [(90, "TEXT 7", None, None, 1), (91, "text 7", None, None, 1), (92, "new", None, None, 1)]), index)
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in found.collect()} == {90: (7, False), 91: (7, False), 92: (92, True)}
    assert max(shipped) <= 2 and spark.table(index).count() == 51
