import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipsieve.llm import grammar_output, packing
from clipsieve.llm.common import Encoder, default_tokenizer

from cases import clashing, documents, got, rows


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_tokenizer(plain):
    odd = ["a  b", "a\n b", "x\n\n y \n z ", " a b  c\td", "it's we'll  \n", "a   \n\n  b", "!!,x a!. b", "x ,y", ",,", "a_.b", "2.0, x.", "ß,é.ü", "×,x", "x y", "x y", "\x85 a", "a\x00b"]
    texts = [r[1] for r in rows()] + odd
    ids, sizes = Encoder(default_tokenizer(), memory=50).encode(pa.array(texts, pa.string()), 2)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == plain(text), text


def test_grammar_round_trip(spark, tmp_path, plain):
    docs = documents(spark)
    for k, table in enumerate((docs, clashing(docs))):
        path = f"{tmp_path}/shards{k}"
        grammar_output.write_shards(table, path, shard_tokens=2000)
        out = grammar_output.read_documents(spark, path, keep_ids=True).collect()
        want = sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        start, expected = 0, []
        for doc_id, text in want:
            ids = plain(text)
            expected.append((doc_id, start, len(ids), crc(ids)))
            start += len(ids)
        found = sorted(out, key=lambda r: r["start"])
        assert [tuple(r)[:4] for r in found] == expected
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in found)
    shards = spark.read.parquet(path).collect()
    assert len(shards) > 3 and any(r["rules"] for r in shards)


def test_rules_shrink_and_spans_decode_alone():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 50_000, 40)
    ids = np.concatenate([np.concatenate([phrase, rng.integers(0, 50_000, 5)]) for _ in range(60)]).astype("<u4")
    sizes = np.array([1000, 1, 699, 1000])
    seq, rules, lengths, symbols = grammar_output.compress(ids, sizes)
    assert seq.size < ids.size / 3 and symbols.sum() == seq.size and len(rules) == len(lengths)
    grammar = grammar_output.Grammar(rules, lengths)
    assert grammar.decode(seq).tolist() == ids.tolist()
    for a, b in ((0, 1), (5, 900), (999, 1001), (2699, 2700), (0, 2700), (2700, 2800), (10, 10)):
        assert grammar.span(seq, a, b).tolist() == ids[a:b].tolist()
    cut = np.cumsum(symbols)
    assert [grammar.decode(s).size for s in np.split(seq, cut[:-1])] == sizes.tolist()


def pairs_left(seq, symbols, min_use=4):
    """Pairs that still occur ``min_use`` times without overlapping themselves or a document's end."""
    uses = defaultdict(int)
    ends, taken = set((np.cumsum(symbols) - 1).tolist()), {}
    for k in range(len(seq) - 1):
        pair = (int(seq[k]), int(seq[k + 1]))
        if k not in ends and taken.get(pair) != k:
            uses[pair] += 1
            taken[pair] = k + 1
    return [p for p, n in uses.items() if n >= min_use]


def test_no_frequent_pair_is_left():
    """Runs of one id, long passages and random texts alike."""
    rng = np.random.default_rng(7)
    passage = rng.integers(0, 50_000, 600)
    cases = [
        (np.full(10_000, 7), [10_000], 100), (np.concatenate([np.concatenate([passage, rng.integers(0, 50_000, 2)]) for _ in range(200)]), [602] * 200, 1300),
        (np.tile([5, 5, 9], 3000), [900] * 10, 100), (rng.integers(0, 40, 30_000), [10] * 3000, None), (rng.zipf(1.5, 20_000) % 50_000, [1, 19_999], None), (np.array([3]), [1], None),
    ]
    for ids, sizes, most in cases:
        ids, sizes = ids.astype("<u4"), np.array(sizes)
        seq, rules, lengths, symbols = grammar_output.compress(ids, sizes)
        grammar = grammar_output.Grammar(rules, lengths)
        assert grammar.decode(seq).tolist() == ids.tolist() and pairs_left(seq, symbols) == []
        assert np.add.reduceat(grammar.sizes(seq), np.cumsum(symbols) - symbols).tolist() == sizes.tolist()
        assert most is None or seq.size + len(rules) < most
    assert grammar_output.compress(np.zeros(0, "<u4"), np.zeros(0, np.int64))[0].size == 0


def test_another_pre_tokeniser_encodes_whole_texts(tmp_path):
    import json

    spec = json.loads(open(default_tokenizer()).read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    other = Tokenizer.from_file(str(path))
    other.encode_special_tokens = True
    coder = Encoder(str(path))
    texts = ["some words, and more.\nNext", "", "a b"]
    ids, sizes = coder.encode(pa.array(texts))
    assert not coder.cuts and ids.tolist() == [x for t in texts for x in other.encode(t, add_special_tokens=False).ids] and len(sizes) == 3


def test_packing(spark, plain):
    docs = documents(spark)
    for table in (docs, clashing(docs)):
        out = packing.pack(table, capacity=128, keep_ids=True)
        found = out.collect()
        expected = []
        for r in rows():
            ids = plain(r[1])
            first = len(ids) - (-(-len(ids) // 128) - 1) * 128
            cuts = [0, *range(first, len(ids) + 1, 128)]
            expected += [(r[0], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        key = lambda x: tuple((v is not None, v or 0) for v in x)
        assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(expected, key=key)
        bins = defaultdict(list)
        for r in found:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for members in bins.values():
            at = 0
            for offset, length in sorted(members):
                assert offset == at
                at += length
            assert at <= 128
        total = sum(e[3] for e in expected)
        assert len(bins) <= -(-total // 128) + 6
    made = {r["sequence_id"]: r for r in packing.sequences(out).collect()}
    assert set(made) == set(bins) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in made.values())


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_sound_and_tight(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 60)) for k in rng.integers(1, 100, 40)}
    plan = packing.plan_bins(counts, 100)
    space = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, first, per_bin, offset in plan.segments.tolist():
        for k in range(n):
            space[first + k // per_bin].append((offset + k % per_bin * length, length))
            ranks[length].append(rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for members in space.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 100 and sum(3 * length > 100 for _, length in members) <= 2
    assert sorted(space) == list(range(plan.n_bins))
    # First fit decreasing, item by item, is no better.
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= length), None)
        if at is None:
            gaps.append(100 - length)
        else:
            gaps[at] -= length
    assert plan.n_bins <= len(gaps) + 1


def test_empty_tables(spark, tmp_path):
    none = documents(spark, [])
    assert packing.pack(none).count() == 0
    grammar_output.write_shards(none, f"{tmp_path}/none")
    assert grammar_output.read_documents(spark, f"{tmp_path}/none").agg(F.count("*")).first()[0] == 0
    assert got(packing.pack(documents(spark, [(1, None, None, None, None)])).select("doc_id", "piece", "start", "length", "offset")) == [(1, 0, 0, 1, 0)]


class CountedTokenizer:
    """A tokenizer that counts the texts it encodes."""

    def __init__(self, inner):
        self.__dict__.update(inner=inner, texts=0)

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def __setattr__(self, name, value):
        setattr(self.inner, name, value)

    def encode_batch_fast(self, texts, **more):
        self.__dict__["texts"] += len(texts)
        return self.inner.encode_batch_fast(texts, **more)


def test_new_pieces_are_encoded_in_few_texts(plain):
    rng = np.random.default_rng(5)
    make = lambda letters, n: ["".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(n)]
    words = make("abcdefghiéßŁ", 4000) + make("aé'1_漢я.,-ś", 2000) + ["'s", "it's", "<|endoftext|>", "﻿", "​", "\xad", ""]
    texts = [" ".join(words), "\n".join(words[::-1])] + words
    want = [plain(t) for t in texts]
    coder = Encoder(default_tokenizer())
    coder.tokenizer = CountedTokenizer(coder.tokenizer)
    for other in (coder, Encoder(default_tokenizer())):
        if other is not coder:
            other.feed = 12345  # never found between the pieces: each is encoded by itself
        ids, sizes = other.encode(pa.array(texts, pa.string()), 2)
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert len(coder.known) > 5000 and coder.tokenizer.texts < 20
