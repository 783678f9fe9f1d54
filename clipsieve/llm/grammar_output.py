"""Token ids as Re-Pair grammars, one for each shard of consecutive documents.

A shard file row holds the sequence of a shard (ids, and nonterminals from ``FIRST_RULE`` on), the rules as
pairs of symbols, the length of every rule's expansion, and per document its id, its number of symbols and its
number of ids.  Symbols never span two documents, and a symbol's length is known without expanding it,
so any document or span is decoded alone.

Rules are made in rounds, until no pair of neighbours occurs ``min_use`` times any more: the pairs of a round that are
more frequent than both neighbours they overlap with are replaced at once; the next round pairs the new symbols.
Below ``MIN_USE`` uses a rule takes more bytes than it saves.

Defined results: a null or empty text is the end id alone; documents with equal doc_id follow each other by
text; a null doc_id comes first; an empty table gives no file row and no document; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clipsieve.llm.common import batches, default_tokenizer, encoder

END_ID = 2
#: Ids of any vocabulary in use are below it.
FIRST_RULE = 1 << 20
SHARD_TOKENS = 1 << 18
_SHARDS = (
    "part int, shard int, n_docs int, n_tokens long, part_start long, doc_ids array<long>, sizes array<int>, symbols array<int>, "
    "sequence binary, rules binary, lengths binary"
)
MIN_USE = 4
_TABLE_BITS = 18


class _Rules:
    """Rules in the order they are made."""

    def __init__(self, min_use: int):
        self.min_use, self.n = min_use, 0
        self.pairs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def name(self, a: np.ndarray, b: np.ndarray, slot: np.ndarray, length: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the picked pairs are replaced, and by what, and which are too rare; of pairs that share a slot one goes first."""
        first = np.zeros(1 << bits, np.int32)
        first[slot] = np.arange(slot.size, dtype=np.int32)
        of = first[slot]
        alike = np.flatnonzero((a[of] == a) & (b[of] == b))
        uses = np.bincount(slot[alike], minlength=1 << bits)
        enough = uses[slot[alike]] >= self.min_use
        good = alike[enough]
        fresh = np.flatnonzero(uses >= self.min_use)
        number = np.zeros(1 << bits, np.uint32)
        number[fresh] = np.arange(FIRST_RULE + self.n, FIRST_RULE + self.n + fresh.size, dtype=np.uint32)
        if fresh.size:
            of = first[fresh]
            self.pairs.append(np.stack([a[of], b[of]], 1))
            self.lengths.append(length[of])
            self.n += fresh.size
        return good, number[slot[good]], alike[~enough]


def _slots(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    mixed = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed >>= np.uint32(32 - bits)
    return mixed.view(np.int32)


def _weights(slot: np.ndarray, bits: int, min_use: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every slot below ``size`` its rank among frequent pairs, the more frequent the higher, 0 if it is rare, and its count."""
    often = np.bincount(slot, minlength=size)[:size]
    ranked = (np.minimum(often, (1 << (31 - bits)) - 1).astype(np.int32) << bits) | np.arange(size, dtype=np.int32)
    ranked[often < min_use] = 0
    return ranked, often


def _settled(slot: np.ndarray, tried: np.ndarray, often: np.ndarray, failed: np.ndarray) -> np.ndarray:
    """Those of the failed places whose pair was tried wherever it occurs: it is rare for good."""
    seen = np.bincount(slot[tried], minlength=often.size)[: often.size]
    return failed[seen[slot[failed]] >= often[slot[failed]]]


def _even_places(again: np.ndarray) -> np.ndarray:
    """Of places (ascending) that go on a run from the place before them, the second, fourth, sixth of each run."""
    place = np.arange(again.size)
    opens = np.append(True, again[1:] != again[:-1] + 1)[: again.size]
    return again[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]


def compress(ids: np.ndarray, sizes: np.ndarray, min_use: int = MIN_USE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, rules (pairs of symbols), expansion lengths of the rules, and symbols of each document.

    A round counts the pairs at the active places only: where a pair was frequent before, and next to what the last round
    replaced; everywhere else no pair can have become frequent.  Where one pair overlaps itself, as in a run
    of one id, every second place counts.  While most places are active, the symbols are a plain array, later a linked list.
    """
    rules = _Rules(min_use)
    symbol, length = ids.astype(np.uint32), np.ones(ids.size, np.uint32)
    last = np.zeros(ids.size, bool)
    last[np.cumsum(sizes) - 1] = True
    active = ~last
    while symbol.size > 1 and np.count_nonzero(active) > symbol.size >> 3:
        bits = max(8, min(_TABLE_BITS, int(symbol.size).bit_length()))
        slot = _slots(symbol[:-1], symbol[1:], bits)
        slot[~active[:-1]] = 1 << bits
        ranked, often = _weights(slot, bits, min_use, 1 << bits)
        own = np.append(ranked, np.int32(0))[slot]
        pick = own > 0
        active[:-1] = pick
        pick[1:] &= own[1:] >= own[:-1]
        pick[:-1] &= own[:-1] >= own[1:]
        even = _even_places(np.flatnonzero((own[1:] == own[:-1]) & (own[1:] > 0)) + 1)
        pick[even] = False
        at = np.flatnonzero(pick)
        good, new, rare = rules.name(symbol[at], symbol[at + 1], slot[at], length[at] + length[at + 1], bits)
        active[_settled(slot, np.concatenate([at, even]), often, at[rare])] = False
        if not good.size:
            continue
        at = at[good]
        symbol[at] = new
        length[at] += length[at + 1]
        last[at] = last[at + 1]
        active[at] = active[at[at > 0] - 1] = True
        stay = np.ones(symbol.size, bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        symbol, length, last, active = symbol.take(stay), length.take(stay), last.take(stay), active.take(stay)
        active &= ~last
    symbol, last = _linked_rounds(rules, symbol, length, last, active)
    table = np.concatenate(rules.pairs) if rules.n else np.zeros((0, 2))
    flat = np.concatenate(rules.lengths) if rules.n else np.zeros(0)
    return symbol.astype("<u4"), table.astype("<u4"), flat.astype("<u4"), np.diff(np.flatnonzero(last) + 1, prepend=0)


def _linked_rounds(rules: _Rules, symbol: np.ndarray, length: np.ndarray, last: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = symbol.size
    symbol, length, last = np.append(symbol, np.uint32(0)), np.append(length, np.uint32(0)), np.append(last, True)
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n stands for none
    before[0] = n
    weight, alive = np.zeros(n + 1, np.int32), np.ones(n, bool)
    at = np.flatnonzero(active)
    while at.size:
        bits = max(8, min(_TABLE_BITS, int(at.size).bit_length()))
        right = after[at]
        a, b = symbol[at], symbol[right]
        slot = _slots(a, b, bits)
        ranked, often = _weights(slot, bits, rules.min_use, 1 << bits)
        own = ranked[slot]
        rare = own == 0
        if rare.any():
            active[at[rare]] = False
            keep = np.flatnonzero(~rare)
            at, right, a, b, slot, own = at[keep], right[keep], a[keep], b[keep], slot[keep], own[keep]
        weight[at] = own
        left = before[at]
        left_weight = weight[left]
        pick = (left_weight <= own) & (weight[right] <= own)
        even = _even_places(np.flatnonzero((left_weight[1:] == own[1:]) & (left[1:] == at[:-1])) + 1)
        pick[even] = False
        weight[at] = 0
        pick = np.flatnonzero(pick)
        taken, gone = at[pick], right[pick]
        good, new, rare = rules.name(a[pick], b[pick], slot[pick], length[taken] + length[gone], bits)
        active[at[_settled(slot, np.concatenate([pick, even]), often, pick[rare])]] = False
        if not good.size:
            at = at[active[at]]
            continue
        taken, gone = taken[good], gone[good]
        beyond = after[gone]
        symbol[taken] = new
        length[taken] += length[gone]
        last[taken] = last[gone]
        after[taken], before[beyond] = beyond, taken
        before[n] = n
        alive[gone] = active[gone] = active[taken] = False
        near = np.concatenate([taken, before[taken]])
        active[near[~last[near]]] = True  # place n is last
        at = np.flatnonzero(active)
    return symbol[:n][alive], last[:n][alive]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for every start, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Grammar:
    """Decoder of one shard."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), "<u4")
        sides = [(rules[:, k], rules[:, k].astype(np.int64) - FIRST_RULE) for k in (0, 1)] if len(rules) else []
        depth = np.ones(len(rules), np.int64)
        while sides:  # a rule is one deeper than its deeper side
            deeper = 1 + np.maximum(*(np.where(c >= 0, depth[np.maximum(c, 0)], 0) for _, c in sides))
            if (deeper == depth).all():
                break
            depth = deeper
        for level in range(1, int(depth.max(initial=0)) + 1):
            own = np.flatnonzero(depth == level)
            to = self.starts[own]
            for symbol, child in sides:
                symbol, child = symbol[own], child[own]
                plain = child < 0
                self.flat[to[plain]] = symbol[plain]
                n = np.where(plain, 1, self.lengths[np.maximum(child, 0)])
                if not plain.all():
                    into, out = _ranges(to[~plain], n[~plain]), _ranges(self.starts[child[~plain]], n[~plain])
                    self.flat[into] = self.flat[out]
                to = to + n

    def sizes(self, seq: np.ndarray) -> np.ndarray:
        if not self.lengths.size:
            return np.ones(seq.size, np.int64)
        return np.where(seq >= FIRST_RULE, self.lengths[np.maximum(seq.astype(np.int64) - FIRST_RULE, 0)], 1)

    def decode(self, seq: np.ndarray) -> np.ndarray:
        size = self.sizes(seq)
        ends = np.cumsum(size)
        rule = seq >= FIRST_RULE
        out = np.empty(int(ends[-1]) if seq.size else 0, "<u4")
        out[(ends - size)[~rule]] = seq[~rule]
        if rule.any():
            n = size[rule]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat((ends - size)[rule], n) + step] = self.flat[np.repeat(self.starts[seq[rule].astype(np.int64) - FIRST_RULE], n) + step]
        return out

    def span(self, seq: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a sequence; only the symbols that touch the span are expanded."""
        ends = np.cumsum(self.sizes(seq))
        if start >= stop or not seq.size or start >= ends[-1]:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, min(stop, ends[-1]), "left")
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.decode(seq[a : b + 1])[skip : skip + stop - start]


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, end: int = END_ID, min_use: int = MIN_USE) -> None:
    """Encodes the documents, in ascending order of doc_id, into shards of about ``shard_tokens`` ids."""
    vocabulary = tokenizer or default_tokenizer()

    def run(source):
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        shard = start = 0

        def close():
            doc_ids = [d for x in held for d in x[0]]
            sizes = np.concatenate([x[2] for x in held])
            ids = np.concatenate([x[1] for x in held])
            seq, rules, lengths, symbols = compress(ids, sizes, min_use)
            row = [part, shard, len(doc_ids), int(sizes.sum()), start, doc_ids, sizes.tolist(), symbols.tolist(), seq.tobytes(), rules.tobytes(), lengths.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _SHARDS.split(", ")])

        for batch in batches(source, "text", shard_tokens * 2):
            ids, sizes = coder.encode(batch.column("text"), end)
            held.append((batch.column("doc_id").to_pylist(), ids, sizes))
            if (n := sum(x[1].size for x in held)) >= shard_tokens:
                yield close()
                held.clear()
                shard, start = shard + 1, start + n
        if held:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SHARDS).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Every document decoded from the shards: doc_id, start, n_tokens, ids_crc32 and, if wanted, its ids (binary).

    Starts run over all shards: the driver's plan sums one row for each task that wrote.
    """
    shards = spark.read.schema(_SHARDS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(source):
        for batch in source:
            for r in batch.to_pylist():
                seq = np.frombuffer(r["sequence"], "<u4")
                grammar = Grammar(np.frombuffer(r["rules"], "<u4").reshape(-1, 2), np.frombuffer(r["lengths"], "<u4"))
                ids = memoryview(grammar.decode(seq).tobytes())
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                parts = [ids[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + r["part_start"] + ends - sizes), pa.array(sizes),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([bytes(p) for p in parts] if keep_ids else [None] * len(parts), pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return shards.join(F.broadcast(parts), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
