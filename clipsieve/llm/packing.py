"""Best-fit packing with large-item matching.

Documents become pieces of at most ``capacity`` ids.  Pieces of one length are interchangeable, so the
packing is decided on the histogram of lengths (``capacity`` counts, whatever the corpus): lengths above a
third of the capacity are matched greedily, two to a bin at most; shorter ones go, longest first, into the
smallest gap that takes them.  The decision is a short list of rank ranges, and each piece finds its bin by
its rank among the pieces of its length.  No task sees more than its own pieces.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed once
each; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from clipsieve.llm.common import batches, default_tokenizer, encoder, written

END_ID = 2
CAPACITY = 1024
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: only what is longer than ``capacity`` is cut, the first piece may be shorter.

    ``place`` counts the pieces of one length within a task.  ``keep_ids`` adds the ids themselves.
    """

    def run(source):
        coder, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches(source, "text"):
            ids, sizes = coder.encode(batch.column("text"), end)
            n_pieces = -(-sizes // capacity)
            first = sizes - (n_pieces - 1) * capacity
            doc = np.repeat(np.arange(sizes.size), n_pieces)
            piece = np.arange(doc.size) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            length = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            ends = np.cumsum(length)
            raw = memoryview(ids.tobytes())
            parts = [raw[4 * a : 4 * b] for a, b in zip((ends - length).tolist(), ends.tolist())]
            order = np.argsort(length, kind="stable")
            by = length[order]
            runs = np.arange(by.size) - np.searchsorted(by, by)
            place = np.empty_like(length)
            place[order] = seen[by] + runs
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(np.full(doc.size, task), pa.int32()), pa.array(place),
                pa.array([bytes(p) for p in parts] if keep_ids else [None] * doc.size, pa.binary()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


@dataclass
class Plan:
    """Segments by (length, rank): ranks ``rank .. rank + n - 1`` go to bins ``bin ..``, ``per_bin`` to each, from ``offset``."""

    segments: np.ndarray
    n_bins: int


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Packs a histogram of lengths below ``capacity``."""
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    bins = 0

    def put(length: int, n: int, first: int, per_bin: int, offset: int) -> None:
        segments.append((length, used[length], n, first, per_bin, offset))
        used[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for k in large:
        while left[k]:
            mate = next((m for m in large if m <= capacity - k and left[m] > (m == k)), None)
            if mate is None:
                n = left[k]
                gaps[capacity - k].append((bins, n))
                put(k, n, bins, 1, 0)
            elif mate == k:
                n = left[k] // 2
                gaps[capacity - 2 * k].append((bins, n))
                put(k, 2 * n, bins, 2, 0)
            else:
                n = min(left[k], left[mate])
                gaps[capacity - k - mate].append((bins, n))
                put(k, n, bins, 1, 0)
                put(mate, n, bins, 1, k)
            bins += n
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[k]:
            gap = next((g for g in range(k, capacity) if gaps[g]), capacity)
            per_bin = gap // k
            if gap == capacity:
                n = -(-left[k] // per_bin)
                first, bins = bins, bins + n
            else:
                first, n = gaps[gap].pop()
            full = min(n, left[k] // per_bin)
            offset = capacity - gap
            if full:
                put(k, full * per_bin, first, per_bin, offset)
                gaps[gap - per_bin * k].append((first, full))
            if full < n and left[k]:
                some = left[k]
                put(k, some, first + full, some, offset)
                gaps[gap - some * k].append((first + full, 1))
                full += 1
            if full < n:
                gaps[gap].append((first + full, n - full))
    table = np.array(sorted(segments), np.int64).reshape(-1, 6)
    return Plan(table, bins)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece; full pieces are sequences of their own."""
    short = F.col("length") < capacity
    per_task = pieces.where(short).groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"], "left").withColumn("rank", F.col("base") + F.col("place"))

    def run(source):
        length, rank, n, first, per_bin, offset = plan.segments.T
        key = (length << 44) + rank
        for batch in source:
            size, r, own = (np.asarray(pc.fill_null(batch.column(c), 0)) for c in ("length", "rank", "place"))
            task = np.asarray(batch.column("task")).astype(np.int64)
            if key.size:
                at = np.maximum(np.searchsorted(key, (size << 44) + r, side="right") - 1, 0)
                inside = r - rank[at]
                sequence, where = first[at] + inside // per_bin[at], offset[at] + inside % per_bin[at] * size
            else:
                sequence, where = r, r
            alone = size == capacity
            sequence = np.where(alone, -1 - ((task << 38) + own), sequence)
            where = np.where(alone, 0, where)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")), pa.array(sequence), pa.array(where),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece with its sequence and its place there.

    The histogram that reaches the driver has ``capacity`` rows at most.
    """
    pieces = written(cut_pieces(docs, tokenizer or default_tokenizer(), capacity, end, keep_ids), "pieces")
    return place_pieces(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., keep_ids=True)``: ids as little-endian 32-bit integers."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return grouped.select(
        "sequence_id", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"))).alias("members"),
        F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )
