"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction.  For a cluster with centroid c whose members are within angle t of it, no member u
can score a row i above |u| |i| cos(max(0, angle(c, i) - t)).  Rows are sorted by that bound once for a cluster, and
every member walks the same list until the bound of what is left certifies that nothing there can enter its answer.

The list is cut for a cluster of machines: rows lie in cells (nearest of ``CELLS`` directions), and cells in chunks of
about ``CHUNK`` rows.  A cluster's list goes through the cells by their greatest bound, and inside a chunk through the
rows by their own.  A walk takes the ``FIRST`` cells to learn a certificate, then only the cells above it.  Positives are
walked first; their scores set the range in which negatives are walked for.  Scores are exact integers throughout.

Both sets of directions are fitted to bounded samples (``MAX_FIT`` rows each).  The driver sees the directions, their sizes
and bounds between them, never rows.  A task holds one chunk and up to ``MEMBERS`` anchors; hot cells are split by row number,
and an anchor's list of answers never holds more than asked for.  Equal anchor rows are walked for once.

Defined results: rows without label or vector, or with a null or non-finite component, take no part; each other row takes
part, repeated ones as often as they occur, and an anchor row is no positive of its own while its copies are; shorter
vectors are filled up with zeros, an empty vector scores 0 with everything; components beyond 2 ** 22 after scaling count as 2 ** 22;
a null vec_id is the last among ties; a negative positive score has no negatives, as its range is empty; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clipsieve.llm.common import written

SCALE = 256
LARGEST = 1 << 22
CELLS = 64
MAX_CLUSTERS = 256
ANCHORS_PER_CLUSTER = 32
CHUNK = 16_384
MEMBERS = 8_192
FIRST = 2
STRIDE = 2_048
MAX_FIT = 4_096
NO_ID = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and integer components of the rows that take part, each with a row number."""
    most = F.lit(float(LARGEST))
    component = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, most), -most)).cast("int")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", finite))
    rows = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", component).alias("q"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of equal width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int32)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(flat.size) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a zero vector stays zero."""
    x = x.astype(np.float64)
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length > 0, length, 1)[:, None], length


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions by spherical k-means, from evenly spread rows of the sorted sample."""
    unit = np.unique(directions(x)[0], axis=0)
    k = max(1, min(k, len(unit)))
    found = unit[np.arange(k) * len(unit) // k]
    for _ in range(rounds):
        near = (unit @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, unit)
        empty = ~sums.any(1)
        sums[empty] = found[empty]
        found = directions(sums)[0]
    return found


def fitted(rows: DataFrame, k: int, width: int) -> np.ndarray:
    """``centroids`` of at most ``MAX_FIT`` rows, chosen by hash, in one task."""

    def learn(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column("q"), width) for b in source if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([centroids(np.concatenate(parts), k).tobytes()], pa.binary())], names=["c"])

    sample = rows.select("q", F.xxhash64("q", "row").alias("h")).orderBy("h").limit(MAX_FIT).select("q")
    return np.frombuffer(bytes(sample.repartition(1).mapInArrow(learn, "c binary").first()["c"])).reshape(-1, width)


def placed(rows: DataFrame, centres: np.ndarray, width: int, out: str) -> DataFrame:
    """Each row's nearest direction, its angle to it and its length."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            unit, length = directions(matrix(batch.column("q"), width))
            cosine = unit @ centres.T
            near = cosine.argmax(1)
            angle = np.arccos(np.clip(cosine[np.arange(len(near)), near], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angle), pa.array(length)], names=[*batch.schema.names, out, "angle", "length"])

    kinds = {"vec_id": "long", "label": "long", "q": "array<int>", "row": "long", "copies": "long"}
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in rows.columns), f"{out} int, angle double, length double"]))


class Lists:
    """Bounds of a row for every anchor cluster."""

    def __init__(self, centres: np.ndarray, reach: np.ndarray):
        self.centres, self.reach = centres, reach

    def bounds(self, q: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Greatest score, for a member of length 1, of each row with any member of each cluster."""
        unit, length = directions(q)
        angle = np.arccos(np.clip(unit @ self.centres[which].T, -1, 1)) - self.reach[which] - 1e-7
        return np.where(length[:, None] > 0, length[:, None] * np.cos(np.maximum(angle, 0)), 0.0)


def certain(length: np.ndarray | Column, bound: np.ndarray | Column) -> np.ndarray | Column:
    """A bound as no rounding can exceed it."""
    return length * bound + abs(length * bound) * 1e-9 + 0.5 if isinstance(length, np.ndarray) else length * bound + F.abs(length * bound) * 1e-9 + 0.5


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products, in the narrowest kind of number that holds every sum."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return x.astype(kind) @ y.astype(kind).T


def first_rows(member: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of every member: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, member))
    m = member[order]
    starts = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if m.size else np.zeros(0, np.int64)
    place = np.arange(m.size) - np.repeat(starts, np.diff(np.r_[starts, m.size]))
    return order[place < most]


class Walk:
    """What one member set looks for; ``slots`` answers of ``most`` rows each, every slot with its range of scores."""

    def __init__(self, n: int, slots: int, most: int, same: bool):
        self.most, self.same = most, same
        self.low, self.high = np.full((n, slots), -np.inf), np.full((n, slots), np.inf)
        self.found = [[(np.zeros(0, np.int64),) * 3 for _ in range(slots)]]
        self.hits: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4 for _ in range(slots)]

    def need(self) -> np.ndarray:
        """No row below it can be an answer of the member."""
        return np.where(self.low <= self.high, self.low, np.inf).min(1)

    def take(self, members: np.ndarray, scores: np.ndarray, ids: np.ndarray, matches: np.ndarray, column: np.ndarray) -> None:
        """A block's scores of some members; ``matches[k, c]`` tells whether column c has the wanted kind of label for member k."""
        low, high = self.low[members], self.high[members]
        top = np.where(low <= high, high, -np.inf).max(1)
        at, col = np.nonzero((scores >= self.need()[members][:, None]) & (scores <= top[:, None]))
        ok = matches[at, col]
        at, col = at[ok], col[ok]
        value = scores[at, col].astype(np.int64)
        for slot, kept in enumerate(self.hits):
            fits = (value >= low[at, slot]) & (value <= high[at, slot])
            if not fits.any():
                continue
            new = (members[at[fits]], value[fits], ids[col[fits]], column[col[fits]])
            merged = tuple(np.concatenate(p) for p in zip(kept, new))
            keep = first_rows(merged[0], merged[1], merged[2], self.most)
            kept = self.hits[slot] = tuple(p[keep] for p in merged)
            counts = np.bincount(kept[0], minlength=len(self.low))
            full = np.flatnonzero(counts >= self.most)
            worst = np.full(len(self.low), np.inf)
            np.minimum.at(worst, kept[0], kept[1])
            self.low[full, slot] = np.maximum(self.low[full, slot], worst[full])


def walk_chunk(lists: Lists, walk: Walk, clusters: np.ndarray, lengths: np.ndarray, labels: np.ndarray, u: np.ndarray, ids: np.ndarray, row_labels: np.ndarray, q: np.ndarray) -> None:
    """All members of each cluster down the cluster's list of the chunk's rows."""
    for j in np.unique(clusters).tolist():
        mine = np.flatnonzero(clusters == j)
        bound = lists.bounds(q, np.array([j]))[:, 0]
        order = np.argsort(-bound, kind="stable")
        step = 256
        start = 0
        while start < order.size:
            mine = mine[certain(lengths[mine], bound[order[start]]) >= walk.need()[mine]]
            if not mine.size:
                break
            rows = order[start : start + step]
            start, step = start + step, min(step * 4, STRIDE)
            matches = (labels[mine][:, None] == row_labels[rows][None]) == walk.same
            walk.take(mine, exact(u[mine], q[rows]), ids[rows], matches, rows)


def walked(visits: DataFrame, chunks: DataFrame, supers: int, lists: Lists, width: int, slots: int, most: int, same: bool) -> DataFrame:
    """row (of the anchor), slot, score, other, own: the best of every chunk for the anchors that visit it."""
    keys = ["cell", "part", "super"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            rows = {c: np.frombuffer(b"".join(right[c].to_pylist()), k) for c, k in (("ids", "<i8"), ("labels", "<i8"), ("flat", "<i4"))}
            q = rows["flat"].reshape(-1, width)
            u = matrix(left["q"], width)
            walk = Walk(left.num_rows, slots, most, same)
            for side, edge in ((walk.low, "low"), (walk.high, "high")):
                side[:] = np.array(left[edge].to_pylist(), float)
            anchor_ids, anchor_rows = left["vec_id"].to_numpy(), left["row"].to_numpy()
            walk_chunk(lists, walk, left["cluster"].to_numpy(), left["length"].to_numpy(), left["label"].to_numpy(), u, rows["ids"], rows["labels"], q)
            for slot, (member, value, ids, column) in enumerate(walk.hits):
                own = (anchor_ids[member] == ids) & (u[member] == q[column]).all(1)
                out.append((anchor_rows[member], np.full(member.size, slot, np.int32), value, ids, own))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "slot", "score", "other", "own"])

    spread = chunks.withColumn("super", F.explode(F.sequence(F.lit(0), F.lit(supers - 1))))
    wanted = spread.join(visits.select(*keys).distinct(), keys, "left_semi")
    return visits.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, "row long, slot int, score long, other long, own boolean")


def best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), F.asc("other"), F.desc("own"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def mine(vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` percent of the positive's.

    ``vectors`` has vec_id, embedding and label; ``label`` and ``anchor`` are expressions of those.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, label)
    found = rows.agg(F.max(F.size("q")), F.count_if(F.coalesce(anchor & (F.col("vec_id") != NO_ID), F.lit(False)))).first()
    if not found[1]:
        return spark.createDataFrame([], RESULT)
    width = max(found[0], 1)
    anchors = rows.where(F.coalesce(anchor & (F.col("vec_id") != NO_ID), F.lit(False))).groupBy("vec_id", "label", "q").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    anchors = written(anchors.select("vec_id", "label", "q", "row", "copies"), "anchors")
    n_anchors = anchors.count()

    centres = fitted(anchors, min(MAX_CLUSTERS, max(1, n_anchors // ANCHORS_PER_CLUSTER)), width)
    members = placed(anchors, centres, width, "cluster")
    reach = np.zeros(len(centres))
    for r in members.groupBy("cluster").agg(F.max("angle").alias("reach")).collect():  # one row a cluster
        reach[r["cluster"]] = r["reach"]
    lists = Lists(centres, reach)
    supers = -(-n_anchors // MEMBERS)
    members = members.withColumn("super", F.pmod(F.xxhash64("row"), F.lit(supers)).cast("int"))

    cells = written(placed(rows, fitted(rows, CELLS, width), width, "cell").drop("angle", "length"), "cells")
    sizes = {r["cell"]: -(-r["n"] // CHUNK) for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    parts = F.broadcast(spark.createDataFrame(list(sizes.items()), "cell int, parts int"))

    def pack(table: pa.Table) -> pa.Table:
        q = matrix(table["q"], width)
        top = np.full(len(centres), -np.inf)
        for start in range(0, len(q), STRIDE):
            top = np.maximum(top, lists.bounds(q[start : start + STRIDE]).max(0))
        data = [table["vec_id"].to_numpy().astype("<i8"), table["label"].to_numpy().astype("<i8"), q.astype("<i4")]
        return pa.table([
            table["cell"][:1], table["part"][:1], *[pa.array([x.tobytes()], pa.binary()) for x in data], pa.array([top.tolist()], pa.list_(pa.float64())),
        ], names=["cell", "part", "ids", "labels", "flat", "bounds"])

    dealt = cells.join(parts, "cell").select("vec_id", "label", "q", "cell", F.pmod("row", "parts").cast("int").alias("part"))
    chunks = written(dealt.groupBy("cell", "part").applyInArrow(pack, "cell int, part int, ids binary, labels binary, flat binary, bounds array<double>"), "chunks")
    limits = chunks.select("cell", F.posexplode("bounds").alias("cluster", "bound")).groupBy("cluster", "cell").agg(F.max("bound").alias("bound"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("bound"), F.asc("cell")))
    order = F.broadcast(spark.createDataFrame(limits.withColumn("place", place).toArrow()).join(parts, "cell"))  # at most MAX_CLUSTERS x CELLS rows
    chunks = chunks.drop("bounds")

    def visits(state: DataFrame, which: Column) -> DataFrame:
        """A row for each chunk that an anchor still has to walk."""
        joined = state.join(order, "cluster").where(which)
        return joined.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "bound", "place", "angle", "copies")

    def walk(state: DataFrame, slots: int, most: int, same: bool, name: str) -> DataFrame:
        """Both parts of the walk; ``state`` has the arrays ``low`` and ``high`` of each slot."""
        arguments = (chunks, supers, lists, width, slots, most, same)
        first = written(best(walked(visits(state, F.col("place") <= FIRST), *arguments), most), name + "-first")
        full = F.map_from_entries(F.collect_list(F.struct("slot", "score")))
        known = first.where(F.col("place") == most).groupBy("row").agg(full.alias("full"))
        state = state.join(known, "row", "left").withColumn(
            "low", F.when(F.col("full").isNull(), F.col("low")).otherwise(F.transform("low", lambda x, k: F.greatest(x, F.coalesce(F.element_at("full", k).cast("double"), x))))
        ).drop("full")
        need = F.array_min(F.transform(F.arrays_zip("low", "high"), lambda x: F.when(x["low"] <= x["high"], x["low"]).otherwise(float("inf"))))
        onward = visits(state, (F.col("place") > FIRST) & (certain(F.col("length"), F.col("bound")) >= need))
        return written(best(first.drop("place").union(walked(onward, *arguments)), most), name)

    open_range = members.withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    top = walk(open_range, 1, positives + 1, True, "positives")
    # The anchor's own row is one of the equal rows with its id; any of them stands for it.
    itself = F.row_number().over(Window.partitionBy("row", "own").orderBy("place"))
    others = top.withColumn("nth", itself).where(~(F.col("own") & (F.col("nth") == 1)))
    by_place = Window.partitionBy("row").orderBy("place")
    chosen = others.withColumn("slot", F.row_number().over(by_place) - 1).where(F.col("slot") < positives).select("row", "slot", F.col("score").alias("positive_score"), F.col("other").alias("positive_id"))
    chosen = written(chosen, "chosen")
    ranges = chosen.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "positive_score"))).alias("scores"))

    def edge(percent: int, up: bool) -> Column:
        """Least or greatest integer score of each slot; a slot without positive has an empty range."""
        def one(k: Column) -> Column:
            p = F.element_at("scores", k) * percent
            value = (p + F.pmod(-p, F.lit(100)) if up else p - F.pmod(p, F.lit(100))) / 100
            return F.coalesce(value.cast("double"), F.lit(float("inf" if up else "-inf")))

        return F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), one)

    ranged = members.join(ranges, "row").withColumns({"low": edge(low, True), "high": edge(high, False)}).drop("scores")
    hard = walk(ranged, positives, negatives, False, "negatives")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return (
        anchors.select(F.col("vec_id").alias("anchor_id"), "row", copies.alias("_copy")).join(chosen, "row").join(hard, ["row", "slot"])
        .select(
            "anchor_id", F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"), F.col("place").cast("int").alias("rank"),
            F.nullif("other", F.lit(NO_ID)).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        )
    )
