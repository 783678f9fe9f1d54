"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: in round i < t every shingle is thrown into a bin with a value, and a bin keeps the least
(round, value); rounds t to 2t - 1 throw every shingle into bin i - t.  So each coordinate is filled, however
small the set, and agreement of coordinates is concentrated around the Jaccard similarity.  ``BANDS`` bands
of ``ROWS`` coordinates miss a pair of similarity 0.75 with a chance of (1 - 0.75 ** 5) ** 42 < 2e-5, less above it.

Equal sets form one class first, so copies cost nothing further.  Classes that share a band are
compared by sketch in blocks of ``BLOCK`` rows at most, whatever the size of a band's bucket; only sketches that agree
in ``LEAST_AGREED`` or more count.  A trial compares the full sets of 64-bit shingle hashes, which are made once for the
classes with such a partner.  First every class is tried against its most similar earlier class, then what
is still apart against the partner with the most links so far: whoever is linked needs no more links inside its
component.  At last all remaining pairs of different components that share a band are tried inside their blocks, each in the
first band it shares, and only links leave a block.

Defined results: a text without words has no shingle and is linked with nothing, and its row is its own component; other
rows that repeat a doc_id are one node of the graph, whatever their texts; a row without doc_id joins its class but never
names one; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clipsieve.llm.common import batches, mix64, written
from clipsieve.llm.components import components
from clipsieve.llm.shingles import shingle_sets

WIDTH = 5
SIMILARITY = 75  # in hundredths
BANDS, ROWS = 42, 5
BLOCK = 512
#: Share of equal coordinates from which a pair is tried; at a similarity of 0.75 fewer agree with a chance below 1e-4.
LEAST_AGREED = 0.62


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a set that isn't empty."""
    best = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    round_, n = 0, shingles.size
    while round_ < size:
        some = min(size - round_, max(1, int(size * np.log(size) * 1.3 / n)))
        salts = mix64(np.arange(round_, round_ + some, dtype=np.uint64), 7)
        thrown = mix64(shingles[None, :] ^ salts[:, None], 3)
        bins = (thrown % np.uint64(size)).astype(np.int64)
        value = (np.arange(round_, round_ + some, dtype=np.uint64) << np.uint64(48))[:, None] | (thrown >> np.uint64(16))
        bins, value = bins.ravel(), value.ravel()
        order = np.argsort(value, kind="stable")[::-1]
        fresh = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        fresh[bins[order]] = value[order]  # the last write, the least value, stays
        best = np.minimum(best, fresh)
        round_ += some
        if (best != np.iinfo(np.uint64).max).all():
            return best
    for k in np.flatnonzero(best == np.iinfo(np.uint64).max).tolist():
        best[k] = (mix64(shingles, 1000 + k) >> np.uint64(16)).min() | np.uint64((size + k) << 48)
    return best


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set, band keys, and one byte of each coordinate."""
    steps = np.array([pow(0x9FB21C651E98DF25, k + 1, 1 << 64) for k in range(rows)], np.uint64)

    def run(source):
        for batch in batches(source, "text"):
            sets = shingle_sets(batch.column("text"), width)
            known: dict[bytes, tuple] = {}
            digests, keys, bytes_ = [], [], []
            for s in sets:
                digest = _digest(s)
                if digest not in known:
                    if s.size:
                        c = sketch(s, bands * rows)
                        key = mix64((mix64(c, 5).reshape(bands, rows) * steps).sum(1) + mix64(np.arange(bands), 11))
                        known[digest] = key.view(np.int64), (mix64(c, 13) & np.uint64(255)).astype(np.uint8).tobytes()
                    else:
                        known[digest] = None, None
                digests.append(digest)
                keys.append(known[digest][0])
                bytes_.append(known[digest][1])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([s.size for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary()),
            ], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets have that similarity or more."""
    least, most = sorted((a.size, b.size))
    if 100 * least < similarity * most:
        return False
    both = np.sort(np.concatenate([a, b]))
    same = int((both[1:] == both[:-1]).sum())
    return same > 0 and 100 * same >= similarity * (a.size + b.size - same)


def _links_of(i: np.ndarray, j: np.ndarray, component: np.ndarray, sets: pa.ChunkedArray, similarity: int) -> list[tuple[int, int]]:
    """Tries the pairs in order, but none inside what is linked already."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    made: dict[int, np.ndarray] = {}

    def own(k: int) -> np.ndarray:
        if k not in made:
            made[k] = np.frombuffer(sets[k].as_buffer(), np.uint64)
        return made[k]

    found = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = root(int(component[a])), root(int(component[b]))
        if x != y and _similar(own(a), own(b), similarity):
            above[max(x, y)] = min(x, y)
            found.append((a, b))
    return found


def _compare(members: DataFrame, mode: str, least: float, similarity: int = SIMILARITY) -> DataFrame:
    """Pairs of classes (x, y) of different components that share a bucket and agree in ``least`` coordinates.

    ``members``: key, block, of_a, of_b (the two blocks that meet), node, component, links, sketch.  In mode "earlier"
    every x has its most similar partner before it, and a partner that is in no such pair comes as an x without y; in
    mode "hub" every x has the partner with the most links.  In mode "all", with the columns bands and shingles too,
    all pairs are tried on the spot and links come that join what was apart.
    """

    def pairs(t: pa.Table):
        n = t.num_rows
        if not n:
            return
        key, own, a, b, node, comp, links = (np.asarray(t.column(c)) for c in ("key", "block", "of_a", "of_b", "node", "component", "links"))
        marks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        firsts = np.flatnonzero(new)
        end = np.append(firsts[1:], n)[np.cumsum(new) - 1]
        best, mate, met = np.zeros(n), np.full(n, -1), np.zeros(n, bool)
        if mode == "all":
            bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(n, -1)
        xs, ys, values = [], [], []
        rows, lag = np.arange(n), 1
        while True:
            rows = rows[rows + lag < end[rows]]
            if not rows.size:
                break
            i = rows[(comp[rows] != comp[rows + lag]) & ((own[rows] != own[rows + lag]) | (a[rows] == b[rows]))]
            agreed = (marks[i] == marks[i + lag]).mean(1) if i.size else np.zeros(0)
            i, agreed = i[agreed >= least], agreed[agreed >= least]
            j = i + lag
            met[i] = met[j] = True
            if mode == "all":
                here = bands[i, (bands[i] == bands[j]).argmax(1)] == key[i] if i.size else np.zeros(0, bool)
                xs.append(j[here]), ys.append(i[here]), values.append(agreed[here])
            for x, y in ((j, i), (i, j))[: {"earlier": 1, "hub": 2, "all": 0}[mode]]:
                value = agreed + (links[y] if mode == "hub" else 0)
                up = value > best[x]
                best[x[up]], mate[x[up]] = value[up], y[up]
            lag += 1
        if mode == "all":
            i, j, agreed = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ys, xs, values))
            likely = np.argsort(-agreed, kind="stable")
            found = _links_of(i[likely], j[likely], comp, t.column("shingles"), similarity)
            y, x = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        else:
            x, y = np.flatnonzero(mate >= 0), mate[mate >= 0]
        out = [(node[x], pa.array(node[y]), best[x])]
        if mode == "earlier":
            alone = np.unique(node[met & (mate < 0)])
            out.append((alone, pa.nulls(alone.size, pa.int64()), np.zeros(alone.size)))
        for x, y, value in out:
            for k in range(0, x.size, 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]), y[k : k + 50_000], pa.array(value[k : k + 50_000])], names=["x", "y", "value"])

    def run(source):
        held: list[pa.RecordBatch] = []
        for batch in source:
            held.append(batch)
            t = pa.Table.from_batches(held)
            if t.num_rows < 4096 and t.nbytes < 16_000_000:
                continue
            key = [np.asarray(t.column(c)) for c in ("key", "of_a", "of_b")]
            same = np.logical_and.reduce([k == k[-1] for k in key])
            cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from pairs(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    dealt = members.repartition("key", "of_a", "of_b").sortWithinPartitions("key", "of_a", "of_b", "node")
    found = dealt.mapInArrow(run, "x long, y long, value double")
    if mode == "all":
        return found.select(F.col("x").alias("a"), F.col("y").alias("b"))
    return found.groupBy("x").agg(F.max(F.struct("value", "y"))["y"].alias("y"))


def _members(band_rows: DataFrame, classes: DataFrame, labels: DataFrame | None, links: DataFrame | None, block: int) -> DataFrame:
    """Rows of the buckets that hold several components, dealt to pairs of blocks."""
    rows = band_rows.withColumns({"component": F.col("node"), "links": F.lit(0).cast("long")})
    if labels is not None:
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        known = labels.join(degree, "node", "left")
        rows = band_rows.join(known, "node", "left").withColumns({"component": F.coalesce("component", "node"), "links": F.coalesce("links", F.lit(0).cast("long"))})
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "n")
    rows = rows.join(mixed, "key").join(classes, "node")
    blocks = F.ceil(F.col("n") / block)
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("key", "block", F.least("block", "other").alias("of_a"), F.greatest("block", "other").alias("of_b"), "node", "component", "links", *(c for c in classes.columns if c != "node"))


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The full shingle sets of the documents ``nodes``."""

    def run(source):
        for batch in batches(source, "text"):
            found = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "shingles"])

    wanted = docs.select("doc_id", "text").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return written(wanted.mapInArrow(run, "node long, shingles binary"), "sets")


def _linked(sets: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda n, s: sets.select(F.col("node").alias(n), F.col("shingles").alias(s))
    both = pairs.join(side("x", "sx"), "x").join(side("y", "sy"), "y")

    def close(source):
        for batch in source:
            keep = [_similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), similarity) for pair in zip(batch.column("sx"), batch.column("sy"))]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("x", "y", "sx", "sy").mapInArrow(close, "a long, b long"), "links")


def _shared_ids(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a doc_id that stands for several texts."""
    named = base.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest").join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    several = named.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("doc_id", "least")
    return named.join(several, "doc_id").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, least_agreed: float = LEAST_AGREED,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is the component's), one row per row."""
    base = written(sketched(docs, width, bands, rows), "sketches")
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
    )
    classes = written(classes, "classes")
    band_rows = classes.select("node", F.explode("bands").alias("key"))
    marks = classes.select("node", "sketch")
    first = written(_compare(_members(band_rows, marks, None, None, block), "earlier", least_agreed), "pairs")
    sets = _sets(docs, first.select(F.col("x").alias("node")), width)
    links = _linked(sets, first.where("y is not null"), similarity)
    labels = components(links.union(_shared_ids(base, classes)))

    def join_up(more: DataFrame) -> DataFrame:
        return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    pairs = written(_compare(_members(band_rows, marks, labels, links, block), "hub", least_agreed), "pairs")
    more = _linked(sets, pairs, similarity)
    labels = join_up(more)
    whole = classes.select("node", "sketch", "bands").join(sets, "node")  # only who has a partner
    apart = _members(band_rows.join(sets.select("node"), "node", "left_semi"), whole, labels, links.union(more), block)
    labels = join_up(written(_compare(apart, "all", least_agreed, similarity), "links"))
    named = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id (null last), all columns.

    Rows are told apart by a 64-bit hash of doc_id and text, so rows that share a doc_id don't share a fate, and
    rows without doc_id are in groups as any other; rows equal in both stay or go together.
    """
    row = F.xxhash64("doc_id", "text").alias("h")
    found = near_duplicates(docs.select(row.alias("doc_id"), "text"), **options)
    groups = written(found.select(F.col("doc_id").alias("h"), F.col("component_id").alias("group")).distinct(), "groups")
    several = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    members = groups.join(several, "group").join(docs.select(row, "doc_id").distinct(), "h")
    stays = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))["h"].alias("stays"))
    gone = members.join(stays, "group").where("h <> stays").select("h").distinct()
    return docs.withColumn("_row", row).join(gone.withColumnRenamed("h", "_row"), "_row", "left_anti").select(*docs.columns)
