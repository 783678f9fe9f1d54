"""Greedy one-to-one matching of a source's annotations and candidates, without their pairs.

Annotations take, in order, their best free candidate.  What a run of annotations takes from a set of candidates
has two properties that let the work be dealt out.  A candidate that is not taken from a set is not taken from any larger
one either, so each part of a source's candidates may be reduced to what the annotations would take from it alone, and
parts are reduced again together, to the same result as the whole.  And later annotations never
disturb earlier ones, so annotations go in blocks, each on what the blocks before left.

A task holds one block of annotations (``BLOCK``) and one part of a source's candidates (``PART``), or several small ones; it
finds shared seconds with numpy and emits one row an annotation at most.  A source takes as many rounds as it has
blocks of annotations, and in a round its number of parts shrinks ``FAN``-fold at a time; sources and groups go side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clipsieve.operators.ranking import rank_per_group
from clipsieve.session import cut_lineage

BLOCK = 4_096
PART = 16_384
FAN = 4
#: Rows that a task is dealt on average, and the tasks among which the groups of one source are spread.
TASK_ROWS = 50_000
GROUP_SPREAD = 16


def take_in_order(starts: np.ndarray, ends: np.ndarray, c_starts: np.ndarray, c_ends: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Place of an annotation, place of the candidate it takes, shared seconds.

    Annotations come in their order, candidates with the one that wins a tie first.
    """
    c_starts = c_starts.copy()
    for k in range(len(starts)):
        shared = np.minimum(c_ends, ends[k]) - np.maximum(c_starts, starts[k])
        best = int(shared.argmax())
        if shared[best] > 0:
            yield k, best, float(shared[best])
            c_starts[best] = np.inf


def _reduced(annotations: DataFrame, candidates: DataFrame, group: list[str], tasks: int) -> DataFrame:
    """What each part's annotations take: group, source, part, ann_index and the candidate with the shared seconds.

    ``annotations``: source, ann_index, start, end.  ``candidates``: group, source, part, cand_rank, cand_start, cand_end, cand_score.
    """
    spread = F.pmod(F.xxhash64(*group), F.lit(GROUP_SPREAD)) if group else F.lit(0).cast("long")
    parts = candidates.withColumn("_spread", spread)
    task = lambda part, spread: F.pmod(F.xxhash64("source", part, spread), F.lit(tasks))
    places = parts.select("source", F.col("part").alias("of_part"), F.col("_spread").alias("of_spread")).distinct()
    left = annotations.join(places, "source").withColumn("_own_task", task("of_part", "of_spread"))
    right = parts.withColumn("_task", task("part", "_spread"))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    columns = [*group, "source", "part", "cand_rank", "cand_start", "cand_end", "cand_score"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "ann_index long", "overlap double"])

    keys = ["source", "part", "_spread", *group]

    def run(ann: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        ann = ann.sort_values(["source", "of_part", "of_spread", "ann_index"], kind="stable")
        order = [True] * len(keys) + [False, True]
        cand = cand.sort_values([*keys, "cand_score", "cand_rank"], ascending=order, na_position="last", kind="stable")
        own = {key: (at[0], at[-1] + 1) for key, at in ann.reset_index(drop=True).groupby(["source", "of_part", "of_spread"]).indices.items()}
        spans, cuts = ([x[c].to_numpy(float) for c in names] for x, names in ((ann, ("start", "end")), (cand, ("cand_start", "cand_end"))))
        number = cand.groupby(keys, sort=False).ngroup().to_numpy()
        firsts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if number.size else number
        places = list(zip(*(cand[c].to_numpy()[firsts] for c in keys[:3])))
        rows: list[int] = []
        mine: list[int] = []
        seconds: list[float] = []
        for place, lo, hi in zip(places, firsts.tolist(), [*firsts[1:].tolist(), len(cand)]):
            if place in own:
                first, end = own[place]
                for k, best, shared in take_in_order(*(x[first:end] for x in spans), *(x[lo:hi] for x in cuts)):
                    rows.append(lo + best), mine.append(first + k), seconds.append(shared)
        return cand.iloc[rows][columns].assign(ann_index=ann["ann_index"].to_numpy()[mine], overlap=np.array(seconds, float))

    return left.groupBy("_own_task").cogroup(right.groupBy("_task")).applyInPandas(run, schema)


def greedy_pairs(annotations: DataFrame, candidates: DataFrame, group: list[str] = ()) -> DataFrame:
    """Group, ann_index, cand_rank and overlap of every match.

    ``annotations`` (source, ann_index, start, end) serve every group; ``candidates`` (group, source, rank, start, end, score) are told
    apart by group and rank.  Of equally shared seconds the higher score wins, then the lower rank.
    """
    group = list(group)
    annotations = annotations.select("source", "ann_index", "start", "end").where("end > start")
    free = candidates.where("end > start").select(
        *group, "source", F.col("rank").alias("cand_rank"), F.col("start").alias("cand_start"), F.col("end").alias("cand_end"), F.col("score").alias("cand_score"),
    ).join(annotations.select("source").distinct(), "source", "left_semi")
    free = cut_lineage(free)
    per_source = free.groupBy(*group, "source").agg(F.count("*").alias("n"))
    parts, rows = per_source.agg(F.max(F.ceil(F.col("n") / PART)), F.sum("n")).first()
    most, n_annotations = annotations.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if not rows or not most:
        return free.select(*group, F.lit(0).cast("long").alias("ann_index"), "cand_rank", F.lit(0.0).alias("overlap")).limit(0)
    tasks = max(free.sparkSession.sparkContext.defaultParallelism, -(-(rows + n_annotations) // TASK_ROWS))
    blocks = -(-most // BLOCK)
    if blocks > 1:
        numbered = rank_per_group(annotations, ["source"], [F.asc("ann_index")], "_n")
        annotations = cut_lineage(numbered.withColumn("block", F.floor((F.col("_n") - 1) / BLOCK)).drop("_n"))
    if parts > 1:
        split = F.pmod(F.xxhash64("cand_rank"), F.ceil(F.col("n") / PART))
        free = free.join(per_source, [*group, "source"]).withColumn("part", split).drop("n")
    else:
        free = free.withColumn("part", F.lit(0).cast("long"))
    done = None
    for block in range(blocks):
        own = annotations.where(F.col("block") == block).drop("block") if blocks > 1 else annotations
        taken, left = _reduced(own, free, group, tasks), parts
        while left > 1:
            left = -(-left // FAN)
            again = cut_lineage(taken).drop("ann_index", "overlap").withColumn("part", F.floor(F.col("part") / FAN))
            taken = _reduced(own, again, group, tasks)
        found = cut_lineage(taken.select(*group, "ann_index", "cand_rank", "overlap"))
        done = found if done is None else done.unionByName(found)
        if block + 1 < blocks:
            later = annotations.where(F.col("block") > block).select("source").distinct()
            free = cut_lineage(free.join(found, [*group, "cand_rank"], "left_anti").join(later, "source", "left_semi").select(*free.columns))
    return done
