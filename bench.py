"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is planned and run in full into a no-op sink, after one warm-up run, and the
median of ``$BENCH_RUNS`` runs counts.  Tables a query needs are computed inside its time, but for the
candidates that evaluate reads, which are made before.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from clipsieve.config import SHORT_REPORT, ScoringConfig
from clipsieve.operators import ai, evaluate as E, rating as R, signals as G, sweep as W
from clipsieve.plans import bridge as B, flows
from clipsieve.session import local_session
from clipsieve.sources import transcripts as X

CFG = ScoringConfig(**SHORT_REPORT)
WORDS = ("the", "that", "with", "zebra")


def rate(spark, sf):
    return [flows.rate(B.signals(spark, sf), CFG)]


def rate_all(spark, sf):
    return [R.ranked_candidates(B.signals(spark, sf), B.FULL)]


def evaluate(spark, sf):
    e = E.evaluate(B.annotations(spark, sf), B.candidates(spark, sf))
    return [e.matches, e.missed, e.false_positives, e.metrics]


def sweep(spark, sf):
    return [W.sweep_scoring(B.signals(spark, sf), B.annotations(spark, sf), CFG)]


def frames(spark, sf):
    return [ai.score_frames(B.frame_vectors(spark, sf), B.prompt_vectors(spark, sf), profile="bank")]


def spikes(spark, sf):
    return [R.audio_spikes(B.levels(B.events(spark, sf)), 85.0, -35.0)]


def topics(spark, sf):
    hits = X.transcript_hits(B.cues(spark, sf), WORDS)
    return [G.topic_clusters(hits)]


def documents(spark, sf):
    from pyspark.sql import functions as F

    docs = B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text", F.lit(60.0).alias("duration"))
    return [X.text_transcript_hits(docs, WORDS)]


QUERIES = {
    "C6_rate": rate, "W4_rank_all": rate_all, "A6_evaluate": evaluate, "A11_sweep_scoring": sweep, "L5_score_frames": frames,
    "A2_audio_spikes": spikes, "A14_topic_clusters": topics, "S11_text_transcript_hits": documents,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=8, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    B.candidates(spark, sf_dir).count()  # the table that evaluate reads
    wanted = sys.argv[1:] or list(QUERIES)
    times = {}
    for name in wanted:
        took = []
        for _ in range(runs + 1):
            started = time.time()
            for df in QUERIES[name](spark, sf_dir):
                df.write.format("noop").mode("overwrite").save()
            took.append(time.time() - started)
        times[name] = round(statistics.median(took[1:]), 3)
        print(name, [round(t, 2) for t in took], file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
