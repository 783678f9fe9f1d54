"""Parsers, documents and scalar functions on literal inputs."""

import random
import re

import pytest
from pyspark.sql import Row, functions as F

from clipsieve import schemas
from clipsieve.functions import scalars as S
from clipsieve.operators import ai, signals as G
from clipsieve.sources import documents as D, logs as L, media as M, transcripts as X
from clipsieve.sources.identity import resolve_sources
from clipsieve.streaming import incremental as N


def lines(spark, text):
    return L.split_lines(spark.createDataFrame([("f", text)], "source string, value string"))


def test_logs(spark):
    scenes = L.parse_scene_log(lines(spark, "n:0 pts_time:1.25 x\nn:1 pts_time:3.5 x"))
    assert sorted(r.time for r in scenes.collect()) == [1.25, 3.5]
    durations = spark.createDataFrame([("f", 10.0)], "source string, duration double")
    text = "silence_start: 2.1\nsilence_end: 4.6\nsilence_end: 5\nsilence_start: 6\nsilence_start: 7.5"
    assert sorted((r.start, r.end) for r in L.parse_silence_log(lines(spark, text), durations).collect()) == [(2.1, 4.6), (7.5, 10.0)]
    key = "lavfi.astats.Overall.RMS_level="
    levels = L.parse_level_log(lines(spark, f"{key}-3\npts_time:0\n{key}-40.5\npts_time:1\n{key}-12.25\n{key}-inf\n{key}oops"))
    assert sorted((r.time, r.rms_db) for r in levels.collect()) == [(0.0, -40.5), (1.0, -120.0), (1.0, -12.25)]


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of some dozens of bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "90b", "spark.sql.files.openCostInBytes": "1b"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def test_logs_in_splits(spark, tmp_path, small_splits):
    """A log read in many splits gives the rows that it gives as one text."""
    rng = random.Random(1)
    texts = {}
    for name in ("a.log", "b.log", "deep/c.log", "empty.log"):
        out = []
        for k in range(0 if name == "empty.log" else 60):
            out.append(rng.choice([f"silence_start: {k}.5", f"silence_end: {k}.25", f"n:1 pts_time:{k}.125 x", "lavfi.astats.Overall.RMS_level=-%d" % k, "", "é" * k]))
        texts[name] = rng.choice(["\n", "\r\n"]).join(out)
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(texts[name].encode())
    read = L.log_lines(spark, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/a.log", lineSep="\n").select("_metadata.file_block_start").distinct().count() >= 8
    got = sorted((r.source.split(f"{tmp_path}/")[1], r.line_no, r.line) for r in read.collect())
    assert got == sorted((n, k, x) for n, t in texts.items() if t for k, x in enumerate(re.split("\r?\n", t)) if x or k < 59)
    whole = L.split_lines(spark.createDataFrame([(f"file:{tmp_path}/{n}", t) for n, t in texts.items()], "source string, value string"))
    for parse in (L.parse_scene_log, L.parse_silence_log, L.parse_level_log):
        rows = lambda df: sorted(map(tuple, parse(df).collect()))
        assert rows(read) == rows(whole) != []
    (tmp_path / "l_7.txt").write_text("\n".join(f"{k} 0.5 0.5 0.2 0.4 0.9" for k in range(40)))
    labels = D.label_file_lines(spark, str(tmp_path)).collect()
    assert sorted((r.line, r.text.split(" ")[0]) for r in labels) == [(k, str(k)) for k in range(40)]


CUE = re.compile(r"(?s)(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})[^\n]*\n(.*?)(?=\n\s*\n|\Z)", re.ASCII)


def cues_brute(text):
    found = CUE.findall(text.replace("\r\n", "\n"))
    return [(k, a, re.sub("<[^>]+>", "", body).replace("\n", " ").strip(" ")) for k, (a, _, body) in enumerate(found)]


def test_cues_are_those_of_one_pattern_over_the_text(spark, tmp_path, small_splits):
    """Clock lines, blank lines and words in any order, in chunks of any width and files of any number of splits."""
    rng = random.Random(8)
    parts = ["00:00:%02d,000 --> 00:00:59.500 align:start", "x 00:00:%02d.250-->00:00:59,000", "", "", " ", "\t", "words %d", "<i>tag %d", "end</i>", "1"]
    texts = ["\n".join(p % k if "%" in p else p for k, p in enumerate(rng.choices(parts, k=rng.randrange(0, 40)))) for _ in range(60)]
    texts += ["", "00:00:01,000 --> 00:00:02,000", "00:00:01,000 --> 00:00:02,000\n", "00:00:01,000 --> 00:00:02,000\n\nlate\r\n\r\nout"]
    files = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "source string, content string")
    for width in (3.0, 4096.0):
        cues = X.parse_cue_lines(L.split_lines(files, "content"), width).collect()
        got = sorted((r.source, r.cue_index, int(r.start), r.text) for r in cues)
        assert got == sorted((f"f{k}", i, int(a[6:8]), body) for k, t in enumerate(texts) for i, a, body in cues_brute(t))
    long = "\n".join(t for t in texts[:40]) + "\nlast words"
    (tmp_path / "long.srt").write_text(long)
    cues = X.parse_cue_lines(L.numbered_lines(spark, str(tmp_path))).collect()
    assert sorted((r.cue_index, int(r.start), r.text) for r in cues) == [(i, int(a[6:8]), body) for i, a, body in cues_brute(long)]


def test_silence_from_levels(spark):
    rows = [("a", float(t), db) for t, db in enumerate([-10, -50, -50, -50, -10, -50, -10, -60, -60])]
    got = L.silence_from_levels(spark.createDataFrame([(s, t, float(d)) for s, t, d in rows], schemas.LEVELS), -30.0, 2.0)
    assert [(r.start, r.end) for r in got.collect()] == [(1.0, 4.0)]


def test_cues_and_hits(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:03,500\r\n<i>What a</i>\r\nPASS\r\n\r\n2\r\n00:00:05.000 --> 00:00:06.000\r\nnothing\r\n"
    cues = X.parse_cues(spark.createDataFrame([("a", srt)], "source string, content string"))
    assert [(r.start, r.end, r.text) for r in cues.orderBy("cue_index").collect()] == [(1.0, 3.5, "What a PASS"), (5.0, 6.0, "nothing")]
    hits = X.transcript_hits(cues, ["wow", "Pass"]).collect()
    assert len(hits) == 1 and hits[0].keywords == ["pass"]
    doc = spark.createDataFrame([("a", "x" * 600 + " win", 60.0)], "source string, text string, duration double")
    hit = X.text_transcript_hits(doc, ["win"]).first()
    assert hit.end == 20.0 and hit.text == "x" * 600 + " win" and len(X.text_transcript_hits(doc, ["win"], shown=500).first().text) == 500


def test_probe(spark):
    docs = [("/m/a.mp4", '{"format": {"size": "1048576", "duration": "12.3456"}, "streams": [{"codec_type": "video", "width": 1920, "height": 1080, "codec_name": "h264", "r_frame_rate": "30000/1001"}, {"codec_type": "audio"}]}'), ("/m/b.mp4", "{oops")]
    rows = {r.filename: r for r in M.parse_probe_json(spark.createDataFrame(docs, "filepath string, content string")).collect()}
    assert (rows["a.mp4"].size_mb, rows["a.mp4"].duration, rows["a.mp4"].fps, rows["a.mp4"].has_audio) == (1.0, 12.346, 29.97, True)
    assert rows["b.mp4"].status == "error"


def test_detections(spark):
    texts = [("/r/clip_1.txt", 0, "0 0.5 0.5 0.2 0.4 0.91"), ("/r/clip_1.txt", 1, "2 0.4 0.5 0.3 0.3 0.77"), ("/r/clip_31.txt", 0, "0 0.6 0.5 0.2 0.4 0.82"), ("/r/clip_31.txt", 1, "0 bad 1 1 1")]
    df = spark.createDataFrame([("a", *t) for t in texts], "source string, label_file string, line int, text string")
    media = spark.createDataFrame([("a", 30.0, 2.0)], "source string, fps double, duration double")
    found = D.parse_detections(df, media)
    assert found.count() == 3
    assert {r.class_name: r["count"] for r in G.class_summary(found).collect()} == {"person": 2, "car": 1}
    assert len(G.detection_segments(found, media, 1.0, width=0.5).collect()) == 2  # 0 s and 1 s are within the gap
    assert len(G.detection_segments(found, media, 0.5, width=0.5).collect()) == 3


def test_events_and_topics(spark):
    schema = "id string, source string, start double, end double, score int, labels array<string>, reasons array<string>"
    c = spark.createDataFrame([("clip_0001", "a", 0.0, 5.0, 80, [], ["inside pass"]), ("clip_0002", "a", 6.0, 9.0, 70, [], ["spin after contact"])], schema)
    assert {(r.id, r.event_type) for r in G.detect_events(c).collect()} == {("clip_0001", "pass"), ("clip_0002", "incident")}
    quiet = spark.createDataFrame([("x", "a", 0.0, 5.0, 80, ["object_car", "audio_spike"], [])], schema)
    assert G.detect_events(quiet).first().event_type == "vehicle_action"
    hits = spark.createDataFrame([("a", "clean inside pass", ["pass"]), ("a", "a big crash, bypassed", [])], "source string, text string, keywords array<string>")
    assert {r.topic: r["count"] for r in G.topic_clusters(hits).collect()} == {"racecraft": 1, "incidents": 1}


def test_selection_errors(spark):
    doc = '{"source": "m.mp4", "clips": [{"start": "00:00:01", "end": "00:00:03"}, {"start": 5, "end": 4}, {"source": "mixed", "start": 1, "end": 2}, {"start_seconds": 1.5}]}'
    rows = D.load_selection(spark.createDataFrame([("p", doc)], schemas.DOCUMENTS)).orderBy("clip_index").collect()
    assert [r.error for r in rows] == [None, "non-positive duration", "missing source", "missing end"]
    assert rows[0].label == "clip_001" and rows[0].fps == 30.0


def test_signal_documents_are_given_once(spark):
    docs = spark.createDataFrame([], schemas.DOCUMENTS)
    with pytest.raises(ValueError):
        D.load_signals({"face-person": docs, "face_person_presence": docs}, spark.createDataFrame([], "source string"))


def test_basename_resolution(spark):
    known = spark.createDataFrame([("/m/a.mp4",), ("/m/x/b.mp4",), ("/m/y/b.mp4",)], "source string")
    left = spark.createDataFrame([("/other/a.mp4",), ("elsewhere/b.mp4",), ("x/b.mp4",), (None,)], "source string")
    got = {r.source: r.canonical_source for r in resolve_sources(left, known, ["/m"]).collect()}
    assert got == {"/other/a.mp4": "/m/a.mp4", "elsewhere/b.mp4": "elsewhere/b.mp4", "x/b.mp4": "/m/x/b.mp4", None: None}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(S.hhmmss(F.lit(3725.9))) == "01:02:05"
    assert value(S.timecode(F.lit(1.999), 30.0)) == "00:00:01:00"
    assert [value(S.seconds_of(F.lit(t))) for t in ("01:00:02.5", "00:01:01:29", "7.25", "x")] == [3602.5, 61.0, 7.25, None]
    assert value(S.slug(F.lit("Traffic Light!"))) == "traffic_light" and value(S.slug(F.lit("--"))) == "object"
    assert value(S.path_key(F.lit("a\\b/../c//d/."))) == "a/c/d" and value(S.basename(F.lit("C:\\x\\y.mp4"))) == "y.mp4"
    assert [value(S.round_score(F.lit(v))) for v in (2.5, 3.5, 55.49)] == [2, 4, 55]
    assert value(S.matched_keywords(F.lit("a_pass bypass, lap1 pit lane"), ["pass", "lap", "pit lane"])) == ["pass", "pit lane"]
    assert value(S.sigmoid(F.lit(60.0))) == 1.0


def test_frames_and_missed_moments(spark):
    vectors = spark.createDataFrame([("a", 1.0, [1.0, 0.0])], "source string, time double, vector array<float>")
    prompts = spark.createDataFrame([("p", "x", "lx", "tx", "i", [1.0, 0.0]), ("p", "y", "ly", "ty", "i", [0.0, 1.0])], schemas.PROMPT_VECTORS)
    scored = ai.score_frames(vectors, prompts, profile="p").first()
    assert scored.top_score == 1.0 and scored.labels == ["lx"]
    schema = f"frame_id string, source string, time double, top_score double, labels array<string>, prompt_scores array<{schemas.PROMPT_SCORE}>, explanation string"
    p = lambda s: [Row(id="q", label="l", prompt="t", intent="i", score=s)]
    frames = spark.createDataFrame([(f"f{t}", "a", t, s, l, p(s), f"r{t}") for t, s, l in ((12.0, 0.99, ["k"]), (31.0, 0.91, ["u"]), (33.0, 0.88, ["v"]), (60.0, 0.1, ["w"]))], schema)
    c = spark.createDataFrame([(1, "clip_0001", "a", 10.0, 20.0, 90, "select", []), (2, "clip_0002", "a", 30.0, 35.0, 40, "cut", [])], "rank long, id string, source string, start double, end double, score int, action string, labels array<string>")
    rows = ai.missed_moments(frames, c).collect()
    assert len(rows) == 1
    m = rows[0]
    assert (m.id, m.start, m.end, m.confidence, m.labels, m.existing_candidate.id) == ("missed_0001", 29.0, 37.0, 0.91, ["u", "v"], "clip_0002")
    assert m.reason == "r31.0; r33.0" and len(m.prompt_matches) == 1


def test_prompt_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([("a", 1.0, [1.0, 0.2]), ("a", 2.0, [0.1, 1.0])], "source string, time double, vector array<float>")
    prompts = spark.createDataFrame([("p", f"x{i}", f"l{i}", "t", "i", [1.0, i * 0.02]) for i in range(5)], schemas.PROMPT_VECTORS)
    rows = lambda: sorted((r.time, r.top_score, tuple(p.id for p in r.prompt_scores)) for r in ai.score_frames(vectors, prompts, profile="p").collect())
    whole = rows()
    monkeypatch.setattr(ai, "PROMPT_BLOCK", 2)
    assert rows() == whole


def test_incremental(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, "t1"), ("b", 2, "t2")], "path string, length long, modificationTime string")
    state = str(tmp_path / "state")
    key = N.analysis_key(__import__("clipsieve.config", fromlist=["x"]).ScoringConfig())
    todo = N.incremental_sources(files, N.read_state(spark, state), key)
    assert todo.count() == 2
    N.record_processed(todo.where("path = 'a'"), state, 1)
    assert [r.path for r in N.incremental_sources(files, N.read_state(spark, state), key).collect()] == ["b"]
    changed = files.withColumn("length", F.col("length") + 1)
    assert N.incremental_sources(changed, N.read_state(spark, state), key).count() == 2


def test_state_survives_repeated_and_killed_batches(spark, tmp_path):
    """A batch run twice, one killed halfway and compaction leave the state of a plain run."""
    def files(*rows):
        return spark.createDataFrame(rows, "path string, signature string")

    def seen(path):
        return sorted(tuple(r) for r in N.read_state(spark, path).collect())

    plain, rough = str(tmp_path / "plain"), str(tmp_path / "rough")
    batches = [files(("a", "1"), ("b", "1")), files(("a", "2"), ("c", "1")), files(("d", "1"), ("b", "2"))]
    assert seen(plain) == [] and N.last_batch(spark, plain) == 0
    for n, rows in enumerate(batches, 1):
        N.record_processed(rows, plain, n)
    want = [("a", "2"), ("b", "2"), ("c", "1"), ("d", "1")]
    assert seen(plain) == want
    for n, rows in enumerate(batches, 1):
        # What a killed run of the batch left: some of its rows, and none of its commit.
        files(("a", "killed"), ("z", "killed")).withColumn("batch", F.lit(n).cast("long")).write.parquet(f"{rough}/rows/batch-{n}")
        before = seen(rough)
        assert "killed" not in str(before)
        N.record_processed(rows, rough, n)
        N.record_processed(rows, rough, n)
        if n == 2:
            N.compact(spark, rough)
            N.compact(spark, rough)
            N.record_processed(batches[0], rough, 1)
            assert seen(rough) == [("a", "2"), ("b", "1"), ("c", "1")]
    assert seen(rough) == want and N.last_batch(spark, rough) == 3
    N.compact(spark, rough)
    assert seen(rough) == want and spark.read.parquet(f"{rough}/rows/base-3").count() == 4


def test_media_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.MP4", "d/b.mov", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in M.scan_media(spark, str(tmp_path)).collect()) == ["a.MP4", "b.mov"]


def test_probes_of_large_user_numbers(spark, tmp_path):
    """Sizes in bytes beyond an int."""
    from checks import sources as Q

    users = [1500, 2200, 5_000_000_001]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(users)], "event_id long, user_id long")
    rows.selectExpr("*", "TIMESTAMP_NTZ'2024-01-02 00:00:00' AS ts", "'view' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.filepath: r.size_mb for r in Q.parse_probe_json(spark, str(tmp_path)).collect()}
    assert got == {f"user_{u}.mp4": round(u * 1_000_000 / 1048576, 2) for u in users}
    assert Q.build_inventory(spark, str(tmp_path)).first()["count"] == 3


def test_a_report_is_parsed_once(spark):
    text = '{"signals": [{"asset": {"filepath": "a"}, "scene_changes": [1.0, 2.0], "audio_levels": [{"time": 1.0, "rms_db": -3.0}]}], "candidates": [{"id": "c", "source": "a", "score": 5}]}'
    t = D.read_ratings(spark.createDataFrame([("r.json", text)], "path string, content string"))
    assert not any("from_json" in df._jdf.queryExecution().optimizedPlan().toString() for df in t.values())
    assert [t[n].count() for n in ("scenes", "levels", "candidates", "object_hits")] == [2, 1, 1, 0]
