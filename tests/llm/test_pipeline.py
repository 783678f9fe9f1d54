import corpus_pipeline
from clipsieve.llm.queries import ORACLE, QUERIES


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]
    assert set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_stages_on_a_table(spark):
    from clipsieve.llm.common import table, written

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, folder), name)
        if name != "packing":
            assert out.columns == docs.columns
            ids = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        seen.append(out.count())
        docs = out
    assert seen[1] <= seen[0] and seen[2] <= seen[1] and seen[3] <= seen[2] and seen[5] >= seen[4] > 0


def test_stages_equal_brute_force_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns; then no rows at all."""
    from cases import clashing, documents, lower, rows
    from clipsieve.llm import mixing, toxicity
    from clipsieve.llm.common import table, written
    from test_dedup import kept_brute

    data = rows()
    docs = clashing(documents(spark, data))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(k, 1, int(k in (46, 47))) for k in range(60)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: sorted((repr((r["doc_id"], r["text"])) for r in df.collect()))

    first = written(stages["toxicity"](spark, docs, str(tmp_path)), "t")
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, str(tmp_path), "labels"))).collect()
    assert first.columns == docs.columns and first.count() == sum(r["predicted"] == 0 for r in scores)

    second = written(stages["exact_dedup"](spark, docs, str(tmp_path)), "e")
    best = {}
    for d in data:
        key = lower(d[1] or "")
        best[key] = max((x[0] for x in data if lower(x[1] or "") == key and x[0] is not None), default=None)
    assert kept(second) == sorted({repr((d[0], d[1])) for d in data if d[0] == best[lower(d[1] or "")]})

    third = stages["near_dedup"](spark, second, str(tmp_path))
    left = kept(third)
    groups = kept_brute([(r["doc_id"], r["text"]) for r in second.collect()]).values()
    assert len(left) == len(groups)
    assert all(repr(min(g, key=lambda m: (m[0] is None, m[0] or 0))) in left for g in groups)

    fourth = stages["mixing"](spark, docs, str(tmp_path))
    assert fourth.columns == docs.columns
    times = {}
    for r in mixing.mix(docs).collect():
        if r["size"]:
            times[r["doc_id"]] = times.get(r["doc_id"], 0) + r["taken"] // r["size"]
    copies = {}
    for r in fourth.where("text is not null and length(trim(text)) > 0").collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert all(copies.get(k, 0) == n for k, n in times.items())

    folder = tmp_path / "none"
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    marks.limit(0).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, str(folder)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
