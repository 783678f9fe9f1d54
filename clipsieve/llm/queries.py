"""The registered queries of this subpackage, each an operator on its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipsieve.llm import compression, credentials, exact_dedup, filter_audit, grammar_output, hard_negatives, license_scan, line_labelling, line_templates, mixing, near_dedup, packing, toxicity
from clipsieve.llm.common import table, work_path


def op1_line_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_labelling.judge(docs, line_labelling.train(docs, table(spark, sf_dir, "labels")))


def op2_grammar_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "shards")
    grammar_output.write_shards(table(spark, sf_dir, "documents"), path)
    return grammar_output.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(table(spark, sf_dir, "documents"))


def op5_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression.score(docs, compression.train(docs, table(spark, sf_dir, "labels")))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_line_labelling, op2_grammar_output, op3_credential_linking, op4_line_templates, op5_large_item_packing, op6_license_windows,
    op7_similarity_sketching, op8_digest_index, op9_hash_threshold_mix, op10_positive_unlabelled,
    op11_compression_classifier, op12_filter_interactions, op13_shared_list_negatives, pipeline,
)}

ORACLE = {
    "op8_digest_index": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""",
    "op9_hash_threshold_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((n - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), f AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + most / w * sum(w) OVER (ORDER BY most / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= total AS full_ FROM w
), t AS (
  SELECT source, source_size, CASE WHEN full_ THEN most ELSE
    (total - sum(CASE WHEN full_ THEN most ELSE 0 END) OVER ()) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target FROM f
), e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), b AS (SELECT *, min(CASE WHEN upto > need THEN place END) OVER (PARTITION BY source) AS stop FROM r)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN stop IS NULL OR place < stop THEN 1 ELSE 0 END))::BIGINT AS taken FROM b
""",
    "op12_filter_interactions": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (SELECT doc_id, coalesce(max(quality), 0) AS good, coalesce(max(toxic), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (SELECT t AS text_, min(doc_id) AS least FROM d GROUP BY t
), p AS (
  SELECT part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > least THEN 16 ELSE 0 END AS pattern,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d JOIN m ON t = text_ LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (SELECT part, pattern, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM p GROUP BY part, pattern
), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN f e ON a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN pattern & (before + bit)::INT = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN pattern & before = 0 AND pattern & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN pattern & before > 0 AND pattern & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN pattern = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN pattern & before = 0 AND pattern & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN pattern & before = 0 AND pattern & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
""",
    "op13_shared_list_negatives": r"""
WITH v AS (
  SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5
), h AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3
""",
}
