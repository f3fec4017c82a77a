"""The queries opN_<name>: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _frame, curriculum, decontaminate, langid, linededup, lm, minhash, reshard, substring_dedup, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_shared_blocks(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "spans", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = reshard.listing(reshard.reshard(_table(spark, sf_dir, "documents"), _frame.temporary_folder(spark, "shards")))
    return written.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes", F.round("position", 6).alias("position"))


OP5_SQL = r"""
WITH RECURSIVE sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM sizes GROUP BY source),
wsrc AS (SELECT *, (CASE rnk % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM src),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS t FROM wsrc),
levels AS (SELECT a.cap / a.w AS r, (t - coalesce((SELECT sum(b.cap) FROM wsrc b WHERE b.cap / b.w < a.cap / a.w), 0)) / (SELECT sum(b.w) FROM wsrc b WHERE b.cap / b.w >= a.cap / a.w) AS level FROM wsrc a, total),
chosen AS (SELECT level FROM levels WHERE level <= r ORDER BY r LIMIT 1),
plan AS (SELECT source, source_size, rnk, least(cap, coalesce((SELECT level FROM chosen), 0) * w) AS target FROM wsrc),
rows_ AS (SELECT s.*, p.source_size, p.rnk, p.target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
due AS (SELECT *, CASE WHEN size > 0 AND off < floor(target) THEN least(size, floor(target)::BIGINT - off) ELSE 0 END AS t1, CASE WHEN size > 0 AND source_size + off < floor(target) THEN least(size, floor(target)::BIGINT - source_size - off) ELSE 0 END AS t2 FROM rows_)
SELECT doc_id, size, source_size, target, (t1 + t2)::BIGINT AS taken, ((t1 > 0)::INT + (t2 > 0)::INT)::INT AS passes,
 CASE WHEN t1 > 0 THEN round(CASE rnk % 3 WHEN 0 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * (off / target)) - 0.5::DOUBLE) / 1.0::DOUBLE WHEN 1 THEN (sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * (off / target))) - 1.5::DOUBLE) / -1.0::DOUBLE ELSE off / target END, 6) + 0.0::DOUBLE END AS position
FROM due
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, _table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest AS pd, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON pd = payload_digest
"""


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_lm_scoring, op3_language_id, op4_flow_resharding, op5_curriculum_mixing, op6_warc, op7_exact_top_k, op8_benchmark_decontamination, op9_minhash_near_dedup, op10_substring_dedup)}
ORACLES: dict[str, str] = {"op5_curriculum_mixing": OP5_SQL, "op6_warc": OP6_SQL, "op7_exact_top_k": OP7_SQL}
