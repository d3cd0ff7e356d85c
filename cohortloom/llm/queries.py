"""The operators as registered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import centroids, chat, collocations, embedding_dedup, exact_dedup, mixing, near_dedup, packing, secret_scan, sharding, token_counts, token_files, toxicity
from cohortloom.llm.shared import table

Job = Callable[[SparkSession, str], DataFrame]

SHARDS = 40


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), token_files.token_folder(spark), end_id=2)
    return token_files.read_tokens(manifest)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS).withColumn("law", F.lit("key"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op5_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.token_lengths(table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fm_index_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.render(chat.reconstruct(chat.events_of_turns(turns))))


def op13_walsh_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
"""

OP10_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM rows GROUP BY source),
stopped AS (
  SELECT source, source_size, weight, FALSE AS stop, 0 AS round FROM sources
  UNION ALL
  SELECT source, source_size, weight, stop OR 3 * source_size <= weight * level, round + 1 FROM (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (WHERE stop) OVER (), 0)) / CAST(sum(weight) FILTER (WHERE NOT stop) OVER () AS DOUBLE) AS level
    FROM stopped) WHERE round < 40),
targets AS (
  SELECT source, source_size, CASE WHEN stop THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target FROM (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (WHERE stop) OVER (), 0)) / CAST(sum(weight) FILTER (WHERE NOT stop) OVER () AS DOUBLE) AS level
    FROM stopped WHERE round = 40)),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE least(floor(t.target / t.source_size), 3) END AS whole,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * least(3, whole + CASE WHEN upto <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

QUERIES: dict[str, Job] = {
    job.__name__: job for job in (op1_token_files, op2_sharding, op3_toxicity, op4_bag_minhash, op5_randomness_battery, op6_best_two_fit, op7_itq, op8_exact_dedup, op9_token_counts, op10_mixing, op11_fm_index_collocations, op12_event_sourced_chat, op13_walsh_hadamard)
}
ORACLE: dict[str, str] = {"op8_exact_dedup": OP8_SQL, "op10_mixing": OP10_SQL, "op11_fm_index_collocations": collocations.SQL, "op12_event_sourced_chat": chat.SQL, "op13_walsh_hadamard": centroids.SQL}
