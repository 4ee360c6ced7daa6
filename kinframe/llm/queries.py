"""The registered queries of this subpackage; each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, language, mixing, neardup, pieces, repeats, secrets, sharding, telephony, token_files, vectors, warc, whitening
from .common import stash, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = language.learn_dictionaries(docs.where(~language.held_out()))
    return language.identify(docs.select("doc_id", "text"), known).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts", "part", "seq", "previous_page")


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.features(telephony.store(table(spark, sf_dir, "documents"), work_dir(spark, "media")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(sharding.keyed_sizes(docs, "text"), shards=8)
    stored = stash(placed, f"{work_dir(spark, 'shards')}/documents")
    return sharding.measured(stored).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn_formats(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.checksums(token_files.read_documents(spark, path))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_language, op3_warc, op4_telephony, op5_mixing, op6_pieces, op7_vectors, op8_repeats, op9_sharding, op10_secrets, op11_filter_audit, op12_whitening, op13_token_files)}

#: The mixture and the filter audit in SQL. The other operators rest on compression, hashes of other kinds, files or search,
#: and are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM per),
leveled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
             - CAST(coalesce(sum(source_size) OVER (ORDER BY source_size * CAST(2 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * CAST(2 AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY source_size * CAST(2 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ranked),
targets AS (
  SELECT source, source_size, least(source_size * CAST(2 AS DOUBLE), max(level) OVER () * weight) AS target FROM leveled),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, row_number() OVER (PARTITION BY s.source, s.doc_id, s.digest) - 1 AS turn, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE CAST(0 AS DOUBLE) END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || coalesce(s.digest, '')), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(ceil((turn + 1) * rate - draw) - ceil(turn * rate - draw) AS BIGINT) * size AS taken FROM rated
""",
    "op11_filter_audit": r"""
WITH letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (
  SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders),
cut AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT c.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(c.doc_id > min(c.doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS failed
  FROM cut c LEFT JOIN labelled l ON c.doc_id = l.doc_id),
sets AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, failed),
met AS (
  SELECT part, filter_order, step, n, good, toxic, failed, substr(filter_order, step, 1) AS letter,
         contains(failed, substr(filter_order, step, 1)) AS here,
         step > 1 AND failed <> '' AND length(translate(failed, substr(filter_order, 1, step - 1), '')) < length(failed) AS before
  FROM sets, steps),
per AS (
  SELECT part, filter_order, step, letter,
         CAST(sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN here AND before THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM per
""",
}
