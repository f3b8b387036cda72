"""The text operators applied to the given tables: one query each, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm import (audit, decontam, fingerprint, htmltext, jaccard, langid, linededup, packing, pii, pipeline,
                            sharding, simhash, veccode, warc)
from snapledger.storage import scratch_dir
from snapledger.workloads import Query, Workload, read

SHARDS = [f"shard-{n:03d}" for n in range(64)]


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"), "doc_id", "text")
    base = F.filter("spans", lambda x: x["base"])
    number = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("key").alias("doc_id"), *[number(kind) for kind in pii.BASE],
                        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(read(spark, sf_dir, "documents"), "doc_id", "text")


def web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(read(spark, sf_dir, "pages"), f"{scratch_dir(spark, 'warc')}/archives")
    return warc.read_records(index).select(
        F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return kept.select("doc_id", "removed", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("text", 256).alias("text_sha256"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"), "doc_id", "text")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(documents.where(~F.col("held_out")), key="doc_id", text="text", lang="lang")
    return (langid.predict_language(documents.select("doc_id", "held_out", "text"), model)
            .select("doc_id", "held_out", "lang_pred", "score"))


def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), key="doc_id", text="text",
                           item_key="item_id", item_text="text")
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (htmltext.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccode.compress(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), key="doc_id", text="text", part="lang",
                              label_key="doc_id", quality="quality", toxic="toxic")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {
    "op1_personal_data": personal_data,
    "op2_best_fit_packing": pack,
    "op3_similarity_join": similar,
    "op4_web_archive": web_archive,
    "op5_line_dedup": lines,
    "op6_fingerprint": fingerprints,
    "op7_language": language,
    "op8_sharding": shard,
    "op9_decontamination": benchmark_leaks,
    "op10_html_text": main_text,
    "op11_vector_codes": vector_codes,
    "op12_filter_audit": filter_audit,
    "op13_simhash": near_duplicates,
    "pipeline": pipeline.run,
}
VECTOR_CODES_SQL = """
WITH RECURSIVE kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT r, vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM pieces WHERE r <= 64),
{rounds}, assigned AS MATERIALIZED ({last}),
coded AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
         CAST(sum(d) AS BIGINT) AS error
  FROM assigned GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded
"""
_ASSIGN = """
  SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, p, any_value(x) AS x, min(CAST(d AS HUGEINT) * 64 + e) // 64 AS d,
         min(CAST(d AS HUGEINT) * 64 + e) % 64 AS e
  FROM (SELECT s.r, s.vec_id, s.label, s.p, s.x, b.e,
               list_sum(list_transform(range(1, len(s.x) + 1), lambda i: (s.x[i] - b.x[i]) * (s.x[i] - b.x[i]))) AS d
        FROM pieces AS s JOIN {book} AS b USING (p))
  GROUP BY r, p
"""
_ROUND = """
near{n} AS MATERIALIZED ({assign}),
sums{n} AS (
  SELECT p, e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS mean
  FROM near{n}, range(1, (SELECT max(len(x)) FROM near{n}) + 1) AS t(i) GROUP BY p, e, i
),
means{n} AS (SELECT p, e, list(CAST(mean AS BIGINT) ORDER BY i) AS x FROM sums{n} GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{before} AS b LEFT JOIN means{n} AS m ON b.p = m.p AND b.e = m.e)
"""
FILTER_AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
judged AS (
  SELECT d.part, coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM words AS d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) AS l USING (doc_id)
), cells AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, s, o[s] AS f, o[1:s - 1] AS before FROM orders, range(1, 6) AS t(s)),
counted AS (
  SELECT part, o, s, f, n, good, toxic, contains(fails, f) AS own, fails = f AS only_own,
         length(translate(fails, before, '')) < length(fails) AS gone FROM cells, steps
), found AS (
  SELECT part, o, s, f, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM counted GROUP BY part, o, s, f
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM found
"""
SQL: dict[str, str] = {
    "op11_vector_codes": VECTOR_CODES_SQL.format(
        rounds=", ".join(_ROUND.format(n=n, before=n - 1, assign=_ASSIGN.format(book=f"book{n - 1}")) for n in (1, 2)),
        last=_ASSIGN.format(book="book2")),
    "op12_filter_audit": FILTER_AUDIT_SQL,
}


def workloads() -> dict[str, Workload]:
    return {name: Workload(name, run, SQL.get(name)) for name, run in QUERIES.items()}
