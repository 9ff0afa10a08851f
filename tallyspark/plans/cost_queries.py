"""Usage and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config, cost
from ..session import shared_dir
from ..sources import files
from . import projections as P
from .base import CTES, query
from .extract_queries import processed

ROUND = "round({}::DOUBLE, {})"


def inputs(spark, d):
    return P.usage(spark, d), P.query_history(spark, d), P.raw_documents(spark, d)


def detail(spark, d):
    u, q, raw = inputs(spark, d)
    counts = config.default_config(spark).select("doc_type", config.comma_field_count(F.col("extraction_prompt")).alias("field_count"))
    return cost.per_call_detail(u, q, raw, counts, P.FUNCTION, P.usage_time())


CTES["daily_cost"] = """
SELECT usage_date, coalesce(c, 0) AS ai_credits, coalesce(n, 0) AS ai_calls, coalesce(t, 0)::BIGINT AS total_tokens,
  coalesce(docs, 0) AS docs_extracted, coalesce(w, 0) AS warehouse_credits
FROM (SELECT start_time::DATE AS usage_date, sum(ai_credits) AS c, count(*) AS n, sum(tokens) AS t FROM usage_calls GROUP BY 1)
FULL JOIN (SELECT start_time::DATE AS usage_date, sum(credits_used) AS w FROM metering WHERE resource = 'EXTRACT_WH'
  AND start_time >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY GROUP BY 1) USING (usage_date)
FULL JOIN (SELECT extracted_at::DATE AS usage_date, count(*) AS docs FROM fields GROUP BY 1) USING (usage_date)
"""
CTES["prompt_parts"] = "SELECT * FROM (VALUES " + P._values([(r[0], r[2].count(",") + 1) for r in config.default_rows()]) + ") t(doc_type, field_count)"
CTES["call_detail"] = """
SELECT query_id, start_time, file_name, doc_type, page_count, file_size_bytes, ai_credits, tokens, elapsed_sec, field_count,
  ((2 * (ai_credits * 1000000)::BIGINT + page_count) // (2 * page_count))::DOUBLE / 1000000 AS credits_per_page, round(tokens::DOUBLE / page_count, 0) AS tokens_per_page
FROM call_docs LEFT JOIN prompt_parts USING (doc_type) WHERE file_name IS NOT NULL
"""


def stored_payloads(spark, d):
    """Extraction results as they are read back from storage."""
    path = shared_dir(spark, "payloads")
    files.append(processed(spark, d).select("file_name", "doc_type", "raw_extraction"), path)
    return files.table(spark, path)


def daily(spark, d):
    return cost.daily(P.usage(spark, d), P.metering(spark, d), P.fields(spark, d), P.FUNCTION, P.WAREHOUSE, P.usage_time())


@query("cost_daily", """
SELECT usage_date, ai_credits::DOUBLE AS ai_credits, ai_calls, total_tokens, docs_extracted, warehouse_credits::DOUBLE AS warehouse_credits FROM daily_cost""")
def _(spark, d):
    return daily(spark, d)


@query("cost_per_document", """
SELECT usage_date, ai_credits::DOUBLE AS ai_credits, ai_calls, total_tokens, docs_extracted, round(ai_credits::DOUBLE / ai_calls, 6) AS credits_per_doc
FROM daily_cost WHERE ai_calls > 0""")
def _(spark, d):
    return cost.per_document(daily(spark, d))


BY_TYPE = """
SELECT coalesce(doc_type, 'UNKNOWN') AS doc_type, start_time::DATE AS usage_date, count(*) AS call_count,
  round(sum(ai_credits), 6)::DOUBLE AS ai_credits, sum(tokens)::BIGINT AS total_tokens,
  round(sum(elapsed_sec), 1)::DOUBLE AS total_elapsed_sec, round(sum(elapsed_sec)::DOUBLE / count(elapsed_sec), 1) AS avg_elapsed_sec
FROM call_docs GROUP BY 1, 2"""


@query("cost_by_doc_type", BY_TYPE)
def _(spark, d):
    u, q, raw = inputs(spark, d)
    return cost.by_doc_type(u, q, raw, P.FUNCTION, P.usage_time())


@query("call_log", """
SELECT query_id, start_time, ai_credits::DOUBLE AS ai_credits, tokens, coalesce(doc_type, 'UNKNOWN') AS doc_type,
  elapsed_sec::DOUBLE AS elapsed_sec, 1::BIGINT AS rows_produced,
  CASE WHEN query_id % 20 = 0 THEN 'SELECT 1' ELSE 'SELECT read(''docs/' || CASE WHEN query_id % 3 = 0 THEN upper(printf('invoice_%08d.pdf', query_id))
    ELSE printf('invoice_%08d.pdf', query_id) END || chr(39) || CASE WHEN query_id % 7 = 0 THEN ', ''docs/' || printf('invoice_%08d.pdf', query_id + 1) || chr(39) ELSE '' END
    || ')' END AS query_text
FROM call_docs WHERE start_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY ORDER BY start_time DESC, query_id, file_name LIMIT 500""")
def _(spark, d):
    u, q, raw = inputs(spark, d)
    return cost.call_log(u, q, raw, P.FUNCTION, P.usage_time())


@query("cost_summary", """
WITH c AS (SELECT sum(ai_credits) FILTER (start_time >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS c7,
    sum(ai_credits) FILTER (start_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AS c30, sum(ai_credits) AS c90,
    sum(tokens) FILTER (start_time >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)::BIGINT AS t7,
    sum(tokens) FILTER (start_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY)::BIGINT AS t30, sum(tokens)::BIGINT AS t90, count(*) AS n
  FROM usage_calls),
w AS (SELECT sum(credits_used) FILTER (start_time >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS w7,
    sum(credits_used) FILTER (start_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AS w30, sum(credits_used) AS w90
  FROM metering WHERE resource = 'EXTRACT_WH'),
f AS (SELECT count(*) AS docs FROM fields)
SELECT round(c7, 4)::DOUBLE AS ai_credits_last_7d, round(c30, 4)::DOUBLE AS ai_credits_last_30d, round(c90, 4)::DOUBLE AS ai_credits_last_90d,
  t7 AS tokens_7d, t30 AS tokens_30d, t90 AS tokens_90d, n AS total_calls, docs AS unique_docs,
  round(c90::DOUBLE / n, 6) AS avg_credits_per_doc, round(c90::DOUBLE / docs, 6) AS amortized_credits_per_unique_doc,
  round(w7, 4)::DOUBLE AS wh_credits_last_7d, round(w30, 4)::DOUBLE AS wh_credits_last_30d, round(w90, 4)::DOUBLE AS wh_credits_last_90d
FROM c, w, f""")
def _(spark, d):
    return cost.summary(P.usage(spark, d), P.metering(spark, d), P.fields(spark, d), P.FUNCTION, P.WAREHOUSE, P.usage_time())


SHOWN_SERVICES = ["AI_SERVICES", "WAREHOUSE_METERING", "CONTAINER_SERVICES"]


@query("cost_breakdown", """
SELECT ts::DATE AS usage_date, CASE event_type WHEN 'click' THEN 'AI_SERVICES' WHEN 'signup' THEN 'WAREHOUSE_METERING' ELSE 'CONTAINER_SERVICES' END AS service_type,
  round(sum(value::DECIMAL(18,2)) * 0.01::DECIMAL(3,2), 4)::DOUBLE AS credits_used, round(sum(value::DECIMAL(18,2)) * 0.008::DECIMAL(4,3), 4)::DOUBLE AS credits_billed
FROM events WHERE event_type IN ('click', 'signup', 'error') GROUP BY 1, 2""")
def _(spark, d):
    return cost.breakdown(P.metering_daily(spark, d), SHOWN_SERVICES, P.day("2024-01-31"))


@query("cost_per_doc_detail", """
SELECT query_id, start_time, file_name, doc_type, page_count::BIGINT AS page_count, file_size_bytes, ai_credits::DOUBLE AS ai_credits, tokens,
  elapsed_sec::DOUBLE AS elapsed_sec, field_count::BIGINT AS field_count, credits_per_page, tokens_per_page FROM call_detail""")
def _(spark, d):
    return detail(spark, d).orderBy(F.desc("start_time"), "query_id", "file_name")


@query("field_counts", """
SELECT doc_type, field_count::BIGINT AS field_count, parsed_field_count, documents FROM prompt_parts
JOIN (SELECT doc_type, count(*) AS parsed_field_count FROM spec GROUP BY 1) USING (doc_type)
JOIN (SELECT doc_type, count(*) AS documents FROM raw_documents GROUP BY 1) USING (doc_type)""")
def _(spark, d):
    """Parts of the whole prompt between commas, and fields it really asks for."""
    prompt = F.col("extraction_prompt")
    counts = config.default_config(spark).select("doc_type", config.comma_field_count(prompt).alias("field_count"),
                                                 F.size(config.parse_fields(prompt)).alias("parsed_field_count"))
    used = P.raw_documents(spark, d).groupBy("doc_type").agg(F.count("*").alias("documents"))
    return counts.join(used, "doc_type")


CTES["cost_driver"] = """
SELECT doc_type, count(*) AS total_calls, round(avg(page_count), 1) AS avg_pages, round(avg(file_size_bytes), 0) AS avg_file_size,
  round(avg(tokens), 0) AS avg_tokens, round(sum(ai_credits)::DOUBLE / count(*), 6) AS avg_credits,
  round(avg(credits_per_page), 6) AS avg_credits_per_page, round(avg(tokens_per_page), 0) AS avg_tokens_per_page,
  avg(field_count) AS fields_extracted, round(sum(elapsed_sec)::DOUBLE / count(*), 1) AS avg_elapsed_sec,
  round(corr(page_count, tokens), 4) AS page_token_correlation, round(corr(tokens, ai_credits::DOUBLE), 4) AS token_credit_correlation
FROM call_detail GROUP BY doc_type
"""


@query("cost_drivers", "SELECT * FROM cost_driver")
def _(spark, d):
    return cost.drivers(detail(spark, d))


@query("cost_driver_means", """
SELECT round(avg(avg_credits_per_page), 6) AS avg_credits_per_page, round(avg(avg_tokens_per_page), 6) AS avg_tokens_per_page,
  round(avg(token_credit_correlation), 6) AS token_credit_correlation, round(avg(page_token_correlation), 6) AS page_token_correlation FROM cost_driver""")
def _(spark, d):
    return cost.driver_means(cost.drivers(detail(spark, d)))


@query("token_histogram", """
SELECT sort_order::BIGINT AS sort_order, ['< 1.5K tokens', '1.5K - 3K', '3K - 6K', '6K - 15K', '15K+ tokens'][sort_order] AS token_range,
  count(*) AS calls, round(sum(ai_credits)::DOUBLE / count(*), 6) AS avg_credits, min(ai_credits)::DOUBLE AS min_credits,
  max(ai_credits)::DOUBLE AS max_credits, round(avg(tokens), 0) AS avg_tokens
FROM (SELECT *, 1 + (tokens >= 1500)::INT + (tokens >= 3000)::INT + (tokens >= 6000)::INT + (tokens >= 15000)::INT AS sort_order FROM usage_calls)
GROUP BY 1, 2""")
def _(spark, d):
    return cost.token_histogram(cost.calls(P.usage(spark, d), P.FUNCTION, P.usage_time()))


CTES["doc_conf"] = """
SELECT file_name, doc_type, count(*) AS n_fields, round(sum(confidence::DECIMAL(6,2))::DOUBLE / count(*), 6) AS avg_confidence FROM doc_score GROUP BY 1, 2
"""


@query("doc_confidence", "SELECT * FROM doc_conf")
def _(spark, d):
    return cost.document_confidence(stored_payloads(spark, d))


@query("confidence_by_type", """
SELECT c.doc_type, round(avg(avg_confidence), 6) AS avg_confidence, round(sum(ai_credits)::DOUBLE / count(*), 6) AS avg_credits,
  count(*) AS doc_count, count(*) FILTER (avg_confidence < 0.7) AS low_confidence
FROM doc_conf c JOIN call_detail USING (file_name) GROUP BY 1""")
def _(spark, d):
    scored = cost.document_confidence(stored_payloads(spark, d))
    return cost.confidence_by_type(cost.confidence_and_cost(scored, detail(spark, d)))


@query("credits_by_type", """
SELECT doc_type, count(*) AS calls, sum(ai_credits)::DOUBLE AS total_credits, sum(tokens)::BIGINT AS tokens
FROM call_detail WHERE start_time >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1""")
def _(spark, d):
    return cost.credits_by_type(detail(spark, d), P.usage_time(), 14)


DAILY = """SELECT '{0}' AS resource, start_time::DATE AS usage_date, sum(credits_used)::DOUBLE AS credits
FROM metering WHERE resource = '{0}' AND start_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 2"""


@query("resource_daily", DAILY.format(P.WAREHOUSE) + " UNION ALL " + DAILY.format(P.POOL))
def _(spark, d):
    one = lambda r: cost.resource_daily(P.metering(spark, d), r, P.usage_time(), 30).select(F.lit(r).alias("resource"), "usage_date", "credits")
    return one(P.WAREHOUSE).unionByName(one(P.POOL))


@query("resource_totals", """
SELECT resource, coalesce(sum(credits), 0)::DOUBLE AS credits, count(credits) AS days_used, round(coalesce(sum(credits), 0)::DOUBLE * 3.0, 2) AS estimate
FROM (VALUES ('EXTRACT_WH'), ('EXTRACT_POOL'), ('IDLE_POOL')) r(resource) LEFT JOIN (
  SELECT resource, start_time::DATE AS usage_date, sum(credits_used) AS credits FROM metering
  WHERE start_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1, 2) USING (resource) GROUP BY resource""")
def _(spark, d):
    return cost.resource_totals(P.metering(spark, d), [P.WAREHOUSE, P.POOL, "IDLE_POOL"], P.usage_time(), 30, 3.0)


@query("currency_estimate", """
SELECT start_time::DATE AS usage_date, sum(credits_used)::DOUBLE AS credits, round(sum(credits_used)::DOUBLE * 3.0, 2) AS estimate
FROM metering WHERE resource = 'EXTRACT_WH' AND start_time >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY GROUP BY 1""")
def _(spark, d):
    df = cost.resource_daily(P.metering(spark, d), P.WAREHOUSE, P.usage_time(), 90).withColumn("credits", F.col("credits").cast("double"))
    return cost.in_currency(df, "credits", 3.0, "estimate")
