"""Building blocks: functions, predicates, joins and orders on their own, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core
from ..functions.normalize import normalize_date
from ..operators import docs, review
from . import projections as P
from .base import draw, query


@query("fn_string", """
SELECT doc_id, lang || '/' || source AS joined, replace(source, 'src', 'source ') AS replaced, length(text) AS chars,
  length(text) - length(replace(text, ',', '')) + 1 AS parts, upper(lang) AS upper_lang, trim('  ' || lang || ' ') AS trimmed, text LIKE '%the%' AS has_the
FROM documents""")
def _(spark, d):
    return P.read(spark, d, "documents").select(
        "doc_id", F.concat("lang", F.lit("/"), "source").alias("joined"), F.replace("source", F.lit("src"), F.lit("source ")).alias("replaced"),
        F.length("text").alias("chars"), F.size(F.split("text", ",")).alias("parts"), F.upper("lang").alias("upper_lang"),
        F.trim(F.concat(F.lit("  "), "lang", F.lit(" "))).alias("trimmed"), F.col("text").like("%the%").alias("has_the"))


@query("fn_regex", """
SELECT o_orderkey, regexp_replace('$' || o_totalprice::DECIMAL(12,2), '[^0-9.]', '', 'g') AS stripped,
  regexp_replace(strftime(o_orderdate, '%m/%d/%Y'), '(\\d{2})/(\\d{2})/(\\d{4})', '\\3-\\1-\\2') AS iso,
  regexp_matches(o_orderpriority, '^[12]-') AS urgent, split_part(o_orderpriority, '-', 2) AS priority,
  regexp_replace(day(o_orderdate) || 'th of ' || o_orderkey || 'st', '(\\d+)(st|nd|rd|th)\\b', '\\1', 'g') AS plain
FROM orders""")
def _(spark, d):
    o = P.read(spark, d, "orders")
    return o.select(
        "o_orderkey", F.regexp_replace(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(12,2)")), r"[^0-9.]", "").alias("stripped"),
        F.regexp_replace(F.date_format("o_orderdate", "MM/dd/yyyy"), r"(\d{2})/(\d{2})/(\d{4})", "$3-$1-$2").alias("iso"),
        F.col("o_orderpriority").rlike("^[12]-").alias("urgent"), F.get(F.split("o_orderpriority", "-", 2), F.lit(1)).alias("priority"),
        F.regexp_replace(F.concat(F.dayofmonth("o_orderdate"), F.lit("th of "), "o_orderkey", F.lit("st")), P.V.ORDINAL_SUFFIX, "$1").alias("plain"))


@query("fn_safe_cast", """
SELECT k, CASE k % 4 WHEN 0 THEN round(p, 2)::DOUBLE WHEN 3 THEN NULL ELSE NULL END AS amount, CASE WHEN k % 4 = 1 THEN NULL WHEN k % 4 = 0 THEN round(p, 2)::DOUBLE END AS cleaned,
  CASE WHEN k % 3 = 0 THEN day END AS day
FROM (SELECT o_orderkey AS k, o_totalprice::DECIMAL(14,4) AS p, o_orderdate::DATE AS day FROM orders)""")
def _(spark, d):
    """Numbers that fit, overflow, are empty or have two dots; dates that are ISO, bare years or impossible."""
    o, k = P.read(spark, d, "orders"), F.col("o_orderkey")
    number = F.when(k % 4 == 0, F.col("o_totalprice").cast("decimal(14,4)").cast("string")).when(k % 4 == 1, "99999999999.99").when(k % 4 == 2, "").otherwise("1.2.3")
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, "2024").otherwise("2024-02-30")
    return o.select(k.alias("k"), core.to_amount(number).alias("amount"), core.clean_amount(number).alias("cleaned"), core.to_iso_date(day).alias("day"))


@query("fn_datetime", """
SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS days, o_orderdate::DATE + 30 AS plus_30,
  date_trunc('month', o_orderdate)::DATE AS month, epoch(o_orderdate)::BIGINT AS seconds, o_orderdate - INTERVAL 24 HOUR AS day_before
FROM orders""")
def _(spark, d):
    return P.read(spark, d, "orders").select(
        "o_orderkey", core.days_past(F.to_date("o_orderdate"), P.day()).alias("days"), F.date_add(F.to_date("o_orderdate"), 30).alias("plus_30"),
        F.trunc("o_orderdate", "MM").alias("month"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("seconds"),
        (F.col("o_orderdate") - F.expr("INTERVAL 24 HOURS")).alias("day_before"))


FORMS = ["yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"]


@query("fn_date_formats", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 < 10 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'quarter ' || quarter(o_orderdate) END AS iso FROM orders")
def _(spark, d):
    text = F.concat(F.lit("quarter "), F.quarter("o_orderdate"))
    for i, form in enumerate(FORMS):
        text = F.when(F.col("o_orderkey") % 11 == i, F.date_format("o_orderdate", form)).otherwise(text)
    return P.read(spark, d, "orders").select("o_orderkey", normalize_date(text).alias("iso"))


@query("fn_conditional", """
SELECT invoice_id, CASE WHEN total_amount > 250000 THEN 'large' ELSE 'small' END AS size, coalesce(payment_date, due_date, invoice_date) AS first_date,
  CASE WHEN due_date IS NOT NULL THEN greatest(date_diff('day', due_date, DATE '2000-01-01'), 0) END AS late
FROM invoices""")
def _(spark, d):
    days = core.days_past(F.col("due_date"), P.day())
    return P.invoices(spark, d).select(
        "invoice_id", F.when(F.col("total_amount") > 250000, "large").otherwise("small").alias("size"),
        F.coalesce("payment_date", "due_date", "invoice_date").alias("first_date"),
        F.when(days.isNotNull(), F.greatest(days, F.lit(0))).alias("late"))


@query("fn_math", """
SELECT event_id, round(value::DECIMAL(12,2), 1)::DOUBLE AS rounded, abs(value - 50)::DOUBLE AS distance,
  CASE WHEN user_id % 10 > 0 THEN ((20 * (value::DECIMAL(12,2) * 100)::BIGINT + user_id % 10) // (2 * (user_id % 10)))::DOUBLE / 1000 END AS ratio, (event_id % 9000)::DOUBLE / 1000 AS seconds
FROM events""")
def _(spark, d):
    m = F.col("value").cast("decimal(12,2)")
    return P.read(spark, d, "events").select(
        "event_id", F.round(m, 1).alias("rounded"), F.abs(F.col("value") - 50).alias("distance"),
        core.rate(m, F.col("user_id") % 10, 3).alias("ratio"), (F.col("event_id") % 9000 / F.lit(1000.0)).alias("seconds"))


@query("fn_json", """
SELECT event_id, (props->>'$.k')::BIGINT AS k, NULL::VARCHAR AS missing, event_id % 3 <> 0 AS valid, (props->>'$.k')::BIGINT * 200 AS tokens
FROM events""")
def _(spark, d):
    """Paths, missing keys, invalid text, the first element of an array, a nested object."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{,"), "props")).otherwise(F.col("props"))
    nested = F.concat(F.lit('{"a":{"b":'), "props", F.lit("}}"))
    k = F.get_json_object(nested, "$.a.b.k").cast("bigint")
    metrics = F.concat(F.lit('[{"value": '), k * 200, F.lit("}]"))
    return P.read(spark, d, "events").select(
        "event_id", k.alias("k"), F.get_json_object("props", "$.none").alias("missing"),
        F.try_parse_json(text).isNotNull().alias("valid"), F.get_json_object(metrics, "$[0].value").cast("bigint").alias("tokens"))


@query("fn_object_array", """
SELECT record_id, 10 AS keys, 9 + (field_5 IS NOT NULL)::INT AS present, field_1 AS vendor FROM fields""".replace("10 AS keys, 9 + (field_5 IS NOT NULL)::INT AS", "10::BIGINT AS keys, (9 + (field_5 IS NOT NULL)::INT)::BIGINT AS"))
def _(spark, d):
    m = core.json_map(F.col("raw_extraction"))
    return P.fields(spark, d).select(
        "record_id", F.size(F.json_object_keys("raw_extraction")).alias("keys"),
        F.size(F.map_filter(m, lambda k, v: v.isNotNull())).alias("present"), F.try_element_at(m, F.lit("vendor_name")).alias("vendor"))


@query("fn_hash_pick", f"""
SELECT o_orderkey, {draw(100, 'o_orderkey', "'a'")} AS percent, 5 + {draw(21, 'o_orderkey', "'b'")} AS days,
  ['x', 'y', 'z'][{draw(3, 'o_orderkey', "'c'")} + 1] AS letter, (100 + {draw(900, 'o_orderkey', "'d'")}) / 100.0::DOUBLE AS amount FROM orders""")
def _(spark, d):
    """Picks by the hash of a key: numbers, ranges, list elements, amounts."""
    k = F.col("o_orderkey")
    return P.read(spark, d, "orders").select(
        "o_orderkey", core.pick(100, k, "a").alias("percent"), core.pick_between(5, 25, k, "b").alias("days"),
        core.pick_from(["x", "y", "z"], k, "c").alias("letter"), core.pick_amount("1.00", "9.99", k, "d").alias("amount"))


@query("fn_format", """
SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice::DECIMAL(12,2)::DOUBLE) AS money, strftime(o_orderdate, '%B %d, %Y') AS day FROM orders""")
def _(spark, d):
    return P.read(spark, d, "orders").select(
        "o_orderkey", core.money_text(F.col("o_totalprice").cast("decimal(12,2)")).alias("money"), core.long_date(F.col("o_orderdate")).alias("day"))


@query("pred_like", "SELECT file_name FROM raw_documents WHERE file_name LIKE 'invoice_0000%' AND file_name NOT LIKE '%9.pdf'")
def _(spark, d):
    name = F.col("file_name")
    return P.raw_documents(spark, d).where(name.like("invoice_0000%") & ~name.like("%9.pdf")).select("file_name")


@query("pred_contains", "SELECT doc_id FROM documents WHERE text ILIKE '%' || source || '%' OR text ILIKE '%THE%'")
def _(spark, d):
    has = F.expr("text ILIKE concat('%', source, '%')") | F.col("text").ilike("%THE%")
    return P.read(spark, d, "documents").where(has).select("doc_id")


@query("pred_in_between", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value BETWEEN 10 AND 20 AND user_id NOT IN (1, 2, 3)")
def _(spark, d):
    c = F.col
    return P.read(spark, d, "events").where(c("event_type").isin("click", "view") & c("value").between(10, 20) & ~c("user_id").isin(1, 2, 3)).select("event_id")


@query("pred_recent", " UNION ALL ".join(
    f"SELECT '{n} {u}' AS span, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL {n} {u}"
    for n, u in [(7, "DAY"), (14, "DAY"), (30, "DAY"), (90, "DAY"), (24, "HOUR")]))
def _(spark, d):
    """Several windows counted in one pass."""
    spans = [(7, "DAY"), (14, "DAY"), (30, "DAY"), (90, "DAY"), (24, "HOUR")]
    counts = P.read(spark, d, "events").agg(*[
        F.count_if(core.since(F.col("ts"), P.usage_time(), n, u)).alias(f"{n} {u}") for n, u in spans])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f"{n} {u}").alias("span"), F.col(f"{n} {u}").alias("n")) for n, u in spans])))


@query("fields_with_type", "SELECT record_id, doc_type, field_1, field_10::DOUBLE AS field_10 FROM fields JOIN raw_documents USING (file_name)")
def _(spark, d):
    return docs.with_type(P.fields(spark, d), P.raw_documents(spark, d)).select("record_id", "doc_type", "field_1", "field_10")


@query("line_rollup", """
SELECT f.record_id, l.n AS line_item_count, l.total::DOUBLE AS computed_line_total
FROM fields f LEFT JOIN (SELECT file_name, count(*) AS n, sum(col_5) AS total FROM table_data GROUP BY 1) l ON f.file_name = l.file_name""")
def _(spark, d):
    return P.fields(spark, d).select("record_id", "file_name").join(review.line_rollup(P.table_data(spark, d)), "file_name", "left").drop("file_name")


@query("fields_with_review", """
SELECT f.record_id, v.review_status, v.reviewed_at FROM fields f LEFT JOIN newest_review v ON f.record_id = v.record_id""")
def _(spark, d):
    rv = review.latest(P.reviews(spark, d)).select("record_id", "review_status", "reviewed_at")
    return P.fields(spark, d).select("record_id").join(rv, "record_id", "left")


@query("pending_anti", "SELECT file_name, doc_type FROM raw_documents r WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.file_name = r.file_name)")
def _(spark, d):
    return P.raw_documents(spark, d).join(P.fields(spark, d).select("file_name"), "file_name", "left_anti").select("file_name", "doc_type")


@query("processed_semi", "SELECT file_name, doc_type FROM raw_documents WHERE file_name IN (SELECT file_name FROM fields)")
def _(spark, d):
    return P.raw_documents(spark, d).join(P.fields(spark, d).select("file_name"), "file_name", "left_semi").select("file_name", "doc_type")


@query("orphans", "SELECT i.file_name FROM invoices i LEFT JOIN line_items l ON i.file_name = l.file_name WHERE l.file_name IS NULL")
def _(spark, d):
    return P.invoices(spark, d).select("file_name").join(P.line_items(spark, d).select("file_name"), "file_name", "left_anti")


@query("order_multi", """
SELECT start_time::DATE AS usage_date, resource, sum(credits_used)::DOUBLE AS credits FROM metering GROUP BY 1, 2
ORDER BY usage_date DESC, resource""")
def _(spark, d):
    """Newest day first, resources by name within a day."""
    days = P.metering(spark, d).groupBy(F.to_date("start_time").alias("usage_date"), "resource").agg(F.sum("credits_used").alias("credits"))
    return days.orderBy(F.desc("usage_date"), "resource")


@query("order_nulls", """
SELECT invoice_id, due_date FROM invoices ORDER BY due_date DESC NULLS FIRST, invoice_id""")
def _(spark, d):
    """Newest first with unknown dates ahead of all."""
    return P.invoices(spark, d).orderBy(F.desc_nulls_first("due_date"), "invoice_id").select("invoice_id", "due_date")


@query("distinct_files", "SELECT DISTINCT file_name FROM line_items")
def _(spark, d):
    return P.line_items(spark, d).select("file_name").distinct()
