"""Data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ap, config, cost, docs, review
from ..operators import quality as q
from ..session import shared_dir
from ..sources import files
from . import projections as P
from .base import query
from .cost_queries import daily
from .extract_queries import processed
from .review_queries import summary


def check(name: str, count: str) -> str:
    """SQL of a check that passes when a count of bad rows is 0."""
    return f"SELECT '{name}' AS \"check\", n = 0 AS passed, n::VARCHAR AS detail FROM (SELECT {count})"


def bad(table: str, *rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(check(n, f"count(*) FILTER ({c}) AS n FROM {table}") for n, c in rules)


def ledger(spark, d):
    return ap.ledger(P.invoices(spark, d), P.day())


@query("dq_row_count", """
SELECT 'invoices_present' AS "check", count(*) >= 100 AS passed, count(*)::VARCHAR AS detail FROM orders
UNION ALL SELECT 'nation_rows', count(*) = 25, count(*)::VARCHAR FROM nation""")
def _(spark, d):
    return q.run([q.row_count(P.invoices(spark, d), "invoices_present", at_least=100),
                  q.row_count(P.read(spark, d, "nation"), "nation_rows", exactly=25)])


@query("dq_nothing_pending", bad("raw_documents", ("nothing_pending", "NOT extracted")))
def _(spark, d):
    return q.nothing_pending(P.raw_documents(spark, d))


@query("dq_parity", """
SELECT 'fields_match_registry' AS "check", a = b AS passed, a || ' vs ' || b AS detail
FROM (SELECT (SELECT count(*) FROM fields) AS a, (SELECT count(*) FROM raw_documents) AS b)""")
def _(spark, d):
    return q.parity("fields_match_registry", P.fields(spark, d), P.raw_documents(spark, d))


@query("dq_not_null", bad("line_items", ("product_name_not_null", "product_name IS NULL"), ("category_not_null", "category IS NULL"),
                          ("line_total_not_null", "line_total IS NULL")))
def _(spark, d):
    return q.no_nulls(P.line_items(spark, d), ["product_name", "category", "line_total"])


@query("dq_range", bad("invoices", ("total_amount_in_range", "total_amount < 0.01 OR total_amount > 500000"))
       + " UNION ALL " + bad("raw_documents", ("page_count_in_range", "page_count > 3 AND doc_type <> 'LEASE'")))
def _(spark, d):
    return q.run([q.in_range(P.invoices(spark, d), "total_amount", 0.01, 500000),
                  q.in_range(P.raw_documents(spark, d), "page_count", high=3, unless=F.col("doc_type") == "LEASE")])


@query("dq_allowed", bad("invoices", ("status_allowed", "status NOT IN ('PENDING', 'PAID')"))
       + " UNION ALL " + bad("ap_ledger_rows", ("aging_bucket_allowed", "aging_bucket NOT IN ('Current', '1-30 Days', '31-60 Days', '61-90 Days', '90+ Days', 'Paid')")))
def _(spark, d):
    buckets = ["Current", "1-30 Days", "31-60 Days", "61-90 Days", "90+ Days", "Paid"]
    return q.run([q.allowed(P.invoices(spark, d), "status", ["PENDING", "PAID"]), q.allowed(ledger(spark, d), "aging_bucket", buckets)])


@query("dq_unique", check("invoice_number_unique", "count(*) - count(DISTINCT invoice_number) AS n FROM invoices") + " UNION ALL "
       + check("record_id_unique", "count(*) - count(DISTINCT record_id) AS n FROM reviews"))
def _(spark, d):
    return q.run([q.unique(P.invoices(spark, d), "invoice_number"), q.unique(P.reviews(spark, d), "record_id")])


@query("dq_references", " UNION ALL ".join(
    check(n, f"count(*) AS n FROM {c} WHERE {k} NOT IN (SELECT {k} FROM {p})") for n, c, p, k in [
        ("invoice_registered", "invoices", "raw_documents", "file_name"), ("line_registered", "line_items", "raw_documents", "file_name"),
        ("line_has_invoice", "line_items", "invoices", "invoice_number"), ("invoice_has_lines", "invoices", "line_items", "invoice_number")]))
def _(spark, d):
    inv, li, raw = P.invoices(spark, d), P.line_items(spark, d), P.raw_documents(spark, d)
    return q.run([q.orphans(inv, raw, "file_name", "invoice_registered"), q.orphans(li, raw, "file_name", "line_registered"),
                  q.orphans(li, inv, "invoice_number", "line_has_invoice"), q.orphans(inv, li, "invoice_number", "invoice_has_lines")])


@query("dq_conditional", bad(
    "ap_ledger_rows", ("paid_have_payment_date", "status = 'PAID' AND payment_date IS NULL"),
    ("unpaid_no_payment_date", "status <> 'PAID' AND payment_date IS NOT NULL"),
    ("paid_zero_outstanding", "status = 'PAID' AND outstanding_amount <> 0"),
    ("unpaid_outstanding_equals_total", "status <> 'PAID' AND outstanding_amount <> total_amount")))
def _(spark, d):
    return q.conditional(P.invoices(spark, d), ledger(spark, d))


RECONCILE = "FROM invoices i JOIN (SELECT invoice_number, sum(line_total) AS s FROM line_items GROUP BY 1) l ON i.invoice_number = l.invoice_number"


@query("dq_reconciled", check("line_totals_vs_subtotal", f"count(*) FILTER (abs(s - subtotal)::DOUBLE / subtotal::DOUBLE > 0.2) AS n {RECONCILE}") + " UNION ALL "
       + check("line_totals_vs_total", f"count(*) FILTER (abs(s - total_amount)::DOUBLE / total_amount::DOUBLE > 0.5) AS n {RECONCILE}"))
def _(spark, d):
    inv, li = P.invoices(spark, d), P.line_items(spark, d)
    gap = lambda amount, tol: docs.reconcile(inv, li, "invoice_number", amount, "line_total", tol)
    return q.run([q.reconciled(gap("subtotal", 0.2), "line_totals_vs_subtotal"), q.reconciled(gap("total_amount", 0.5), "line_totals_vs_total")])


def agree(name: str, left: str, right: str) -> str:
    """SQL of a check that two sums agree."""
    return f"""SELECT '{name}' AS "check", abs(l - r) < 0.01 AS passed, round(abs(l - r), 2)::VARCHAR AS detail
FROM (SELECT ({left})::DOUBLE AS l, ({right})::DOUBLE AS r)"""


@query("dq_totals_agree", " UNION ALL ".join([
    agree("aging_vs_ledger", "SELECT sum(s) FROM (SELECT sum(outstanding_amount) AS s FROM ap_ledger_rows GROUP BY aging_bucket)",
          "SELECT sum(outstanding_amount) FROM ap_ledger_rows"),
    agree("vendors_complete", "SELECT count(*) FROM (SELECT vendor_name FROM invoices GROUP BY 1)", "SELECT count(DISTINCT vendor_name) FROM invoices"),
    agree("trend_vs_base", "SELECT sum(s) FROM (SELECT sum(total_amount) AS s FROM invoices GROUP BY date_trunc('month', invoice_date))",
          "SELECT sum(total_amount) FROM invoices")]))
def _(spark, d):
    inv, led = P.invoices(spark, d), ledger(spark, d)
    vendors = ap.spend_by_vendor(inv)
    return q.run([
        q.totals_agree("aging_vs_ledger", ap.aging_summary(led).agg(F.sum("total_outstanding")), led.agg(F.sum("outstanding_amount"))),
        q.totals_agree("vendors_complete", vendors.agg(F.count("*")), inv.agg(F.count_distinct("vendor_name"))),
        q.totals_agree("trend_vs_base", ap.monthly_trend(inv).agg(F.sum("total_spend")), inv.agg(F.sum("total_amount")))])


@query("dq_field_order", bad("fields", ("subtotal_le_total", "field_8 > field_10"), ("due_not_before_document", "field_5 < field_4"),
                             ("date_in_range", "field_4 NOT BETWEEN DATE '1970-01-01' AND DATE '2100-01-01'")))
def _(spark, d):
    return q.field_order(P.fields(spark, d))


@query("dq_line_numbers", bad("(SELECT min(line_number) AS lo, max(line_number) AS hi, count(*) AS n FROM line_items GROUP BY file_name)",
                              ("lines_start_at_one", "lo <> 1"), ("lines_sequential", "hi > 2 * n")))
def _(spark, d):
    return q.line_numbers(P.line_items(spark, d))


@query("dq_field_coverage", """
SELECT doc_type || '.' || field AS "check", count(normalized) >= count(*) * 0.8 AS passed, count(normalized) || '/' || count(*) AS detail
FROM doc_value GROUP BY doc_type, field""")
def _(spark, d):
    payloads = processed(spark, d).select("doc_type", "raw_extraction")
    return q.field_coverage(payloads, config.field_table(config.default_config(spark)))


@query("dq_patterns", bad("fields", ("field_2_pattern", "NOT regexp_matches(field_2, '^INV-\\d+$')"), ("field_3_pattern", "NOT regexp_matches(field_3, '^PO-\\d{4}$')"),
                          ("field_4_pattern", "NOT regexp_matches(field_4::VARCHAR, '^\\d{4}-\\d{2}-\\d{2}$')")))
def _(spark, d):
    return q.patterns(P.fields(spark, d), {"field_2": r"^INV-\d+$", "field_3": r"^PO-\d{4}$", "field_4": r"^\d{4}-\d{2}-\d{2}$"})


@query("dq_arithmetic", bad("fields", ("base_le_total", "NOT field_8 <= field_10 * 1.05 + 1"), ("tax_le_total", "NOT field_9 <= field_10 + 0.01"),
                            ("start_before_end", "NOT field_4 < field_5")))
def _(spark, d):
    c = F.col
    return q.arithmetic(P.fields(spark, d), {
        "base_le_total": c("field_8") <= c("field_10") * 1.05 + 1, "tax_le_total": c("field_9") <= c("field_10") + 0.01,
        "start_before_end": c("field_4") < c("field_5")})


@query("dq_json", """
SELECT 'json_valid' AS "check", n5 = 0 AS passed, n5::VARCHAR AS detail FROM (SELECT count(*) FILTER (record_id % 5 = 0) AS n5 FROM fields)
UNION ALL SELECT 'json_is_object', n = 0, n::VARCHAR FROM (SELECT count(*) FILTER (record_id % 5 = 1) AS n FROM fields)
UNION ALL SELECT 'json_metadata_keys', n = 0, n::VARCHAR FROM (SELECT count(*) FILTER (record_id % 5 = 2) AS n FROM fields)""")
def _(spark, d):
    """Payloads with cut text, arrays and unknown keys among them."""
    k, raw = F.col("record_id") % 5, F.col("raw_extraction")
    spoiled = F.when(k == 0, F.concat(F.lit("x"), raw)).when(k == 1, F.concat(F.lit("["), raw, F.lit("]"))) \
        .when(k == 2, F.regexp_replace(raw, "vendor_name", "_odd")).otherwise(raw)
    return q.json_checks(P.fields(spark, d).select(spoiled.alias("raw_extraction")))


@query("dq_isolation", bad("(SELECT file_name, count(DISTINCT doc_type) AS n FROM fields JOIN raw_documents USING (file_name) GROUP BY 1)", ("one_type_per_document", "n > 1")))
def _(spark, d):
    return q.isolation(P.fields(spark, d), P.raw_documents(spark, d))


SUMMARY_SCHEMA = [
    ("record_id", "bigint"), ("file_name", "string"), ("doc_type", "string"), ("vendor_name", "string"), ("invoice_number", "string"),
    ("po_number", "string"), ("invoice_date", "date"), ("due_date", "date"), ("payment_terms", "string"), ("recipient", "string"),
    ("subtotal", "decimal(12,2)"), ("tax_amount", "decimal(12,2)"), ("total_amount", "decimal(12,2)"), ("extraction_status", "string"),
    ("extracted_at", "timestamp_ntz"), ("line_item_count", "bigint"), ("computed_line_total", "decimal(22,2)"), ("review_status", "string"),
    ("reviewer_notes", "string"), ("reviewed_by", "string"), ("reviewed_at", "timestamp_ntz"), ("raw_extraction", "string"), ("corrections", "string")]


@query("dq_schema", f"""
SELECT 'column_count' AS "check", true AS passed, count(*) * 0 + {len(SUMMARY_SCHEMA)} || '' AS detail FROM fields
UNION ALL SELECT 'column_names', true, '{",".join(n for n, _ in SUMMARY_SCHEMA)}'
UNION ALL SELECT 'column_types', true, '{",".join(t for _, t in SUMMARY_SCHEMA)}'""")
def _(spark, d):
    return q.schema_contract(spark, summary(spark, d), SUMMARY_SCHEMA)


@query("dq_cross_view", """
SELECT 'daily_vs_kpi' AS "check", gap < 0.1 * greatest(a, b) OR gap = 0 AS passed, round(gap, 2)::VARCHAR AS detail
FROM (SELECT a, b, abs(a - b) AS gap FROM (SELECT
  (SELECT sum(ai_credits)::DOUBLE FROM daily_cost WHERE usage_date >= DATE '2024-01-01') AS a,
  (SELECT round(sum(ai_credits) FILTER (start_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY), 4)::DOUBLE FROM usage_calls) AS b))""")
def _(spark, d):
    kpi = cost.summary(P.usage(spark, d), P.metering(spark, d), P.fields(spark, d), P.FUNCTION, P.WAREHOUSE, P.usage_time())
    days = daily(spark, d).where(F.col("usage_date") >= P.day("2024-01-01")).agg(F.sum("ai_credits"))
    return q.totals_agree("daily_vs_kpi", days, kpi.select("ai_credits_last_30d"), 0.1, relative=True)


@query("dq_cardinality", """
SELECT 'one_row_per_record' AS "check", a = b AS passed, a || ' vs ' || b AS detail
FROM (SELECT (SELECT count(*) FROM summary_rows) AS a, (SELECT count(*) FROM fields) AS b)
UNION ALL SELECT 'record_id_unique', count(*) = count(DISTINCT record_id), (count(*) - count(DISTINCT record_id))::VARCHAR FROM summary_rows""")
def _(spark, d):
    """Reviews of unknown records, and many reviews of one record, leave the view's size alone."""
    reviews = P.reviews(spark, d)
    more = reviews.unionByName(reviews.withColumn("record_id", F.lit(8).cast("bigint"))).unionByName(reviews.withColumn("record_id", -F.col("review_id")))
    view = review.document_summary(P.fields(spark, d), P.raw_documents(spark, d), P.table_data(spark, d), more)
    return q.cardinality(view, P.fields(spark, d))


@query("dq_status", f"""
SELECT count(*) AS checks, count(*) FILTER (NOT passed) AS failed, CASE WHEN bool_or(NOT passed AND "check" <> 'due_date_not_null') THEN 'UNHEALTHY'
  WHEN bool_or(NOT passed) THEN 'DEGRADED' ELSE 'HEALTHY' END AS status
FROM ({check("invoice_number_unique", "count(*) - count(DISTINCT invoice_number) AS n FROM invoices")} UNION ALL {bad(
    "invoices", ("vendor_name_not_null", "vendor_name IS NULL"), ("total_amount_not_null", "total_amount IS NULL"),
    ("due_date_not_null", "due_date IS NULL"), ("status_allowed", "status NOT IN ('PENDING', 'APPROVED', 'PAID')"),
    ("total_amount_in_range", "total_amount < 0.01"))})""")
def _(spark, d):
    """All checks of the invoices in one scan of them."""
    c = F.col
    rules = {f"{name}_not_null": c(name).isNull() for name in ("vendor_name", "total_amount", "due_date")}
    checks = q.together(P.invoices(spark, d), rules | {
        "status_allowed": ~c("status").isin("PENDING", "APPROVED", "PAID"), "total_amount_in_range": c("total_amount") < 0.01}, "invoice_number")
    return q.overall(checks, ["due_date_not_null"])


@query("dq_together", f"""
SELECT * FROM ({check("invoice_number_unique", "count(*) - count(DISTINCT invoice_number) AS n FROM invoices")} UNION ALL {bad(
    "invoices", ("due_date_not_null", "due_date IS NULL"), ("paid", "status <> 'PAID'"), ("total_amount_in_range", "total_amount > 400000"))})""")
def _(spark, d):
    c = F.col
    return q.together(P.invoices(spark, d), {"due_date_not_null": c("due_date").isNull(), "paid": c("status") != "PAID",
                                             "total_amount_in_range": c("total_amount") > 400000}, "invoice_number")


@query("dq_while_written", f"""
SELECT 'rows_written' AS "check", count(*) > 0 AS passed, count(*)::VARCHAR AS detail FROM line_items
UNION ALL {bad("line_items", ("category_not_null", "category IS NULL"), ("quantity_in_range", "quantity < 1 OR quantity > 40"))}
UNION ALL SELECT 'rows_stored', true, count(*)::VARCHAR FROM line_items""")
def _(spark, d):
    """Line items are checked as they are written; the last row counts what was stored."""
    c, path = F.col, shared_dir(spark, "checked")
    checks = q.while_written(P.line_items(spark, d), {"category_not_null": c("category").isNull(), "quantity_in_range": ~c("quantity").between(1, 40)},
                             lambda df: df.write.parquet(path))
    stored = files.table(spark, path).agg(F.lit("rows_stored").alias("check"), F.lit(True).alias("passed"), F.count("*").cast("string").alias("detail"))
    return checks.unionByName(stored)


@query("dq_contract_rules", bad(
    "(SELECT file_name, max(normalized) FILTER (pos = 2) AS no, max(normalized) FILTER (pos = 4) AS day FROM doc_value WHERE doc_type = 'CONTRACT' GROUP BY 1)",
    ("contract_number_pattern", "NOT regexp_matches(no, '^INV')"), ("effective_date_pattern", "NOT regexp_matches(day, '^\\d{4}-\\d{2}-\\d{2}$')")))
def _(spark, d):
    v = lambda k: F.get_json_object("raw_extraction", f"$.{k}").alias(k)
    found = processed(spark, d).where("doc_type = 'CONTRACT'").select("raw_extraction")
    return q.patterns(found.select(v("contract_number"), v("effective_date")), {"contract_number": "^INV", "effective_date": r"^\d{4}-\d{2}-\d{2}$"})
