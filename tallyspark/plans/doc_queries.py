"""Document ledger, lists, status and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import json_map, small_table
from ..operators import config, docs, ingest
from . import projections as P
from .base import CTES, query

CTES["doc_ledger_rows"] = """
SELECT record_id, f.file_name, doc_type, field_1 AS vendor_name, field_2 AS document_number, field_3 AS reference,
  field_4 AS document_date, field_5 AS due_date, field_6 AS terms, field_7 AS recipient, field_8::DOUBLE AS subtotal,
  field_9::DOUBLE AS tax_amount, field_10::DOUBLE AS total_amount, status, f.extracted_at,
  CASE WHEN late > 0 THEN late ELSE 0 END AS days_past_due,
  CASE WHEN late IS NULL THEN 'N/A' WHEN late <= 0 THEN 'Current' WHEN late <= 30 THEN '1-30 Days'
    WHEN late <= 60 THEN '31-60 Days' WHEN late <= 90 THEN '61-90 Days' ELSE '90+ Days' END AS aging_bucket
FROM (SELECT *, date_diff('day', field_5, DATE '2000-01-01') AS late FROM fields) f JOIN raw_documents r ON f.file_name = r.file_name
"""


def fields(spark, d):
    return P.fields(spark, d)


def raw(spark, d):
    return P.raw_documents(spark, d)


def ledger(spark, d):
    return docs.ledger(fields(spark, d), raw(spark, d), P.day())


@query("doc_ledger", "SELECT * FROM doc_ledger_rows")
def _(spark, d):
    return ledger(spark, d)


@query("doc_aging", """
SELECT aging_bucket, count(*) AS document_count, sum(total_amount) AS total_amount,
  list_position(['Current', '1-30 Days', '31-60 Days', '61-90 Days', '90+ Days', 'N/A'], aging_bucket)::BIGINT AS sort_order
FROM (SELECT aging_bucket, total_amount::DECIMAL(12,2) AS total_amount FROM doc_ledger_rows) GROUP BY aging_bucket""".replace(
    "sum(total_amount) AS", "sum(total_amount)::DOUBLE AS"))
def _(spark, d):
    return docs.aging_summary(ledger(spark, d))


@query("doc_aging_chart", """
SELECT aging_bucket, count(*) AS document_count, sum(total_amount::DECIMAL(12,2))::DOUBLE AS total_amount,
  CASE aging_bucket WHEN 'N/A' THEN 99 ELSE
    list_position(['Current', '1-30 Days', '31-60 Days', '61-90 Days', '90+ Days'], aging_bucket) - 1 END::BIGINT AS sort_order
FROM doc_ledger_rows WHERE doc_type = 'INVOICE' GROUP BY aging_bucket""")
def _(spark, d):
    return docs.aging_chart(ledger(spark, d), "INVOICE", keep_undated=True)


SENDERS = """
SELECT field_1 AS vendor_name, count(*) AS document_count, sum(field_10)::DOUBLE AS total_amount,
  round(sum(field_10)::DOUBLE / count(field_10), 6) AS avg_amount{dates}
FROM fields f{join} WHERE field_1 IS NOT NULL{where} GROUP BY field_1"""


@query("sender_summary", SENDERS.format(
    dates=", min(field_4) AS first_document, max(field_4) AS last_document", join="", where=""))
def _(spark, d):
    return docs.sender_summary(fields(spark, d))


@query("top_senders", SENDERS.format(
    dates="", join=" JOIN raw_documents r ON f.file_name = r.file_name", where=" AND doc_type = 'RECEIPT'")
    + " ORDER BY sum(field_10) DESC, field_1 LIMIT 15")
def _(spark, d):
    return docs.top_senders(fields(spark, d), raw(spark, d), "RECEIPT")


TREND = """
SELECT date_trunc('month', field_4)::DATE AS month, count(*) AS document_count, sum(field_10)::DOUBLE AS total_amount,
  sum(field_8)::DOUBLE AS total_subtotal, sum(field_9)::DOUBLE AS total_tax,
  round(sum(field_10)::DOUBLE / count(field_10), 6) AS avg_amount
FROM fields WHERE field_4 IS NOT NULL GROUP BY 1"""


@query("doc_monthly_trend", TREND)
def _(spark, d):
    return docs.monthly_trend(fields(spark, d))


@query("trend_rollup", f"""
SELECT sum(total_amount::DECIMAL(18,2))::DOUBLE AS total_amount,
  round(sum(total_amount::DECIMAL(18,2))::DOUBLE / count(*), 6) AS avg_monthly_amount,
  sum(document_count)::BIGINT AS total_documents, round(sum(document_count)::DOUBLE / count(*), 6) AS avg_monthly_documents
FROM ({TREND})""")
def _(spark, d):
    return docs.trend_rollup(docs.monthly_trend(fields(spark, d)))


@query("doc_top_items", """
SELECT col_1 AS item_description, col_2 AS category, count(*) AS appearance_count, sum(col_3)::DOUBLE AS total_quantity,
  round(sum(col_4)::DOUBLE / count(col_4), 6) AS avg_unit_price, sum(col_5)::DOUBLE AS total_spend
FROM table_data WHERE col_1 IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return docs.top_line_items(P.table_data(spark, d))


@query("doc_kpis", """
SELECT count(*) AS total_documents, sum(field_10)::DOUBLE AS total_amount, count(DISTINCT field_1) AS unique_senders,
  count(*) FILTER (field_5 < DATE '2000-01-01') AS overdue_count,
  sum(field_10) FILTER (field_5 < DATE '2000-01-01')::DOUBLE AS overdue_amount
FROM fields JOIN raw_documents USING (file_name)""")
def _(spark, d):
    return docs.kpis(fields(spark, d), raw(spark, d), P.day())


@query("recent_documents", """
SELECT record_id, field_2 AS document_number, field_1 AS sender, field_4 AS document_date, field_5 AS due_date,
  field_10::DOUBLE AS total_amount, status, f.extracted_at
FROM fields f JOIN raw_documents r ON f.file_name = r.file_name
ORDER BY f.extracted_at DESC NULLS LAST, record_id DESC LIMIT 15""")
def _(spark, d):
    return docs.recent_documents(fields(spark, d), raw(spark, d))


@query("doc_list", """
SELECT record_id, f.file_name, doc_type, field_1 AS sender, field_2 AS document_number, field_4 AS document_date,
  field_5 AS due_date, field_6 AS terms, field_8::DOUBLE AS subtotal, field_9::DOUBLE AS tax, field_10::DOUBLE AS total_amount, status
FROM fields f JOIN raw_documents r ON f.file_name = r.file_name WHERE doc_type = 'CONTRACT' AND status = 'EXTRACTED'""")
def _(spark, d):
    return docs.document_list(fields(spark, d), raw(spark, d), doc_type="CONTRACT", status="EXTRACTED")


@query("pick_lists", """
SELECT DISTINCT 'vendor' AS list, vendor_name AS value FROM invoices
UNION ALL SELECT DISTINCT 'sender', field_1 FROM fields WHERE field_1 IS NOT NULL
UNION ALL SELECT DISTINCT 'type', doc_type FROM raw_documents""")
def _(spark, d):
    lists = {"vendor": (P.invoices(spark, d), "vendor_name"), "sender": (fields(spark, d), "field_1"),
             "type": (raw(spark, d), "doc_type")}
    out = None
    for name, (df, column) in lists.items():
        one = docs.pick_list(df, column).select(F.lit(name).alias("list"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("doc_detail", """
SELECT i.file_name, i.invoice_number, vendor_name, total_amount::DOUBLE AS total_amount, line_number::BIGINT AS line_number,
  product_name, category, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, line_total::DOUBLE AS line_total
FROM invoices i LEFT JOIN line_items l ON i.file_name = l.file_name WHERE i.invoice_number = 'INV-77'""")
def _(spark, d):
    return docs.detail(P.invoices(spark, d), P.line_items(spark, d), "INV-77")


LABEL = """coalesce(s.label, CASE p.field WHEN 'bill_to' THEN 'Bill To' WHEN 'vendor_name' THEN 'Vendor Name'
  WHEN 'invoice_number' THEN 'Invoice Number' WHEN 'po_number' THEN 'Po Number' WHEN 'invoice_date' THEN 'Invoice Date'
  WHEN 'due_date' THEN 'Due Date' WHEN 'payment_terms' THEN 'Payment Terms' WHEN 'subtotal' THEN 'Subtotal'
  WHEN 'tax_amount' THEN 'Tax Amount' WHEN 'total_amount' THEN 'Total Amount' END)"""


@query("json_fields", f"""
SELECT p.record_id, p.doc_type, p.position, p.field, {LABEL} AS label, coalesce(p.value, 'N/A') AS value,
  CASE WHEN p.position < 5 THEN 'left' ELSE 'right' END AS half
FROM (SELECT record_id, doc_type, unnest(range(10)) AS position, unnest({list(P.FIELD_OF.values())}) AS field,
    unnest([{', '.join(f'{f}::VARCHAR' for f in P.FIELD_OF)}]) AS value
  FROM fields JOIN raw_documents USING (file_name)) p
LEFT JOIN spec s ON s.doc_type = p.doc_type AND lower(s.label) = replace(p.field, '_', ' ')""")
def _(spark, d):
    typed = docs.with_type(fields(spark, d), raw(spark, d))
    labels = config.default_config(spark).select("doc_type", json_map(F.col("field_labels")).alias("labels"))
    return docs.json_fields(typed, labels)


@query("work_lists", """
SELECT 'pending' AS list, file_name, doc_type, staged_at FROM raw_documents WHERE NOT coalesce(extracted, false)
UNION ALL SELECT 'failed', file_name, doc_type, staged_at FROM raw_documents WHERE extraction_error IS NOT NULL""")
def _(spark, d):
    cols = ["file_name", "doc_type", "staged_at"]
    todo, bad = docs.pending(raw(spark, d)), docs.failed(raw(spark, d))
    return todo.select(F.lit("pending").alias("list"), *cols).unionByName(bad.select(F.lit("failed").alias("list"), *cols))


@query("extraction_status", """
SELECT count(*) AS total_files, count(*) FILTER (extracted) AS extracted_files, count(*) FILTER (NOT extracted) AS pending_files,
  count(extraction_error) AS failed_files, max(extracted_at) AS last_extraction,
  round(count(*) FILTER (extracted)::DOUBLE / count(*), 4) AS progress
FROM raw_documents""")
def _(spark, d):
    return docs.extraction_status(raw(spark, d))


@query("doc_type_counts", """
SELECT doc_type, count(*) AS doc_count, count(*) FILTER (extracted) AS extracted_count FROM raw_documents GROUP BY doc_type""")
def _(spark, d):
    return docs.type_counts(raw(spark, d))


@query("type_benchmark", """
SELECT doc_type, count(*) AS doc_count, round(sum(field_10)::DOUBLE / count(field_10), 6) AS avg_amount
FROM fields JOIN raw_documents USING (file_name) GROUP BY doc_type""")
def _(spark, d):
    return docs.type_benchmark(fields(spark, d), raw(spark, d))


@query("extraction_latency", """
SELECT doc_type, count(*) AS cnt, round(sum(date_diff('second', staged_at, f.extracted_at))::DOUBLE / count(*), 6) AS avg_seconds
FROM fields f JOIN raw_documents r ON f.file_name = r.file_name GROUP BY doc_type""")
def _(spark, d):
    return docs.extraction_latency(fields(spark, d), raw(spark, d))


@query("duplicates", "SELECT file_name, line_number::BIGINT AS line_number, count(*) AS cnt FROM line_items GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return docs.duplicates(P.line_items(spark, d), "file_name", "line_number")


@query("line_reconciliation", """
SELECT invoice_number, subtotal::DOUBLE AS subtotal, line_sum::DOUBLE AS line_sum, round(gap, 6) AS gap_ratio
FROM (SELECT i.invoice_number, subtotal, line_sum, abs(line_sum - subtotal)::DOUBLE / subtotal::DOUBLE AS gap
  FROM invoices i JOIN (SELECT invoice_number, sum(line_total) AS line_sum FROM line_items GROUP BY 1) l
    ON i.invoice_number = l.invoice_number WHERE subtotal > 0)
WHERE gap > 0.2""")
def _(spark, d):
    return docs.reconcile(P.invoices(spark, d), P.line_items(spark, d), "invoice_number", "subtotal", "line_total", 0.2)


@query("config_summary", f"""
SELECT doc_type, n.display_name, field_count, true AS active, documents FROM
  (SELECT doc_type, count(*) AS field_count FROM spec GROUP BY doc_type)
  JOIN (VALUES {P._values([(t, s['display_name']) for t, s in P.V.DOC_TYPES.items()])}) n(doc_type, display_name) USING (doc_type)
  LEFT JOIN (SELECT doc_type, count(*) AS documents FROM raw_documents GROUP BY doc_type) USING (doc_type)""")
def _(spark, d):
    used = raw(spark, d).groupBy("doc_type").agg(F.count("*").alias("documents"))
    return config.summary(config.default_config(spark)).join(used, "doc_type", "left")


@query("row_counts_union", """
SELECT 'raw_documents' AS tbl, count(*) AS cnt FROM raw_documents UNION ALL SELECT 'fields', count(*) FROM fields
UNION ALL SELECT 'table_data', count(*) FROM table_data""")
def _(spark, d):
    return docs.row_counts({"raw_documents": raw(spark, d), "fields": fields(spark, d), "table_data": P.table_data(spark, d)})


# --- registration ------------------------------------------------------------------------------

@query("register_new", """
SELECT file_name, 'docs/' || file_name AS file_path, doc_type, TIMESTAMP '2024-02-01 12:00:00' AS staged_at, false AS extracted,
  NULL::TIMESTAMP AS extracted_at, NULL::VARCHAR AS extraction_error, NULL::BIGINT AS page_count, file_size_bytes
FROM raw_documents WHERE NOT extracted""")
def _(spark, d):
    """The listing holds all files, the registry those already extracted."""
    listing = raw(spark, d).select("file_name", "file_size_bytes", F.col("doc_type").alias("_type"))
    known = raw(spark, d).where("extracted")
    return ingest.register(listing, known, P.run_time(), F.col("_type"), "docs/")


PATHS = ["contracts/", "receipts/", "utility_bills/", "leases/", "inbox/contract-", "inbox/my receipt ", "inbox/"]


@query("route_doc_type", f"""
SELECT path, CASE o_orderkey % 7 WHEN 0 THEN 'CONTRACT' WHEN 1 THEN 'RECEIPT' WHEN 2 THEN 'UTILITY_BILL' WHEN 3 THEN 'LEASE'
  WHEN 4 THEN 'CONTRACT' WHEN 5 THEN 'RECEIPT' ELSE 'INVOICE' END AS doc_type
FROM (SELECT o_orderkey, {PATHS}[o_orderkey % 7 + 1] || printf('doc_%08d.pdf', o_orderkey) AS path FROM orders)""")
def _(spark, d):
    folder = F.get(F.array(*map(F.lit, PATHS)), (F.col("o_orderkey") % 7).cast("int"))
    names = P.read(spark, d, "orders").select(F.concat(folder, F.format_string("doc_%08d.pdf", "o_orderkey")).alias("path"))
    return names.select("path", ingest.route(F.col("path"), ingest.ROUTES).alias("doc_type"))


@query("seed_if_empty", f"""
SELECT c_custkey AS vendor_id, c_name AS vendor_name, NULL::VARCHAR AS address, 'Net 30' AS default_terms FROM customer
UNION ALL SELECT NULL, * FROM (VALUES {P._values(P.V.VENDORS)}) t(vendor_name, address, default_terms)""")
def _(spark, d):
    """A vendor table that already has rows stays as it is; one that no customer is in gets the seeds."""
    vendors = P.read(spark, d, "customer").select(
        F.col("c_custkey").alias("vendor_id"), F.col("c_name").alias("vendor_name"),
        F.lit(None).cast("string").alias("address"), F.lit("Net 30").alias("default_terms"))
    seeds = small_table(spark, P.V.VENDORS, "vendor_name string, address string, default_terms string")
    return ingest.seed_if_empty(vendors, seeds).unionByName(ingest.seed_if_empty(vendors.where("vendor_name = ''"), seeds))


@query("seed_missing", f"""
WITH seeds AS (SELECT * FROM (VALUES {P._values(P.V.VENDORS)}) t(vendor_name, address, default_terms)),
numbered AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(vendor_name), 1, 3))::INT, vendor_name) AS rn FROM seeds)
SELECT c_custkey AS vendor_id, c_name AS vendor_name, NULL AS address, 'Net 30' AS default_terms FROM customer
UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + rn, vendor_name, address, default_terms FROM numbered""")
def _(spark, d):
    vendors = P.read(spark, d, "customer").select(
        F.col("c_custkey").alias("vendor_id"), F.col("c_name").alias("vendor_name"),
        F.lit(None).cast("string").alias("address"), F.lit("Net 30").alias("default_terms"))
    seeds = small_table(spark, P.V.VENDORS, "vendor_name string, address string, default_terms string")
    return ingest.seed_missing(vendors, seeds, "vendor_name", "vendor_id")


@query("metadata_backfill", """
SELECT file_name, doc_type, coalesce(CASE WHEN extracted THEN page_count END, 1 + length(file_name) - 20)::BIGINT AS page_count,
  CASE WHEN extracted THEN file_size_bytes ELSE 1000 + page_count END AS file_size_bytes FROM raw_documents""")
def _(spark, d):
    known = raw(spark, d)
    listing = known.select("file_name", (F.lit(1000) + F.col("page_count")).cast("bigint").alias("file_size_bytes"),
                           (F.length("file_name") - 19).alias("page_count"))
    gaps = known.withColumns({c: F.when(F.col("extracted"), F.col(c)) for c in ("page_count", "file_size_bytes")})
    return ingest.backfill_metadata(gaps, listing).select("file_name", "doc_type", "page_count", "file_size_bytes")


@query("sanitize_names", """
SELECT file_name, nullif(ltrim(regexp_replace(file_name, '[^a-zA-Z0-9._\\- ]', '_', 'g'), '.'), '') AS clean_name,
  CASE WHEN nullif(ltrim(regexp_replace(file_name, '[^a-zA-Z0-9._\\- ]', '_', 'g'), '.'), '') IS NULL
    THEN 'Invalid filename after sanitization' END AS error
FROM (SELECT CASE page_id % 5 WHEN 0 THEN '../' || url WHEN 1 THEN '...' ELSE url END AS file_name FROM pages)""")
def _(spark, d):
    name = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), "url")).when(F.col("page_id") % 5 == 1, "...").otherwise(F.col("url"))
    return ingest.sanitize_names(P.read(spark, d, "pages").select(name.alias("file_name")))
