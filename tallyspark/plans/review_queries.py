"""Review overlay and changes to stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import small_table
from ..functions.normalize import safe_date, safe_number, safe_text
from ..operators import buckets, config, extract, review, tables
from ..sources import files
from ..session import shared_dir
from . import projections as P
from .base import CTES, query

CTES["newest_review"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY reviewed_at DESC, review_id DESC) AS rn
  FROM reviews) WHERE rn = 1
"""
CTES["newest_line_review"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY reviewed_at DESC, review_id DESC) AS rn
  FROM line_reviews) WHERE rn = 1
"""
# what the JSON form of a correction says, after the casts that may fail
CTES["summary_rows"] = """
SELECT f.record_id, f.file_name, r.doc_type,
  coalesce(json_extract_string(v.corrections, '$.vendor_name'), v.corrected_vendor_name, field_1) AS vendor_name,
  field_2 AS invoice_number, field_3 AS po_number,
  coalesce(try_cast(json_extract_string(v.corrections, '$.invoice_date') AS DATE), v.corrected_invoice_date, field_4) AS invoice_date,
  coalesce(try_cast(json_extract_string(v.corrections, '$.due_date') AS DATE), field_5) AS due_date,
  field_6 AS payment_terms, field_7 AS recipient,
  coalesce(round(try_cast(json_extract_string(v.corrections, '$.subtotal') AS DECIMAL(18,6)), 2)::DOUBLE, field_8::DOUBLE) AS subtotal,
  field_9::DOUBLE AS tax_amount,
  coalesce(try_cast(json_extract_string(v.corrections, '$.total_amount') AS DECIMAL(12,2)), v.corrected_total, field_10)::DOUBLE AS total_amount,
  f.status AS extraction_status, f.extracted_at,
  coalesce(json_extract_string(v.corrections, '$.line_item_count')::BIGINT, l.n) AS line_item_count,
  coalesce(json_extract_string(v.corrections, '$.computed_line_total')::DOUBLE, l.total::DOUBLE) AS computed_line_total,
  v.review_status, v.reviewer_notes, v.reviewed_by, v.reviewed_at, v.corrections
FROM fields f JOIN raw_documents r ON f.file_name = r.file_name
LEFT JOIN (SELECT file_name, count(*) AS n, sum(col_5) AS total FROM table_data GROUP BY 1) l ON f.file_name = l.file_name
LEFT JOIN newest_review v ON f.record_id = v.record_id
"""


def summary(spark, d):
    return review.document_summary(P.fields(spark, d), P.raw_documents(spark, d), P.table_data(spark, d), P.reviews(spark, d))


@query("latest_review", "SELECT record_id, review_id, review_status, reviewed_by, reviewed_at, corrections FROM newest_review")
def _(spark, d):
    return review.latest(P.reviews(spark, d)).select("record_id", "review_id", "review_status", "reviewed_by", "reviewed_at", "corrections")


@query("latest_line_review", "SELECT line_id, review_id, reviewer_notes, reviewed_at, corrections FROM newest_line_review")
def _(spark, d):
    return review.latest(P.line_reviews(spark, d), "line_id").select("line_id", "review_id", "reviewer_notes", "reviewed_at", "corrections")


PAIRS = " || ',' || ".join(f"'\"{c}\":' || coalesce('\"' || {f}::VARCHAR || '\"', 'null')" for f, c in P.FIELD_OF.items())
CTES["stored_payload"] = f"SELECT record_id, '{{' || {PAIRS} || '}}' AS raw_extraction FROM fields"


@query("document_summary", "SELECT s.*, p.raw_extraction FROM summary_rows s JOIN stored_payload p ON s.record_id = p.record_id")
def _(spark, d):
    return summary(spark, d)


@query("line_item_detail", """
SELECT t.line_id, t.file_name, t.record_id, t.line_number::BIGINT AS line_number, coalesce(v.corrected_col_1, col_1) AS description,
  coalesce(json_extract_string(v.corrections, '$.col_2'), col_2) AS category,
  coalesce(v.corrected_col_3, col_3)::DOUBLE AS quantity, col_4::DOUBLE AS unit_price,
  coalesce(round(json_extract_string(v.corrections, '$.col_5')::DECIMAL(12,4), 2)::DOUBLE, col_5::DOUBLE) AS line_total,
  '{"Product":"' || col_1 || '","Qty":"' || col_3 || '"}' AS raw_line_data,
  v.review_id AS last_review_id, v.reviewer_notes, v.reviewed_by, v.reviewed_at, v.corrections
FROM table_data t LEFT JOIN newest_line_review v ON t.line_id = v.line_id""")
def _(spark, d):
    return review.line_item_detail(P.table_data(spark, d), P.line_reviews(spark, d))


@query("review_queue", "SELECT record_id, file_name, vendor_name, total_amount FROM summary_rows WHERE review_status IS NULL AND doc_type = 'LEASE'")
def _(spark, d):
    return review.review_queue(summary(spark, d), "Pending Review", "LEASE").select("record_id", "file_name", "vendor_name", "total_amount")


@query("review_diff", """
SELECT record_id, field, was, now FROM (
  SELECT f.record_id, unnest(['field_1', 'field_5', 'field_10']) AS field,
    unnest([field_1, coalesce(field_5::VARCHAR, '(empty)'), field_10::VARCHAR]) AS was,
    unnest([CASE WHEN f.record_id % 3 = 0 THEN ' ' || field_1 || ' ' WHEN f.record_id % 3 = 1 THEN '(empty)' ELSE field_1 END,
      coalesce((field_5 + (f.record_id % 2)::INT)::VARCHAR, '(empty)'), (field_10 + (f.record_id % 5 = 0)::INT)::VARCHAR]) AS now
  FROM fields f) WHERE trim(was) <> trim(now)""")
def _(spark, d):
    before = P.fields(spark, d)
    k = F.col("record_id")
    after = before.withColumns({
        "field_1": F.when(k % 3 == 0, F.concat(F.lit(" "), "field_1", F.lit(" "))).when(k % 3 == 1, F.lit(None)).otherwise(F.col("field_1")),
        "field_5": F.date_add("field_5", (k % 2).cast("int")),
        "field_10": (F.col("field_10") + F.when(k % 5 == 0, 1).otherwise(0)).cast("decimal(12,2)"),
    })
    return review.diff(before, after, "record_id", ["field_1", "field_5", "field_10"])


def edits(spark, d):
    """Reviewer input as text, one edit per order, with bad values among them."""
    k = F.col("o_orderkey")
    forms = [F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("abc"), F.lit("10000000000"), F.lit("-5"), F.lit("  "), F.lit(None).cast("string")]
    days = [F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("soon"), F.lit("2025-13-01"), F.lit("")]
    return P.read(spark, d, "orders").select(
        k.alias("record_id"), P.file_name("o_orderkey").alias("file_name"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("vendor_name"),
        F.get(F.array(*forms), (k % 6).cast("int")).alias("total_amount"),
        F.get(F.array(*forms), ((k + 2) % 6).cast("int")).alias("quantity"),
        F.get(F.array(*days), (k % 5).cast("int")).alias("due_date"))


CTES["edit_rows"] = """
SELECT o_orderkey AS record_id, printf('invoice_%08d.pdf', o_orderkey) AS file_name, ' ' || o_orderpriority || ' ' AS vendor_name,
  a[o_orderkey % 6 + 1] AS total_amount, a[(o_orderkey + 2) % 6 + 1] AS quantity,
  [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%m/%d/%Y'), 'soon', '2025-13-01', ''][o_orderkey % 5 + 1] AS due_date,
  o_orderdate::DATE AS day
FROM (SELECT *, [o_totalprice::DECIMAL(12,2)::VARCHAR, 'abc', '10000000000', '-5', '  ', NULL] AS a FROM orders)
"""


@query("presave_validation", """
SELECT record_id, 'total_amount' AS field, CASE WHEN total_amount = '10000000000' THEN 'exceeds allowed range' ELSE 'not a valid number' END AS problem
FROM edit_rows WHERE total_amount IN ('abc', '10000000000', '  ')
UNION ALL SELECT record_id, 'quantity', CASE WHEN quantity = '-5' THEN 'negative value' ELSE 'not a valid number' END
FROM edit_rows WHERE quantity IN ('abc', '-5', '  ')
UNION ALL SELECT record_id, 'due_date', 'not a valid date' FROM edit_rows WHERE due_date IN ('soon', '2025-13-01')""")
def _(spark, d):
    return review.presave_errors(edits(spark, d), "record_id", {"total_amount": "number", "quantity": "quantity", "due_date": "date"})


@query("safe_convert", """
SELECT record_id, trim(vendor_name) AS vendor_name,
  CASE WHEN abs(try_cast(trim(total_amount) AS DOUBLE)) <= 9999999999.99 THEN try_cast(trim(total_amount) AS DOUBLE) END AS total_amount,
  CASE WHEN record_id % 5 < 2 THEN strftime(day, '%Y-%m-%d') END AS due_date
FROM edit_rows""")
def _(spark, d):
    return edits(spark, d).select("record_id", safe_text(F.col("vendor_name")).alias("vendor_name"),
                                  safe_number(F.col("total_amount")).alias("total_amount"), safe_date(F.col("due_date")).alias("due_date"))


@query("corrections_json", """
SELECT record_id, trim(vendor_name) AS vendor_name,
  CASE WHEN abs(try_cast(trim(total_amount) AS DOUBLE)) <= 9999999999.99 THEN try_cast(trim(total_amount) AS DOUBLE) END AS total_amount,
  CASE WHEN record_id % 5 < 2 THEN strftime(day, '%Y-%m-%d') END AS due_date,
  1 + (try_cast(trim(total_amount) AS DOUBLE) <= 9999999999.99 IS TRUE)::INT + (record_id % 5 < 2)::INT::BIGINT AS keys
FROM edit_rows""")
def _(spark, d):
    types = {"vendor_name": "text", "total_amount": "number", "due_date": "date"}
    made = edits(spark, d).select("record_id", review.corrections_json(types).alias("c"))
    return made.select(
        "record_id", F.get_json_object("c", "$.vendor_name").alias("vendor_name"),
        F.get_json_object("c", "$.total_amount").try_cast("double").alias("total_amount"),
        F.get_json_object("c", "$.due_date").alias("due_date"), F.size(F.json_object_keys("c")).alias("keys"))


@query("audit_trail", "SELECT record_id, review_id, review_status, reviewer_notes, reviewed_at FROM reviews WHERE record_id = 7")
def _(spark, d):
    return review.audit_trail(P.reviews(spark, d), 7).select("record_id", "review_id", "review_status", "reviewer_notes", "reviewed_at")


@query("approved_documents", "SELECT record_id, vendor_name, total_amount, reviewed_by FROM summary_rows WHERE review_status = 'APPROVED'")
def _(spark, d):
    return review.approved(summary(spark, d)).select("record_id", "vendor_name", "total_amount", "reviewed_by")


TYPED = ["vendor_name", "invoice_number", "po_number", "invoice_date", "due_date", "payment_terms", "recipient", "subtotal",
         "tax_amount", "total"]
SAFE = "CASE WHEN abs(try_cast(trim({0}) AS DOUBLE)) <= 9999999999.99 THEN try_cast(trim({0}) AS DOUBLE) END"
STORED_REVIEW = {"vendor_name": "corrected_vendor_name", "invoice_date": "corrected_invoice_date", "total": "corrected_total::DOUBLE"}
EDITED = {"vendor_name": "trim(vendor_name)", "due_date": "due::DATE", "total": "total"}


def _columns(known: dict[str, str]) -> str:
    kind = lambda c: "DATE" if c.endswith("date") else "DOUBLE" if c in ("subtotal", "tax_amount", "total") else "VARCHAR"
    return ", ".join(f"{known.get(c, f'NULL::{kind(c)}')} AS corrected_{c}" for c in TYPED)


@query("append_reviews", f"""
SELECT review_id, record_id, file_name, review_status, {_columns(STORED_REVIEW)}, reviewer_notes, reviewed_by, reviewed_at, corrections FROM reviews
UNION ALL SELECT row_number() OVER (ORDER BY ('0x' || substr(md5(record_id::VARCHAR), 1, 3))::INT, record_id), record_id, file_name, 'CORRECTED',
  {_columns(EDITED)}, 'edited', 'clerk', TIMESTAMP '2024-02-01 12:00:00',
  '{{"vendor_name":"' || trim(vendor_name) || '"' || coalesce(',"total_amount":' || total, '') || coalesce(',"due_date":"' || due || '"', '') || '}}'
FROM (SELECT *, {SAFE.format('total_amount')} AS total, CASE WHEN record_id % 5 < 2 THEN strftime(day, '%Y-%m-%d') END AS due FROM edit_rows)""")
def _(spark, d):
    """Stored reviews and edited documents, both with all columns, are written to one table by appending."""
    path = shared_dir(spark, "reviews")
    files.append(P.reviews(spark, d), path)
    given = edits(spark, d).withColumns({"review_status": F.lit(None).cast("string"), "reviewer_notes": F.lit("edited")})
    types = {"vendor_name": "text", "total_amount": "number", "due_date": "date"}
    files.append(review.review_rows(given, types, F.lit("clerk"), P.run_time()), path)
    return files.table(spark, path)


@query("append_line_reviews", f"""
SELECT row_number() OVER (ORDER BY ('0x' || substr(md5(line_id::VARCHAR), 1, 3))::INT, line_id) AS review_id, line_id, file_name, record_id,
  'part ' || quantity AS corrected_col_1, NULL::VARCHAR AS corrected_col_2, q::DOUBLE AS corrected_col_3, NULL::DOUBLE AS corrected_col_4,
  total AS corrected_col_5, '{{"col_1":"part ' || quantity || '"' || coalesce(',"col_3":' || q::DOUBLE, '') || coalesce(',"col_5":' || total, '') || '}}' AS corrections,
  'counted again' AS reviewer_notes, 'clerk' AS reviewed_by, TIMESTAMP '2024-02-01 12:00:00' AS reviewed_at
FROM (SELECT *, col_3::BIGINT AS quantity, CASE WHEN col_3::BIGINT % 2 = 0 THEN col_3::BIGINT + 1 END AS q, col_5::DOUBLE AS total
  FROM table_data WHERE line_number = 1)""")
def _(spark, d):
    """The first lines, edited: every second quantity is no number, all totals carry blanks."""
    whole = F.col("col_3").cast("bigint")
    first = P.table_data(spark, d).where("line_number = 1").select(
        "line_id", "file_name", "record_id", F.concat(F.lit(" part "), whole).alias("description"),
        F.when(whole % 2 == 0, (whole + 1).cast("string")).otherwise("many").alias("quantity"),
        F.concat(F.lit(" "), F.col("col_5").cast("string")).alias("line_total"), F.lit("counted again").alias("reviewer_notes"))
    return review.line_review_rows(first, {"description": "text", "quantity": "quantity", "line_total": "number"}, F.lit("clerk"), P.run_time())


# --- table changes -------------------------------------------------------------------------------

@query("mark_extracted", """
SELECT r.file_name, CASE WHEN f.record_id IS NOT NULL AND r.doc_type = 'INVOICE' THEN TIMESTAMP '2024-02-01 12:00:00' ELSE r.extracted_at END AS extracted_at,
  r.extracted, CASE WHEN NOT r.extracted THEN left(repeat('x', 600), 500) ELSE r.extraction_error END AS extraction_error
FROM raw_documents r LEFT JOIN fields f ON r.file_name = f.file_name""")
def _(spark, d):
    """Documents of one type are set back and marked again; pending ones get a long error."""
    before = tables.reset_flags(P.raw_documents(spark, d), F.col("doc_type") == "INVOICE") \
        .withColumn("extraction_error", F.when(F.col("doc_type") == "INVOICE", P_error()).otherwise(F.col("extraction_error")))
    errors = P.raw_documents(spark, d).where("NOT extracted").select(
        "file_name", F.repeat(F.lit("x"), 600).alias("error"), F.col("staged_at").alias("failed_at"))
    marked = tables.mark_extracted(before, P.fields(spark, d), P.run_time())
    return tables.record_errors(marked, errors).select("file_name", "extracted_at", "extracted", "extraction_error")


def P_error():
    key = F.regexp_extract("file_name", r"^invoice_(\d+)\.pdf$", 1).cast("bigint")
    return F.when(key % 97 == 0, "parse error")


NEW_ROWS = """SELECT 'new ' || file_name AS file_name, vendor_name AS field_1, total_amount AS field_10 FROM invoices WHERE status = 'PENDING'
  UNION ALL SELECT file_name, 'changed', 1.00 FROM fields WHERE field_6 = 'Net 15'"""


@query("upsert_fields", f"""
WITH fresh AS ({NEW_ROWS}), added AS (
  SELECT n.*, row_number() OVER (ORDER BY ('0x' || substr(md5(n.file_name), 1, 3))::INT, n.file_name) AS rn
  FROM fresh n WHERE n.file_name NOT IN (SELECT file_name FROM fields))
SELECT f.record_id, f.file_name, CASE WHEN n.file_name IS NULL THEN f.field_1 ELSE n.field_1 END AS field_1, f.field_2,
  CASE WHEN n.file_name IS NULL THEN f.field_10 ELSE n.field_10 END::DOUBLE AS field_10
FROM fields f LEFT JOIN fresh n ON f.file_name = n.file_name
UNION ALL SELECT (SELECT max(record_id) FROM fields) + rn, file_name, field_1, NULL, field_10::DOUBLE FROM added""")
def _(spark, d):
    old = P.fields(spark, d).select("record_id", "file_name", "field_1", "field_2", "field_10", "field_6")
    pending = P.invoices(spark, d).where("status = 'PENDING'").select(
        F.concat(F.lit("new "), "file_name").alias("file_name"), F.col("vendor_name").alias("field_1"), F.col("total_amount").alias("field_10"))
    changed = old.where("field_6 = 'Net 15'").select("file_name", F.lit("changed").alias("field_1"), F.lit("1.00").cast("decimal(12,2)").alias("field_10"))
    return tables.upsert(old.drop("field_6"), pending.unionByName(changed), "file_name", "record_id")


@query("upsert_scoped", """
WITH pending AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(file_name), 1, 3))::INT, file_name) AS rn
  FROM invoices WHERE status = 'PENDING' AND invoice_id % 97 = 0)
SELECT record_id, file_name, CASE WHEN record_id % 97 = 0 THEN 'a newer name' ELSE field_1 END AS field_1,
  CASE WHEN record_id % 97 = 0 THEN 2.0::DOUBLE ELSE field_10::DOUBLE END AS field_10 FROM fields
UNION ALL SELECT (SELECT max(record_id) FROM fields) + rn, file_name, 'a newer name', 2.0::DOUBLE FROM pending""")
def _(spark, d):
    """Results stored in hash buckets; a small change set, each document twice, rewrites only its buckets. The later change wins
    though its columns are smaller, stored rows keep their ids and new ones get the next free ids."""
    stored = buckets.BucketedTable(spark, shared_dir(spark, "bucketed"), "file_name", 16)
    stored.write(P.fields(spark, d).select("record_id", "file_name", "field_1", "field_10", "extracted_at"))
    inv = P.invoices(spark, d).where("invoice_id % 97 = 0")
    change = lambda name, amount, at: inv.select(
        "file_name", F.lit(name).alias("field_1"), F.lit(amount).cast("decimal(12,2)").alias("field_10"), P.moment(at).alias("extracted_at"))
    stored.upsert(change("the older name", "3.00", "2024-01-01 00:00:00").unionByName(
        change("a newer name", "2.00", "2024-01-02 00:00:00")), "record_id", newest="extracted_at")
    return stored.read().drop("extracted_at")


@query("replace_scoped", """
SELECT file_name, line_id, col_1 FROM table_data WHERE substr(file_name, 9, 8)::BIGINT % 97 <> 0
UNION ALL SELECT file_name, record_id, 'whole document' FROM fields WHERE record_id % 97 = 0
UNION ALL SELECT t.file_name, line_id, col_1 FROM table_data t LEFT JOIN fields f ON t.file_name = f.file_name
WHERE substr(t.file_name, 9, 8)::BIGINT % 97 = 0 AND f.file_name IS NULL""")
def _(spark, d):
    """Line rows stored in buckets of their document; those of a few documents are replaced."""
    stored = buckets.BucketedTable(spark, shared_dir(spark, "bucketed"), "file_name", 16)
    stored.write(P.table_data(spark, d).select("file_name", "line_id", "col_1"))
    stored.replace_children(P.fields(spark, d).where("record_id % 97 = 0").select(
        "file_name", F.col("record_id").alias("line_id"), F.lit("whole document").alias("col_1")))
    return stored.read()


@query("newest_version", "SELECT record_id, file_name, 'second' AS status, field_10::DOUBLE AS field_10 FROM fields")
def _(spark, d):
    """Two versions of the results are complete, a third is written only in part and not in the manifest."""
    base, rows = shared_dir(spark, "versions"), P.fields(spark, d).select("record_id", "file_name", "status", "field_10")
    files.write_version(rows.withColumn("status", F.lit("first")), base, 1)
    files.write_version(files.newest_version(spark, base).withColumn("status", F.lit("second")), base, 2)
    files.write_version(rows.where("record_id % 2 = 0").withColumn("status", F.lit("third")), base, 3, publish=False)
    return files.newest_version(spark, base)


@query("upsert_registry", """
SELECT file_name, doc_type, CASE WHEN extraction_error IS NULL THEN extracted ELSE true END AS extracted, NULL::VARCHAR AS extraction_error FROM raw_documents""")
def _(spark, d):
    """Saving a document again clears its error."""
    raw = P.raw_documents(spark, d).select("file_name", "doc_type", "extracted", "extraction_error")
    saved = raw.where("extraction_error IS NOT NULL").select(
        "file_name", F.lit(True).alias("extracted"), F.lit(None).cast("string").alias("extraction_error"))
    return tables.upsert(raw, saved, "file_name")


@query("replace_children", """
SELECT file_name, line_id, col_1 FROM table_data WHERE file_name NOT IN (SELECT file_name FROM fields WHERE field_6 = 'Net 30')
UNION ALL SELECT file_name, record_id, 'whole document' FROM fields WHERE field_6 = 'Net 30'""")
def _(spark, d):
    new = P.fields(spark, d).where("field_6 = 'Net 30'").select("file_name", F.col("record_id").alias("line_id"), F.lit("whole document").alias("col_1"))
    return tables.replace_children(P.table_data(spark, d).select("file_name", "line_id", "col_1"), new, "file_name")


@query("delete_by_type", """
SELECT 'kept' AS part, count(*) AS n FROM table_data WHERE file_name NOT IN (SELECT file_name FROM raw_documents WHERE doc_type = 'LEASE')
UNION ALL SELECT 'removed', count(*) FROM table_data WHERE file_name IN (SELECT file_name FROM raw_documents WHERE doc_type = 'LEASE')""")
def _(spark, d):
    leases = P.raw_documents(spark, d).where("doc_type = 'LEASE'")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    t = P.table_data(spark, d)
    return count("kept", tables.delete_where_in(t, leases, "file_name")).unionByName(
        count("removed", tables.keep_where_in(t, leases, "file_name")))


@query("reset_pattern", """
SELECT 'raw_documents' AS tbl, count(*) AS n FROM raw_documents WHERE file_name NOT LIKE 'invoice_000001%'
UNION ALL SELECT 'fields', count(*) FROM fields WHERE file_name NOT LIKE 'invoice_000001%'
UNION ALL SELECT 'table_data', count(*) FROM table_data WHERE file_name NOT LIKE 'invoice_000001%'""")
def _(spark, d):
    kept = tables.reset_pattern(P.raw_documents(spark, d), {"fields": P.fields(spark, d), "table_data": P.table_data(spark, d)}, "invoice_000001%")
    out = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t, df in kept.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("set_active", """
SELECT doc_type, active, count(*) AS documents FROM (SELECT doc_type, doc_type NOT IN ('LEASE', 'RECEIPT') AS active FROM raw_documents) GROUP BY 1, 2""")
def _(spark, d):
    off = small_table(spark, [("LEASE", False), ("RECEIPT", False)], "doc_type string, active boolean")
    changed = config.set_active(config.default_config(spark), off).select("doc_type", "active")
    return P.raw_documents(spark, d).join(changed, "doc_type").groupBy("doc_type", "active").agg(F.count("*").alias("documents"))


@query("add_types", """
SELECT 'added' AS outcome, replace(upper(trim(n_name)), ' ', '_') AS doc_type FROM nation
UNION ALL SELECT 'rejected', t FROM (SELECT DISTINCT o_orderpriority AS t FROM orders) WHERE false
UNION ALL SELECT 'rejected', 'INVOICE'""")
def _(spark, d):
    """New types from a list of names, one of which exists already."""
    new = P.read(spark, d, "nation").select(F.concat(F.lit(" "), F.lower("n_name")).alias("doc_type"), F.col("n_name").alias("display_name"))
    new = new.unionByName(small_table(spark, [("invoice ", "Again")], "doc_type string, display_name string"))
    base = config.default_config(spark)
    table, rejected = config.add_types(base, new)
    added = table.join(base.select("doc_type"), "doc_type", "left_anti")
    return added.select(F.lit("added").alias("outcome"), "doc_type").unionByName(rejected.select(F.lit("rejected").alias("outcome"), "doc_type"))


@query("config_upsert", """
SELECT r.doc_type, CASE WHEN doc_type = 'LEASE' THEN 'Rental' ELSE replace(upper(left(doc_type, 1)) || lower(substr(doc_type, 2)), '_b', ' B') END AS display_name,
  count(*) AS documents FROM raw_documents r GROUP BY 1, 2""")
def _(spark, d):
    change = small_table(spark, [("LEASE", "Rental"), ("MEMO", "Memo")], "doc_type string, display_name string")
    new = tables.upsert(config.default_config(spark), change, "doc_type")
    return P.raw_documents(spark, d).join(new, "doc_type").groupBy("doc_type", "display_name").agg(F.count("*").alias("documents"))


@query("json_edit", """
SELECT record_id, strftime(field_4, '%Y-%m-%d') AS invoice_date, field_10::VARCHAR AS total_amount,
  CASE WHEN field_5 IS NULL THEN '0' ELSE field_5::VARCHAR END AS due_date, field_1 AS vendor_name, 'yes' AS checked FROM fields""")
def _(spark, d):
    """Payloads with US dates, dollar signs and None words, put right in place."""
    f = P.fields(spark, d)
    dirty = F.to_json(F.create_map(
        F.lit("invoice_date"), F.date_format("field_4", "MM/dd/yyyy"), F.lit("total_amount"), F.concat(F.lit("$"), "field_10"),
        F.lit("due_date"), F.coalesce(F.col("field_5").cast("string"), F.lit("None")), F.lit("vendor_name"), F.col("field_1")))
    value = lambda k: F.get_json_object("raw", f"$.{k}")
    edited = tables.edit_json(F.col("raw"), {
        "invoice_date": tables.us_date_to_iso(value("invoice_date")), "total_amount": tables.without_dollar(value("total_amount")),
        "due_date": tables.zero_for_none(value("due_date")), "checked": F.lit("yes")})
    clean = f.select("record_id", dirty.alias("raw")).select("record_id", edited.alias("c"))
    return clean.select("record_id", *[F.get_json_object("c", f"$.{k}").alias(k) for k in
                                       ("invoice_date", "total_amount", "due_date", "vendor_name", "checked")])


@query("add_columns", "SELECT file_name, NULL::BIGINT AS page_count, NULL::BIGINT AS file_size_bytes FROM raw_documents")
def _(spark, d):
    old = P.raw_documents(spark, d).select("file_name")
    return tables.add_columns(old, {"page_count": "int", "file_size_bytes": "bigint"})


@query("keep_newest", "SELECT * FROM (SELECT file_name, max(review_id) AS review_id FROM reviews GROUP BY 1)")
def _(spark, d):
    return tables.keep_newest(P.reviews(spark, d), "file_name", "review_id").select("file_name", "review_id")


@query("latest_by_key", "SELECT record_id, max(review_id) AS review_id FROM reviews GROUP BY 1")
def _(spark, d):
    return tables.latest_by_key(P.reviews(spark, d), "record_id", "review_id")


@query("restore_missing", "SELECT record_id, file_name FROM fields")
def _(spark, d):
    snapshot = P.fields(spark, d).select("record_id", "file_name", "field_6")
    return tables.restore_missing(snapshot, snapshot.where("field_6 <> 'Net 15'"), "record_id").drop("field_6")


STORED = ", ".join(f"field_{i}{'::DOUBLE' if i > 7 else ''} AS field_{i}" for i in range(1, 11))


@query("csv_roundtrip", f"SELECT record_id, file_name, {STORED}, status, extracted_at FROM fields")
def _(spark, d):
    """The results, all columns, as one CSV file in order of their ids."""
    df = P.fields(spark, d).drop("raw_extraction")
    path = f"{shared_dir(spark, 'export')}/results.csv"
    files.export_csv(df, path, order=["record_id"])
    return files.read_csv(spark, path, df.schema)


@query("csv_folder", "SELECT record_id, file_name, field_1, field_4, field_10::DOUBLE AS field_10 FROM fields")
def _(spark, d):
    df = P.fields(spark, d).select("record_id", "file_name", "field_1", "field_4", "field_10")
    path = shared_dir(spark, "export")
    files.export_csv(df, path, single_file=False)
    return files.read_csv(spark, path, df.schema)


# --- field names and overflow ----------------------------------------------------------------------

@query("field_overflow", """
SELECT file_name, v.doc_type, pos::BIGINT AS pos, field AS field_name, CASE WHEN normalized IS NULL AND pos > 10 THEN NULL ELSE normalized END AS value
FROM doc_value v WHERE v.doc_type IN ('UTILITY_BILL', 'LEASE')""")
def _(spark, d):
    """All fields of the types with more than ten, from columns and payload."""
    done = extract.post_process(P.field_docs(spark, d)).where(F.col("doc_type").isin("UTILITY_BILL", "LEASE"))
    cols = [F.get("normalized", F.lit(i))["value"] for i in range(10)]
    pos = F.col("pos")
    return done.select("file_name", "doc_type", "values", F.array(*cols).alias("_c"), "specs", F.posexplode_outer("specs.name").alias("i", "n")) \
        .withColumn("pos", F.col("i") + 1).select(
            "file_name", "doc_type", "pos",
            extract.field_name(pos, F.col("specs.name"), F.col("n")).alias("field_name"),
            extract.field_value(pos, [F.get("_c", F.lit(i)) for i in range(10)], F.col("values"),
                                F.replace(F.col("n"), F.lit("_"), F.lit(" "))).alias("value"))
