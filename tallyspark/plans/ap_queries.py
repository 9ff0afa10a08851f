"""Accounts-payable queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import one_row
from ..operators import ap
from ..sources import synth
from . import projections as P
from .base import CTES, draw, query

CTES["ap_ledger_rows"] = """
SELECT *, CASE WHEN status = 'PAID' THEN 0 WHEN late IS NOT NULL THEN greatest(late, 0) END AS days_past_due,
  CASE WHEN status = 'PAID' THEN 'Paid' WHEN late <= 0 THEN 'Current' WHEN late <= 30 THEN '1-30 Days'
    WHEN late <= 60 THEN '31-60 Days' WHEN late <= 90 THEN '61-90 Days' ELSE '90+ Days' END AS aging_bucket,
  CASE WHEN status = 'PAID' THEN 0 ELSE total_amount END::DECIMAL(12,2) AS outstanding_amount
FROM (SELECT *, date_diff('day', due_date, DATE '2000-01-01') AS late FROM invoices)
"""
LEDGER = """invoice_id, file_name, vendor_name, invoice_number, po_number, invoice_date, due_date, payment_terms, bill_to,
  subtotal::DOUBLE AS subtotal, tax_amount::DOUBLE AS tax_amount, total_amount::DOUBLE AS total_amount, status, payment_date,
  extracted_at, days_past_due, aging_bucket, outstanding_amount::DOUBLE AS outstanding_amount"""


def ledger(spark, d):
    return ap.ledger(P.invoices(spark, d), P.day())


@query("ap_ledger", f"SELECT {LEDGER} FROM ap_ledger_rows")
def _(spark, d):
    return ledger(spark, d)


@query("ap_ledger_filtered", f"SELECT {LEDGER} FROM ap_ledger_rows WHERE status = 'APPROVED' AND aging_bucket = '31-60 Days'")
def _(spark, d):
    return ap.filter_ledger(ledger(spark, d), status="APPROVED", aging="31-60 Days")


@query("ap_overdue", f"SELECT {LEDGER} FROM ap_ledger_rows WHERE aging_bucket NOT IN ('Current', 'Paid')")
def _(spark, d):
    return ap.overdue(ledger(spark, d))


@query("aging_summary", """
SELECT aging_bucket, count(*) AS invoice_count, sum(outstanding_amount)::DOUBLE AS total_outstanding,
  list_position(['Current', '1-30 Days', '31-60 Days', '61-90 Days', '90+ Days', 'Paid'], aging_bucket)::BIGINT AS sort_order
FROM ap_ledger_rows GROUP BY aging_bucket""")
def _(spark, d):
    return ap.aging_summary(ledger(spark, d))


SPEND = """
SELECT vendor_name, count(*) AS invoice_count, sum(total_amount)::DOUBLE AS total_spend,
  round(sum(total_amount)::DOUBLE / count(total_amount), 6) AS avg_invoice_amount,
  min(invoice_date) AS first_invoice, max(invoice_date) AS last_invoice
FROM invoices GROUP BY vendor_name"""


@query("spend_by_vendor", SPEND)
def _(spark, d):
    return ap.spend_by_vendor(P.invoices(spark, d))


@query("top_vendors", SPEND + " ORDER BY sum(total_amount) DESC, vendor_name LIMIT 15")
def _(spark, d):
    return ap.top_vendors(P.invoices(spark, d))


@query("spend_by_category", """
SELECT category, count(DISTINCT file_name) AS invoice_count, sum(line_total)::DOUBLE AS total_spend,
  sum(quantity)::DOUBLE AS total_units, round(sum(unit_price)::DOUBLE / count(unit_price), 6) AS avg_unit_price
FROM line_items WHERE category IS NOT NULL GROUP BY category""")
def _(spark, d):
    return ap.spend_by_category(P.line_items(spark, d))


@query("monthly_trend", """
SELECT date_trunc('month', invoice_date)::DATE AS month, count(*) AS invoice_count, sum(total_amount)::DOUBLE AS total_spend,
  sum(subtotal)::DOUBLE AS subtotal, sum(tax_amount)::DOUBLE AS total_tax,
  round(sum(total_amount)::DOUBLE / count(total_amount), 6) AS avg_invoice_amount
FROM invoices WHERE invoice_date IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return ap.monthly_trend(P.invoices(spark, d))


TOP_ITEMS = """
SELECT product_name, category, count(*) AS appearance_count, sum(quantity)::DOUBLE AS total_quantity,
  round(sum(unit_price)::DOUBLE / count(unit_price), 6) AS avg_unit_price, sum(line_total)::DOUBLE AS total_spend
FROM line_items WHERE product_name IS NOT NULL GROUP BY product_name, category"""


@query("top_line_items", TOP_ITEMS)
def _(spark, d):
    return ap.top_line_items(P.line_items(spark, d))


@query("top_products", TOP_ITEMS + " ORDER BY sum(line_total) DESC, product_name, category LIMIT 20")
def _(spark, d):
    return ap.top_products(P.line_items(spark, d))


@query("vendor_payment_terms", """
SELECT vendor_name, payment_terms, count(*) AS invoice_count, sum(total_amount)::DOUBLE AS total_spend,
  coalesce(sum(total_amount) FILTER (status = 'PAID'), 0)::DOUBLE AS paid_amount,
  coalesce(sum(total_amount) FILTER (status <> 'PAID'), 0)::DOUBLE AS outstanding_amount
FROM invoices GROUP BY vendor_name, payment_terms""")
def _(spark, d):
    return ap.vendor_payment_terms(P.invoices(spark, d))


@query("ap_kpis", """
SELECT count(*) AS total_invoices, sum(total_amount)::DOUBLE AS total_spend,
  sum(total_amount) FILTER (status <> 'PAID')::DOUBLE AS total_outstanding,
  sum(total_amount) FILTER (status <> 'PAID' AND due_date < DATE '2000-01-01')::DOUBLE AS total_overdue,
  count(*) FILTER (status <> 'PAID' AND due_date < DATE '2000-01-01') AS overdue_count,
  round(sum(payment_date - invoice_date) FILTER (status = 'PAID')::DOUBLE / count(*) FILTER (status = 'PAID'), 6) AS avg_days_to_pay,
  count(DISTINCT vendor_name) AS vendor_count
FROM invoices""")
def _(spark, d):
    return ap.kpis(P.invoices(spark, d), P.day())


@query("recent_invoices", """
SELECT invoice_id, invoice_number, vendor_name, invoice_date, due_date, total_amount::DOUBLE AS total_amount, status, aging_bucket
FROM ap_ledger_rows ORDER BY extracted_at DESC NULLS LAST, invoice_id DESC LIMIT 10""")
def _(spark, d):
    return ap.recent_invoices(ledger(spark, d))


@query("headline_counts", """
SELECT (SELECT count(*) FROM orders) AS invoices, (SELECT sum(total_amount)::DOUBLE FROM invoices) AS total_spend,
  (SELECT count(*) FROM lineitem) AS line_items, (SELECT count(DISTINCT vendor_name) FROM invoices) AS vendors""")
def _(spark, d):
    head = P.invoices(spark, d).agg(F.count("*").alias("invoices"), F.sum("total_amount").alias("total_spend"),
                                    F.count_distinct("vendor_name").alias("vendors"))
    return one_row(head, P.line_items(spark, d).agg(F.count("*").alias("line_items")))


@query("simulated_status", f"""
SELECT invoice_id, CASE WHEN paid THEN 'PAID' WHEN due_date < DATE '2000-01-01' AND {draw(100, 'file_name', "'approved'")} < 50 THEN 'APPROVED' ELSE 'PENDING' END AS status,
  CASE WHEN paid THEN invoice_date + (5 + {draw(21, 'file_name', "'days'")})::INT END AS payment_date
FROM (SELECT *, due_date < DATE '1999-12-02' AND {draw(100, 'file_name', "'paid'")} < 85 AS paid FROM invoices)""")
def _(spark, d):
    """Who has paid and when, and what is approved, of invoices that all begin as pending."""
    start = P.invoices(spark, d).withColumns({"status": F.lit("PENDING"), "payment_date": F.lit(None).cast("date")})
    return synth.assign_status(start, P.day()).select("invoice_id", "status", "payment_date")
