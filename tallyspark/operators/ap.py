"""Accounts-payable ledger and spend analytics over invoices and their line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import aging_bucket, bucket_order, days_past, mean_of

PAID = "Paid"


def ledger(invoices: DataFrame, as_of: Column) -> DataFrame:
    """Each invoice with days past due, aging bucket and the amount still open.

    An unpaid invoice without due date has unknown days past due and counts as the oldest bucket.
    """
    paid = F.coalesce(F.col("status") == "PAID", F.lit(False))
    days = days_past(F.col("due_date"), as_of)
    return invoices.withColumns({
        "days_past_due": F.when(paid, 0).when(days.isNotNull(), F.greatest(days, F.lit(0))),
        "aging_bucket": F.when(paid, F.lit(PAID)).otherwise(aging_bucket(days)),
        "outstanding_amount": F.when(paid, F.lit(0)).otherwise(F.col("total_amount")).cast("decimal(12,2)"),
    })


def filter_ledger(df: DataFrame, vendor: str | None = None, status: str | None = None,
                  aging: str | None = None) -> DataFrame:
    """Optional filters; newest due date first, rows without due date before all others."""
    for name, wanted in (("vendor_name", vendor), ("status", status), ("aging_bucket", aging)):
        if wanted is not None:
            df = df.where(F.col(name) == F.lit(wanted))
    return df.orderBy(F.desc_nulls_first("due_date"), "invoice_id")


def overdue(df: DataFrame) -> DataFrame:
    """Open invoices past their due date, the longest overdue first."""
    late = ~F.col("aging_bucket").isin("Current", PAID)
    return df.where(late).orderBy(F.desc_nulls_first("days_past_due"), "invoice_id")


def aging_summary(ledger_df: DataFrame) -> DataFrame:
    return (
        ledger_df.groupBy("aging_bucket")
        .agg(F.count("*").alias("invoice_count"), F.sum("outstanding_amount").alias("total_outstanding"))
        .withColumn("sort_order", bucket_order(F.col("aging_bucket"), PAID, 6))
        .orderBy("sort_order")
    )


def spend_by_vendor(invoices: DataFrame) -> DataFrame:
    return (
        invoices.groupBy("vendor_name")
        .agg(
            F.count("*").alias("invoice_count"),
            F.sum("total_amount").alias("total_spend"),
            mean_of("total_amount").alias("avg_invoice_amount"),
            F.min("invoice_date").alias("first_invoice"),
            F.max("invoice_date").alias("last_invoice"),
        )
        .orderBy(F.desc_nulls_first("total_spend"), "vendor_name")
    )


def top_vendors(invoices: DataFrame, n: int = 15) -> DataFrame:
    return spend_by_vendor(invoices).limit(n)


def spend_by_category(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.count_distinct("file_name").alias("invoice_count"),
            F.sum("line_total").alias("total_spend"),
            F.sum("quantity").alias("total_units"),
            mean_of("unit_price").alias("avg_unit_price"),
        )
        .orderBy(F.desc_nulls_first("total_spend"), "category")
    )


def monthly_trend(invoices: DataFrame) -> DataFrame:
    return (
        invoices.where(F.col("invoice_date").isNotNull())
        .groupBy(F.trunc("invoice_date", "MM").alias("month"))
        .agg(
            F.count("*").alias("invoice_count"),
            F.sum("total_amount").alias("total_spend"),
            F.sum("subtotal").alias("subtotal"),
            F.sum("tax_amount").alias("total_tax"),
            mean_of("total_amount").alias("avg_invoice_amount"),
        )
        .orderBy("month")
    )


def top_line_items(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("product_name").isNotNull())
        .groupBy("product_name", "category")
        .agg(
            F.count("*").alias("appearance_count"),
            F.sum("quantity").alias("total_quantity"),
            mean_of("unit_price").alias("avg_unit_price"),
            F.sum("line_total").alias("total_spend"),
        )
        .orderBy(F.desc_nulls_first("total_spend"), "product_name", "category")
    )


def top_products(lines: DataFrame, n: int = 20) -> DataFrame:
    return top_line_items(lines).limit(n)


def vendor_payment_terms(invoices: DataFrame) -> DataFrame:
    """Spend by vendor and terms; an invoice without status counts as neither paid nor open."""
    def spend_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("total_amount")).otherwise(0))

    return (
        invoices.groupBy("vendor_name", "payment_terms")
        .agg(
            F.count("*").alias("invoice_count"),
            F.sum("total_amount").alias("total_spend"),
            spend_where(F.col("status") == "PAID").alias("paid_amount"),
            spend_where(F.col("status") != "PAID").alias("outstanding_amount"),
        )
        .orderBy(F.desc_nulls_first("total_spend"), "vendor_name", "payment_terms")
    )


def kpis(invoices: DataFrame, as_of: Column) -> DataFrame:
    """Headline row: totals, open and overdue amounts, days to pay of paid invoices, vendors."""
    amount, unpaid = F.col("total_amount"), F.col("status") != "PAID"
    late = unpaid & (F.col("due_date") < as_of)
    days_to_pay = F.when(F.col("status") == "PAID", F.datediff("payment_date", "invoice_date"))
    return invoices.agg(
        F.count("*").alias("total_invoices"),
        F.sum(amount).alias("total_spend"),
        F.sum(F.when(unpaid, amount).otherwise(0)).alias("total_outstanding"),
        F.sum(F.when(late, amount).otherwise(0)).alias("total_overdue"),
        F.count(F.when(late, 1)).alias("overdue_count"),
        mean_of(days_to_pay).alias("avg_days_to_pay"),
        F.count_distinct("vendor_name").alias("vendor_count"),
    )


def recent_invoices(ledger_df: DataFrame, n: int = 10) -> DataFrame:
    return (
        ledger_df.orderBy(F.desc_nulls_last("extracted_at"), F.desc("invoice_id"))
        .limit(n)
        .select("invoice_id", "invoice_number", "vendor_name", "invoice_date", "due_date",
                "total_amount", "status", "aging_bucket")
    )
