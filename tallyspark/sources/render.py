"""Documents as text: labelled lines, a pipe-separated table, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import long_date, money_text

TABLE_HEADER = "# | Product | Category | Qty | Unit Price | Total"


def _labelled(label: str, value: Column) -> Column:
    """``Label: value``, or NULL without value so that the line is left out."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value))


def fold_lines(lines: DataFrame, key: str, order: list[str], text: Column) -> DataFrame:
    """Line texts of each document as one array in order. A document is one value, so its lines meet here."""
    item = F.struct(*order, text.alias("_text"))
    return lines.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_l")).select(
        key, F.col("_l._text").alias("table_rows"))


def invoice_line(number: Column, product: Column, category: Column, qty: Column, price: Column, total: Column) -> Column:
    return F.concat_ws(" | ", number.cast("string"), product, F.coalesce(category, F.lit("")),
                       qty.cast("string"), money_text(price), money_text(total))


def invoices(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Invoice text per document of ``headers``; ``rows`` has (file_name, table_rows)."""
    tax_rate = F.format_number(F.col("tax_amount").cast("double") / F.col("subtotal").cast("double") * 100, 1)
    body = F.array(
        F.col("vendor_name"), F.lit("INVOICE"),
        _labelled("Invoice Number", F.col("invoice_number")), _labelled("PO Number", F.col("po_number")),
        _labelled("Invoice Date", long_date(F.col("invoice_date"))), _labelled("Due Date", long_date(F.col("due_date"))),
        _labelled("Payment Terms", F.col("payment_terms")),
        F.lit(""), F.when(F.col("bill_to").isNotNull(), F.concat(F.lit("Bill To:\n"), "bill_to")),
        F.lit(""), F.lit(TABLE_HEADER), F.array_join(F.coalesce("table_rows", F.array().cast("array<string>")), "\n"),
        F.lit(""), _labelled("Subtotal", money_text(F.col("subtotal"))),
        F.concat(F.lit("Tax ("), F.coalesce(tax_rate, F.lit("0.0")), F.lit("%): "), money_text(F.col("tax_amount"))),
        _labelled("TOTAL DUE", money_text(F.col("total_amount"))),
    )
    return headers.join(rows, "file_name", "left").withColumn("text", F.array_join(body, "\n")).drop("table_rows")


def labelled(df: DataFrame, sender: str, labels: dict[str, str], table_header: list[str] | None = None,
             cells=None) -> DataFrame:
    """Text of any other document: sender, ``Label: value`` lines, then the table from ``lines``.

    ``labels`` maps a column to its printed label; ``cells`` maps a line struct to its cell columns.
    """
    parts = [F.col(sender), *[_labelled(label, F.col(c).cast("string")) for c, label in labels.items()]]
    if table_header:
        rows = F.transform("lines", lambda x: F.concat_ws(" | ", *[c.cast("string") for c in cells(x)]))
        parts += [F.lit(""), F.lit(" | ".join(table_header)), F.array_join(rows, "\n")]
    return df.withColumn("text", F.array_join(F.array(*parts), "\n"))
