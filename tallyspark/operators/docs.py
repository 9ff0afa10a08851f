"""Document ledger, lists and summaries over extracted fields and the document registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import aging_bucket, bucket_order, days_past, json_map, mean_of

NO_DATE = "N/A"

# generic column -> business name
LEDGER_NAMES = {
    "field_1": "vendor_name", "field_2": "document_number", "field_3": "reference",
    "field_4": "document_date", "field_5": "due_date", "field_6": "terms", "field_7": "recipient",
    "field_8": "subtotal", "field_9": "tax_amount", "field_10": "total_amount",
}


def with_type(fields: DataFrame, raw: DataFrame) -> DataFrame:
    """Extracted fields with the document type of the registry."""
    return fields.join(raw.select("file_name", "doc_type"), "file_name")


def ledger(fields: DataFrame, raw: DataFrame, as_of: Column) -> DataFrame:
    """Business names plus aging by due date. Documents without due date are ``N/A``, 0 days."""
    days = days_past(F.col("due_date"), as_of)
    named = with_type(fields, raw).select(
        "record_id", "file_name", "doc_type",
        *[F.col(c).alias(n) for c, n in LEDGER_NAMES.items()],
        "status", "extracted_at",
    )
    return named.withColumns({
        "days_past_due": F.coalesce(F.greatest(days, F.lit(0)), F.lit(0)),
        "aging_bucket": F.when(days.isNull(), F.lit(NO_DATE)).otherwise(aging_bucket(days)),
    })


def aging_summary(ledger_df: DataFrame) -> DataFrame:
    return (
        ledger_df.groupBy("aging_bucket")
        .agg(F.count("*").alias("document_count"), F.sum("total_amount").alias("total_amount"))
        .withColumn("sort_order", bucket_order(F.col("aging_bucket"), NO_DATE, 6))
        .orderBy("sort_order")
    )


def aging_chart(ledger_df: DataFrame, doc_type: str | None = None, keep_undated: bool = False) -> DataFrame:
    """Aging as shown on pages: positions from 0, ``N/A`` at 99 or left out."""
    df = ledger_df if doc_type is None else ledger_df.where(F.col("doc_type") == doc_type)
    if not keep_undated:
        df = df.where(F.col("aging_bucket") != NO_DATE)
    return (
        df.groupBy("aging_bucket")
        .agg(F.count("*").alias("document_count"), F.sum("total_amount").alias("total_amount"))
        .withColumn("sort_order", bucket_order(F.col("aging_bucket"), NO_DATE, 99, first=0))
        .orderBy("sort_order")
    )


def sender_summary(fields: DataFrame) -> DataFrame:
    return (
        fields.where(F.col("field_1").isNotNull())
        .groupBy(F.col("field_1").alias("vendor_name"))
        .agg(
            F.count("*").alias("document_count"),
            F.sum("field_10").alias("total_amount"),
            mean_of("field_10").alias("avg_amount"),
            F.min("field_4").alias("first_document"),
            F.max("field_4").alias("last_document"),
        )
        .orderBy(F.desc_nulls_first("total_amount"), "vendor_name")
    )


def top_senders(fields: DataFrame, raw: DataFrame, doc_type: str | None = None, n: int = 15) -> DataFrame:
    df = with_type(fields, raw)
    if doc_type is not None:
        df = df.where(F.col("doc_type") == doc_type)
    return sender_summary(df).select("vendor_name", "document_count", "total_amount", "avg_amount").limit(n)


def monthly_trend(fields: DataFrame) -> DataFrame:
    return (
        fields.where(F.col("field_4").isNotNull())
        .groupBy(F.trunc("field_4", "MM").alias("month"))
        .agg(
            F.count("*").alias("document_count"),
            F.sum("field_10").alias("total_amount"),
            F.sum("field_8").alias("total_subtotal"),
            F.sum("field_9").alias("total_tax"),
            mean_of("field_10").alias("avg_amount"),
        )
        .orderBy("month")
    )


def trend_rollup(trend: DataFrame) -> DataFrame:
    """Total and mean of the monthly sums."""
    return trend.agg(
        F.sum("total_amount").alias("total_amount"),
        mean_of("total_amount").alias("avg_monthly_amount"),
        F.sum("document_count").alias("total_documents"),
        mean_of("document_count").alias("avg_monthly_documents"),
    )


def top_line_items(table_data: DataFrame) -> DataFrame:
    return (
        table_data.where(F.col("col_1").isNotNull())
        .groupBy(F.col("col_1").alias("item_description"), F.col("col_2").alias("category"))
        .agg(
            F.count("*").alias("appearance_count"),
            F.sum("col_3").alias("total_quantity"),
            mean_of("col_4").alias("avg_unit_price"),
            F.sum("col_5").alias("total_spend"),
        )
        .orderBy(F.desc_nulls_first("total_spend"), "item_description", "category")
    )


def kpis(fields: DataFrame, raw: DataFrame, as_of: Column, doc_type: str | None = None) -> DataFrame:
    df = with_type(fields, raw)
    if doc_type is not None:
        df = df.where(F.col("doc_type") == doc_type)
    late = F.col("field_5") < as_of
    return df.agg(
        F.count("*").alias("total_documents"),
        F.sum("field_10").alias("total_amount"),
        F.count_distinct("field_1").alias("unique_senders"),
        F.count(F.when(late, 1)).alias("overdue_count"),
        F.sum(F.when(late, F.col("field_10")).otherwise(0)).alias("overdue_amount"),
    )


def recent_documents(fields: DataFrame, raw: DataFrame, n: int = 15) -> DataFrame:
    return (
        with_type(fields, raw)
        .orderBy(F.desc_nulls_last("extracted_at"), F.desc("record_id"))
        .limit(n)
        .select("record_id", F.col("field_2").alias("document_number"), F.col("field_1").alias("sender"),
                F.col("field_4").alias("document_date"), F.col("field_5").alias("due_date"),
                F.col("field_10").alias("total_amount"), "status", "extracted_at")
    )


def document_list(fields: DataFrame, raw: DataFrame, doc_type: str | None = None, sender: str | None = None,
                  status: str | None = None) -> DataFrame:
    """Filtered list, newest document date first, undated last."""
    df = with_type(fields, raw)
    for name, wanted in (("doc_type", doc_type), ("field_1", sender), ("status", status)):
        if wanted is not None:
            df = df.where(F.col(name) == F.lit(wanted))
    return df.select(
        "record_id", "file_name", "doc_type", F.col("field_1").alias("sender"),
        F.col("field_2").alias("document_number"), F.col("field_4").alias("document_date"),
        F.col("field_5").alias("due_date"), F.col("field_6").alias("terms"), F.col("field_8").alias("subtotal"),
        F.col("field_9").alias("tax"), F.col("field_10").alias("total_amount"), "status",
    ).orderBy(F.desc_nulls_last("document_date"), "record_id")


def pick_list(df: DataFrame, column: str) -> DataFrame:
    """Distinct values for a selection box, in order, without NULL."""
    return df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value")


def detail(df: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """One document by number or file name, with its line items in order.

    The filter reaches both scans; the header is a single row.
    """
    head = df.where((F.col("invoice_number") == key) | (F.col("file_name") == key)).orderBy("file_name").limit(1)
    body = lines.select("file_name", "line_number", "product_name", "category", "quantity", "unit_price", "line_total")
    return (
        head.select("file_name", "invoice_number", "vendor_name", "total_amount")
        .join(body, "file_name", "left")
        .orderBy("line_number", "product_name", "line_total")
    )


def json_fields(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """All keys of the stored payload in order, with their label, split into two display halves.

    ``labels`` has (doc_type, labels map); a key without label shows as title text.
    """
    keyed = (
        fields.join(labels, "doc_type", "left")
        .withColumn("_m", F.map_filter(json_map(F.col("raw_extraction")), lambda k, v: ~k.startswith("_")))
        .withColumn("_n", F.size("_m"))
        .select("record_id", "doc_type", "labels", "_n", F.posexplode("_m").alias("position", "field", "value"))
    )
    spoken = F.replace(F.col("field"), F.lit("_"), F.lit(" "))
    match = F.filter(F.map_values("labels"), lambda v: F.lower(F.replace(v, F.lit("_"), F.lit(" "))) == F.lower(spoken))
    return keyed.select(
        "record_id", "doc_type", "position", "field",
        F.coalesce(F.get(match, F.lit(0)), F.initcap(spoken)).alias("label"),
        F.coalesce(F.when(F.col("value") != "", F.col("value")), F.lit("N/A")).alias("value"),
        F.when(F.col("position") < F.floor((F.col("_n") + 1) / 2), "left").otherwise("right").alias("half"),
    )


def pending(raw: DataFrame) -> DataFrame:
    """Documents still to be processed: flag false or unknown."""
    return raw.where(~F.coalesce(F.col("extracted"), F.lit(False)))


def failed(raw: DataFrame) -> DataFrame:
    """Documents with an error, newest first."""
    return (
        raw.where(F.col("extraction_error").isNotNull())
        .select("file_name", "doc_type", "extraction_error", "staged_at")
        .orderBy(F.desc("staged_at"), "file_name")
    )


def extraction_status(raw: DataFrame) -> DataFrame:
    total = F.count("*")
    done = F.count_if(F.col("extracted"))
    return raw.agg(
        total.alias("total_files"),
        done.alias("extracted_files"),
        F.count_if(~F.col("extracted")).alias("pending_files"),
        F.count_if(F.col("extraction_error").isNotNull()).alias("failed_files"),
        F.max("extracted_at").alias("last_extraction"),
        F.round(F.try_divide(done.cast("double"), total), 4).alias("progress"),
    )


def type_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("doc_type").agg(
        F.count("*").alias("doc_count"), F.count_if(F.col("extracted")).alias("extracted_count")
    )


def type_benchmark(fields: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents and mean amount by type, the join-and-aggregate measured by the benchmark."""
    return with_type(fields, raw).groupBy("doc_type").agg(
        F.count("*").alias("doc_count"), mean_of("field_10").alias("avg_amount")
    ).orderBy("doc_type")


def extraction_latency(fields: DataFrame, raw: DataFrame) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, staged_at, f_extracted_at)")
    return (
        raw.select("file_name", "doc_type", "staged_at")
        .join(fields.select("file_name", F.col("extracted_at").alias("f_extracted_at")), "file_name")
        .groupBy("doc_type")
        .agg(F.count("*").alias("cnt"), mean_of(seconds).alias("avg_seconds"))
    )


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).where("cnt > 1")


def reconcile(docs: DataFrame, lines: DataFrame, key: str, amount: str, line_amount: str,
              tolerance: float) -> DataFrame:
    """Documents whose line total differs from their own amount by more than the tolerance.

    Lines are summed per document before the join; documents without a positive amount are left out.
    """
    sums = lines.groupBy(key).agg(F.sum(line_amount).alias("line_sum"))
    gap = F.abs(F.col("line_sum") - F.col(amount)).cast("double") / F.col(amount).cast("double")
    return (
        docs.where(F.col(amount) > 0).select(key, amount).join(sums, key)
        .withColumn("gap_ratio", F.round(gap, 6)).where(gap > tolerance)
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [df.agg(F.count("*").alias("cnt")).select(F.lit(name).alias("tbl"), "cnt") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)
