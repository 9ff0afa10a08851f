"""Review overlay: append-only corrections, of which the newest per record or line wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import latest_per, number_rows, to_amount, to_iso_date
from ..functions.normalize import change_text, safe_date, safe_number, safe_text
from ..functions.values import AMOUNT_LIMIT

# summary column -> (original column, typed correction, kind)
SUMMARY_FIELDS = {
    "vendor_name": ("field_1", "corrected_vendor_name", "text"),
    "invoice_number": ("field_2", "corrected_invoice_number", "text"),
    "po_number": ("field_3", "corrected_po_number", "text"),
    "invoice_date": ("field_4", "corrected_invoice_date", "date"),
    "due_date": ("field_5", "corrected_due_date", "date"),
    "payment_terms": ("field_6", "corrected_payment_terms", "text"),
    "recipient": ("field_7", "corrected_recipient", "text"),
    "subtotal": ("field_8", "corrected_subtotal", "m12"),
    "tax_amount": ("field_9", "corrected_tax_amount", "m12"),
    "total_amount": ("field_10", "corrected_total", "m12"),
}
LINE_FIELDS = {
    "description": ("col_1", "text"), "category": ("col_2", "text"),
    "quantity": ("col_3", "m10"), "unit_price": ("col_4", "m10"), "line_total": ("col_5", "m12"),
}
_CASTS = {
    "text": lambda c: c,
    "date": to_iso_date,
    "m12": lambda c: to_amount(c, 12, 2),
    "m10": lambda c: to_amount(c, 10, 2),
    "whole": lambda c: F.round(to_amount(c, 38, 10)).cast("long"),
}


def correction(key: str, kind: str) -> Column:
    """One entry of the JSON corrections, cast; NULL for missing, null or unfit values."""
    return _CASTS[kind](F.get_json_object("corrections", f"$.{key}"))


def latest(reviews: DataFrame, key: str = "record_id") -> DataFrame:
    return latest_per(reviews, [key], [F.desc("reviewed_at"), F.desc("review_id")])


def line_rollup(table_data: DataFrame) -> DataFrame:
    return table_data.groupBy("file_name").agg(
        F.count("*").alias("line_item_count"), F.sum("col_5").alias("computed_line_total")
    )


def document_summary(fields: DataFrame, raw: DataFrame, table_data: DataFrame, reviews: DataFrame) -> DataFrame:
    """Best known value of every field: JSON correction, else typed correction, else extracted.

    Lines and reviews are reduced to one row per document before they are joined, so the result has
    exactly one row per extracted record whatever the number of reviews.
    """
    review_cols = [typed for _, typed, _ in SUMMARY_FIELDS.values()]
    rv = latest(reviews).select("record_id", *review_cols, "review_status", "reviewer_notes", "reviewed_by",
                                "reviewed_at", "corrections")
    joined = (
        fields.join(raw.select("file_name", "doc_type"), "file_name")
        .join(line_rollup(table_data), "file_name", "left")
        .join(rv, "record_id", "left")
    )
    best = [
        F.coalesce(correction(name, kind), F.col(typed), F.col(original)).alias(name)
        for name, (original, typed, kind) in SUMMARY_FIELDS.items()
    ]
    return joined.select(
        "record_id", "file_name", "doc_type", *best,
        F.col("status").alias("extraction_status"), "extracted_at",
        F.coalesce(correction("line_item_count", "whole"), F.col("line_item_count")).alias("line_item_count"),
        F.coalesce(correction("computed_line_total", "m12"), F.col("computed_line_total")).alias("computed_line_total"),
        "review_status", "reviewer_notes", "reviewed_by", "reviewed_at", "raw_extraction", "corrections",
    )


# earlier name of the same view
invoice_summary = document_summary


def line_item_detail(table_data: DataFrame, line_reviews: DataFrame) -> DataFrame:
    rv = latest(line_reviews, "line_id").select(
        "line_id", *[f"corrected_{c}" for c, _ in LINE_FIELDS.values()],
        F.col("review_id").alias("last_review_id"), "reviewer_notes", "reviewed_by", "reviewed_at", "corrections",
    )
    best = [
        F.coalesce(correction(c, kind), F.col(f"corrected_{c}"), F.col(c)).alias(name)
        for name, (c, kind) in LINE_FIELDS.items()
    ]
    return table_data.join(rv, "line_id", "left").select(
        "line_id", "file_name", "record_id", "line_number", *best, "raw_line_data",
        "last_review_id", "reviewer_notes", "reviewed_by", "reviewed_at", "corrections",
    )


def review_queue(summary: DataFrame, status: str | None = None, doc_type: str | None = None,
                 vendor: str | None = None) -> DataFrame:
    """Documents to look at, newest record first. ``Pending Review`` means never reviewed."""
    if status == "Pending Review":
        summary = summary.where(F.col("review_status").isNull())
    elif status is not None:
        summary = summary.where(F.col("review_status") == status)
    if doc_type is not None:
        summary = summary.where(F.col("doc_type") == doc_type)
    if vendor is not None:
        summary = summary.where(F.col("vendor_name") == vendor)
    return summary.orderBy(F.desc("record_id"))


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cell changes (key, field, was, now) between two snapshots, compared as trimmed text."""
    b = before.select(key, *[change_text(F.col(c)).alias(f"_b_{c}") for c in columns])
    a = after.select(key, *[change_text(F.col(c)).alias(f"_a_{c}") for c in columns])
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), F.coalesce(f"_b_{c}", F.lit("")).alias("was"),
                 F.coalesce(f"_a_{c}", F.lit("")).alias("now"))
        for c in columns
    ])
    changed = F.filter(cells, lambda x: x["was"] != x["now"])
    shown = lambda c: F.when(c == "", F.lit("(empty)")).otherwise(c)
    return (
        b.join(a, key, "full").select(key, F.explode(changed).alias("x"))
        .select(key, "x.field", shown(F.col("x.was")).alias("was"), shown(F.col("x.now")).alias("now"))
    )


def presave_errors(edits: DataFrame, key: str, types: dict[str, str]) -> DataFrame:
    """Problems in edited text columns: (key, field, problem). NULL cells are not checked.

    Kinds: ``number`` (must parse and fit the amount range), ``quantity`` (number, not negative),
    ``date`` (must parse when not blank).
    """
    limit = float(AMOUNT_LIMIT)

    def problem(name: str, kind: str) -> Column:
        text = F.trim(F.col(name))
        if kind == "date":
            return F.when((text != "") & safe_date(text).isNull(), F.lit("not a valid date"))
        number = text.try_cast("double")
        checks = F.when(text.isNotNull() & (number.isNull() | F.isnan(number)), F.lit("not a valid number"))
        if kind == "quantity":
            return checks.when(number < 0, F.lit("negative value"))
        return checks.when(F.abs(number) > limit, F.lit("exceeds allowed range"))

    found = F.array_compact(F.array(*[
        F.when(problem(n, k).isNotNull(), F.struct(F.lit(n).alias("field"), problem(n, k).alias("problem")))
        for n, k in types.items()
    ]))
    return edits.select(key, F.explode(found).alias("x")).select(key, "x.field", "x.problem")


def corrections_json(types: dict[str, str]) -> Column:
    """JSON of the edited values that are present, each through its safe converter."""
    convert = {"text": safe_text, "date": safe_date, "number": safe_number, "quantity": safe_number}
    return F.to_json(F.struct(*[convert[k](F.col(n)).alias(n) for n, k in types.items()]))


def _typed(name: str, kind: str, given: list[str]) -> Column:
    """An edited value through its safe converter, as the type of its column; NULL where the column was not edited."""
    if name not in given:
        value = F.lit(None)
    else:
        value = {"text": safe_text, "date": safe_date}.get(kind, safe_number)(F.col(name))
    return value.try_cast({"text": "string", "date": "date", "m12": "decimal(12,2)", "m10": "decimal(10,2)"}[kind])


def review_rows(edits: DataFrame, types: dict[str, str], reviewer: Column, now: Column,
                first_id: int = 1) -> DataFrame:
    """Edited documents as rows to append to the review table; status defaults to CORRECTED.

    ``types`` names the edited columns and their kinds: each goes into the JSON of corrections, and the ten of
    the summary into their typed columns as well. Ids are dense from ``first_id`` on: pass one more than the
    highest id in use.
    """
    typed = [_typed(name, kind, list(types)).alias(column) for name, (_, column, kind) in SUMMARY_FIELDS.items()]
    return number_rows(edits, "record_id", "review_id").select(
        (F.col("review_id") + (first_id - 1)).alias("review_id"), "record_id", "file_name",
        F.coalesce("review_status", F.lit("CORRECTED")).alias("review_status"), *typed,
        F.col("reviewer_notes"), reviewer.alias("reviewed_by"), now.alias("reviewed_at"),
        corrections_json(types).alias("corrections"),
    )


def line_review_rows(edits: DataFrame, types: dict[str, str], reviewer: Column, now: Column,
                     first_id: int = 1) -> DataFrame:
    """Edited lines (line_id, file_name, record_id and columns by their shown names) as rows of the line review table.

    The JSON of corrections is keyed by the stored column, as ``line_item_detail`` reads it.
    """
    typed = [_typed(name, kind, list(types)).alias(f"corrected_{column}") for name, (column, kind) in LINE_FIELDS.items()]
    stored = edits.withColumnsRenamed({name: column for name, (column, _) in LINE_FIELDS.items()})
    keys = {LINE_FIELDS[name][0] if name in LINE_FIELDS else name: kind for name, kind in types.items()}
    json = number_rows(stored, "line_id", "review_id").select("line_id", "review_id", corrections_json(keys).alias("corrections"))
    return edits.join(json, "line_id").select(
        (F.col("review_id") + (first_id - 1)).alias("review_id"), "line_id", "file_name", "record_id", *typed,
        "corrections", F.col("reviewer_notes"), reviewer.alias("reviewed_by"), now.alias("reviewed_at"))


def audit_trail(reviews: DataFrame, record_id: int | None = None) -> DataFrame:
    """All reviews (of one record), newest first."""
    df = reviews if record_id is None else reviews.where(F.col("record_id") == record_id)
    return df.orderBy(F.desc("reviewed_at"), F.desc("review_id"))


def approved(summary: DataFrame) -> DataFrame:
    """What downstream systems may read."""
    return summary.where(F.col("review_status") == "APPROVED")
