"""Registration of files: new names, document types, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.core import number_rows


def register(listing: DataFrame, raw: DataFrame, now: Column, doc_type: Column | str = "INVOICE",
             prefix: str = "") -> DataFrame:
    """Registry rows for files of the listing that are not registered yet.

    Run twice on the same listing, the second run adds nothing.
    """
    kind = F.lit(doc_type) if isinstance(doc_type, str) else doc_type
    fresh = listing.dropDuplicates(["file_name"]).join(raw.select("file_name"), "file_name", "left_anti")
    size = F.col("file_size_bytes") if "file_size_bytes" in listing.columns else F.lit(None)
    return fresh.select(
        "file_name", F.concat(F.lit(prefix), "file_name").alias("file_path"), kind.alias("doc_type"),
        now.alias("staged_at"), F.lit(False).alias("extracted"),
        F.lit(None).cast("timestamp_ntz").alias("extracted_at"), F.lit(None).cast("string").alias("extraction_error"),
        F.lit(None).cast("int").alias("page_count"), size.cast("long").alias("file_size_bytes"),
    )


def route(file_name: Column, rules: list[tuple[str, str]], default: str = "INVOICE") -> Column:
    """Document type by the first name pattern (case-insensitive LIKE) that fits."""
    kind = F.lit(default)
    for pattern, doc_type in reversed(rules):
        kind = F.when(file_name.ilike(pattern), F.lit(doc_type)).otherwise(kind)
    return kind


# directory or name patterns and the type they stand for
ROUTES = [
    ("contracts/%", "CONTRACT"), ("receipts/%", "RECEIPT"), ("utility\\_bills/%", "UTILITY_BILL"),
    ("leases/%", "LEASE"), ("invoices/%", "INVOICE"),
    ("%contract%", "CONTRACT"), ("%receipt%", "RECEIPT"), ("%utility%bill%", "UTILITY_BILL"), ("%lease%", "LEASE"),
]


def seed_if_empty(table: DataFrame, seeds: DataFrame) -> DataFrame:
    """The table, or the seed rows when it has none."""
    rows = table.limit(1).agg(F.count("*")).scalar()
    return table.unionByName(seeds.where(rows == 0), allowMissingColumns=True)


def seed_missing(table: DataFrame, seeds: DataFrame, key: str, id_col: str) -> DataFrame:
    """Add seed rows whose key is not there yet, with the next free ids."""
    fresh = seeds.join(table.select(key), key, "left_anti")
    return table.unionByName(number_rows(fresh, key, id_col, start=table.agg(F.max(id_col))), allowMissingColumns=True)


def page_count(text: Column) -> Column:
    """Pages of a text document: form feeds plus one; NULL without text."""
    return F.size(F.split(text, "\f")).cast("int")


def backfill_metadata(raw: DataFrame, listing: DataFrame) -> DataFrame:
    """Fill size and page count where they are unknown."""
    known = listing.select("file_name", F.col("file_size_bytes").alias("_size"), F.col("page_count").alias("_pages"))
    return (
        raw.join(known, "file_name", "left")
        .withColumns({
            "file_size_bytes": F.coalesce("file_size_bytes", "_size"),
            "page_count": F.coalesce("page_count", "_pages"),
        })
        .select(*raw.columns)
    )


def sanitize(name: Column) -> Column:
    """File name with only letters, digits, dot, dash, underscore and blank; NULL if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9._\- ]", "_"), r"^\.+", ""), F.lit(""))


def sanitize_names(listing: DataFrame) -> DataFrame:
    """Listing with the clean name and, where none is left, an error."""
    clean = sanitize(F.col("file_name"))
    return listing.select(
        "*", clean.alias("clean_name"), F.when(clean.isNull(), "Invalid filename after sanitization").alias("error"))


def empty_registry(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.RAW_DOCUMENTS)
