"""Changes to stored tables, each a function from the old table and a change set to the new one.

Plain files have no UPDATE or MERGE: callers write the result as a new version of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import json_map, latest_per, number_rows
from ..functions.values import ERROR_TEXT_LENGTH


def _flagged(keys: DataFrame, key: str, flag: str) -> DataFrame:
    return keys.select(key).distinct().withColumn(flag, F.lit(True))


def mark_extracted(raw: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Set the flag and time of pending documents that have a result."""
    hit = F.col("_hit").isNotNull() & ~F.coalesce(F.col("extracted"), F.lit(False))
    return (
        raw.join(_flagged(results, "file_name", "_hit"), "file_name", "left")
        .withColumns({
            "extracted_at": F.when(hit, now).otherwise(F.col("extracted_at")),
            "extracted": F.when(hit, F.lit(True)).otherwise(F.col("extracted")),
        })
        .select(*raw.columns)
    )


def record_errors(raw: DataFrame, errors: DataFrame) -> DataFrame:
    """Attach the newest error (file_name, error, failed_at), cut to 500 characters.

    The document stays pending, so it is tried again.
    """
    newest = errors.groupBy("file_name").agg(F.max_by("error", "failed_at").alias("_error"))
    return (
        raw.join(newest, "file_name", "left")
        .withColumn("extraction_error", F.coalesce(F.substring("_error", 1, ERROR_TEXT_LENGTH), "extraction_error"))
        .select(*raw.columns)
    )


def upsert(old: DataFrame, new: DataFrame, key: str, id_col: str | None = None,
           keep: tuple[str, ...] = (), newest: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; the rest is inserted.

    A replaced row keeps its id, the columns in ``keep`` and the columns ``new`` does not have.
    Inserted rows get the next free ids. A change set that is small enough is broadcast by Spark,
    so the stored table is not shuffled. ``new`` is read more than once: store it first when it is costly.
    Of several changes with one key the one with the greatest ``newest`` column counts (a time or a number;
    NULL is oldest), among equal ones, or without that argument, the greatest row, compared column by column.
    ``start`` is a one-row frame with the highest id in use, where ``old`` is not the whole table.
    """
    rest = [c for c in new.columns if c != key]
    order = F.struct(newest, *rest) if newest else F.struct(*rest)
    new = new.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*") if rest else new.distinct()
    new = new.select(key, *rest)
    fixed = {key, id_col, *keep}
    changed = [c for c in new.columns if c in old.columns and c not in fixed]
    change = new.select(key, F.struct(*changed).alias("_change"))
    kept = old.join(change, key, "left").select(*[
        F.when(F.col("_change").isNotNull(), F.col(f"_change.{c}")).otherwise(F.col(c)).alias(c)
        if c in changed else F.col(c)
        for c in old.columns
    ])
    known = old.select(key).join(new.select(key), key, "left_semi")
    added = new.join(known, key, "left_anti")
    if id_col is not None:
        added = number_rows(added.drop(id_col), key, id_col, start=old.agg(F.max(id_col)) if start is None else start)
    return kept.unionByName(added, allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All child rows of the parents in ``new`` are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new)


def delete_where_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


def keep_where_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi").select(*df.columns)


def reset_flags(raw: DataFrame, condition: Column) -> DataFrame:
    """Documents that match become pending again, without time or error."""
    hit = F.coalesce(condition, F.lit(False))
    return raw.withColumns({
        "extracted_at": F.when(~hit, F.col("extracted_at")),
        "extraction_error": F.when(~hit, F.col("extraction_error")),
        "extracted": F.when(hit, F.lit(False)).otherwise(F.col("extracted")),
    })


def reset_pattern(raw: DataFrame, children: dict[str, DataFrame], pattern: str) -> dict[str, DataFrame]:
    """Remove documents whose name is like the pattern, and their rows in the child tables."""
    def keep(df: DataFrame) -> DataFrame:
        return df.where(~F.coalesce(F.col("file_name").like(pattern), F.lit(False)))

    return {"raw_documents": keep(raw), **{name: keep(df) for name, df in children.items()}}


def set_columns(df: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Overwrite columns for the keys in a small change set; other rows stay."""
    names = [c for c in changes.columns if c != key]
    change = changes.select(key, *[F.col(c).alias(f"_c_{c}") for c in names])
    return (
        df.join(change, key, "left")
        .withColumns({c: F.coalesce(F.col(f"_c_{c}"), F.col(c)) for c in names})
        .select(*df.columns)
    )


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add NULL columns of the given types where they do not exist yet."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def keep_newest(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One row per key: the one with the highest id."""
    return latest_per(df, [key], [F.desc(id_col)])


def latest_by_key(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """The highest id per key, without moving the other columns."""
    return df.groupBy(key).agg(F.max(id_col).alias(id_col))


def missing_rows(snapshot: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return snapshot.join(current.select(key), key, "left_anti").select(*snapshot.columns)


def restore_missing(snapshot: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return current.unionByName(missing_rows(snapshot, current, key))


def edit_json(payload: Column, changes: dict[str, Column]) -> Column:
    """Set keys of a JSON object; a change that is NULL leaves the key as it is.

    ``changes`` maps a key to an expression over the payload's map column (see ``edit_values``).
    """
    entries = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v)])
    updates = F.map_filter(entries, lambda k, v: v.isNotNull())
    rest = F.map_filter(json_map(payload), lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    return F.to_json(F.map_concat(rest, updates))


def us_date_to_iso(text: Column) -> Column:
    """``MM/DD/YYYY`` inside the text rewritten; NULL where there is none."""
    return F.when(text.rlike(r"\d{2}/\d{2}/\d{4}"), F.regexp_replace(text, r"(\d{2})/(\d{2})/(\d{4})", "$3-$1-$2"))


def without_dollar(text: Column) -> Column:
    return F.when(text.startswith("$"), F.replace(text, F.lit("$"), F.lit("")))


def zero_for_none(text: Column) -> Column:
    return F.when(text.isin("None", "N/A", "none"), F.lit("0"))
