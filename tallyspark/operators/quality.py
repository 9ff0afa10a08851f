"""Data checks as rows (check, passed, detail).

Checks on one table are evaluated together in a single aggregate over that table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.core import json_map, one_row, small_table

SCHEMA = "check string, passed boolean, detail string"


def _rows(agg: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One aggregate row to one row per check; ``checks`` maps a name to (passed, detail)."""
    items = F.array(*[
        F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("string").alias("detail"))
        for n, (p, d) in checks.items()
    ])
    return agg.select(F.inline(items))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each rule is a condition for a bad row; passes when no row is bad. The detail is the count."""
    agg = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())])
    return _rows(agg, {n: (F.col(f"c{i}") == 0, F.col(f"c{i}")) for i, n in enumerate(rules)})


def together(df: DataFrame, rules: dict[str, Column], unique_column: str) -> DataFrame:
    """``violations`` and ``unique`` of one column in one scan: bad rows are counted per key, then over the keys."""
    per_key = df.groupBy(unique_column).agg(
        F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())])
    sums = [F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(rules))]
    agg = per_key.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count(unique_column)).alias("d"), *sums)
    return _rows(agg, {f"{unique_column}_unique": (F.col("d") == 0, F.col("d")),
                       **{n: (F.col(f"c{i}") == 0, F.col(f"c{i}")) for i, n in enumerate(rules)}})


def while_written(df: DataFrame, rules: dict[str, Column], write: Callable[[DataFrame], None]) -> DataFrame:
    """``violations`` of the rows that ``write`` writes, counted as they pass (observed metrics): no scan of its own.

    The number of rows comes as a check as well, which passes if there are any.
    """
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())]))
    found = seen.get
    rows = [("rows_written", found["rows"] > 0, str(found["rows"]))]
    rows += [(n, found[f"c{i}"] == 0, str(found[f"c{i}"])) for i, n in enumerate(rules)]
    return small_table(df.sparkSession, rows, SCHEMA)


def row_count(df: DataFrame, name: str, at_least: int | None = None, exactly: int | None = None) -> DataFrame:
    n = F.col("n")
    passed = n >= at_least if exactly is None else n == exactly
    return _rows(df.agg(F.count("*").alias("n")), {name: (passed, n)})


def nothing_pending(raw: DataFrame) -> DataFrame:
    return violations(raw, {"nothing_pending": ~F.coalesce(F.col("extracted"), F.lit(False))})


def parity(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    both = one_row(left.agg(F.count("*").alias("l")), right.agg(F.count("*").alias("r")))
    return _rows(both, {name: (F.col("l") == F.col("r"), F.concat_ws(" vs ", "l", "r"))})


def no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return violations(df, {f"{c}_not_null": F.col(c).isNull() for c in columns})


def in_range(df: DataFrame, column: str, low=None, high=None, unless: Column | None = None) -> DataFrame:
    """Values outside [low, high] are bad, except where ``unless`` holds."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    if unless is not None:
        bad = bad & ~unless
    return violations(df, {f"{column}_in_range": bad})


def allowed(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return violations(df, {f"{column}_allowed": ~F.col(column).isin(values)})


def unique(df: DataFrame, column: str) -> DataFrame:
    """Rows less distinct non-NULL values; counted by key so no task holds all values."""
    per_key = df.groupBy(column).agg(F.count("*").alias("n"))
    agg = per_key.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count(column)).alias("d"))
    return _rows(agg, {f"{column}_unique": (F.col("d") == 0, F.col("d"))})


def orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows whose key has no parent."""
    lost = child.select(key).join(parent.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))
    return _rows(lost, {name: (F.col("n") == 0, F.col("n"))})


def conditional(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Paid goes with a payment date and nothing outstanding; unpaid owes its total."""
    paid, unpaid = F.col("status") == "PAID", F.col("status") != "PAID"
    return violations(invoices, {
        "paid_have_payment_date": paid & F.col("payment_date").isNull(),
        "unpaid_no_payment_date": unpaid & F.col("payment_date").isNotNull(),
    }).unionByName(violations(ledger, {
        "paid_zero_outstanding": paid & (F.col("outstanding_amount") != 0),
        "unpaid_outstanding_equals_total": unpaid & (F.col("outstanding_amount") != F.col("total_amount")),
    }))


def reconciled(mismatches: DataFrame, name: str) -> DataFrame:
    return _rows(mismatches.agg(F.count("*").alias("n")), {name: (F.col("n") == 0, F.col("n"))})


def totals_agree(name: str, left: DataFrame, right: DataFrame, tolerance: float = 0.01,
                 relative: bool = False) -> DataFrame:
    """Two one-value frames agree within an absolute or relative tolerance."""
    both = one_row(left.toDF("l"), right.toDF("r")).select(F.col("l").cast("double"), F.col("r").cast("double"))
    gap = F.abs(F.col("l") - F.col("r"))
    limit = tolerance * F.greatest(F.abs("l"), F.abs("r")) if relative else F.lit(tolerance)
    return _rows(both, {name: ((gap < limit) | (gap == 0), F.round(gap, 2))})


def field_order(fields: DataFrame) -> DataFrame:
    return violations(fields, {
        "subtotal_le_total": F.col("field_8") > F.col("field_10"),
        "due_not_before_document": F.col("field_5") < F.col("field_4"),
        "date_in_range": ~F.col("field_4").between(F.lit("1970-01-01").cast("date"), F.lit("2100-01-01").cast("date")),
    })


def line_numbers(lines: DataFrame, key: str = "file_name") -> DataFrame:
    """Line numbers start at 1 and have no large gaps (highest at most twice the count)."""
    per_doc = lines.groupBy(key).agg(F.min("line_number").alias("lo"), F.max("line_number").alias("hi"),
                                     F.count("*").alias("n"))
    return violations(per_doc, {"lines_start_at_one": F.col("lo") != 1, "lines_sequential": F.col("hi") > 2 * F.col("n")})


def field_coverage(payloads: DataFrame, field_table: DataFrame, minimum: float = 0.8) -> DataFrame:
    """Per type and field: in how many documents the payload has a value."""
    present = payloads.select("doc_type", F.explode(json_map(F.col("raw_extraction"))).alias("field", "v")).where(
        F.col("v").isNotNull()).groupBy("doc_type", "field").agg(F.count("*").alias("present"))
    totals = payloads.groupBy("doc_type").agg(F.count("*").alias("documents"))
    wanted = field_table.select("doc_type", "field").join(totals, "doc_type")
    counted = wanted.join(present, ["doc_type", "field"], "left").fillna({"present": 0})
    return counted.select(
        F.concat_ws(".", "doc_type", "field").alias("check"),
        (F.col("present") >= F.col("documents") * F.lit(minimum)).alias("passed"),
        F.concat_ws("/", "present", "documents").alias("detail"))


def patterns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Non-NULL values that do not contain the pattern are bad."""
    return violations(df, {f"{c}_pattern": ~F.col(c).cast("string").rlike(p) for c, p in wanted.items()})


def arithmetic(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Cross-field conditions that must hold where all their inputs are known."""
    return violations(df, {n: ~c for n, c in rules.items()})


META_KEYS = ["_confidence", "_validation_warnings"]


def json_checks(df: DataFrame, column: str = "raw_extraction") -> DataFrame:
    """Payload parses, is an object, and has no unknown keys that start with ``_``."""
    parsed = F.try_parse_json(column)
    keys = F.json_object_keys(F.col(column))
    odd = F.array_except(F.filter(keys, lambda k: k.startswith("_")), F.array(*map(F.lit, META_KEYS)))
    return violations(df, {
        "json_valid": F.col(column).isNotNull() & parsed.isNull(),
        "json_is_object": parsed.isNotNull() & keys.isNull(),
        "json_metadata_keys": F.size(odd) > 0,
    })


def isolation(fields: DataFrame, raw: DataFrame) -> DataFrame:
    """No result belongs to documents of two types."""
    typed = fields.select("file_name").join(raw.select("file_name", "doc_type"), "file_name")
    per_file = typed.groupBy("file_name").agg(F.min("doc_type").alias("lo"), F.max("doc_type").alias("hi"))
    return violations(per_file, {"one_type_per_document": F.col("lo") != F.col("hi")})


def schema_contract(spark: SparkSession, df: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """Names, order, count and types of a view's columns; reads no rows."""
    actual = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    rows = [("column_count", len(actual) == len(expected), f"{len(actual)}"),
            ("column_names", [n for n, _ in actual] == [n for n, _ in expected], ",".join(n for n, _ in actual)),
            ("column_types", [t for _, t in actual] == [t for _, t in expected], ",".join(t for _, t in actual))]
    return small_table(spark, rows, SCHEMA)


def cardinality(summary: DataFrame, fields: DataFrame) -> DataFrame:
    """The review view has one row per record, whatever the reviews."""
    return parity("one_row_per_record", summary, fields).unionByName(unique(summary.select("record_id"), "record_id"))


def accuracy(actual: DataFrame, truth: DataFrame, keys: list[str] | None = None,
             rows: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per type and field: documents compared, matches and rate of (file_name, doc_type, field, value).

    With ``rows`` (``extract.long_fields``) both frames hold a row per document, ``actual`` as ``extract.post_process`` leaves
    it and ``truth`` as (file_name, doc_type, response). Documents meet by their name and become rows per field afterwards,
    so no such row is exchanged or sorted, and documents that are dealt by name stay where they are. A name that comes
    several times has the same fields each time.
    """
    if rows is None:
        t = truth.select("file_name", "doc_type", "field", F.col("value").alias("expected"))
        a = actual.select("file_name", "field", F.col("value").alias("found"))
        pairs = t.join(a, ["file_name", "field"], "left")
    else:
        t = truth.select("file_name", "doc_type", "response")
        both = t.join(actual.select("file_name", "normalized", "confidence"), "file_name", "left")
        pairs = rows(both.withColumn("normalized", _answers_to(F.col("response"), F.col("normalized")))).where("field IS NOT NULL").select(
            "doc_type", "field", F.col("raw").alias("expected"), F.col("normalized").alias("found"))
    same = F.lower(F.trim("expected")).eqNullSafe(F.lower(F.trim("found")))
    numeric = F.col("expected").try_cast("decimal(18,4)") == F.col("found").try_cast("decimal(18,4)")
    hit = same | F.coalesce(numeric, F.lit(False))
    return (
        pairs.groupBy("doc_type", "field")
        .agg(F.count("*").alias("compared"), F.count_if(hit).alias("matched"))
        .withColumn("rate", F.round(F.col("matched") / F.col("compared"), 4))
    )


def _answers_to(response: Column, normalized: Column) -> Column:
    """``normalized`` with exactly the fields of ``response``; one that was not read has no value. They mostly are the same."""
    def read(name: Column) -> Column:
        found = F.get(F.filter(normalized, lambda n: n["name"] == name), F.lit(0))
        return F.struct(name.alias("name"), found["ftype"].alias("ftype"), found["value"].alias("value"))

    return F.when(F.map_keys(response) == normalized["name"], normalized).otherwise(F.transform(F.map_keys(response), read))


def run(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def overall(checks: DataFrame, warn_only: list[str] = ()) -> DataFrame:
    """UNHEALTHY with any failure, DEGRADED with failures of warning checks only, else HEALTHY."""
    severity = F.when(F.col("passed"), 0).when(F.col("check").isin(list(warn_only)), 1).otherwise(2)
    worst = F.coalesce(F.max(severity), F.lit(0))
    return checks.agg(
        F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"),
        F.when(worst == 2, "UNHEALTHY").when(worst == 1, "DEGRADED").otherwise("HEALTHY").alias("status"))
