import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators import quality, review
from tallyspark.plans.quality_queries import SUMMARY_SCHEMA


def fields(spark):
    row = (1, "a.pdf", "Vendor", "N1", "PO1", dt.date(2024, 1, 1), dt.date(2024, 2, 1), "Net 30", "Me",
           Decimal("90.00"), Decimal("10.00"), Decimal("100.00"), "{}", "EXTRACTED", dt.datetime(2024, 1, 2))
    return spark.createDataFrame([row], schemas.FIELDS)


def raw(spark):
    return spark.createDataFrame([("a.pdf", "INVOICE")], "file_name string, doc_type string")


def lines(spark, n=2):
    rows = [(i, "a.pdf", "1", i, "p", "c", Decimal("1.00"), Decimal("2.00"), Decimal("50.00"), "{}") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, schemas.TABLE_DATA)


def reviews(spark, *entries):
    """entries: (review_id, minute, corrections, typed values)."""
    rows = []
    for rid, minute, corrections, typed in entries:
        row = {f.name: None for f in schemas.DOCUMENT_REVIEW}
        row.update(review_id=rid, record_id=1, file_name="a.pdf", review_status="CORRECTED",
                   reviewed_at=dt.datetime(2024, 3, 1, 0, minute), corrections=None if corrections is None else json.dumps(corrections), **typed)
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, schemas.DOCUMENT_REVIEW)


def summary(spark, *entries):
    return review.document_summary(fields(spark), raw(spark), lines(spark), reviews(spark, *entries))


@pytest.mark.parametrize("corrections, typed, column, expected", [
    (None, {}, "vendor_name", "Vendor"),
    (None, {"corrected_vendor_name": "Typed"}, "vendor_name", "Typed"),
    ({"vendor_name": "Json"}, {"corrected_vendor_name": "Typed"}, "vendor_name", "Json"),
    ({"vendor_name": ""}, {}, "vendor_name", ""),
    ({"vendor_name": None}, {}, "vendor_name", "Vendor"),
    ({}, {}, "vendor_name", "Vendor"),
    ({"total_amount": "123.456789"}, {}, "total_amount", Decimal("123.46")),
    ({"total_amount": 7777.7}, {}, "total_amount", Decimal("7777.70")),
    ({"total_amount": "99999999999.99"}, {}, "total_amount", Decimal("100.00")),
    ({"total_amount": "abc"}, {"corrected_total": Decimal("5.00")}, "total_amount", Decimal("5.00")),
    ({"total_amount": -500}, {}, "total_amount", Decimal("-500.00")),
    ({"total_amount": 0}, {}, "total_amount", Decimal("0.00")),
    ({"due_date": "2024-02-30"}, {}, "due_date", dt.date(2024, 2, 1)),
    ({"due_date": "9999-12-31"}, {}, "due_date", dt.date(9999, 12, 31)),
    ({"due_date": "2024"}, {}, "due_date", dt.date(2024, 2, 1)),
    ({"line_item_count": "7"}, {}, "line_item_count", 7),
    ({"computed_line_total": 12.5}, {}, "computed_line_total", Decimal("12.50")),
    (None, {}, "line_item_count", 2),
    ({"vendor_name": "x" * 1000}, {}, "vendor_name", "x" * 1000),
    ({"vendor_name": "Ünïcode ☃"}, {}, "vendor_name", "Ünïcode ☃"),
])
def test_overlay(spark, corrections, typed, column, expected):
    assert summary(spark, (1, 0, corrections, typed)).first()[column] == expected


def test_newest_review_wins_as_a_whole(spark):
    row = summary(spark, (1, 5, {"vendor_name": "new"}, {}), (2, 1, {"vendor_name": "old", "total_amount": 1}, {})).first()
    assert (row.vendor_name, row.total_amount) == ("new", Decimal("100.00"))


def test_same_time_highest_id_wins(spark):
    assert summary(spark, (1, 5, {"vendor_name": "one"}, {}), (2, 5, {"vendor_name": "two"}, {})).first().vendor_name == "two"


def test_schema_is_the_contract(spark):
    df = summary(spark, (1, 0, None, {}))
    assert [r.passed for r in quality.schema_contract(spark, df, SUMMARY_SCHEMA).collect()] == [True] * 3
    assert len(df.columns) == 23


def test_line_overlay(spark):
    row = {f.name: None for f in schemas.LINE_REVIEW}
    row.update(review_id=1, line_id=1, corrected_col_3=Decimal("9.00"), corrections='{"col_1":"fixed","col_5":"1.005"}',
               reviewed_at=dt.datetime(2024, 1, 1))
    out = review.line_item_detail(lines(spark), spark.createDataFrame([tuple(row.values())], schemas.LINE_REVIEW)).orderBy("line_id").collect()
    assert (out[0].description, out[0].quantity, out[0].line_total, out[0].last_review_id) == ("fixed", Decimal("9.00"), Decimal("1.01"), 1)
    assert (out[1].description, out[1].last_review_id) == ("p", None)


def test_corrections_keep_only_given_values(spark):
    df = spark.createDataFrame([("  Acme ", "12.5", "", None)], "v string, n string, d string, q string")
    got = json.loads(df.select(review.corrections_json({"v": "text", "n": "number", "d": "date", "q": "quantity"})).first()[0])
    assert got == {"v": "Acme", "n": 12.5}


def test_diff_of_added_row(spark):
    a = spark.createDataFrame([(1, "x", 1)], "k int, a string, b int")
    b = spark.createDataFrame([(1, " x ", 2), (2, "y", None)], "k int, a string, b int")
    got = sorted(tuple(r) for r in review.diff(a, b, "k", ["a", "b"]).collect())
    assert got == [(1, "b", "1", "2"), (2, "a", "(empty)", "y")]


def test_hot_record_is_cut_before_the_exchange(spark):
    """Nearly all reviews are of one record: a task may hand over only one row of it."""
    many = spark.range(20000).select(F.col("id").alias("review_id"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("record_id"),
                                     F.timestamp_seconds(F.col("id")).alias("reviewed_at"))
    df = review.latest(many)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 2000 and df.where("record_id = 0").first().review_id == 19999


def test_ledger_order_puts_unknown_dates_first(spark):
    from tallyspark.operators import ap

    rows = [(1, "V", "PENDING", "Current", dt.date(2024, 1, 1)), (2, "V", "PENDING", "90+ Days", None), (3, "V", "PENDING", "Current", dt.date(2024, 2, 1))]
    df = spark.createDataFrame(rows, "invoice_id int, vendor_name string, status string, aging_bucket string, due_date date")
    assert [r.invoice_id for r in ap.filter_ledger(df).collect()] == [2, 3, 1]
    assert [r.invoice_id for r in ap.filter_ledger(df, vendor="V", aging="Current").collect()] == [3, 1]
