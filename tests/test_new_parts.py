"""Review rows with typed columns, totals per resource, checks while writing, table functions, overflow."""

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallyspark.operators import cost, extract, quality, review
from tallyspark.sources import files, synth


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def test_review_rows_are_typed(spark):
    edits = spark.createDataFrame([(1, "f1", None, " Acme ", "12.345", "2024-13-01", "n"), (2, "f2", "APPROVED", None, "1e12", "03/04/2024", None)],
                                  "record_id long, file_name string, review_status string, vendor_name string, total_amount string, due_date string, reviewer_notes string")
    rows = review.review_rows(edits, {"vendor_name": "text", "total_amount": "number", "due_date": "date"}, F.lit("me"), now(), first_id=10)
    got = {r.record_id: r for r in rows.collect()}
    assert {r.review_id for r in got.values()} == {10, 11}
    assert (got[1].corrected_vendor_name, str(got[1].corrected_total), got[1].corrected_due_date, got[1].review_status) == ("Acme", "12.35", None, "CORRECTED")
    assert (got[2].corrected_vendor_name, got[2].corrected_total, str(got[2].corrected_due_date), got[2].review_status) == (None, None, "2024-03-04", "APPROVED")
    assert got[1].corrections == '{"vendor_name":"Acme","total_amount":12.345}' and got[1].corrected_subtotal is None
    types = dict(rows.dtypes)
    assert types["corrected_total"] == "decimal(12,2)" and types["corrected_invoice_date"] == "date"


def test_line_review_rows_feed_the_view(spark):
    table = spark.createDataFrame([(5, "f", "1", 1, "pen", "x", "{}")], "line_id long, file_name string, record_id string, line_number int, col_1 string, col_2 string, raw_line_data string") \
        .withColumns({"col_3": F.lit(1).cast("decimal(10,2)"), "col_4": F.lit(2).cast("decimal(10,2)"), "col_5": F.lit(2).cast("decimal(12,2)")})
    edit = spark.createDataFrame([(5, "f", "1", "ink", "3", "999999999999", None)],
                                 "line_id long, file_name string, record_id string, description string, quantity string, unit_price string, reviewer_notes string")
    rows = review.line_review_rows(edit, {"description": "text", "quantity": "quantity", "unit_price": "number"}, F.lit("me"), now())
    r = review.line_item_detail(table, rows).first()
    assert (r.description, float(r.quantity), float(r.unit_price), r.last_review_id) == ("ink", 3.0, 2.0, 1)


def test_resource_totals(spark):
    metering = spark.createDataFrame([("a", "2024-04-30 10:00:00", 1.5), ("a", "2024-04-30 11:00:00", 0.5), ("a", "2020-01-01 00:00:00", 9.0)], "resource string, t string, c double") \
        .select("resource", F.col("t").cast("timestamp_ntz").alias("start_time"), F.col("c").cast("decimal(18,6)").alias("credits_used"))
    got = sorted((r.resource, float(r.credits), r.days_used, float(r.estimate)) for r in cost.resource_totals(metering, ["a", "b"], now(), 30, 3.0).collect())
    assert got == [("a", 2.0, 1, 6.0), ("b", 0.0, 0, 0.0)]
    assert "estimate" not in cost.resource_totals(metering, ["a"], now(), 30).columns


def test_checks_share_a_scan(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5)], "k string, v int")
    rules = {"v_not_null": F.col("v").isNull(), "v_small": F.col("v") > 3}
    got = {r.check: (r.passed, r.detail) for r in quality.together(df, rules, "k").collect()}
    assert got == {"k_unique": (False, "2"), "v_not_null": (False, "1"), "v_small": (False, "1")}
    one = {r.check: (r.passed, r.detail) for r in quality.unique(df, "k").unionByName(quality.violations(df, rules)).collect()}
    assert one == got


def test_checks_while_written(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("id")))
    checks = quality.while_written(df, {"v_not_null": F.col("v").isNull(), "id_small": F.col("id") >= 100}, lambda x: x.write.parquet(str(tmp_path / "t")))
    assert tuples(checks) == [("rows_written", True, "100"), ("v_not_null", False, "10"), ("id_small", True, "0")]
    assert files.table(spark, str(tmp_path / "t")).count() == 100


def test_table_function_over_a_table(spark):
    spark.udtf.register("fold_lines", synth.FoldLines)
    rows = [("b", 2, "y", 1.5), ("a", 1, "x", None), ("b", 1, None, 2.0), (None, 1, "z", 0.0)]
    spark.createDataFrame(rows, "doc string, n int, t string, v double").createOrReplaceTempView("fold_rows")
    got = {r.key: (r.n_lines, r.text) for r in spark.sql("SELECT * FROM fold_lines(TABLE(fold_rows), 'doc', 'n')").collect()}
    assert got == {"a": (1, "x | "), "b": (2, " | 2.0\ny | 1.5"), None: (1, "z | 0.0")}
    with pytest.raises(Exception, match="no such column"):
        spark.sql("SELECT * FROM fold_lines(TABLE(fold_rows), 'nothing')").collect()


def test_overflow(spark):
    names = F.array(*[F.lit(f"f{i}") for i in range(1, 13)])
    df = spark.createDataFrame([('{"f1":"a","f11":"x","f12":null,"other":"y","_confidence":{"f1":1.0}}',), ('{"f1":"a"}',)], "j string")
    assert [r[0] for r in df.select(extract.overflow(F.col("j"), names)).collect()] == ['{"f11":"x","f12":null}', "{}"]
