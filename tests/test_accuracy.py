"""Accuracy by document: the rows of the join by field, without exchanging a row per field."""

import re

from pyspark.sql import functions as F

from conftest import tuples
from tallyspark.operators import extract, quality
from tallyspark.plans import projections as P
from tallyspark.plans import load
from tallyspark.plans.base import QUERIES

READ = "file_name string, doc_type string, response map<string,string>, normalized array<struct<name:string,ftype:string,value:string>>, confidence map<string,double>"


def documents(spark):
    n = lambda **v: [(k, "VARCHAR", x) for k, x in v.items()]
    read = spark.createDataFrame([
        ("a", "T", None, n(x="Acme", y="2.50"), None), ("b", "T", None, n(y="2", x=None), None),
        ("b", "T", None, n(y="3", z="1", x="q"), None),  # a name twice, in another order and with a field more
        ("c", "T", None, None, None), (None, "T", None, n(x="1"), None), ("only read", "T", None, n(x="1"), None)], READ)
    truth = spark.createDataFrame([
        ("a", "T", {"x": " acme", "y": "2.5"}), ("b", "T", {"x": None, "y": "2"}), ("b", "T", {"x": "q"}),
        ("c", "T", {"x": None, "y": "7"}), (None, "T", {"x": "1"}), ("only printed", "U", {"x": "1", "w": None}),
        ("none", "T", {}), ("null", "T", None)], "file_name string, doc_type string, response map<string,string>")
    return read, truth


def test_documents_give_the_rows_of_the_join_by_field(spark):
    read, truth = documents(spark)
    by_field = quality.accuracy(
        read.select("file_name", F.inline("normalized")).selectExpr("file_name", "name AS field", "value"),
        truth.select("file_name", "doc_type", F.explode("response").alias("field", "value")))
    by_document = quality.accuracy(read, truth, rows=extract.long_fields)
    assert by_document.columns == by_field.columns
    assert sorted(tuples(by_document)) == sorted(tuples(by_field)) and by_field.count() == 4


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_per_field_is_exchanged(spark, sf):
    load()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(QUERIES["accuracy"](spark, sf)))
    assert dealt and not [x for x in dealt if "file_name" in x and "field" in x]


def test_lines_are_dealt_before_they_are_printed(spark, sf):
    """Where the part table is too large to broadcast, lines go back to their documents as columns, not as printed cells."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plans = [plan(P.typed_texts(spark, sf)), plan(P.invoice_texts(spark, sf))]
    finally:
        spark.conf.set(key, before)
    for text in plans:
        assert re.search(r"ObjectHashAggregate\(keys=\[file_name[^\n]*\n[ :|+-]*ObjectHashAggregate\(keys=\[file_name", text)
