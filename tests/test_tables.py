import datetime as dt

from pyspark.sql import functions as F

from conftest import tuples
from tallyspark import schemas
from tallyspark.functions.core import number_rows
from tallyspark.operators import ingest, tables


def test_number_rows_is_dense_and_repeatable(spark):
    df = spark.range(5000).select(F.concat(F.lit("f"), "id").alias("k"))
    top = spark.createDataFrame([(100,)], "m long")
    a = number_rows(df, "k", "n", start=top)
    assert sorted(r.n for r in a.collect()) == list(range(101, 5101))
    b = number_rows(df.repartition(13), "k", "n", start=top)
    assert a.exceptAll(b).count() == 0


def test_number_rows_in_more_buckets(spark):
    df = spark.range(3000).select(F.concat(F.lit("f"), "id").alias("k"))
    assert sorted(r.n for r in number_rows(df, "k", "n", digits=5).collect()) == list(range(1, 3001))


def test_number_rows_on_empty_table(spark):
    empty = spark.createDataFrame([], "m long").agg(F.max("m"))
    assert [r.n for r in number_rows(spark.createDataFrame([("a",)], "k string"), "k", "n", start=empty).collect()] == [1]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x", "keep"), (2, "b", "y", "keep")], "id long, k string, v string, w string")
    new = spark.createDataFrame([("b", None), ("c", "z")], "k string, v string")
    once = tables.upsert(old, new, "k", "id")
    assert sorted(tuples(once)) == [(1, "a", "x", "keep"), (2, "b", None, "keep"), (3, "c", "z", None)]
    assert sorted(tuples(tables.upsert(once, new, "k", "id"))) == sorted(tuples(once))


def test_upsert_can_keep_columns(spark):
    old = spark.createDataFrame([("a", 1, 1)], "k string, created int, v int")
    new = spark.createDataFrame([("a", 9, 9)], "k string, created int, v int")
    assert tuples(tables.upsert(old, new, "k", keep=("created",))) == [("a", 1, 9)]


def test_replace_children(spark):
    old = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "parent string, v int")
    new = spark.createDataFrame([("p", 9)], "parent string, v int")
    assert sorted(tuples(tables.replace_children(old, new, "parent"))) == [("p", 9), ("q", 3)]


def registry(spark, *rows):
    return spark.createDataFrame([(n, n, "INVOICE", dt.datetime(2024, 1, 1), e, None, err, None, None) for n, e, err in rows], schemas.RAW_DOCUMENTS)


def test_mark_and_errors(spark):
    raw = registry(spark, ("a", False, None), ("b", False, None), ("c", None, None))
    now = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    marked = tables.mark_extracted(raw, spark.createDataFrame([("a",), ("c",)], "file_name string"), now)
    assert {r.file_name: r.extracted for r in marked.collect()} == {"a": True, "b": False, "c": True}
    errors = spark.createDataFrame([("b", "x" * 900, dt.datetime(2024, 1, 1)), ("b", "new", dt.datetime(2024, 1, 2))],
                                   "file_name string, error string, failed_at timestamp_ntz")
    out = {r.file_name: r for r in tables.record_errors(marked, errors).collect()}
    assert out["b"].extraction_error == "new" and out["b"].extracted is False and out["a"].extraction_error is None


def test_register_twice_adds_nothing(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "file_name string, file_size_bytes long")
    now = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    first = ingest.register(listing, ingest.empty_registry(spark), now, prefix="in/")
    assert sorted((r.file_name, r.file_path, r.extracted) for r in first.collect()) == [("a", "in/a", False), ("b", "in/b", False)]
    assert ingest.register(listing, first, now).count() == 0


def test_seed_only_when_empty(spark):
    seeds = spark.createDataFrame([("s",)], "name string")
    assert tuples(ingest.seed_if_empty(seeds.limit(0), seeds)) == [("s",)]
    full = spark.createDataFrame([("x",)], "name string")
    assert tuples(ingest.seed_if_empty(full, seeds)) == [("x",)]


def test_reset_pattern_leaves_others(spark):
    raw = registry(spark, ("gen_1", True, None), ("doc_1", True, None))
    kept = tables.reset_pattern(raw, {"fields": raw.select("file_name")}, "gen\\_%")
    assert [r.file_name for r in kept["raw_documents"].collect()] == ["doc_1"] and kept["fields"].count() == 1


def test_json_edit_keeps_other_keys(spark):
    df = spark.createDataFrame([('{"a":"$5","b":null,"c":"x"}',)], "j string")
    got = df.select(tables.edit_json(F.col("j"), {"a": tables.without_dollar(F.get_json_object("j", "$.a")), "d": F.lit("new"),
                                                  "c": F.lit(None).cast("string")}).alias("j"))
    assert got.first().j == '{"b":null,"c":"x","a":"5","d":"new"}'


def test_sanitize(spark):
    df = spark.createDataFrame([("../a b'.pdf",), ("...",), ("ok_1-2.pdf",)], "file_name string")
    assert [r[0] for r in df.select(ingest.sanitize(F.col("file_name"))).collect()] == ["_a b_.pdf", None, "ok_1-2.pdf"]


def test_route_first_rule_wins(spark):
    names = ["contracts/receipt.pdf", "My_Receipt.PDF", "utility_bills/x.pdf", "other.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(ingest.route(F.col("n"), ingest.ROUTES)).collect()] == ["CONTRACT", "RECEIPT", "UTILITY_BILL", "INVOICE"]
