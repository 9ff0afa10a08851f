import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallyspark.operators import cost


def calls(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def names(spark, *files):
    return spark.createDataFrame([(f, f"T{i}") for i, f in enumerate(files)], "file_name string, doc_type string")


def both(call_df, raw):
    keyed = lambda df: sorted(tuples(df.select("query_id", "file_name", "doc_type")), key=repr)
    like = keyed(call_df.join(raw, F.expr("query_text ILIKE concat('%', file_name, '%')"), "left"))
    assert keyed(cost.match_documents(call_df, raw, ["doc_type"])) == like
    return like


def test_forms_of_names(spark):
    raw = names(spark, "invoice_01.pdf", "Invoice_01.PDF", "a", "_", "x_", "_y", "doc_1", "my file.txt", "in/voice.pdf", "ünïcode_é.pdf", "long_name_with_parts.jpeg")
    found = both(calls(spark, [
        "read('docs/invoice_01.pdf')", "INVOICE_01.PDF twice invoice_01.pdf", "invoiceX01.pdf", "nothing here", "", None, "x", "doc-1 and doc_1",
        "see MY FILE.TXT, in/voice.pdf", "ÜNÏCODE_É.PDF", "long name with parts.jpeg", "pdf", ".pdf"]), raw)
    assert (0, "invoice_01.pdf", "T0") in found and (2, "Invoice_01.PDF", "T1") in found and (5, None, None) in found


def test_random_texts(spark):
    rng = random.Random(5)
    alphabet = "ab_.x"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    raw = names(spark, *{word(rng.randint(1, 7)) for _ in range(40)})
    both(calls(spark, [word(rng.randint(0, 25)).upper() if i % 2 else word(rng.randint(0, 25)) for i in range(60)]), raw)


def test_one_document_named_by_most_calls(spark):
    raw = names(spark, *[f"doc_{i:04d}.pdf" for i in range(300)])
    df = spark.range(3000).select(F.col("id").alias("query_id"), F.format_string(
        "read doc_%04d.pdf now", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 300).cast("int")).alias("query_text"))
    got = cost.match_documents(df, raw, ["doc_type"])
    assert got.count() == 3000 and got.where("file_name = 'doc_0007.pdf'").count() >= 2000
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_forms_join_in_proportion(spark):
    """As many forms as names, all with one extension: each text meets its own name's form and few others."""
    def docs(n):
        return spark.range(n).select(F.expr(
            "concat(repeat('x_', cast(id % 50 as int)), repeat('y', cast(id div 50 as int)), '_', id, '_scan.pdf')").alias("file_name"),
            F.col("id").cast("string").alias("doc_type"))

    def rows(n):
        raw = docs(n)
        forms = cost._name_forms(raw.select(F.lower("file_name").alias("_name")))
        texts = raw.select(F.col("doc_type").cast("long").alias("query_id"), F.concat(F.lit("read "), "file_name").alias("_t"))
        return cost._places(texts, forms).count()

    small, large = rows(500), rows(2000)
    assert large <= 5 * small and large <= 16 * 2000
    call_df = docs(200).select(F.col("doc_type").cast("long").alias("query_id"), F.concat(F.lit("read "), "file_name").alias("query_text"))
    both(call_df, docs(200))


def test_correlation_of_constant_input_is_null(spark):
    from tallyspark.functions.core import correlation

    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("b", 1, 2), ("b", 2, 4), ("b", 3, None)], "g string, x int, y int")
    got = dict(tuples(df.groupBy("g").agg(F.round(correlation(F.col("x"), F.col("y")), 6))))
    assert got == {"a": None, "b": 1.0}


@pytest.mark.parametrize("n, days", list(itertools.product([0, 3], [0, 2])))
def test_daily_joins_all_sources(spark, n, days):
    at = dt.datetime(2024, 1, 30, 12)
    usage = spark.createDataFrame([(i, at, "F", 0.5, '[{"value": 100}]') for i in range(n)],
                                  "query_id long, start_time timestamp_ntz, function_name string, credits double, metrics string")
    metering = spark.createDataFrame([(at - dt.timedelta(days=i), "W", 1.0) for i in range(days)], "start_time timestamp_ntz, resource string, credits_used double")
    fields = spark.createDataFrame([(dt.datetime(2023, 1, 1),)], "extracted_at timestamp_ntz")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = cost.daily(usage, metering, fields, "F", "W", as_of).collect()
    assert rows[-1].docs_extracted == 1 and rows[-1].ai_calls == 0
    assert len(rows) == 1 + len({0} if n else set()) + days - (1 if n and days else 0)
    if n:
        assert (rows[0].ai_calls, rows[0].ai_credits, rows[0].total_tokens) == (3, 1.5, 300)
