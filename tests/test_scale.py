"""Plans and hot groups."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.functions.core import let
from tallyspark.operators import config, extract
from tallyspark.sources import files

# names whose plan is built without running anything
PLANNED = ["ap_ledger", "aging_summary", "spend_by_category", "document_summary", "line_item_detail", "review_diff", "cost_by_doc_type",
           "cost_drivers", "register_new", "upsert_fields", "replace_children", "normalize_values", "payload_json", "reextract"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_nested_loops_and_no_python(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas"):
        assert bad not in text


def test_payload_needs_no_shuffle_of_its_own(spark):
    from tallyspark.operators import config

    docs = spark.createDataFrame([("a", "INVOICE", "x")], "file_name string, doc_type string, text string")
    text = plan(extract.run(docs, config.default_config(spark), F.lit(None).cast("timestamp_ntz"))["fields"])
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text


def test_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(entry.queries()["pred_in_between"](spark, sf))
    assert "PushedFilters: [IsNotNull" in text and "In(event_type, [click,view])" in text and "props" not in text


def test_one_document_with_very_many_lines(spark):
    n = 20000
    table = "\n".join(["# | Product | Category | Qty | Unit Price | Total", *[f"{i} | p{i} | c | 1 | $1.00 | $1.00" for i in range(1, n + 1)]])
    docs = spark.createDataFrame([("big", "INVOICE", "Acme\nInvoice Number: 1\n\n" + table)], "file_name string, doc_type string, text string")
    from tallyspark.operators import config

    lines = extract.run(docs, config.default_config(spark), F.lit(None).cast("timestamp_ntz"))["lines"]
    assert lines.agg(F.count("*"), F.max("line_number"), F.sum("col_5")).first()[:2] == (n, n)


def test_supplier_files_are_written_by_many_tasks(spark, sf):
    """The exchange before a file per supplier is not cut by its few bytes: that left all files to one task."""
    from tallyspark.plans import stream_queries

    path = stream_queries.supplier_files(spark, sf)
    parts = files.list_documents(spark, path, "*.txt").select("file_name").collect()
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").count()
    assert len(parts) == suppliers and len({r.file_name.split("-")[1] for r in parts}) > 1


def test_bound_values_are_no_array_elements(spark):
    """``let`` binds without an array: reading an element types the whole body again for every row."""
    df = spark.range(3).select(let(F.col("id") + 1, lambda x: let(x * 2, lambda y: F.when(x > 1, x + y))).alias("v"),
                               let(F.lit(None).cast("string"), lambda x: F.coalesce(x, F.lit("none"))).alias("n"))
    assert [tuple(r) for r in df.collect()] == [(None, "none"), (6, "none"), (9, "none")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "aggregate(" in plan


def test_unused_results_are_not_worked_out(spark, sf):
    """A job that stores no scores, warnings or payload does not compute them, nor do scores compute the payload."""
    def plan(name):
        return entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()

    fields, scores = plan("resolve_aliases"), plan("confidence_scores")
    assert "is required but missing" not in fields and "to_json" not in fields
    assert "is required but missing" in scores and "to_json" not in scores


def test_a_text_is_cut_into_lines_once(spark):
    """Labels, values and the first line come from one column, and no lambda runs over the lines."""
    docs = spark.createDataFrame([("a", "INVOICE", "Acme\r\nBill To:\n one \n\ntwo\nTax (8%) : 5\nTotal: \nTOTAL: 7\nAmount Due: 8")],
                                 "file_name string, doc_type string, text string")
    done = extract.entities(docs, config.default_config(spark))
    found = done.head()["response"]
    assert (found["vendor_name"], found["recipient"], found["tax_amount"], found["total_amount"]) == ("Acme", "one", "5", "8")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=[^") == 1 and "RLIKE" not in plan


def test_rules_are_typed_once_per_type(spark):
    """Bounds, patterns and places of rules come with the configuration, not from every document."""
    rules = {r["field"]: r for r in config.parsed(config.default_config(spark)).where("doc_type = 'INVOICE'").head()["rules"]}
    assert (rules["total_amount"]["place"], rules["total_amount"]["low"], rules["total_amount"]["high"]) == (9, 0.0, 10000000.0)
    assert rules["invoice_date"]["first"] is not None and rules["vendor_name"]["regex"] is None


def test_answers_in_any_order_and_odd_white_space(spark):
    """A response in another order, with other or without fields gives the same as one in order; strip as the pattern does."""
    from tallyspark.functions.normalize import _strip, _stripped

    docs = spark.createDataFrame([(1, "INVOICE")], "n int, doc_type string").join(config.parsed(config.default_config(spark)), "doc_type")
    given = {"total_amount": "$-5", "vendor_name": " PSEG ", "other": "x", "due_date": "3rd May 2024"}
    pairs = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
    ordered = F.map_from_arrays("specs.name", F.transform("specs.name", lambda n: F.try_element_at(pairs, n)))
    none = F.lit(None).cast("map<string,string>")
    rows = [extract.post_process(docs.withColumn("response", r)).select("values", "warnings", "confidence").head() for r in (pairs, ordered, none)]
    assert rows[0] == rows[1]
    assert rows[0]["values"]["total_amount"] == "-5" and rows[0]["values"]["due_date"] == "2024-05-03"
    assert ("total_amount", "min") in [(w.field, w.rule) for w in rows[0]["warnings"]]
    assert rows[2]["values"]["vendor_name"] is None and rows[2]["confidence"]["vendor_name"] == 0.1
    odd = spark.createDataFrame([(x,) for x in (" a\t", "\x0b a \x85", "a  ", "\x85 ", "", " ", None, "a\xa0 ", "\r\n a \n\n")], "c string")
    assert all(r[0] == r[1] for r in odd.select(_strip(F.col("c")), _stripped(F.col("c"))).collect())


def test_texts_are_read_by_plain_replacement_and_places(spark, sf):
    """Line ends need no pattern, and a line's cells are taken by place, not out of a map made for every line."""
    plan = entry.queries()["tables_all_types"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "\\r\\n?" not in plan and "\r\n?" not in plan and "map(Line," not in plan
    ends = spark.createDataFrame([("a\r\n\rb\r\r\nc\n\r",)], "t string")
    assert ends.select(extract._unix(F.col("t")), F.regexp_replace("t", r"\r\n?", "\n")).head() == ("a\n\nb\n\nc\n\n",) * 2
