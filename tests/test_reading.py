"""Reading texts: labels are looked up in one text, and values are trimmed only where there is something to trim."""

import json

from pyspark.sql import functions as F

from tallyspark.functions import normalize
from tallyspark.functions.core import blank, trimmed
from tallyspark.operators import config, extract

ODD = ["", " ", "   ", "a", " a", "a ", " a b ", "\ta", "a\t", "\t", "a\n", "a \n", "a \x85", "a ", " a", "\n \n", "a\r\n", None]


def test_trims_of_odd_texts(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "c string").repartition(3)
    c = F.col("c")
    pairs = [(trimmed(c), F.trim(c)), (blank(c), F.trim(c) == ""), (normalize._stripped(c), normalize._strip(c))]
    for now, plain in pairs:
        assert df.where(~now.eqNullSafe(plain)).count() == 0 and df.where(now.isNotNull()).count() == len(ODD) - 1


def test_labels_with_commas_and_repeats(spark):
    """A label may hold commas, in the configuration and in the text; the first of several counts, and a part of a label is none."""
    long = spark.createDataFrame([
        ("MEMO", "Memo", i, name, label, "Text", True) for i, (name, label) in enumerate(
            [("author", "Author"), ("place", "City, State"), ("city", "City"), ("state", "State"), ("note", "Note")], 1)],
        "doc_type string, display_name string, pos int, name string, label string, type string, correctable boolean")
    conf = config.from_fields(long).select("*", F.lit(None).cast("string").alias("validation_rules"), F.lit(True).alias("active"))
    text = "Somebody\nCity, State: Reno, NV\nState, City: none\nNote, two: no\nNote: first\nNote: second\nCity:\n Fernley "
    docs = spark.createDataFrame([("a", "MEMO", text)], "file_name string, doc_type string, text string")
    got = extract.entities(docs, conf).first().response
    assert got == {"author": "Somebody", "place": "Reno, NV", "city": "Fernley", "state": None, "note": "first"}


def test_labels_are_not_searched_element_by_element(spark):
    docs = spark.createDataFrame([("a", "INVOICE", "Acme\nInvoice Number: 7")], "file_name string, doc_type string, text string")
    done = extract.post_process(extract.entities(docs, config.default_config(spark)))
    plan = done.select("response", "confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert "find_in_set" in plan and "array_position" not in plan
    assert json.loads(done.first().raw_extraction)["invoice_number"] == "7"
