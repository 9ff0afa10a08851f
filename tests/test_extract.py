import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from tallyspark.functions import values as V
from tallyspark.operators import config, extract, quality
from tallyspark.sources import render, synth

NOW = "2024-05-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def doc(spark, text, kind="INVOICE", name="a.pdf"):
    return spark.createDataFrame([(name, kind, text)], "file_name string, doc_type string, text string")


INVOICE = """Acme Supply, Inc.
12 Main Street
Springfield, IL 60001
INVOICE
Invoice Number: INV-00042
PO Number: PO-123456
Invoice Date: March 05, 2024
Due Date: April 4th, 2024
Payment Terms: Net 30

Bill To:
QuickStop #12
9 Oak Ave

# | Product | Category | Qty | Unit Price | Total
1 | Cola 20oz | Beverages | 24 | $1.25 | $30.00
2 | Chips |  | 1,000 | $2.00 | $2,000.00

Subtotal: $2,030.00
Tax (8.0%): $162.40
TOTAL DUE: $2,192.40

Payment Terms: Net 30 - Please remit by April 04, 2024"""


def test_invoice_text(spark):
    done = extract.run(doc(spark, INVOICE), config.default_config(spark), now())
    row = done["fields"].first()
    assert [row[f"field_{i}"] for i in range(1, 11)] == [
        "Acme Supply, Inc.", "INV-00042", "PO-123456", dt.date(2024, 3, 5), dt.date(2024, 4, 4), "Net 30", "QuickStop #12, 9 Oak Ave",
        Decimal("2030.00"), Decimal("162.40"), Decimal("2192.40")]
    lines = [tuple(r)[:-1] for r in done["lines"].orderBy("line_number").collect()]
    assert lines == [("a.pdf", 1, "Cola 20oz", "Beverages", Decimal("24.00"), Decimal("1.25"), Decimal("30.00")),
                     ("a.pdf", 2, "Chips", "", Decimal("1000.00"), Decimal("2.00"), Decimal("2000.00"))]
    payload = json.loads(row.raw_extraction)
    assert payload["total_amount"] == "2192.40" and payload["_confidence"]["vendor_name"] == 1.0 and "_validation_warnings" not in payload


def test_windows_line_ends_and_missing_fields(spark):
    row = extract.run(doc(spark, "Acme\r\nInvoice Number: 7\r\n"), config.default_config(spark), now())["fields"].first()
    payload = json.loads(row.raw_extraction)
    assert (payload["vendor_name"], payload["invoice_number"], payload["due_date"], payload["total_amount"]) == ("Acme", "7", None, "0")
    assert payload["_confidence"]["due_date"] == 0.1
    assert {w["field"] for w in payload["_validation_warnings"]} == {"invoice_date"}


def test_negative_amount_keeps_its_sign_in_the_payload_only(spark):
    row = extract.run(doc(spark, "Acme\nSubtotal: -$12.50"), config.default_config(spark), now())["fields"].first()
    assert row.field_8 == Decimal("12.50") and json.loads(row.raw_extraction)["subtotal"] == "-12.50"


def test_errors_and_unknown_types(spark):
    docs = doc(spark, "  ").unionByName(doc(spark, None, name="b")).unionByName(doc(spark, "Acme", "MEMO", "c")).unionByName(doc(spark, "Acme", name="d"))
    done = extract.run(docs, config.default_config(spark), now())
    assert sorted((r.file_name, r.error) for r in done["errors"].collect()) == [
        ("a.pdf", "document has no text"), ("b", "document has no text"), ("c", "No active config found for doc_type=MEMO")]
    assert [r.file_name for r in done["fields"].collect()] == ["d"]


TYPES = {
    "CONTRACT": (synth.contracts, "party_name", ["milestone", "due_date", "amount", "status"]),
    "RECEIPT": (synth.receipts, "merchant_name", ["item", "qty", "price", "total"]),
    "UTILITY_BILL": (synth.utility_bills, "utility_company", ["tier", "kwh_range", "rate", "amount"]),
    "LEASE": (synth.leases, "landlord_name", None),
}


@pytest.mark.parametrize("kind", TYPES)
def test_round_trip_of_every_type(spark, kind):
    """Synthetic documents, printed and read back, give their own values."""
    make, sender, columns = TYPES[kind]
    made = make(spark.range(1, 60).withColumnRenamed("id", "seed"))
    labels = {f: label for f, label, _ in V.DOC_TYPES[kind]["fields"][1:] if f in made.columns}
    header = [c for c, _ in V.DOC_TYPES[kind]["columns"]] if columns else None
    texts = render.labelled(made, sender, labels, header, (lambda x: [x[c] for c in columns]) if columns else None)
    done = extract.post_process(extract.entities(texts.withColumn("doc_type", F.lit(kind)), config.default_config(spark)))
    found = extract.long_fields(done).select("file_name", "field", F.col("normalized").alias("value"))
    truth = made.select("file_name", F.lit(kind).alias("doc_type"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in [sender, *labels]])))
    rates = {r.field: r.rate for r in quality.accuracy(found, truth).collect()}
    assert set(rates) == {sender, *labels} and set(rates.values()) == {1.0}


def test_model_plugin_catches_errors(spark):
    docs = doc(spark, "x").unionByName(doc(spark, "boom", name="b"))

    def model(name, text, fields):
        if text == "boom":
            raise ValueError("no answer " + "y" * 900)
        return {"vendor_name": text, "total_amount": 5}

    out = {r.file_name: r for r in extract.with_model(docs, config.default_config(spark), model).collect()}
    assert out["a.pdf"].response["total_amount"] == "5" and out["a.pdf"].error is None
    assert out["b"].response is None and len(out["b"].error) == V.ERROR_TEXT_LENGTH


def test_model_in_the_job(spark):
    """The whole job with a model: fields, lines and errors; one type only when asked for."""
    docs = doc(spark, "Acme").unionByName(doc(spark, "boom", name="b")).unionByName(doc(spark, None, name="c")).unionByName(
        doc(spark, "x", "MEMO", "m")).unionByName(doc(spark, "Corner Shop", "RECEIPT", "r"))

    def model(name, text, fields):
        if text == "boom":
            raise ValueError
        return {fields[0]: text, "line_items": {"Line": [1, 2], "Description": ["Cola", None], "Total": ["$3.00", 4]}}

    done = extract.run(docs, config.default_config(spark), now(), model=model)
    assert sorted((r.file_name, r.field_1) for r in done["fields"].collect()) == [("a.pdf", "Acme"), ("r", "Corner Shop")]
    lines = [(r.file_name, r.line_number, r.col_1, r.col_5) for r in done["lines"].orderBy("file_name", "line_number").collect()]
    assert lines == [("a.pdf", 1, "Cola", Decimal("3.00")), ("a.pdf", 2, None, Decimal("4.00"))]
    assert {r.file_name: r.error for r in done["errors"].collect()} == {
        "b": "ValueError", "c": "document has no text", "m": "No active config found for doc_type=MEMO"}
    only = extract.run(docs, config.default_config(spark), now(), model=model, doc_type="RECEIPT")
    assert [r.file_name for r in only["fields"].collect()] == ["r"] and only["errors"].isEmpty()


def test_zip_shortest_and_first_column(spark):
    ragged = json.dumps({"response": {"line_items": {"Line": [1, 2, 3], "Product": ["a", "b"], "Category": ["c", None, "c"], "Qty": [1, 2, 3],
                                                     "Unit Price": ["$1.00", "2", "3"], "Total": ["1", "1,000.50", "3"]}}})
    missing = json.dumps({"response": {"line_items": {"Line": [1]}}})
    df = spark.createDataFrame([("r", ragged), ("m", missing)], "file_name string, extraction string")
    got = sorted(tuple(r)[:7] for r in extract.shred_lines(df).collect())
    assert got == [("r", 1, "a", "c", Decimal("1.00"), Decimal("1.00"), Decimal("1.00")),
                   ("r", 2, "b", None, Decimal("2.00"), Decimal("2.00"), Decimal("1000.50"))]
    cols = F.array(*map(F.lit, extract.LINE_COLUMNS))
    table = df.select("file_name", extract.line_arrays(F.col("extraction")).alias("line_items"), cols.alias("table_cols"))
    rows = sorted((r.file_name, r.line_number, r.col_1) for r in extract.rows_by_first_column(table).collect())
    assert rows == [("m", 1, None), ("r", 1, "a"), ("r", 2, "b"), ("r", 3, None)]


def test_large_amounts_in_json_numbers(spark):
    df = spark.createDataFrame([("a", '{"response":{"total_amount":12345678.5,"subtotal":"$1,234.56","tax_amount":"1.2.3","vendor_name":"V"}}')],
                               "file_name string, extraction string")
    row = extract.shred_header(df).first()
    assert (row.total_amount, row.subtotal, row.tax_amount, row.status) == (Decimal("12345678.50"), Decimal("1234.56"), None, "PENDING")


def test_display_rows(spark):
    df = spark.createDataFrame([("a", '{"response":{"t":{"x":[1,2]},"l":["p","q"],"s":"v"}}')], "file_name string, extraction string")
    got = sorted(tuple(r) for r in extract.display_rows(df).select("key", F.coalesce("column", F.lit("")), "position", "value").collect())
    assert got == [("l", "", 0, "p, q"), ("s", "", 0, "v"), ("t", "x", 0, "1"), ("t", "x", 1, "2")]


# --- configuration -----------------------------------------------------------------------------------

@pytest.mark.parametrize("prompt, names", [
    ("Extract the following fields from this x: a, b , c. FORMATTING RULES: d, e", ["a", "b", "c"]),
    ("Fields: a,b", ["a", "b"]), ("Fields: only.", ["only"]), ("no list here", None)])
def test_parse_fields(spark, prompt, names):
    assert spark.createDataFrame([(prompt,)], "p string").select(config.parse_fields(F.col("p"))).first()[0] == names


def test_default_config_parses_back(spark):
    got = {}
    for r in config.field_table(config.default_config(spark)).orderBy("doc_type", "pos").collect():
        got.setdefault(r.doc_type, []).append((r.field, r.label, r.ftype))
    assert got == {t: s["fields"] for t, s in V.DOC_TYPES.items()}
    counts = config.default_config(spark).select("doc_type", config.comma_field_count(F.col("extraction_prompt")).alias("n"))
    assert dict(tuples(counts))["INVOICE"] == 13


def test_questions(spark):
    df = spark.createDataFrame([("po_number",), ("claim_number",)], "f string")
    assert [r[0] for r in df.select(config.question(F.col("f"))).collect()] == [
        V.QUESTIONS["po_number"], "What is the claim number? Return the value."]


def test_config_from_fields(spark):
    long = spark.createDataFrame([
        ("MEMO", "Memo", 2, "day", "Day", "Date", True), ("MEMO", "Memo", 1, "author", "Author", "Text", True), ("MEMO", "Memo", 3, "fee", "Fee", "Number", False),
        ("MEMO", "Memo", 4, "ref", "Ref", "Text", None), ("MEMO", "Memo", 5, "total", "Total", "Number", True)],
        "doc_type string, display_name string, pos int, name string, label string, type string, correctable boolean")
    cols = spark.createDataFrame([("MEMO", 1, "Item", None), ("MEMO", 2, "Cost", "What it costs")], "doc_type string, pos int, name string, description string")
    row = config.from_fields(long, cols).first()
    assert row.extraction_prompt.startswith("Extract the following fields from this memo: author, day, fee, ref, total. FORMATTING RULES: ")
    labels = json.loads(row.field_labels)
    assert labels == {"field_1": "Author", "field_2": "Day", "field_3": "Fee", "field_4": "Ref", "field_5": "Total", "sender_label": "Author",
                      "amount_label": "Total", "date_label": "Day", "reference_label": "Ref"}
    assert json.loads(row.review_fields) == {"correctable": ["author", "day", "ref", "total"],
                                             "types": {"author": "VARCHAR", "day": "DATE", "fee": "NUMBER", "ref": "VARCHAR", "total": "NUMBER"}}
    assert json.loads(row.table_extraction_schema) == {"columns": ["Item", "Cost"], "descriptions": ["Item", "What it costs"]}


def test_add_types(spark):
    new = spark.createDataFrame([(" bill of lading ", "Bill of lading"), ("invoice", "Again"), ("", "None"), ("x", " ")], "doc_type string, display_name string")
    table, rejected = config.add_types(config.default_config(spark), new)
    assert table.where("doc_type = 'BILL_OF_LADING' AND active").count() == 1 and table.count() == 6
    assert sorted(r.reason for r in rejected.collect()) == ["already exists"] + ["code and display name are required"] * 2


def test_field_names_and_overflow(spark):
    df = spark.createDataFrame([({"a": "1", "late_fee": "9"}, "Late Fee", "")], "raw map<string,string>, label string, none string")
    value = lambda i, label: extract.field_value(F.lit(i), [F.lit("c1")], F.col("raw"), F.lit(label))
    name = lambda i, label: extract.field_name(F.lit(i), F.array(F.lit("first")), F.lit(label))
    row = df.select(value(1, "x"), value(11, "Late Fee"), value(12, "Nothing"), name(1, "X Y"), name(2, "X Y"), name(2, "")).first()
    assert tuple(row) == ("c1", "9", None, "first", "x_y", None)
