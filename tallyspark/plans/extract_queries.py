"""Configuration, extraction, post-processing and shredding."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.core import json_map, small_table
from ..functions.values import QUESTIONS
from ..operators import config, cost, extract, ingest, quality, tables, validate
from ..session import shared_dir
from ..sources import files, render, synth
from . import projections as P
from .base import CTES, draw, literal, one_of, query


# --- configuration ---------------------------------------------------------------------------------

@query("parse_prompt_fields", """
SELECT doc_type, pos::BIGINT AS pos, field, ftype, label, documents FROM spec
JOIN (SELECT doc_type, count(*) AS documents FROM raw_documents GROUP BY 1) USING (doc_type)""")
def _(spark, d):
    used = P.raw_documents(spark, d).groupBy("doc_type").agg(F.count("*").alias("documents"))
    return config.field_table(config.default_config(spark)).join(used, "doc_type")


@query("question_text", f"""
SELECT field, coalesce(q.question, 'What is the ' || lower(replace(field, '_', ' ')) || '? Return the value.') AS question, count(*) AS asked
FROM (SELECT s.field FROM raw_documents r JOIN spec s ON r.doc_type = s.doc_type
  UNION ALL SELECT r.doc_type || '_note' FROM raw_documents r) LEFT JOIN (VALUES {P._values(list(QUESTIONS.items()))}) q(field, question) USING (field)
GROUP BY 1, 2""")
def _(spark, d):
    """Questions asked over all documents; one extra field per type has no known question."""
    raw = P.raw_documents(spark, d).select("doc_type")
    asked = raw.join(config.field_table(config.default_config(spark)).select("doc_type", "field"), "doc_type").select("field")
    asked = asked.unionByName(raw.select(F.concat("doc_type", F.lit("_note")).alias("field")))
    return asked.groupBy("field", config.question(F.col("field")).alias("question")).agg(F.count("*").alias("asked"))


@query("config_from_fields", f"""
SELECT 'PARTS_' || p_brand AS doc_type, 'Parts ' || p_brand AS display_name, count(*) AS fields,
  'Extract the following fields from this parts ' || lower(p_brand) || ': ' || string_agg(name, ', ' ORDER BY pos) || '. {config.V.FORMATTING_RULES.replace("'", "''")}' AS extraction_prompt,
  min_by(label, pos) AS sender, max_by(label, pos) FILTER (kind = 'Number') AS amount
FROM (SELECT p_brand, p_type, min(p_partkey) AS pos, lower(p_type) || '_size' AS name, p_type || ' Size' AS label,
    CASE WHEN p_type < 'M' THEN 'Number' ELSE 'Text' END AS kind FROM part GROUP BY p_brand, p_type)
GROUP BY p_brand""")
def _(spark, d):
    """A document type per brand, a field per kind of part."""
    kind = F.when(F.col("p_type") < "M", "Number").otherwise("Text")
    long = P.read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("pos")).select(
        F.concat(F.lit("PARTS_"), "p_brand").alias("doc_type"), F.concat(F.lit("Parts "), "p_brand").alias("display_name"),
        "pos", F.concat(F.lower("p_type"), F.lit("_size")).alias("name"), F.concat("p_type", F.lit(" Size")).alias("label"),
        kind.alias("type"), F.lit(True).alias("correctable"))
    made = config.from_fields(long)
    label = lambda k: F.get_json_object("field_labels", f"$.{k}")
    return made.select("doc_type", "display_name", F.size(config.parse_fields(F.col("extraction_prompt"))).alias("fields"),
                       "extraction_prompt", label("sender_label").alias("sender"), label("amount_label").alias("amount"))


@query("config_defaults", """
SELECT file_name, doc_type, doc_type IN (SELECT doc_type FROM spec) AS has_config,
  CASE doc_type WHEN 'CONTRACT' THEN 'Party Name' WHEN 'RECEIPT' THEN 'Merchant Name' WHEN 'UTILITY_BILL' THEN 'Utility Company'
    WHEN 'LEASE' THEN 'Landlord Name' ELSE 'Vendor Name' END AS first_label
FROM (SELECT file_name, CASE WHEN page_count = 4 THEN 'MEMO' ELSE doc_type END AS doc_type FROM raw_documents)""")
def _(spark, d):
    raw = P.raw_documents(spark, d).select("file_name", F.when(F.col("page_count") == 4, "MEMO").otherwise(F.col("doc_type")).alias("doc_type"))
    labelled = config.attach(raw, config.default_config(spark))
    return labelled.select("file_name", "doc_type", "has_config", F.get_json_object("labels", "$.field_1").alias("first_label"))


@query("limits_check", """
SELECT file_name, doc_type, 10 + q AS question_count, true AS questions_ok, true AS tables_ok, page_count * 40 <= 125 AS pages_ok,
  file_size_bytes * 5000 <= 104857600 AS size_ok
FROM raw_documents JOIN (SELECT doc_type, count(*) AS q FROM spec GROUP BY 1) USING (doc_type)""")
def _(spark, d):
    raw = P.raw_documents(spark, d).withColumns({"page_count": F.col("page_count") * 40, "file_size_bytes": F.col("file_size_bytes") * 5000})
    return config.request_limits(raw, config.default_config(spark))


@query("page_counts", """
SELECT doc_id, 1 + length(text) - length(replace(text, '. ', '.')) AS pages FROM documents""")
def _(spark, d):
    """Page counts of whole texts, with every sentence on its own page; also as an SQL function."""
    texts = P.read(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\f")).alias("text"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION page_count(t STRING) RETURNS INT RETURN size(split(t, '\\\\f'))")
    by_sql = F.call_function("page_count", F.col("text"))
    return texts.select("doc_id", F.when(by_sql == ingest.page_count(F.col("text")), by_sql).alias("pages"))


# --- post-processing -------------------------------------------------------------------------------

def processed(spark, d):
    return extract.post_process(P.field_docs(spark, d))


def long(spark, d):
    return extract.long_fields(processed(spark, d))


@query("normalize_values", "SELECT file_name, doc_type, pos::BIGINT AS pos, field, ftype, raw, normalized FROM doc_norm")
def _(spark, d):
    """Every printed value of every document in canonical form, before names are resolved."""
    from ..functions.normalize import normalize

    rows = P.field_docs(spark, d).select("file_name", "doc_type", "response", F.posexplode("specs").alias("i", "s"))
    raw = F.try_element_at("response", F.col("s.name"))
    return rows.select("file_name", "doc_type", (F.col("i") + 1).alias("pos"), F.col("s.name").alias("field"),
                       F.col("s.ftype").alias("ftype"), raw.alias("raw"), normalize(raw, F.col("s.ftype")).alias("normalized"))


@query("resolve_aliases", "SELECT v.file_name, v.field, v.normalized FROM doc_value v JOIN name_field n ON v.field = n.field")
def _(spark, d):
    names = F.col("field").isin(P.V.NAME_FIELDS)
    return long(spark, d).where(names).select("file_name", "field", "normalized")


@query("validate_fields", """
SELECT file_name, doc_type, row_number() OVER (PARTITION BY file_name ORDER BY rpos, wpos) - 1 AS position, field, rule, message
FROM doc_warning""")
def _(spark, d):
    return processed(spark, d).select("file_name", "doc_type", F.posexplode_outer("warnings").alias("position", "w")).where(
        "w IS NOT NULL").select("file_name", "doc_type", "position", "w.field", "w.rule", "w.message")


PATTERNS = {"INVOICE": ("invoice_number", "INV-[0-9]{1,3}$"), "CONTRACT": ("effective_date", "2[0-9]{3}-0[1-6]"),
            "RECEIPT": ("total_paid", "[0-9]+[.][0-9]0$"), "UTILITY_BILL": ("rate_schedule", "Net (15|60)"), "LEASE": ("tenant_name", ".*#[0-9]*7$")}


@query("validate_patterns", f"""
SELECT v.file_name, v.doc_type, v.field, 'pattern' AS rule, v.field || '=' || normalized || ' does not match pattern ' || p.pattern AS message
FROM doc_value v JOIN (VALUES {P._values([(t, f, p) for t, (f, p) in PATTERNS.items()])}) p(doc_type, field, pattern)
  ON v.doc_type = p.doc_type AND v.field = p.field
WHERE NOT regexp_matches(normalized, '^(?:' || p.pattern || ')')""")
def _(spark, d):
    """Types whose only rule is a pattern: it counts from the start of a value and says nothing of a missing one."""
    rules = F.create_map(*[F.lit(x) for t, (f, p) in PATTERNS.items() for x in (t, json.dumps({f: {"pattern": p}}))])
    conf = config.default_config(spark).withColumn("validation_rules", F.try_element_at(rules, F.col("doc_type")))
    done = extract.post_process(P.field_docs(spark, d, conf))
    return done.select("file_name", "doc_type", F.inline_outer("warnings")).where("rule IS NOT NULL")


@query("overflow_json", """
SELECT file_name, doc_type, '{' || coalesce(string_agg('"' || field || '":' || coalesce('"' || normalized || '"', 'null'), ',' ORDER BY pos)
  FILTER (pos > 10), '') || '}' AS overflow
FROM doc_value GROUP BY file_name, doc_type""")
def _(spark, d):
    """What each record holds beyond its ten columns, as JSON."""
    done = processed(spark, d)
    return done.select("file_name", "doc_type", extract.overflow(F.col("raw_extraction"), F.col("specs.name")).alias("overflow"))


@query("confidence_scores", "SELECT file_name, doc_type, pos::BIGINT AS pos, field, confidence FROM doc_score")
def _(spark, d):
    return long(spark, d).select("file_name", "doc_type", "pos", "field", "confidence")


def _wide(i: int) -> str:
    v = f"max(normalized) FILTER (pos = {i})"
    if i in (4, 5):
        return f"try_strptime({v}, '%Y-%m-%d')::DATE AS field_{i}"
    if i in (8, 9, 10):
        return f"round(try_cast(regexp_replace({v}, '[^0-9.]', '', 'g') AS DECIMAL(18,4)), 2)::DOUBLE AS field_{i}"
    return f"{v} AS field_{i}"


@query("field_columns", f"SELECT file_name, doc_type, {', '.join(map(_wide, range(1, 11)))} FROM doc_value GROUP BY file_name, doc_type")
def _(spark, d):
    return processed(spark, d).select("file_name", "doc_type", *extract.field_columns(F.col("normalized")))


@query("payload_json", """
SELECT v.file_name, count(*) + 1 + (max(w.n) > 0)::INT AS keys, count(*) AS scores, coalesce(max(w.n), 0) AS warnings,
  count(normalized) AS present
FROM doc_value v LEFT JOIN (SELECT file_name, count(*) AS n FROM doc_warning GROUP BY 1) w ON v.file_name = w.file_name
GROUP BY v.file_name""".replace("(max(w.n) > 0)::INT", "coalesce(max(w.n) > 0, false)::INT"))
def _(spark, d):
    """What the stored payload holds: keys, scores, warnings, present values."""
    body = json_map(F.col("raw_extraction"))
    return processed(spark, d).select(
        "file_name", F.size(F.json_object_keys("raw_extraction")).alias("keys"),
        F.size(F.from_json(body["_confidence"], "map<string,double>")).alias("scores"),
        F.coalesce(F.size(F.from_json(F.try_element_at(body, F.lit("_validation_warnings")), f"array<{validate.WARNING}>")), F.lit(0)).alias("warnings"),
        F.size(F.map_filter(body, lambda k, v: ~k.startswith("_") & v.isNotNull())).alias("present"))


@query("payload_values", """
SELECT v.file_name, v.field AS key, v.normalized AS value, s.confidence, coalesce(w.rules, '') AS rules
FROM doc_value v JOIN doc_score s ON v.file_name = s.file_name AND v.field = s.field
LEFT JOIN (SELECT file_name, field, string_agg(rule || ': ' || message, '; ' ORDER BY wpos) AS rules FROM doc_warning GROUP BY 1, 2) w
  ON v.file_name = w.file_name AND v.field = w.field""")
def _(spark, d):
    """Every value of the stored payload, read back from its JSON, with its score and the rules it breaks."""
    body = json_map(F.col("raw_extraction"))
    read = processed(spark, d).select(
        "file_name", F.from_json(body["_confidence"], "map<string,double>").alias("scores"),
        F.coalesce(F.from_json(F.try_element_at(body, F.lit("_validation_warnings")), f"array<{validate.WARNING}>"),
                   F.array().cast(f"array<{validate.WARNING}>")).alias("flags"), body.alias("body"))
    rows = read.select("file_name", "scores", "flags", F.explode(F.map_filter("body", lambda k, v: ~k.startswith("_"))).alias("key", "value"))
    own = F.transform(F.filter("flags", lambda w: w["field"] == F.col("key")), lambda w: F.concat_ws(": ", w["rule"], w["message"]))
    return rows.select("file_name", "key", "value", F.try_element_at("scores", F.col("key")).alias("confidence"), F.array_join(own, "; ").alias("rules"))


CTES["preview"] = """
SELECT file_name, doc_type, pos, CASE WHEN pos <= 10 THEN 'field_' || pos ELSE 'raw_extraction (overflow)' END AS target_column,
  field, coalesce(raw, '(null)') AS raw_value, coalesce(v, '(null)') AS normalized,
  CASE WHEN pos IN (4, 5) THEN 'DATE' WHEN pos IN (8, 9, 10) THEN 'NUMBER' ELSE 'VARCHAR' END AS db_type,
  CASE WHEN coalesce(v, '') = '' THEN '(NULL)'
    WHEN pos IN (4, 5) AND NOT regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}') THEN 'NULL (bad format: ' || v || ')'
    WHEN pos IN (8, 9, 10) AND try_cast(v AS DOUBLE) IS NULL THEN 'NULL (non-numeric: ' || v || ')' ELSE v END AS cast_preview,
  CASE WHEN v IS NULL OR trim(v) = '' THEN 0.1 WHEN ftype = 'NUMBER' AND try_cast(v AS DOUBLE) IS NULL THEN 0.7
    WHEN ftype = 'NUMBER' AND try_cast(v AS DOUBLE) = 0 THEN 0.9
    WHEN ftype = 'DATE' AND NOT regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}') THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence
FROM (SELECT *, normalized AS v FROM doc_value)
"""


@query("mapping_preview", """
SELECT file_name, doc_type, target_column, field, raw_value, normalized, db_type, cast_preview, confidence,
  CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MED' ELSE 'LOW' END AS confidence_band,
  pos <= 10 AND cast_preview LIKE '%NULL%' AS casts_to_null
FROM preview""")
def _(spark, d):
    return validate.mapping_preview(long(spark, d).drop("confidence"))


# --- shredding ---------------------------------------------------------------------------------------

@query("header_shred", """
SELECT file_name, vendor_name, invoice_number, po_number, invoice_date, due_date, payment_terms, bill_to, subtotal::DOUBLE AS subtotal,
  tax_amount::DOUBLE AS tax_amount, total_amount::DOUBLE AS total_amount, 'PENDING' AS status FROM invoices""")
def _(spark, d):
    """Header answers with currency signs, as text and as JSON numbers, back to typed columns."""
    inv = P.invoices(spark, d)
    answer = F.struct("vendor_name", "invoice_number", "po_number", F.col("invoice_date").cast("string").alias("invoice_date"),
                      F.col("due_date").cast("string").alias("due_date"), "payment_terms", "bill_to",
                      render.money_text(F.col("subtotal")).alias("subtotal"), "tax_amount",
                      F.concat(F.lit("USD "), "total_amount").alias("total_amount"))
    return extract.shred_header(inv.select("file_name", F.to_json(F.struct(answer.alias("response"))).alias("extraction")))


SHORT = "NOT (k % 7 = 0 AND rn = n)"


def _cells(*without: str) -> str:
    """SQL of a line's cells as JSON, as ``projections.extractions`` answers them."""
    cells = {"Line": "rn::VARCHAR", "Product": "product_name", "Category": "category", "Qty": "quantity::VARCHAR",
             "Unit Price": "'$' || format('{:,.2f}', unit_price::DOUBLE)", "Total": f"CASE WHEN {SHORT} THEN line_total::VARCHAR END"}
    return "json_object(" + ", ".join(f"'{c}', {v}" for c, v in cells.items() if c not in without) + ")::VARCHAR"


@query("line_shred_shortest", f"""
SELECT file_name, invoice_number, rn AS line_number, product_name, category, quantity::DOUBLE AS quantity,
  unit_price::DOUBLE AS unit_price, line_total::DOUBLE AS line_total,
  CASE WHEN category IS NULL THEN {_cells('Category')} ELSE {_cells()} END AS raw_line_data FROM numbered_lines WHERE {SHORT}""")
def _(spark, d):
    return extract.shred_lines(P.extractions(spark, d))


@query("line_rows_first_column", f"""
SELECT file_name, rn AS line_number, product_name AS col_1, category AS col_2, quantity::DOUBLE AS col_3,
  unit_price::DOUBLE AS col_4, CASE WHEN {SHORT} THEN line_total::DOUBLE END AS col_5, {_cells()} AS raw_line_data FROM numbered_lines""")
def _(spark, d):
    cols = F.array(*map(F.lit, extract.LINE_COLUMNS))
    table = P.extractions(spark, d).select("file_name", extract.line_arrays(F.col("extraction")).alias("line_items"), cols.alias("table_cols"))
    return extract.rows_by_first_column(table)


@query("line_rows_positional", f"""
SELECT file_name, rn AS line_number, rn::VARCHAR AS col_1, product_name AS col_2,
  try_cast(nullif(regexp_replace(category, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS col_3, quantity::DOUBLE AS col_4, unit_price::DOUBLE AS col_5, {_cells()} AS raw_line_data FROM numbered_lines""")
def _(spark, d):
    """The first five configured columns as they come: the line number lands in col_1."""
    cols = F.array(*map(F.lit, extract.LINE_COLUMNS))
    table = P.extractions(spark, d).select("file_name", extract.line_arrays(F.col("extraction")).alias("line_items"), cols.alias("table_cols"))
    return extract.rows_by_first_column(table, "positional")


@query("display_rows", " UNION ALL ".join(
    f"""SELECT file_name, 'line_items' AS key, '{c}' AS "column", rn - 1 AS position, {v} AS value FROM numbered_lines"""
    for c, v in {"Line": "rn::VARCHAR", "Product": "product_name", "Category": "category", "Qty": "quantity::VARCHAR",
                 "Unit Price": "'$' || format('{:,.2f}', unit_price::DOUBLE)", "Total": "line_total::VARCHAR"}.items()) + f" WHERE {SHORT}")
def _(spark, d):
    return extract.display_rows(P.extractions(spark, d).select("file_name", "extraction"))


# --- text ------------------------------------------------------------------------------------------

MONEY = "'$' || format('{{:,.2f}}', {}::DOUBLE)"


@query("render_text", f"""
SELECT file_name, concat_ws(chr(10), vendor_name, 'INVOICE', 'Invoice Number: ' || invoice_number, 'PO Number: ' || po_number,
  'Invoice Date: ' || strftime(invoice_date, '%B %d, %Y'), 'Due Date: ' || strftime(due_date, '%B %d, %Y'), 'Payment Terms: ' || payment_terms,
  '', 'Bill To:' || chr(10) || bill_to, '', '{render.TABLE_HEADER}', coalesce(rows, ''), '', 'Subtotal: ' || {MONEY.format('subtotal')},
  'Tax (' || format('{{:.1f}}', tax_amount::DOUBLE / subtotal::DOUBLE * 100) || '%): ' || {MONEY.format('tax_amount')},
  'TOTAL DUE: ' || {MONEY.format('total_amount')}) AS text
FROM invoices LEFT JOIN (SELECT file_name, string_agg(concat_ws(' | ', line_number, product_name, coalesce(category, ''), quantity,
    {MONEY.format('unit_price')}, {MONEY.format('line_total')}), chr(10) ORDER BY line_number, line_item_id) AS rows
  FROM line_items GROUP BY file_name) USING (file_name)""")
def _(spark, d):
    return P.invoice_texts(spark, d).select("file_name", "text")


ROUND_TRIP = """
SELECT file_name, vendor_name AS field_1, invoice_number AS field_2, po_number AS field_3, invoice_date AS field_4, due_date AS field_5,
  payment_terms AS field_6, bill_to AS field_7, subtotal::DOUBLE AS field_8, tax_amount::DOUBLE AS field_9, total_amount::DOUBLE AS field_10
FROM invoices"""


def extracted(spark, d):
    return extract.entities(P.invoice_texts(spark, d).select("file_name", "doc_type", "text"), config.default_config(spark))


@query("entities_roundtrip", ROUND_TRIP)
def _(spark, d):
    """Invoices rendered to text and read back are the invoices."""
    done = extract.post_process(extracted(spark, d))
    return done.select("file_name", *extract.field_columns(F.col("normalized")))


@query("tables_roundtrip", """
SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY line_number, line_item_id) AS line_number, product_name AS col_1,
  coalesce(category, '') AS col_2, quantity::DOUBLE AS col_3, unit_price::DOUBLE AS col_4, line_total::DOUBLE AS col_5 FROM line_items""")
def _(spark, d):
    table = extract.tables(extracted(spark, d)).select("file_name", "line_items", "table_cols")
    return extract.rows_by_first_column(table).drop("raw_line_data")


@query("per_row_apply", "SELECT file_name, vendor_name, invoice_number, total_amount::DOUBLE AS total_amount FROM invoices")
def _(spark, d):
    """A model plugged in as a function of one document, run on batches in the tasks."""
    def model(name, text, wanted):
        lines = text.splitlines()
        found = dict(x.split(": ", 1) for x in lines if ": " in x)
        return {"vendor_name": lines[0], "invoice_number": found.get("Invoice Number"), "total_amount": found.get("TOTAL DUE")}

    texts = P.invoice_texts(spark, d).select("file_name", "doc_type", "text")
    done = extract.post_process(extract.with_model(texts, config.default_config(spark), model))
    v = lambda k: F.try_element_at("values", F.lit(k))
    return done.select("file_name", v("vendor_name").alias("vendor_name"), v("invoice_number").alias("invoice_number"),
                       v("total_amount").try_cast("decimal(12,2)").alias("total_amount"))


@query("entities_all_types", "SELECT file_name, doc_type, pos::BIGINT AS pos, field, normalized FROM doc_value")
def _(spark, d):
    """Documents of all five types rendered to text and read back: every field."""
    done = extract.post_process(extract.entities(P.typed_texts(spark, d), config.default_config(spark)))
    return extract.long_fields(done).select("file_name", "doc_type", "pos", "field", "normalized")


def _stored_lines() -> str:
    """SQL of the stored line rows of all types: col_1 to col_5 and the row as JSON, by the columns of the type."""
    text = {"line_number": "line_number::VARCHAR", "product_name": "product_name", "category": "coalesce(category, '')",
            "quantity": "quantity::VARCHAR", "unit_price": MONEY.format("unit_price"), "line_total": MONEY.format("line_total")}
    plain = text | {c: f"{c}::DOUBLE" for c in ("quantity", "unit_price", "line_total")}
    kinds = {t: [c for c, _ in spec["columns"]] for t, spec in P.V.DOC_TYPES.items()}
    case = lambda of: "CASE doc_type " + " ".join(f"WHEN '{t}' THEN {of(cols)}" for t, cols in kinds.items()) + " END"

    def stored(names):
        return case(lambda cols: next((plain[P.CELL_OF[n]] for n in names if n in cols), "NULL"))

    def pairs(cols):
        return "json_object(" + ", ".join(f"'{c}', {text[P.CELL_OF[c]]}" for c in cols) + ")::VARCHAR"

    shown = ", ".join(f"{stored(names)} AS col_{i}" for i, names in enumerate(extract.NAMED_COLUMNS, 1))
    return f"SELECT file_name, rn AS line_number, {shown}, {case(pairs)} AS raw_line_data FROM numbered_lines JOIN raw_documents USING (file_name)"


@query("tables_all_types", _stored_lines())
def _(spark, d):
    """The lines of documents of all five types, as the job stores them."""
    return extract.run(P.typed_texts(spark, d), config.default_config(spark), P.run_time())["lines"]


@query("batch_driver", f"""
SELECT file_name, {', '.join(map(_wide, range(1, 11)))}, NULL::VARCHAR AS message
FROM doc_value JOIN raw_documents USING (file_name) WHERE NOT extracted GROUP BY file_name
UNION ALL SELECT NULL, {', '.join(['NULL'] * 10)}, 'Processed ' || count(*) || ' document(s) via config-driven extraction'
FROM raw_documents WHERE NOT extracted
UNION ALL SELECT NULL, {', '.join(['NULL'] * 10)}, 'No active config found for doc_type=MEMO'""")
def _(spark, d):
    """All pending documents, whatever their type, in one job: what is stored and the message; and a type nobody configured."""
    base = config.default_config(spark)
    todo = extract.work_list(P.raw_documents(spark, d), P.fields(spark, d)).select("file_name")
    texts = P.typed_texts(spark, d).join(todo, "file_name")
    path = shared_dir(spark, "read")
    extract.read_documents(texts, base).write.parquet(path)  # once, for the rows and for the message
    stored = extract.split_results(spark.read.parquet(path), P.run_time())["fields"].select(
        "file_name", *[f"field_{i}" for i in range(1, 11)])
    memo = extract.run(texts, base, P.run_time(), doc_type="MEMO")["fields"]
    said = extract.message(stored, base).unionByName(extract.message(memo, base, "MEMO"))
    return stored.unionByName(said, allowMissingColumns=True)


@query("accuracy", """
SELECT doc_type, field, count(*) AS compared, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit) / count(*), 4) AS rate
FROM (SELECT doc_type, field, coalesce(lower(trim(raw)) IS NOT DISTINCT FROM lower(trim(normalized))
  OR try_cast(raw AS DECIMAL(18,4)) = try_cast(normalized AS DECIMAL(18,4)), false) AS hit FROM doc_value) GROUP BY doc_type, field""")
def _(spark, d):
    """Documents of all five types, printed, read back and compared with the answers they were printed from."""
    found = extract.post_process(extract.entities(P.typed_texts(spark, d), config.default_config(spark)))
    return quality.accuracy(found, P.field_docs(spark, d), rows=extract.long_fields)


@query("accuracy_invoices", """
SELECT 'INVOICE' AS doc_type, field, count(*) AS compared, count(*) AS matched, 1.0::DOUBLE AS rate
FROM (SELECT unnest(['vendor_name', 'invoice_number', 'po_number', 'invoice_date', 'due_date', 'payment_terms', 'recipient',
  'subtotal', 'tax_amount', 'total_amount']) AS field FROM invoices) GROUP BY field""")
def _(spark, d):
    """Rendered invoices against the stored ones, whose values are typed."""
    pairs = F.array(*[F.struct(F.lit({"bill_to": "recipient"}.get(c, c)).alias("field"), F.col(c).cast("string").alias("value"))
                      for c in P.FIELD_OF.values()])
    truth = P.invoices(spark, d).select("file_name", F.lit("INVOICE").alias("doc_type"), F.inline(pairs))
    found = extract.long_fields(extract.post_process(extracted(spark, d))).select("file_name", "field", F.col("normalized").alias("value"))
    return quality.accuracy(found, truth)


V = P.V
SEEDS = "(SELECT o_orderkey AS seed FROM orders)"


def between(lo: int, hi: int, *keys) -> str:
    return f"({lo} + {draw(hi - lo + 1, 'seed', *map(literal, keys))})"


def cents(lo: str, hi: str, *keys) -> str:
    return between(round(float(lo) * 100), round(float(hi) * 100), *keys)


def chosen(options: list, *keys) -> str:
    return one_of(options, "seed", *map(literal, keys))


def seeds(spark, d, table="orders", key="o_orderkey"):
    return P.read(spark, d, table).select(F.col(key).alias("seed"))


TRUTHS = {
    "RECEIPT": (synth.receipts, "file_name string, merchant_name string, transaction_id string, purchase_date date, items int",
                lambda: F.size("lines").alias("items"), "transaction_id", "items"),
    "UTILITY_BILL": (synth.utility_bills, "file_name string, meter_number string, kwh_usage int", None, "meter_number", "kwh_usage"),
    "LEASE": (synth.leases, "file_name string, lease_number string, lease_start_date date, total_lease_value decimal(12,2)", None,
              "lease_number", "total_lease_value"),
}


@query("truth_json", f"""
SELECT 'RECEIPT' AS doc_type, printf('receipt_%02d.pdf', seed) AS file_name, 'TXN' || {between(100000, 999999, 'txn')} AS number, {between(2, 8, 'items')}::DOUBLE AS amount FROM {SEEDS}
UNION ALL SELECT 'UTILITY_BILL', printf('utility_bill_%02d.pdf', seed), {chosen(['E', 'M', 'K'], 'meter')} || {between(100000, 999999, 'mno')}, {between(180, 1400, 'kwh')}::DOUBLE FROM {SEEDS}
UNION ALL SELECT 'LEASE', printf('lease_%02d.pdf', seed), 'LSE-' || {between(10000, 99999, 'no')},
  {cents('1500', '8500', 'rent')} * {chosen(V.LEASE_MONTHS, 'term')} / 100.0::DOUBLE FROM {SEEDS}""")
def _(spark, d):
    """Documents of three types written as truth files, JSON arrays of 100 records, and read back as tables."""
    out = []
    for kind, (make, schema, extra, number, amount) in TRUTHS.items():
        truth = make(seeds(spark, d)).select("seed", *[
            extra() if extra and name == "items" else F.col(name) for name in (x.split()[0] for x in schema.split(", "))])
        rows = F.collect_list(F.struct(*truth.columns[1:]))
        path = shared_dir(spark, "truth")
        truth.groupBy(F.floor(F.col("seed") / 100)).agg(F.to_json(rows, {"pretty": "true"}).alias("value")).select("value").write.text(path)
        out.append(files.json_array(spark, path, schema).select(
            F.lit(kind).alias("doc_type"), "file_name", F.col(number).alias("number"), F.col(amount).cast("double").alias("amount")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("token_estimate", """
SELECT file_name, doc_type, page_count::BIGINT AS page_count, (page_count * 970 + 600)::BIGINT AS estimated_tokens,
  round((page_count * 970 + 600) * 0.000005::DOUBLE, 6) AS estimated_credits FROM raw_documents""")
def _(spark, d):
    return cost.estimate(P.raw_documents(spark, d), 0.000005, 200, 400)


# --- synthetic documents ---------------------------------------------------------------------------

CTES["product"] = "SELECT * FROM (VALUES " + P._values([
    (i, c, name, round(lo * 100), round(hi * 100)) for i, (c, name, lo, hi) in enumerate(V.PRODUCTS)]) + ") t(idx, category, name, lo, hi)"
# the products of a document in the order they are drawn, with their place from 0
CTES["drawn_product"] = f"""
SELECT seed, p.*, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'product', idx))) - 1 AS i FROM {SEEDS}, product p
"""
CTES["drawn_invoice"] = f"""
SELECT seed, sum(price * quantity) AS subtotal, count(*) AS lines, string_agg(name, ', ' ORDER BY i) AS products FROM (
  SELECT *, lo + {draw('hi - lo + 1', 'seed', "'price'", 'i')} AS price, {one_of(V.ORDER_QUANTITIES, 'seed', "'qty'", 'i')} AS quantity
  FROM drawn_product WHERE i < {between(3, 15, 'items')})
GROUP BY seed
"""


@query("synth_invoices", f"""
SELECT printf('invoice_%05d.pdf', seed) AS file_name, vendor_name, payment_terms, 'PO-' || {between(100000, 999999, 'po')} AS po_number, invoice_date,
  invoice_date + coalesce(try_cast(regexp_extract(payment_terms, '(\\d+)\\s*$', 1) AS INT), 30) AS due_date, lines, products,
  subtotal / 100.0::DOUBLE AS subtotal, tax / 100.0::DOUBLE AS tax_amount, (subtotal + tax) / 100.0::DOUBLE AS total_amount
FROM (SELECT *, {chosen([v[0] for v in V.VENDORS], 'vendor')} AS vendor_name, {chosen([v[2] for v in V.VENDORS], 'vendor')} AS payment_terms,
    DATE '2025-01-01' + {draw(365, 'seed', "'day'")}::INT AS invoice_date, ((subtotal * {between(600, 900, 'tax')} + 5000) // 10000)::BIGINT AS tax
  FROM drawn_invoice)""")
def _(spark, d):
    """An invoice per order: vendor, terms, dates, products in order, amounts."""
    return synth.invoices(seeds(spark, d)).select(
        "file_name", "vendor_name", "payment_terms", "po_number", "invoice_date", "due_date", F.size("lines").alias("lines"),
        F.array_join("lines.product_name", ", ").alias("products"), "subtotal", "tax_amount", "total_amount")


CATEGORY_LISTS = ["Snacks, Frozen", "Tobacco", "Unknown", "Beverages,Candy & Gum"]
CTES["order_wish"] = f"""
SELECT o_orderkey AS seed, [{', '.join(literal(v[0]) for v in V.VENDORS)}, 'Nobody Inc.'][o_orderkey % {len(V.VENDORS) + 1} + 1] AS vendor_name, 3 + o_orderkey % 8 AS num_items,
  [['Snacks', 'Frozen'], ['Tobacco'], [], ['Beverages', 'Candy & Gum']][o_orderkey % 4 + 1] AS wanted FROM orders
"""
CTES["wished_line"] = f"""
SELECT *, greatest(floor(2500.0::DOUBLE / 1.08::DOUBLE / (sum((lo + hi) / 2.0::DOUBLE) OVER (PARTITION BY seed) / 100))::INT, 6) AS base FROM (
  SELECT w.*, p.category, p.name, p.lo, p.hi, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'product', place))) - 1 AS i
  FROM order_wish w JOIN (SELECT *, row_number() OVER (PARTITION BY wish ORDER BY idx) - 1 AS place FROM (
    SELECT p.*, unnest([['Snacks', 'Frozen'], ['Tobacco'], [], ['Beverages', 'Candy & Gum']]) AS wish FROM product p) WHERE len(wish) = 0 OR list_contains(wish, category)) p
  ON p.wish = w.wanted) WHERE i < num_items
"""


@query("synth_invoices_like", f"""
SELECT w.seed, w.vendor_name, lines, subtotal / 100.0::DOUBLE AS subtotal, DATE '2000-01-01' - {draw(8, 'w.seed', "'day'")}::INT AS invoice_date,
  NULL::VARCHAR AS error
FROM order_wish w JOIN (SELECT seed, count(*) AS lines, sum((lo + {draw('hi - lo + 1', 'seed', "'price'", 'i')})
    * [greatest(base - 12, 6), base, base + 12, base + 24][{draw(4, 'seed', "'qty'", 'i')} + 1]) AS subtotal FROM wished_line GROUP BY seed) l ON w.seed = l.seed
WHERE vendor_name <> 'Nobody Inc.'
UNION ALL SELECT seed, vendor_name, NULL, NULL, NULL, 'Error: Vendor not found - Nobody Inc.' FROM order_wish WHERE vendor_name = 'Nobody Inc.'""")
def _(spark, d):
    """Invoices to order, one per order, of the categories and the number of items asked for; one vendor in thirteen is unknown
    and gives an error row."""
    k = F.col("o_orderkey")
    vendors = small_table(spark, V.VENDORS, "vendor_name string, address string, default_terms string")
    names = F.array(*[F.lit(v[0]) for v in V.VENDORS], F.lit("Nobody Inc."))
    wanted = P.read(spark, d, "orders").select(
        k.alias("seed"), F.get(names, (k % (len(V.VENDORS) + 1)).cast("int")).alias("vendor_name"), (F.lit(3) + k % 8).cast("int").alias("num_items"),
        F.get(F.array(*map(F.lit, CATEGORY_LISTS)), (k % 4).cast("int")).alias("categories"), F.lit(2500.0).alias("approx_total"))
    good = synth.invoices_like(wanted, vendors, P.day()).select(
        "seed", "vendor_name", F.size("lines").alias("lines"), "subtotal", "invoice_date", F.lit(None).cast("string").alias("error"))
    return good.unionByName(synth.unknown_vendors(wanted, vendors), allowMissingColumns=True)


@query("synth_contracts", f"""
SELECT printf('contract_%02d.pdf', seed) AS file_name, {[*V.PARTIES]}[seed % 5 + 1] AS party_name, counterparty, terms, effective_date,
  effective_date + {chosen(V.CONTRACT_DAYS, 'length')} AS expiration_date, 'CTR-' || year(effective_date) || '-' || {between(1000, 9999, 'no')} AS contract_number,
  'REF-' || upper(left(counterparty, 3)) || '-' || {between(100, 999, 'ref')} AS reference_id, base / 100.0::DOUBLE AS base_value, adj / 100.0::DOUBLE AS adjustments,
  (base + adj) / 100.0::DOUBLE AS total_value, first / 100.0::DOUBLE AS first_amount, (base + adj - first - second - third) / 100.0::DOUBLE AS last_amount,
  effective_date + ({between(30, 90, 'gap', 0)} + {between(30, 90, 'gap', 1)} + {between(30, 90, 'gap', 2)})::INT AS last_due
FROM (SELECT *, {', '.join(f"((base + adj) * {between(150, 350, 'share', i)} + 500) // 1000 AS {n}" for i, n in enumerate(('first', 'second', 'third')))}
  FROM (SELECT seed, {[*V.COUNTERPARTIES]}[seed % 5 + 1] AS counterparty, {chosen(V.CONTRACT_TERMS, 'terms')} AS terms,
    DATE '2026-01-01' + {draw(61, 'seed', "'day'")}::INT AS effective_date, {cents('5000', '150000', 'base')} AS base,
    CASE WHEN {draw(4, 'seed', "'adj'")} = 0 THEN {cents('-2000', '5000', 'amount')} ELSE 0 END AS adj FROM {SEEDS}))""")
def _(spark, d):
    return synth.contracts(seeds(spark, d)).select(
        "file_name", "party_name", "counterparty", "terms", "effective_date", "expiration_date", "contract_number", "reference_id", "base_value",
        "adjustments", "total_value", F.get("lines", F.lit(0))["amount"].alias("first_amount"), F.element_at("lines", -1)["amount"].alias("last_amount"),
        F.element_at("lines", -1)["due_date"].alias("last_due"))


CTES["receipt_item"] = "SELECT * FROM (VALUES " + P._values([(i, round(p * 100)) for i, (_, p) in enumerate(V.RECEIPT_ITEMS)]) + ") t(idx, price)"


@query("synth_receipts", f"""
SELECT printf('receipt_%02d.pdf', seed) AS file_name, merchant_name, day AS purchase_date, day + 30 AS return_by_date,
  'R' || strftime(day, '%m%d') || '-' || {between(1000, 9999, 'no')} AS receipt_number, 'TXN' || {between(100000, 999999, 'txn')} AS transaction_id,
  {chosen(V.PAYMENT_METHODS, 'pay')} AS payment_method, lines, subtotal / 100.0::DOUBLE AS subtotal, tax / 100.0::DOUBLE AS tax_amount, (subtotal + tax) / 100.0::DOUBLE AS total_paid
FROM (SELECT *, ((subtotal * {between(600, 800, 'taxable')} * rate + 50000000) // 100000000)::BIGINT AS tax FROM (
  SELECT seed, lines, subtotal, DATE '2026-02-01' + {draw(31, 'seed', "'day'")}::INT AS day, {chosen([m for m, _ in V.MERCHANTS], 'merchant')} AS merchant_name,
    {chosen([round(float(V.SALES_TAX[s]) * 100000) for _, s in V.MERCHANTS], 'merchant')} AS rate
  FROM (SELECT seed, count(*) AS lines, sum(price * {one_of(V.RECEIPT_QUANTITIES, 'seed', "'qty'", 'i')}) AS subtotal FROM (
    SELECT seed, price, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, 'item', idx))) - 1 AS i FROM {SEEDS}, receipt_item)
    WHERE i < {between(2, 8, 'items')} GROUP BY seed)))""")
def _(spark, d):
    return synth.receipts(seeds(spark, d)).select(
        "file_name", "merchant_name", "purchase_date", "return_by_date", "receipt_number", "transaction_id", "payment_method",
        F.size("lines").alias("lines"), "subtotal", "tax_amount", "total_paid")


def _tier(i: int) -> str:
    """SQL of a tier's charge in cents."""
    _, _, below, width, summer, winter = V.ENERGY_TIERS[i]
    used = f"greatest(kwh - {below}, 0)" if width is None else f"least(greatest(kwh - {below}, 0), {width})"
    price = f"CASE WHEN month(day) IN ({', '.join(map(str, V.SUMMER_MONTHS))}) THEN {round(float(summer) * 10000)} ELSE {round(float(winter) * 10000)} END"
    return f"(({price}) * {used} + 50) // 100"


@query("synth_bills", f"""
SELECT printf('utility_bill_%02d.pdf', seed) AS file_name, {chosen([u for u, _ in V.UTILITIES], 'utility')} AS utility_company,
  {chosen([r for _, r in V.UTILITIES], 'utility')} AS rate_schedule, {chosen(V.SERVICE_ADDRESSES, 'address')} AS service_address,
  {" || '-' || ".join(between(lo, hi, 'acc', i) for i, (lo, hi) in enumerate([(10, 99), (1000, 9999), (1000, 9999), (10, 99)]))} AS account_number,
  {chosen(['E', 'M', 'K'], 'meter')} || {between(100000, 999999, 'mno')} AS meter_number, day - {between(28, 32, 'period')}::INT AS billing_period_start,
  day AS billing_period_end, day + {between(18, 25, 'due')}::INT AS due_date, kwh AS kwh_usage,
  CASE WHEN kwh > 600 THEN {cents('1.5', '8.5', 'kw')} ELSE 0 END / 100.0::DOUBLE AS demand_kw, charges / 100.0::DOUBLE AS current_charges,
  previous / 100.0::DOUBLE AS previous_balance, (charges + previous) / 100.0::DOUBLE AS total_due
FROM (SELECT *, {' + '.join(_tier(i) for i in range(len(V.ENERGY_TIERS)))} + {cents('15', '45', 'delivery')} + {cents('2.50', '8', 'benefit')} + {cents('5', '22', 'taxes')} AS charges,
    CASE WHEN {draw(3, 'seed', "'prev'")} = 0 THEN {cents('50', '250', 'balance')} ELSE 0 END AS previous
  FROM (SELECT seed, {between(180, 1400, 'kwh')} AS kwh, DATE '2026-02-01' + {draw(26, 'seed', "'day'")}::INT AS day FROM {SEEDS}))""")
def _(spark, d):
    return synth.utility_bills(seeds(spark, d)).drop("seed", "lines")


@query("synth_leases", f"""
SELECT printf('lease_%02d.pdf', seed) AS file_name, {[*V.LANDLORDS]}[seed % {len(V.LANDLORDS)} + 1] AS landlord_name,
  {chosen(V.TENANTS, 'tenant')} || {between(100, 999, 'store')} AS tenant_name, 'LSE-' || {between(10000, 99999, 'no')} AS lease_number,
  {between(100, 9999, 'house')} || ' ' || {chosen(V.STREETS, 'street')} || ' ' || {chosen(V.STREET_SUFFIXES, 'suffix')} || ', ' || {chosen(V.CITIES, 'city')} || ', '
    || {chosen(V.STATES, 'state')} || ' ' || {between(30000, 89999, 'zip')} AS property_address,
  day AS lease_start_date, day + (months * 30)::INT AS lease_end_date, months::BIGINT AS lease_term_months, rent / 100.0::DOUBLE AS monthly_rent,
  ((rent * {chosen([round(float(m) * 10) for m in V.DEPOSIT_MONTHS], 'deposit')} + 5) // 10) / 100.0::DOUBLE AS security_deposit, {chosen(V.RENT_DUE_DAYS, 'dueday')}::BIGINT AS payment_due_day,
  {cents('50', '250', 'late')} / 100.0::DOUBLE AS late_fee, rent * months / 100.0::DOUBLE AS total_lease_value
FROM (SELECT seed, DATE '2025-01-01' + {draw(366, 'seed', "'day'")}::INT AS day, {chosen(V.LEASE_MONTHS, 'term')} AS months, {cents('1500', '8500', 'rent')} AS rent FROM {SEEDS})""")
def _(spark, d):
    return synth.leases(seeds(spark, d)).drop("seed")


@query("bench_corpus", """
SELECT 'bench_invoice_' || printf('%05d', o_orderkey) || '.pdf' AS file_name, 'INVOICE' AS doc_type, false AS extracted FROM orders
UNION ALL SELECT file_name, doc_type, extracted FROM raw_documents WHERE extracted""")
def _(spark, d):
    """Test invoices, vendors in turn, registered beside the documents that exist."""
    corpus = synth.invoices(seeds(spark, d), prefix="bench_invoice_", round_robin=True).select("file_name")
    known = P.raw_documents(spark, d).where("extracted")
    new = ingest.register(corpus.where(F.col("file_name").like("bench\\_invoice\\_%")), known, P.run_time())
    cols = ["file_name", "doc_type", "extracted"]
    return known.select(*cols).unionByName(new.select(*cols))


def drawn(what: str, n: str) -> str:
    """SQL of the table function's draws."""
    return f"(('0x' || left(md5(seed || ':' || {what}), 12))::BIGINT % ({n}))"


@query("bench_cleanup", """
SELECT 'raw_documents' AS tbl, file_name FROM raw_documents WHERE extracted UNION ALL SELECT 'fields', file_name FROM fields
UNION ALL SELECT 'removed', 'bench_invoice_' || printf('%05d', o_orderkey) || '.pdf' FROM orders""")
def _(spark, d):
    """Test invoices are registered and extracted, and removed again by the pattern of their names; all others stay."""
    corpus = synth.invoices(seeds(spark, d), prefix="bench_invoice_", round_robin=True).select("file_name")
    known = P.raw_documents(spark, d).where("extracted")
    raw = known.unionByName(ingest.register(corpus, known, P.run_time()), allowMissingColumns=True).select("file_name")
    fields = P.fields(spark, d).select("file_name").unionByName(corpus)
    left = tables.reset_pattern(raw, {"fields": fields}, "bench\\_invoice\\_%")
    gone = raw.join(left["raw_documents"], "file_name", "left_anti")
    named = [df.select(F.lit(name).alias("tbl"), "file_name") for name, df in [*left.items(), ("removed", gone)]]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("generator_udtf", f"""
SELECT seed AS s_suppkey, 'gen_invoice_' || seed || '.pdf' AS file_name, 'INV-' || printf('%05d', seed) AS number, 'PO-' || (100000 + {drawn("'po'", '900000')}) AS po,
  5::BIGINT AS lines, '$' || format('{{:,.2f}}', (net + (net * (60 + {drawn("'rate'", '31')}) + 500) // 1000) / 100.0::DOUBLE) AS total
FROM (SELECT seed, sum(cents * 6 * greatest(1, floor(900.0::DOUBLE * 100 / 1.08::DOUBLE / 5 / cents / 6 + 0.5::DOUBLE)::BIGINT))::BIGINT AS net FROM (
  SELECT seed, lo + {drawn("'price ' || name", 'hi - lo + 1')} AS cents, row_number() OVER (PARTITION BY seed ORDER BY {drawn('name', str(1 << 40))}, idx) AS k
  FROM (SELECT s_suppkey AS seed FROM supplier), product WHERE category IN ('Snacks', 'Frozen')) WHERE k <= 5 GROUP BY seed)""")
def _(spark, d):
    """The table function, called once per supplier: numbers, lines and amounts of the text it makes."""
    spark.udtf.register("generate_invoice", synth.GenerateInvoice)
    P.read(spark, d, "supplier").createOrReplaceTempView("udtf_suppliers")
    return spark.sql("""
        SELECT s.s_suppkey, g.file_name, regexp_extract(g.text, 'Invoice Number: (.*)', 1) AS number, regexp_extract(g.text, 'PO Number: (.*)', 1) AS po,
          regexp_count(g.text, '(?m)^[0-9]+ \\\\| ') AS lines, regexp_extract(g.text, 'TOTAL DUE: (.*)', 1) AS total
        FROM udtf_suppliers s, LATERAL generate_invoice(s.s_name, 'Main St 1', 'Net 30', 5, 'Snacks,Frozen', 900.0D,
             DATE '2024-02-01', CAST(s.s_suppkey AS INT)) g""")


@query("fold_lines_udtf", """
SELECT file_name AS key, count(*) AS n_lines, string_agg(concat_ws(' | ', product_name, coalesce(category, ''), quantity, unit_price, line_total), chr(10)
  ORDER BY line_number, line_item_id) AS text FROM line_items GROUP BY file_name""")
def _(spark, d):
    """A table function over the whole line table, a call's rows being those of one document in order."""
    spark.udtf.register("fold_lines", synth.FoldLines)
    P.line_items(spark, d).select("file_name", "line_number", "line_item_id", "product_name", "category", "quantity", "unit_price",
                                  "line_total").createOrReplaceTempView("udtf_lines")
    return spark.sql("SELECT * FROM fold_lines(TABLE(udtf_lines), 'file_name', 'line_number', 'line_item_id')")


@query("list_documents")
def _(spark, d):
    """The given files as a listing, largest last."""
    return files.list_documents(spark, d, "*.parquet").select("file_name", "file_size_bytes")


@query("table_scan", "SELECT record_id, file_name, field_10::DOUBLE AS field_10 FROM fields WHERE field_10 > 400000")
def _(spark, d):
    return P.fields(spark, d).where("field_10 > 400000").select("record_id", "file_name", "field_10")
