"""The stored tables of the library, projected from the given tables.

Each projection is row-local or one join; ids, names and flags follow from the row's own key. Only line ids
need the other lines of the order (``numbered_lines``). The SQL of the same projections is in ``CTES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.core import let, money_text
from ..operators import config as cfg
from ..operators import extract
from ..sources import render
from .base import CTES

FUNCTION = "EXTRACT"
WAREHOUSE = "EXTRACT_WH"
POOL = "EXTRACT_POOL"
TYPES = list(V.DOC_TYPES)


def day(text: str = "2000-01-01") -> Column:
    """The day ledgers are looked at."""
    return F.lit(text).cast("date")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def usage_time() -> Column:
    """The time usage is looked at."""
    return moment("2024-01-31 00:00:00")


def run_time() -> Column:
    """The time jobs say they ran."""
    return moment("2024-02-01 12:00:00")


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def file_name(key: Column | str) -> Column:
    """``invoice_00000042.pdf``; longer keys keep all their digits."""
    digits = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.concat(F.lit("invoice_"), F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), F.lit("0")), F.lit(".pdf"))


def _m(c: str, p: int = 12) -> Column:
    return F.col(c).cast(f"decimal({p},2)")


def invoices(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    terms = F.when(key % 3 == 0, 15).when(key % 3 == 1, 30).otherwise(60)
    issued = F.to_date("o_orderdate")
    total = _m("o_totalprice")
    tax = F.round(total * F.lit("0.08").cast("decimal(3,2)"), 2).cast("decimal(12,2)")
    status = F.when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "P", "APPROVED").otherwise("PENDING")
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("invoice_id"), file_name("o_orderkey").alias("file_name"), F.col("c_name").alias("vendor_name"),
        F.concat(F.lit("INV-"), key).alias("invoice_number"), F.concat(F.lit("PO-"), key).alias("po_number"),
        issued.alias("invoice_date"), F.when(key % 50 != 0, F.date_add(issued, terms)).alias("due_date"),
        F.concat(F.lit("Net "), terms).alias("payment_terms"),
        F.concat("c_mktsegment", F.lit(" Store #"), "c_custkey").alias("bill_to"),
        (total - tax).cast("decimal(12,2)").alias("subtotal"), tax.alias("tax_amount"), total.alias("total_amount"),
        status.alias("status"),
        F.when(status == "PAID", F.date_add(issued, (F.lit(5) + key % 21).cast("int"))).alias("payment_date"),
        F.timestamp_add("SECOND", (key % 600).cast("int"), F.col("o_orderdate")).alias("extracted_at"),
    )


CTES["invoices"] = """
SELECT o_orderkey AS invoice_id, printf('invoice_%08d.pdf', o_orderkey) AS file_name, c_name AS vendor_name,
  'INV-' || o_orderkey AS invoice_number, 'PO-' || o_orderkey AS po_number, o_orderdate::DATE AS invoice_date,
  CASE WHEN o_orderkey % 50 <> 0 THEN (o_orderdate::DATE + terms::INT) END AS due_date,
  'Net ' || terms AS payment_terms, c_mktsegment || ' Store #' || c_custkey AS bill_to,
  (total - tax)::DECIMAL(12,2) AS subtotal, tax AS tax_amount, total AS total_amount, status,
  CASE WHEN status = 'PAID' THEN (o_orderdate::DATE + (5 + o_orderkey % 21)::INT) END AS payment_date,
  o_orderdate + to_seconds(o_orderkey % 600) AS extracted_at
FROM (SELECT *, round(total * 0.08::DECIMAL(3,2), 2)::DECIMAL(12,2) AS tax FROM (
  SELECT *, [15, 30, 60][o_orderkey % 3 + 1] AS terms, o_totalprice::DECIMAL(12,2) AS total,
    CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'P' THEN 'APPROVED' ELSE 'PENDING' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey))
"""


#: Line ids leave room for so many lines of an order; more raise an error.
LINES = 1_000_000


def numbered_lines(spark, d, names: DataFrame | None = None) -> DataFrame:
    """The line table (of the orders in ``names``) with ``file_name`` and an id per line: the order's key, then the line's
    place in its order.

    The number in the table repeats within an order, so places follow it and then the other columns; equal lines
    get ids of their own. Partitioned by name, as most uses of lines are.
    """
    place = F.row_number().over(Window.partitionBy("file_name").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag"))
    fits = F.when(F.col("_place") < LINES, F.col("l_orderkey") * LINES + F.col("_place")).otherwise(
        F.raise_error(F.lit(f"an order has {LINES} lines or more")).cast("bigint"))
    lines = read(spark, d, "lineitem").withColumn("file_name", file_name("l_orderkey"))
    if names is not None:
        lines = lines.join(names.select("file_name"), "file_name", "left_semi")
    return lines.withColumn("_place", place).withColumn("line_id", fits).drop("_place")


CTES["line_of_order"] = f"""
SELECT *, l_orderkey * {LINES} + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
  l_quantity, l_extendedprice, l_returnflag) AS line_id FROM lineitem
"""


def line_items(spark, d, names: DataFrame | None = None) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_type")
    price = F.round(_m("l_extendedprice") / _m("l_quantity", 10), 2).cast("decimal(10,2)")
    return numbered_lines(spark, d, names).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("line_id").alias("line_item_id"), "file_name",
        F.concat(F.lit("INV-"), "l_orderkey").alias("invoice_number"), F.col("l_linenumber").alias("line_number"),
        F.col("p_name").alias("product_name"),
        F.when(F.col("l_partkey") % 40 != 0, F.col("p_type")).alias("category"),
        _m("l_quantity", 10).alias("quantity"), price.alias("unit_price"), _m("l_extendedprice").alias("line_total"),
    )


CTES["line_items"] = """
SELECT line_id AS line_item_id,
  printf('invoice_%08d.pdf', l_orderkey) AS file_name, 'INV-' || l_orderkey AS invoice_number,
  l_linenumber AS line_number, p_name AS product_name,
  CASE WHEN l_partkey % 40 <> 0 THEN p_type END AS category, l_quantity::DECIMAL(10,2) AS quantity,
  (((200 * (l_extendedprice::DECIMAL(12,2) * 100)::BIGINT + (l_quantity * 100)::BIGINT) // (2 * (l_quantity * 100)::BIGINT))
    ::DECIMAL(18,0) * 0.01::DECIMAL(3,2))::DECIMAL(10,2) AS unit_price,
  l_extendedprice::DECIMAL(12,2) AS line_total
FROM line_of_order JOIN part ON l_partkey = p_partkey
"""


def raw_documents(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    done = F.col("o_orderstatus") != "O"
    return read(spark, d, "orders").select(
        file_name("o_orderkey").alias("file_name"),
        F.concat(F.lit("docs/"), file_name("o_orderkey")).alias("file_path"),
        F.get(F.array(*map(F.lit, TYPES)), (key % 5).cast("int")).alias("doc_type"),
        F.col("o_orderdate").alias("staged_at"), done.alias("extracted"),
        F.when(done, F.timestamp_add("SECOND", (key % 600).cast("int"), F.col("o_orderdate"))).alias("extracted_at"),
        F.when(key % 97 == 0, "parse error").alias("extraction_error"),
        (F.lit(1) + key % 4).cast("int").alias("page_count"), (F.lit(20000) + key % 5000).alias("file_size_bytes"),
    )


CTES["raw_documents"] = f"""
SELECT printf('invoice_%08d.pdf', o_orderkey) AS file_name, printf('docs/invoice_%08d.pdf', o_orderkey) AS file_path,
  {TYPES}[o_orderkey % 5 + 1] AS doc_type, o_orderdate AS staged_at, o_orderstatus <> 'O' AS extracted,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(o_orderkey % 600) END AS extracted_at,
  CASE WHEN o_orderkey % 97 = 0 THEN 'parse error' END AS extraction_error,
  (1 + o_orderkey % 4)::INT AS page_count, 20000 + o_orderkey % 5000 AS file_size_bytes
FROM orders
"""


FIELD_OF = {
    "field_1": "vendor_name", "field_2": "invoice_number", "field_3": "po_number", "field_4": "invoice_date",
    "field_5": "due_date", "field_6": "payment_terms", "field_7": "bill_to", "field_8": "subtotal",
    "field_9": "tax_amount", "field_10": "total_amount",
}


def fields(spark, d) -> DataFrame:
    """Extracted documents: all that are no longer pending."""
    raw = F.to_json(F.create_map(*[x for c in FIELD_OF.values() for x in (F.lit(c), F.col(c).cast("string"))]))
    return invoices(spark, d).where(F.col("status") != "PENDING").select(
        F.col("invoice_id").alias("record_id"), "file_name", *[F.col(c).alias(f) for f, c in FIELD_OF.items()],
        raw.alias("raw_extraction"), F.lit("EXTRACTED").alias("status"), "extracted_at")


CTES["fields"] = f"""
SELECT invoice_id AS record_id, file_name, {', '.join(f'{c} AS {f}' for f, c in FIELD_OF.items())},
  'EXTRACTED' AS status, extracted_at
FROM invoices WHERE status <> 'PENDING'
"""


def table_data(spark, d) -> DataFrame:
    return line_items(spark, d).select(
        F.col("line_item_id").alias("line_id"), "file_name", F.expr("substring(invoice_number, 5)").alias("record_id"),
        "line_number", F.col("product_name").alias("col_1"), F.col("category").alias("col_2"),
        F.col("quantity").alias("col_3"), F.col("unit_price").alias("col_4"), F.col("line_total").alias("col_5"),
        F.to_json(F.struct(F.col("product_name").alias("Product"), F.col("quantity").cast("string").alias("Qty"))).alias("raw_line_data"),
    )


CTES["table_data"] = """
SELECT line_item_id AS line_id, file_name, substr(invoice_number, 5) AS record_id, line_number,
  product_name AS col_1, category AS col_2, quantity AS col_3, unit_price AS col_4, line_total AS col_5
FROM line_items
"""

def reviews(spark, d) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    amount = _m("value")
    json = F.when(user % 20 == 0, F.concat(F.lit('{"total_amount":"'), amount, F.lit('","invoice_date":"2000-01-15"}'))) \
        .when(user % 20 == 5, F.lit('{"total_amount":"99999999999.99","due_date":"2000-02-30","vendor_name":""}')) \
        .when(user % 20 == 10, F.concat(F.lit('{"line_item_count":"3","computed_line_total":'), amount, F.lit("}"))) \
        .when(user % 20 == 15, F.lit('{"vendor_name":null,"subtotal":"123.456789"}'))
    none = lambda t: F.lit(None).cast(t)
    return read(spark, d, "events").where(F.col("event_type") == "click").select(
        event.alias("review_id"), F.floor(event / 10).cast("bigint").alias("record_id"),
        file_name(F.floor(event / 10).cast("bigint")).alias("file_name"),
        F.get(F.array(F.lit("APPROVED"), F.lit("REJECTED"), F.lit("CORRECTED")), (user % 3).cast("int")).alias("review_status"),
        F.when(user % 7 == 0, F.concat(F.lit("Corrected Vendor "), user)).alias("corrected_vendor_name"),
        none("string").alias("corrected_invoice_number"), none("string").alias("corrected_po_number"),
        F.when(user % 4 == 0, F.to_date("ts")).alias("corrected_invoice_date"), none("date").alias("corrected_due_date"),
        none("string").alias("corrected_payment_terms"), none("string").alias("corrected_recipient"),
        none("decimal(12,2)").alias("corrected_subtotal"), none("decimal(12,2)").alias("corrected_tax_amount"),
        F.when(user % 2 == 0, amount).alias("corrected_total"),
        F.concat(F.lit("note "), event).alias("reviewer_notes"), F.concat(F.lit("user"), user).alias("reviewed_by"),
        F.col("ts").alias("reviewed_at"), json.alias("corrections"),
    )


CTES["reviews"] = """
SELECT event_id AS review_id, event_id // 10 AS record_id, printf('invoice_%08d.pdf', event_id // 10) AS file_name,
  ['APPROVED', 'REJECTED', 'CORRECTED'][user_id % 3 + 1] AS review_status,
  CASE WHEN user_id % 7 = 0 THEN 'Corrected Vendor ' || user_id END AS corrected_vendor_name,
  CASE WHEN user_id % 4 = 0 THEN ts::DATE END AS corrected_invoice_date,
  CASE WHEN user_id % 2 = 0 THEN value::DECIMAL(12,2) END AS corrected_total,
  'note ' || event_id AS reviewer_notes, 'user' || user_id AS reviewed_by, ts AS reviewed_at,
  CASE user_id % 20
    WHEN 0 THEN '{"total_amount":"' || value::DECIMAL(12,2) || '","invoice_date":"2000-01-15"}'
    WHEN 5 THEN '{"total_amount":"99999999999.99","due_date":"2000-02-30","vendor_name":""}'
    WHEN 10 THEN '{"line_item_count":"3","computed_line_total":' || value::DECIMAL(12,2) || '}'
    WHEN 15 THEN '{"vendor_name":null,"subtotal":"123.456789"}' END AS corrections
FROM events WHERE event_type = 'click'
"""


def line_reviews(spark, d) -> DataFrame:
    """Two reviews for every returned line."""
    q = F.col("l_quantity").cast("bigint")
    li = numbered_lines(spark, d).where(F.col("l_returnflag") == "R")
    return li.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(
        (F.col("line_id") * 2 + F.col("i")).alias("review_id"), "line_id", "file_name",
        F.col("l_orderkey").cast("string").alias("record_id"),
        F.when(F.col("i") == 1, F.lit("fixed item")).alias("corrected_col_1"), F.lit(None).cast("string").alias("corrected_col_2"),
        F.when(q % 3 == 0, (q + F.col("i")).cast("decimal(10,2)")).alias("corrected_col_3"),
        F.lit(None).cast("decimal(10,2)").alias("corrected_col_4"), F.lit(None).cast("decimal(12,2)").alias("corrected_col_5"),
        F.when(q % 5 == 0, F.concat(F.lit('{"col_2":"returned","col_5":"'), F.col("i") + 10, F.lit('.005"}'))).alias("corrections"),
        F.concat(F.lit("round "), F.col("i")).alias("reviewer_notes"), F.lit("checker").alias("reviewed_by"),
        F.timestamp_add("DAY", ((q + F.col("i")) % 2).cast("int"), F.col("l_shipdate")).alias("reviewed_at"),
    )


CTES["line_reviews"] = """
SELECT line_id * 2 + i AS review_id, line_id, file_name, l_orderkey::VARCHAR AS record_id,
  CASE WHEN i = 1 THEN 'fixed item' END AS corrected_col_1,
  CASE WHEN q % 3 = 0 THEN (q + i)::DECIMAL(10,2) END AS corrected_col_3,
  CASE WHEN q % 5 = 0 THEN '{"col_2":"returned","col_5":"' || (i + 10) || '.005"}' END AS corrections,
  'round ' || i AS reviewer_notes, 'checker' AS reviewed_by, l_shipdate + to_days(((q + i) % 2)::INT) AS reviewed_at
FROM (SELECT l_orderkey, l_shipdate, l_quantity::BIGINT AS q, unnest([0, 1]) AS i,
    printf('invoice_%08d.pdf', l_orderkey) AS file_name, line_id
  FROM line_of_order WHERE l_returnflag = 'R')
"""


# --- usage ---------------------------------------------------------------------------------------

def usage(spark, d) -> DataFrame:
    event = F.col("event_id")
    tokens = F.get_json_object("props", "$.k").cast("bigint") * 200
    return read(spark, d, "events").where(F.col("event_type") == "purchase").select(
        event.alias("query_id"), F.col("ts").alias("start_time"), F.lit(FUNCTION).alias("function_name"),
        (F.col("value").cast("decimal(18,2)") / 1000).cast("decimal(18,6)").alias("credits"),
        F.concat(F.lit('[{"value": '), tokens, F.lit("}]")).alias("metrics"))


CTES["usage_calls"] = """
SELECT event_id AS query_id, ts AS start_time, (value::DECIMAL(18,2)::DECIMAL(18,6) / 1000)::DECIMAL(18,6) AS ai_credits,
  json_extract_string(props, '$.k')::BIGINT * 200 AS tokens
FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY
"""


def query_history(spark, d) -> DataFrame:
    event = F.col("event_id")
    name = F.when(event % 3 == 0, F.upper(file_name("event_id"))).otherwise(file_name("event_id"))
    second = F.when(event % 7 == 0, F.concat(F.lit(", 'docs/"), file_name(event + 1), F.lit("'"))).otherwise("")
    text = F.when(event % 20 == 0, F.lit("SELECT 1")).otherwise(F.concat(F.lit("SELECT read('docs/"), name, F.lit("'"), second, F.lit(")")))
    return read(spark, d, "events").where(F.col("event_type") == "purchase").select(
        event.alias("query_id"), text.alias("query_text"), (F.lit(1000) + event % 9000).alias("total_elapsed_time"),
        F.lit(1).cast("bigint").alias("rows_produced"))


# texts name the document of the event, every seventh also the next one, every twentieth none
CTES["call_files"] = """
SELECT query_id, start_time, ai_credits, tokens, ((1000 + query_id % 9000)::DECIMAL(18,3) / 1000)::DECIMAL(18,3) AS elapsed_sec,
  unnest(CASE WHEN query_id % 20 = 0 THEN [NULL::BIGINT] WHEN query_id % 7 = 0 THEN [query_id, query_id + 1]
    ELSE [query_id] END) AS order_key
FROM usage_calls
"""
CTES["call_docs"] = """
SELECT c.*, r.file_name, r.doc_type, r.page_count, r.file_size_bytes
FROM call_files c LEFT JOIN raw_documents r ON r.file_name = printf('invoice_%08d.pdf', c.order_key)
"""


def metering(spark, d) -> DataFrame:
    return read(spark, d, "events").where(F.col("event_type").isin("signup", "error")).select(
        F.col("ts").alias("start_time"),
        F.when(F.col("event_type") == "signup", WAREHOUSE).otherwise(POOL).alias("resource"),
        (F.col("value").cast("decimal(18,2)") / 100).cast("decimal(18,6)").alias("credits_used"))


CTES["metering"] = """
SELECT ts AS start_time, CASE event_type WHEN 'signup' THEN 'EXTRACT_WH' ELSE 'EXTRACT_POOL' END AS resource,
  (value::DECIMAL(18,2)::DECIMAL(18,6) / 100)::DECIMAL(18,6) AS credits_used
FROM events WHERE event_type IN ('signup', 'error')
"""

SERVICES = {"click": "AI_SERVICES", "signup": "WAREHOUSE_METERING", "error": "CONTAINER_SERVICES",
            "view": "STORAGE", "purchase": "REPLICATION"}


def metering_daily(spark, d) -> DataFrame:
    from ..functions.core import lookup

    cents = F.sum(F.col("value").cast("decimal(18,2)"))
    return read(spark, d, "events").groupBy(
        F.to_date("ts").alias("usage_date"), lookup(SERVICES, F.col("event_type")).alias("service_type")
    ).agg((cents.cast("decimal(28,6)") / 100).cast("decimal(28,6)").alias("credits_used"),
          (cents.cast("decimal(28,6)") / 125).cast("decimal(28,6)").alias("credits_billed"))


# --- field values as printed -------------------------------------------------------------------------

# which attribute of an order a field shows
SOURCE = {
    "vendor_name": "sender", "invoice_number": "number", "po_number": "ref", "invoice_date": "date1",
    "due_date": "date2", "payment_terms": "terms", "recipient": "recipient", "subtotal": "amount1",
    "tax_amount": "amount2", "total_amount": "amount3",
    "party_name": "sender", "contract_number": "number", "reference_id": "ref", "effective_date": "date1",
    "expiration_date": "date2", "terms": "terms", "counterparty": "recipient", "base_value": "amount1",
    "adjustments": "amount2", "total_value": "amount3",
    "merchant_name": "sender", "receipt_number": "number", "transaction_id": "ref", "purchase_date": "date1",
    "return_by_date": "date2", "payment_method": "terms", "buyer": "recipient", "total_paid": "amount3",
    "utility_company": "sender", "account_number": "number", "meter_number": "ref", "service_address": "recipient",
    "billing_period_start": "date1", "billing_period_end": "date2", "rate_schedule": "terms", "kwh_usage": "kwh",
    "demand_kw": "kw", "previous_balance": "amount2", "current_charges": "amount1", "total_due": "amount3",
    "landlord_name": "sender", "tenant_name": "recipient", "lease_number": "number", "property_address": "recipient",
    "lease_start_date": "date1", "lease_end_date": "date2", "lease_term_months": "small", "monthly_rent": "amount1",
    "security_deposit": "amount2", "payment_due_day": "small", "late_fee": "kw", "total_lease_value": "amount3",
}


def _date_forms(day: Column) -> Column:
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "MMMM dd, yyyy", "dd MMM yyyy", "yyyy/MM/dd"]
    text = F.lit("to be agreed")
    for i, form in reversed(list(enumerate(forms))):
        text = F.when(F.col("k") % 6 == i, F.date_format(day, form)).otherwise(text)
    return F.when(day.isNull(), F.lit("N/A")).otherwise(text)


def field_docs(spark, d, config: DataFrame | None = None) -> DataFrame:
    """Documents with an answer for every configured field of their type, as printed: dates in many
    forms, amounts with currency signs, abbreviated, blank and missing values. Joined with the parsed
    configuration, ready for ``extract.post_process``."""
    k = F.col("k")
    inv = invoices(spark, d).select(
        F.col("invoice_id").alias("k"), "file_name", "vendor_name", "bill_to", "payment_terms",
        F.date_add("invoice_date", 9000).alias("day1"), F.date_add("due_date", 9000).alias("day2"),
        "subtotal", "tax_amount", "total_amount")
    plain = lambda c: F.col(c).cast("string")
    src = {
        "sender": F.when(k % 10 == 0, "PSE&G").when(k % 10 == 1, "  con ed ").when(k % 10 == 2, F.lit(None))
        .when(k % 10 == 3, "   ").otherwise(F.col("vendor_name")),
        "number": F.concat(F.lit("INV-"), k), "ref": F.when(k % 8 == 0, "n/a").otherwise(F.concat(F.lit(" PO-"), k)),
        "date1": _date_forms(F.col("day1")), "date2": _date_forms(F.col("day2")),
        "terms": F.col("payment_terms"), "recipient": F.col("bill_to"),
        "amount1": F.when(k % 4 == 0, money_text(F.col("subtotal"))).otherwise(plain("subtotal")),
        "amount2": F.when(k % 4 == 1, "None").when(k % 4 == 2, F.concat(F.lit("-"), plain("tax_amount"))).otherwise(plain("tax_amount")),
        "amount3": F.when(k % 4 == 3, F.concat(plain("total_amount"), F.lit(" USD"))).when(k % 9 == 0, "1.2.3").otherwise(money_text(F.col("total_amount"))),
        "kwh": F.concat(k % 1400, F.lit(" kWh")), "kw": F.concat(k % 90, F.lit(".5 kW")), "small": (k % 40).cast("string"),
        "key": k,
    }
    raw = raw_documents(spark, d).select("file_name", "doc_type")
    # which attribute a field shows is looked up once per type: a map is searched key by key
    place_of = F.create_map(*[F.lit(x) for field, n in SOURCE.items() for x in (field, list(src).index(n))])
    conf = cfg.parsed(cfg.default_config(spark) if config is None else config).withColumn(
        "_places", F.transform("specs.name", lambda name: F.try_element_at(place_of, name)))
    return (
        # the key is dealt as one of the attributes: uses with and without it then share the exchange
        inv.select("file_name", F.array(*[c.cast("string") for c in src.values()]).alias("_src"))
        .join(raw, "file_name").transform(extract.dealt).join(conf, "doc_type")
        .withColumn("k", F.get("_src", F.lit(list(src).index("key"))).cast("long"))
        .withColumn("response", F.map_from_arrays("specs.name", F.transform("_places", lambda p: F.get("_src", p))))
        .drop("_src", "_places")
    )


def _values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (bool, int)):
            return str(v).upper()
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


CTES["spec"] = "SELECT * FROM (VALUES " + _values([
    (t, i, f, ftype, label, SOURCE[f])
    for t, s in V.DOC_TYPES.items() for i, (f, label, ftype) in enumerate(s["fields"], 1)
]) + ") t(doc_type, pos, field, ftype, label, src)"
CTES["abbreviation"] = f"SELECT * FROM (VALUES {_values(list(V.COMPANY_NAMES.items()))}) t(short, full_name)"
CTES["name_field"] = f"SELECT * FROM (VALUES {_values([(f,) for f in V.NAME_FIELDS])}) t(field)"
CTES["rule"] = "SELECT * FROM (VALUES " + _values([
    (t, i, f, r.get("required"), r.get("min"), r.get("max"), r.get("date_min"), r.get("date_max"))
    for t, s in V.DOC_TYPES.items() for i, (f, r) in enumerate(s["validation"].items())
]) + ") t(doc_type, rpos, field, required, lo, hi, day_lo, day_hi)"
CTES["doc_source"] = """
SELECT invoice_id AS k, i.file_name, r.doc_type, payment_terms AS terms, bill_to AS recipient,
  'INV-' || invoice_id AS number, CASE WHEN invoice_id % 8 = 0 THEN 'n/a' ELSE ' PO-' || invoice_id END AS ref,
  CASE invoice_id % 10 WHEN 0 THEN 'PSE&G' WHEN 1 THEN '  con ed ' WHEN 2 THEN NULL WHEN 3 THEN '   ' ELSE vendor_name END AS sender,
  invoice_date + 9000 AS day1, due_date + 9000 AS day2,
  CASE WHEN invoice_id % 4 = 0 THEN '$' || format('{:,.2f}', subtotal::DOUBLE) ELSE subtotal::VARCHAR END AS amount1,
  CASE invoice_id % 4 WHEN 1 THEN 'None' WHEN 2 THEN '-' || tax_amount ELSE tax_amount::VARCHAR END AS amount2,
  CASE WHEN invoice_id % 4 = 3 THEN total_amount || ' USD' WHEN invoice_id % 9 = 0 THEN '1.2.3'
    ELSE '$' || format('{:,.2f}', total_amount::DOUBLE) END AS amount3,
  (invoice_id % 1400) || ' kWh' AS kwh, (invoice_id % 90) || '.5 kW' AS kw, (invoice_id % 40)::VARCHAR AS small
FROM invoices i JOIN raw_documents r ON i.file_name = r.file_name
"""
CTES["doc_field"] = """
SELECT k, file_name, s.doc_type, pos, field, ftype, CASE src WHEN 'sender' THEN sender WHEN 'number' THEN number
  WHEN 'ref' THEN ref WHEN 'terms' THEN terms WHEN 'recipient' THEN recipient WHEN 'amount1' THEN amount1
  WHEN 'amount2' THEN amount2 WHEN 'amount3' THEN amount3 WHEN 'kwh' THEN kwh WHEN 'kw' THEN kw WHEN 'small' THEN small
  ELSE CASE WHEN d IS NULL THEN 'N/A' ELSE CASE k % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%m/%d/%Y')
    WHEN 2 THEN strftime(d, '%B %d, %Y') WHEN 3 THEN strftime(d, '%d %b %Y') WHEN 4 THEN strftime(d, '%Y/%m/%d')
    ELSE 'to be agreed' END END END AS raw
FROM (SELECT x.*, s.pos, s.field, s.ftype, s.src, CASE s.src WHEN 'date1' THEN day1 WHEN 'date2' THEN day2 END AS d
  FROM doc_source x JOIN spec s ON x.doc_type = s.doc_type) s
"""
CTES["doc_norm"] = """
SELECT k, file_name, doc_type, pos, field, ftype, raw, CASE
  WHEN t IS NULL OR lower(t) IN ('null', 'none', 'n/a', '') THEN CASE WHEN ftype = 'NUMBER' THEN '0' END
  WHEN ftype = 'DATE' THEN coalesce(strftime(try_strptime(t, ['%Y-%m-%d', '%m/%d/%Y', '%m-%d-%Y', '%d/%m/%Y', '%B %d, %Y',
    '%b %d, %Y', '%B %d %Y', '%b %d %Y', '%d %B %Y', '%d %b %Y', '%Y/%m/%d']), '%Y-%m-%d'), t)
  WHEN ftype = 'NUMBER' THEN CASE WHEN n IN ('', '.', '-') THEN '0' ELSE n END ELSE t END AS normalized
FROM (SELECT *, regexp_replace(regexp_replace(t, '\\s*(kWh|kW|kwh|kw|%)\\s*', '', 'g'), '[^0-9.\\-]', '', 'g') AS n
  FROM (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM doc_field))
"""
CTES["doc_value"] = """
SELECT d.* EXCLUDE (normalized), CASE WHEN n.field IS NOT NULL THEN coalesce(a.full_name, d.normalized) ELSE d.normalized END AS normalized
FROM doc_norm d LEFT JOIN name_field n ON d.field = n.field LEFT JOIN abbreviation a ON lower(trim(d.normalized)) = a.short
"""
CTES["doc_warning"] = """
SELECT file_name, doc_type, rpos, wpos, field, w.rule AS rule, w.message AS message FROM (
  SELECT file_name, doc_type, rpos, field, unnest([1, 2, 3, 4, 5]) AS wpos, unnest([
    CASE WHEN required AND (v IS NULL OR trim(v) = '' OR (v = '0' AND ftype <> 'NUMBER'))
      THEN {'rule': 'required', 'message': field || ' is required but missing or empty'} END,
    CASE WHEN num < lo THEN {'rule': 'min', 'message': field || '=' || num || ' is below minimum ' || lo} END,
    CASE WHEN num > hi THEN {'rule': 'max', 'message': field || '=' || num || ' exceeds maximum ' || hi} END,
    CASE WHEN day < day_lo::DATE THEN {'rule': 'date_min', 'message': field || '=' || v || ' is before ' || day_lo} END,
    CASE WHEN day > day_hi::DATE THEN {'rule': 'date_max', 'message': field || '=' || v || ' is after ' || day_hi} END]) AS w
  FROM (SELECT v.file_name, r.*, v.normalized AS v, v.ftype, CASE WHEN v.ftype = 'NUMBER' THEN try_cast(v.normalized AS DOUBLE) END AS num,
      CASE WHEN v.ftype = 'DATE' THEN try_strptime(v.normalized, '%Y-%m-%d')::DATE END AS day
    FROM rule r JOIN doc_value v ON r.doc_type = v.doc_type AND r.field = v.field))
WHERE w IS NOT NULL
"""
CTES["doc_score"] = """
SELECT file_name, doc_type, pos, field, CASE WHEN v IS NULL OR trim(v) = '' THEN 0.1::DOUBLE ELSE greatest(0, 1.00::DECIMAL(6,2)
    - CASE WHEN ftype = 'NUMBER' AND num = 0 THEN 0.10::DECIMAL(6,2) ELSE 0 END - CASE WHEN ftype = 'NUMBER' AND num IS NULL THEN 0.30::DECIMAL(6,2) ELSE 0 END
    - CASE WHEN ftype = 'DATE' AND NOT regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}') THEN 0.20::DECIMAL(6,2) ELSE 0 END
    - flags * 0.30::DECIMAL(6,2))::DOUBLE END AS confidence
FROM (SELECT *, coalesce(required AND (v IS NULL OR trim(v) = '' OR (v = '0' AND ftype <> 'NUMBER')), false)::INT + coalesce(num < lo, false)::INT
    + coalesce(num > hi, false)::INT + coalesce(day < day_lo::DATE, false)::INT + coalesce(day > day_hi::DATE, false)::INT AS flags
  FROM (SELECT v.file_name, v.doc_type, v.pos, v.field, v.ftype, v.normalized AS v, r.required, r.lo, r.hi, r.day_lo, r.day_hi,
      CASE WHEN v.ftype = 'NUMBER' THEN try_cast(v.normalized AS DOUBLE) END AS num,
      CASE WHEN v.ftype = 'DATE' THEN try_strptime(v.normalized, '%Y-%m-%d')::DATE END AS day
    FROM doc_value v LEFT JOIN rule r ON r.doc_type = v.doc_type AND r.field = v.field))
"""


# --- documents as text ----------------------------------------------------------------------------------

def invoice_texts(spark, d, names: DataFrame | None = None) -> DataFrame:
    """Invoices (all, or those in ``names``) rendered to text with their lines, as documents of type INVOICE.

    Names cut the line table before its lines are brought together.
    """
    inv, li = invoices(spark, d), line_items(spark, d, names)
    if names is not None:
        inv = inv.join(names.select("file_name"), "file_name", "left_semi")
    cells = render.invoice_line(*[F.col(c) for c in ("line_number", "product_name", "category", "quantity", "unit_price", "line_total")])
    # dealt before they are printed: cells take more room than the columns they come from
    rows = render.fold_lines(extract.dealt(li), "file_name", ["line_number", "line_item_id"], cells)
    return render.invoices(inv, rows).withColumn("doc_type", F.lit("INVOICE")).transform(extract.dealt)


#: What each table column of the five types prints of a line item.
CELL_OF = {"Line": "line_number", "Due Date": "line_number"} | {
    c: source for names, source in zip(extract.NAMED_COLUMNS, ["product_name", "category", "quantity", "unit_price", "line_total"])
    for c in names}


def typed_texts(spark, d) -> DataFrame:
    """Documents of all five types as text (file_name, doc_type, text): the answers of ``field_docs`` under
    their labels, then the order's lines in the columns of the type. The first line is empty.

    By the key modulo 3: columns as configured, in reverse order, or two tables, the second in reverse order."""
    shown = {"line_number": F.col("line_number").cast("string"), "product_name": F.col("product_name"),
             "category": F.coalesce("category", F.lit("")), "quantity": F.col("quantity").cast("string"),
             "unit_price": money_text(F.col("unit_price")), "line_total": money_text(F.col("line_total"))}
    # dealt before they are printed: cells take more room than the columns they come from
    rows = render.fold_lines(extract.dealt(line_items(spark, d)), "file_name", ["line_number", "line_item_id"],
                             F.array(*shown.values()))
    label_of = {f: label for t in V.DOC_TYPES.values() for f, label, _ in t["fields"]}
    labels = F.create_map(*[F.lit(x) for pair in label_of.items() for x in pair])
    places = F.create_map(*[F.lit(x) for c, source in CELL_OF.items() for x in (c, list(shown).index(source))])
    # labels and places of a type's fields and columns are looked up once per type, not by every document and line
    printed = cfg.parsed(cfg.default_config(spark)).select(
        "doc_type", F.transform("specs.name", lambda n: F.element_at(labels, n)).alias("_labels"),
        F.transform("table_cols", lambda c: F.try_element_at(places, c)).alias("_cells"))
    # the answers of ``field_docs`` come in the order of the specs
    fields = let(F.map_values("response"), lambda v: F.transform(
        F.col("_labels"), lambda label, i: F.concat(label, F.lit(": "), F.get(v, i))))

    def table_text(rows: Column, names: Column, cells: Column) -> Column:
        row_text = lambda r: F.array_join(F.transform(cells, lambda p: F.get(r, p)), " | ")
        lines = F.concat(F.array(F.array_join(names, " | ")), F.transform(rows, row_text))
        return F.array_join(lines, "\n")

    given = F.col("table_cols"), F.col("_cells")
    turned = F.reverse(F.col("table_cols")), F.col("_turned")
    rows_of = F.coalesce("table_rows", F.array().cast(rows.schema["table_rows"].dataType))
    half = F.ceil(F.size(rows_of) / 2).cast("int")
    two = F.concat(table_text(F.slice(rows_of, 1, half), *given), F.lit("\n\n"),
                   table_text(F.slice(rows_of, half + 1, F.size(rows_of)), *turned))
    table = F.when(F.col("k") % 3 == 0, table_text(rows_of, *given)).when(F.col("k") % 3 == 1, table_text(rows_of, *turned)).otherwise(two)
    text = F.concat(F.lit("\n"), F.array_join(fields, "\n"), F.lit("\n\n"), table)
    printed = printed.withColumn("_turned", F.reverse("_cells"))
    made = field_docs(spark, d).join(rows, "file_name", "left").join(printed, "doc_type").select("file_name", "doc_type", text.alias("text"))
    return extract.dealt(made)


def extractions(spark, d) -> DataFrame:
    """Table answers as JSON: parallel arrays in line order; every seventh order lacks its last Total."""
    item = F.struct("line_number", "line_item_id", "product_name", "category", "quantity", "unit_price", "line_total")
    g = line_items(spark, d).groupBy("file_name", "invoice_number").agg(F.sort_array(F.collect_list(item)).alias("x"))
    col = lambda f: F.transform("x", lambda r: r[f].cast("string"))
    number = F.transform("x", lambda _, i: (i + 1).cast("string"))
    ragged = F.expr("substring(invoice_number, 5)").cast("bigint") % 7 == 0
    totals = F.when(ragged, F.slice(col("line_total"), 1, F.size("x") - 1)).otherwise(col("line_total"))
    arrays = F.create_map(F.lit("Line"), number, F.lit("Product"), col("product_name"), F.lit("Category"), col("category"),
                          F.lit("Qty"), col("quantity"), F.lit("Unit Price"), F.transform("x", lambda r: money_text(r["unit_price"])),
                          F.lit("Total"), totals)
    return g.select("file_name", "invoice_number", F.to_json(F.struct(F.struct(arrays.alias("line_items")).alias("response"))).alias("extraction"))


CTES["numbered_lines"] = """
SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY line_number, line_item_id) AS rn,
  count(*) OVER (PARTITION BY file_name) AS n, substr(invoice_number, 5)::BIGINT AS k FROM line_items
"""
