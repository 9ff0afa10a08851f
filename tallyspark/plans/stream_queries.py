"""Streams run to completion over the given tables, and the health of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config, extract, health
from ..session import shared_dir
from ..sources import files
from ..streaming import jobs
from . import projections as P
from .base import query
from .extract_queries import ROUND_TRIP


PARTS, FILES = 4, 2


def order_feed(spark, d):
    """The order table as a stream of names of arriving documents."""
    schema = P.read(spark, d, "orders").schema
    return spark.readStream.schema(schema).parquet(f"{d}/orders*.parquet").select(P.file_name("o_orderkey").alias("file_name"))


def arrivals(spark, d):
    """The names of the orders' documents as files that arrive in four parts, a micro-batch each (by key modulo 4)."""
    path = shared_dir(spark, "arrivals")
    orders = P.read(spark, d, "orders")
    for i in range(PARTS):
        names = orders.where(F.col("o_orderkey") % PARTS == i).select(P.file_name("o_orderkey").alias("file_name"))
        names.repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema("file_name string").option("maxFilesPerTrigger", FILES).parquet(path)


def texts_of(spark, d):
    """Makes documents with text of the names of a micro-batch."""
    return lambda names: P.invoice_texts(spark, d, names).select("file_name", "doc_type", "text")


def short_texts(spark, d, there):
    """Like ``texts_of`` with one line of text, where ``there`` (by name and order) is true."""
    orders = P.read(spark, d, "orders").withColumn("file_name", P.file_name("o_orderkey"))
    text = F.concat(F.lit("Total: "), "o_totalprice")
    return lambda names: orders.join(names, "file_name").select(
        "file_name", F.lit("INVOICE").alias("doc_type"), F.when(there, text).alias("text"))


def batch_number():
    return F.substring_index("batch", "-", -1).cast("bigint").alias("batch")


@query("stream_extract", ROUND_TRIP.replace("FROM invoices", ", invoice_id % 4 AS batch FROM invoices"))
def _(spark, d):
    """All orders stream through extraction in four micro-batches; a second run of the stream finds nothing to do."""
    base, feed = shared_dir(spark, "stream"), arrivals(spark, d)
    for _ in range(2):
        jobs.extract_stream(feed, config.default_config(spark), base, P.run_time(), texts_of(spark, d)).awaitTermination()
    return jobs.results(spark, base, "fields").select("file_name", *[f"field_{i}" for i in range(1, 11)], batch_number())


@query("stream_interval", "SELECT printf('invoice_%08d.pdf', o_orderkey) AS file_name, round(o_totalprice, 2) AS field_10, o_orderkey % 4 AS batch FROM orders")
def _(spark, d):
    """The same on a timer, as a stream that never ends: followed until everything that arrived has a result, then stopped."""
    base, total = shared_dir(spark, "stream"), P.read(spark, d, "orders").count()
    timed = jobs.extract_stream(arrivals(spark, d), config.default_config(spark), base, P.run_time(),
                                short_texts(spark, d, F.lit(True)), every="1 second")
    jobs.follow(timed, lambda: jobs.results(spark, base, "fields").count() >= total)
    return jobs.results(spark, base, "fields").select("file_name", "field_10", batch_number())


@query("stream_lines", """
SELECT file_name, count(*) AS lines, sum(line_total)::DOUBLE AS total FROM line_items GROUP BY file_name""")
def _(spark, d):
    base = shared_dir(spark, "stream")
    jobs.extract_stream(order_feed(spark, d), config.default_config(spark), base, P.run_time(), texts_of(spark, d)).awaitTermination()
    return jobs.results(spark, base, "lines").groupBy("file_name").agg(F.count("*").alias("lines"), F.sum("col_5").alias("total"))


@query("stream_errors", """
SELECT printf('invoice_%08d.pdf', o_orderkey) AS file_name, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 1 THEN 'document has no text' END AS error,
  (CASE WHEN o_orderstatus <> 'O' THEN 0 WHEN o_orderkey % 2 = 1 THEN 3 WHEN o_orderkey % 4 = 2 THEN 2 ELSE 1 END)::BIGINT AS failures
FROM orders""")
def _(spark, d):
    """Open orders have no text at first. A second stream tries them again by itself: every fourth has a text by the second
    try, every other fourth by the third; the odd ones fail three times and are given up."""
    base, conf = shared_dir(spark, "stream"), config.default_config(spark)
    closed, key = F.col("o_orderstatus") != "O", F.col("o_orderkey")
    jobs.extract_stream(order_feed(spark, d), conf, base, P.run_time(), short_texts(spark, d, closed)).awaitTermination()
    later = (key % 4 == 0) | ((key % 4 == 2) & (F.col("attempt") == 3))
    again = jobs.retry_stream(short_texts(spark, d, later), conf, base, P.run_time(), wait_ms=100, attempts=3, every="1 second")

    def settled():
        return not jobs.open_errors(spark, base).groupBy("file_name").agg(F.max("attempt").alias("n")).where("n < 3").head(1)

    jobs.follow(again, settled)
    failures = jobs.results(spark, base, "errors").groupBy("file_name").agg(F.count("*").alias("failures"))
    good = jobs.results(spark, base, "fields").select("file_name", F.lit(None).cast("string").alias("error"))
    state = good.unionByName(jobs.open_errors(spark, base).select("file_name", "error").distinct())
    return state.join(failures, "file_name", "left").fillna(0, ["failures"])


@query("stream_progress", """
SELECT b AS batch_id, count(*) AS rows_in, count(*) FILTER (o_orderstatus <> 'O') AS processed, count(*) FILTER (o_orderstatus = 'O') AS failed,
  (SELECT count(*) FROM orders) - sum(count(*) FILTER (o_orderstatus <> 'O')) OVER (ORDER BY b)::BIGINT AS waiting
FROM (SELECT o_orderkey % 4 AS b, o_orderstatus FROM orders) GROUP BY b""")
def _(spark, d):
    """What every micro-batch took in and what was left after it, from the query's progress and the stored results."""
    base = shared_dir(spark, "stream")
    there = short_texts(spark, d, F.col("o_orderstatus") != "O")
    done = jobs.extract_stream(arrivals(spark, d), config.default_config(spark), base, P.run_time(), there)
    done.awaitTermination()
    return jobs.backlog_by_batch(done, P.raw_documents(spark, d), base)


@query("stream_backlog", "SELECT doc_type, count(*) AS waiting FROM raw_documents WHERE file_name NOT IN (SELECT file_name FROM fields) GROUP BY 1")
def _(spark, d):
    return jobs.backlog(P.raw_documents(spark, d), P.fields(spark, d))


@query("stream_message", "SELECT 'Processed ' || count(*) || ' new invoice(s)' AS message FROM fields")
def _(spark, d):
    return jobs.processed_message(P.fields(spark, d))


@query("auto_ingest", "SELECT printf('invoice_%08d.pdf', o_orderkey) AS file_name, 'in/' || printf('invoice_%08d.pdf', o_orderkey) AS file_path, false AS extracted FROM orders")
def _(spark, d):
    """Arriving names are registered once, however often the stream is started."""
    base = shared_dir(spark, "ingest")
    for _ in range(2):
        jobs.register_stream(order_feed(spark, d), base, P.run_time(), "INVOICE", "in/").awaitTermination()
    return jobs.registry(spark, base).select("file_name", "file_path", "extracted")


def folder_name(path):
    """``s_suppkey=7`` of a path ``.../s_suppkey=7/part-0.txt``."""
    return F.element_at(F.split(path, "/"), -2)


def supplier_files(spark, d):
    """A text file per supplier, in a folder of its own.

    Making a file costs far more than its bytes, by which an adaptive exchange would leave them all to one task, so the
    number of tasks is given; each moves its own files into place when it ends.
    """
    path = shared_dir(spark, "incoming")
    text = F.concat_ws("\n", "s_name", F.concat(F.lit("Total: $"), F.format_number("s_acctbal", 2)))
    rows = P.read(spark, d, "supplier").select("s_suppkey", text.alias("text"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    dealt.write.partitionBy("s_suppkey").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


@query("text_files", "SELECT 's_suppkey=' || s_suppkey AS file_name, s_name || chr(10) || 'Total: $' || format('{:,.2f}', s_acctbal) || chr(10) AS text FROM supplier")
def _(spark, d):
    """Files read whole, with names from their folders."""
    return files.documents(spark, supplier_files(spark, d), "*.txt", folder_name)


@query("register_files", """
SELECT 's_suppkey=' || s_suppkey AS file_name, 'in/s_suppkey=' || s_suppkey AS file_path, length(s_name || 'Total: $' || format('{:,.2f}', s_acctbal)) + 2 AS file_size_bytes,
  false AS extracted FROM supplier""")
def _(spark, d):
    """Arriving files are registered with their size; a second start of the stream finds none that is new."""
    base, path = shared_dir(spark, "ingest"), supplier_files(spark, d)
    for _ in range(2):
        listing = jobs.arriving_files(spark, path, "*.txt", name=folder_name)
        jobs.register_stream(listing, base, P.run_time(), "INVOICE", "in/").awaitTermination()
    return jobs.registry(spark, base).select("file_name", "file_path", "file_size_bytes", "extracted")


HEALTH_SQL = """
SELECT count(*) AS total_files, count(*) FILTER (extracted) AS extracted_ok, count(extraction_error) AS failed_files,
  count(*) FILTER (NOT extracted AND extraction_error IS NULL) AS pending_files,
  coalesce(max(extracted_at), TIMESTAMP '1970-01-01') AS last_extraction,
  count(*) FILTER (extraction_error IS NOT NULL AND {} >= TIMESTAMP '2001-08-01' - INTERVAL {}) AS recent_failures
FROM raw_documents"""


def health_row(spark, d, column="extracted_at", hours=24):
    return health.health(P.raw_documents(spark, d), P.moment("2001-08-01 00:00:00"), column, hours)


@query("health", HEALTH_SQL.format("extracted_at", "24 HOUR"))
def _(spark, d):
    return health_row(spark, d)


@query("health_staged", HEALTH_SQL.format("staged_at", "24 HOUR"))
def _(spark, d):
    """Failures dated by the time a document came in."""
    return health_row(spark, d, "staged_at")


@query("health_message", f"""
SELECT 'Extraction Health: ' || total_files || ' total, ' || extracted_ok || ' OK, ' || failed_files || ' failed, ' || pending_files ||
  ' pending, ' || recent_failures || ' recent failures (24h)' || CASE WHEN recent_failures >= 3 THEN ' — WARNING: failure threshold exceeded!'
  WHEN pending_files > 0 THEN ' — INFO: documents pending extraction.' ELSE ' — HEALTHY' END AS message
FROM ({HEALTH_SQL.format('staged_at', '24 HOUR')})""")
def _(spark, d):
    return health.message(health_row(spark, d, "staged_at"))


@query("alert_rows", f"""
SELECT 'EXTRACTION_FAILURE_ALERT' AS alert_name, recent_failures AS failed_count, total_files, 'Extraction failure threshold exceeded: ' ||
  recent_failures || ' failures in last 24h out of ' || total_files || ' total files.' AS message
FROM ({HEALTH_SQL.format('staged_at', '1000 DAY')}) WHERE recent_failures >= 3
UNION ALL SELECT 'EXTRACTION_FAILURE_ALERT', recent_failures, total_files, 'none expected' FROM ({HEALTH_SQL.format('extracted_at', '24 HOUR')})
WHERE recent_failures >= 1000""")
def _(spark, d):
    """Fires for the failures of the last thousand days, not for those of the last day."""
    now = P.moment("2001-08-01 00:00:00")
    fires = health.alert(health_row(spark, d, "staged_at", 24000), now)
    return fires.unionByName(health.alert(health_row(spark, d), now, 1000)).drop("fired_at")


@query("alert_ticks", f"""
SELECT 'EXTRACTION_FAILURE_ALERT' AS alert_name, recent_failures AS failed_count, total_files, 'Extraction failure threshold exceeded: ' ||
  recent_failures || ' failures in last 24h out of ' || total_files || ' total files.' AS message, tick
FROM ({HEALTH_SQL.format('staged_at', '1000 DAY')}), (VALUES (0::BIGINT), (1), (2)) t(tick) WHERE recent_failures >= 1""")
def _(spark, d):
    """The alert stream for three ticks of its clock: a row per tick as long as enough documents failed lately."""
    base = shared_dir(spark, "alerts")
    ticking = jobs.alert_stream(spark, lambda: P.raw_documents(spark, d), base, lambda: P.moment("2001-08-01 00:00:00"), threshold=1,
                                failure_time="staged_at", every="1 second", hours=24000)
    jobs.run_ticks(ticking, 3)
    return jobs.alerts(spark, base).where("tick < 3").drop("fired_at")


@query("reextract", """
SELECT f.record_id, f.file_name, CASE WHEN doc_type = 'INVOICE' THEN 'read again' ELSE f.status END AS state,
  f.field_10::DOUBLE AS field_10, f.field_7 AS field_7
FROM fields f JOIN raw_documents r ON f.file_name = r.file_name
UNION ALL SELECT max_id + row_number() OVER (ORDER BY ('0x' || substr(md5(i.file_name), 1, 3))::INT, i.file_name), i.file_name, 'read again',
  i.total_amount::DOUBLE, i.bill_to
FROM invoices i JOIN raw_documents r ON i.file_name = r.file_name, (SELECT max(record_id) AS max_id FROM fields)
WHERE doc_type = 'INVOICE' AND i.status = 'PENDING'""")
def _(spark, d):
    """One type is read again from its texts: stored rows keep their ids, pending ones get new ids."""
    fields = P.fields(spark, d)
    texts = P.invoice_texts(spark, d).select("file_name", "text")
    again = jobs.reextract(P.raw_documents(spark, d), fields, P.table_data(spark, d), texts, config.default_config(spark),
                           P.run_time(), "INVOICE")["fields"]
    state = F.when(F.col("extracted_at") == P.run_time(), "read again").otherwise(F.col("status"))
    return again.select("record_id", "file_name", state.alias("state"), "field_10", "field_7")


@query("reextract_registry", """
SELECT file_name, extracted OR doc_type = 'INVOICE' AS extracted, CASE WHEN doc_type <> 'INVOICE' THEN extraction_error END AS extraction_error
FROM raw_documents""")
def _(spark, d):
    texts = P.invoice_texts(spark, d).select("file_name", "text")
    again = jobs.reextract(P.raw_documents(spark, d), P.fields(spark, d), P.table_data(spark, d), texts,
                           config.default_config(spark), P.run_time(), "INVOICE")["raw_documents"]
    return again.select("file_name", "extracted", "extraction_error")


@query("work_list", "SELECT file_name, doc_type FROM raw_documents WHERE NOT extracted AND doc_type = 'LEASE'")
def _(spark, d):
    return extract.work_list(P.raw_documents(spark, d), P.fields(spark, d), "LEASE").select("file_name", "doc_type")
