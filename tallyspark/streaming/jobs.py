"""Continuous processing: registration, extraction, retry and alerts as Structured Streaming jobs.

Results of a micro-batch go to their own ``batch=<query id>-<batch id>`` folder, which a repeated batch
overwrites, so every document is stored once even when a batch is tried again. Which names a stream has
seen is kept in its state store (RocksDB), so a batch costs the same however much has been processed
before. The query id is the checkpoint's: under a new checkpoint, whose state is empty and whose batches
count from 0 again, earlier results stay, and their documents are looked up and skipped. The registry is
never changed from a stream; the state of a document follows from registry, results and errors (see ``status``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.core import number_rows, small_table
from ..operators import extract, health, ingest, tables
from ..session import shared_dir
from ..sources import files

RESULTS = {
    "fields": "file_name string, field_1 string, field_2 string, field_3 string, field_4 date, field_5 date, "
              "field_6 string, field_7 string, field_8 decimal(12,2), field_9 decimal(12,2), field_10 decimal(12,2), "
              "raw_extraction string, status string, extracted_at timestamp_ntz",
    "lines": "file_name string, line_number int, col_1 string, col_2 string, col_3 decimal(10,2), "
             "col_4 decimal(10,2), col_5 decimal(12,2), raw_line_data string",
    "errors": "file_name string, error string, failed_at timestamp_ntz, attempt int",
}
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare(spark: SparkSession, base: str) -> None:
    """Empty result tables, so that readers never meet a missing folder."""
    for name, schema in RESULTS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/{name}/batch=-1")


def results(spark: SparkSession, base: str, name: str) -> DataFrame:
    schema = RESULTS[name] + ", batch string"
    return spark.read.schema(schema).parquet(f"{base}/{name}")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the checkpoint keeps for its query."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def batch_key(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """A batch's number under the id that the checkpoint keeps for its query."""
    return f"{query_id(spark, checkpoint)}-{batch_id}"


def store(docs: DataFrame, config: DataFrame, base: str, now: Column, batch: str, model=None,
          attempts: DataFrame | None = None) -> None:
    """Extract documents (by a model if one is given) and write their fields, lines and errors as one batch.

    Texts are read once: what they say is written to a folder of the batch's own first, the three tables are
    made from that, and the folder is removed. ``attempts`` (file_name, attempt) numbers tries after the first.
    """
    spark = docs.sparkSession
    path = f"{base}/read/{batch}"
    extract.read_documents(extract.dealt(docs), config, model).write.mode("overwrite").parquet(path)
    parts = extract.split_results(spark.read.parquet(path), now)
    if attempts is None:
        parts["errors"] = parts["errors"].withColumn("attempt", F.lit(1))
    else:
        parts["errors"] = parts["errors"].join(attempts.select("file_name", "attempt"), "file_name")
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
    files.remove(spark, path)


def start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    """Run every interval, or once over all that is new when no interval is given."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def start_keyed(spark: SparkSession, writer, checkpoint: str, every: str | None) -> StreamingQuery:
    """Like ``start`` for a query with keyed state; a query takes its settings when it starts, the session keeps its own."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return start(writer, checkpoint, every)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def follow(query: StreamingQuery, done: Callable[[], bool], timeout: float = 600) -> StreamingQuery:
    """Let a timed query run until ``done()`` and its micro-batch has ended, then stop it; an error of the query, or too
    long a wait, is raised."""
    end = time.monotonic() + timeout

    def wait_while(going: Callable[[], bool]) -> None:
        while going():
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError(f"stream did not get there in {timeout} s: {query.status}")
            time.sleep(0.1)

    def last() -> tuple | None:
        return query.lastProgress and (query.lastProgress.batchId, query.lastProgress.timestamp)

    try:
        wait_while(lambda: not done())
        before = last()
        wait_while(lambda: query.status["isTriggerActive"] and last() == before)
    finally:
        query.stop()
    return query


def run_ticks(query: StreamingQuery, ticks: int, timeout: float = 600) -> StreamingQuery:
    """Let a timed query finish so many micro-batches, then stop it."""
    return follow(query, lambda: query.lastProgress is not None and query.lastProgress.batchId >= ticks - 1, timeout)


def extract_stream(feed: DataFrame, config: DataFrame, base: str, now: Column, to_documents=None,
                   every: str | None = None, model=None) -> StreamingQuery:
    """Extract the documents of a stream of (file_name, doc_type, text) rows, each name once.

    Names seen are keyed state, for which rows are exchanged by name; to keep texts out of that, let the feed
    hold names only and give ``to_documents``, which makes documents of the new names of a micro-batch (a
    stored frame, so it may be used several times). Batches without new names do no work.
    """
    spark = feed.sparkSession
    prepare(spark, base)
    checkpoint = f"{base}/_checkpoint"
    known = []

    def known_elsewhere(key: str) -> DataFrame | None:
        """Names with a result of another checkpoint or of a retry; None if there were none when the stream started."""
        if not known:
            others = results(spark, base, "fields").where(~F.col("batch").startswith(key.rpartition("-")[0])).select("file_name")
            known.append(others if others.head(1) else None)
        return known[0]

    def process(batch: DataFrame, batch_id: int) -> None:
        key = batch_key(spark, checkpoint, batch_id)
        others = known_elsewhere(key)
        new = batch if others is None else batch.join(others, "file_name", "left_anti")
        if to_documents is None:
            return store(new, config, base, now, key, model)
        path = f"{base}/read/names-{key}"
        new.write.mode("overwrite").parquet(path)
        store(to_documents(spark.read.schema(new.schema).parquet(path)), config, base, now, key, model)
        files.remove(spark, path)

    once = feed.dropDuplicates(["file_name"])
    return start_keyed(spark, once.writeStream.foreachBatch(process), checkpoint, every)


def retry_stream(to_documents, config: DataFrame, base: str, now: Column, wait_ms: int = 600_000, attempts: int = 3,
                 every: str = "1 minute", model=None) -> StreamingQuery:
    """Read failed documents again by themselves, ``wait_ms`` after each failure and ``attempts`` times in all.

    The source is the table of errors, which this stream itself adds to when a try fails again. ``to_documents``
    makes documents, as they are now, from the (file_name, attempt) rows that are due.

    Failures seen are keyed state, and a clock (the ``rate`` source) starts batches when nothing new failed. A batch
    costs by the documents that wait, all of which it handles as columns.
    """
    spark = config.sparkSession
    prepare(spark, base)
    checkpoint = f"{base}/_checkpoint_retry"
    schema = "file_name string, attempt int, due_at long, ready int"

    def process(batch: DataFrame, batch_id: int) -> None:
        """What waits is a folder per batch, made of the one before and the new failures; the last two are kept, as a batch
        may be repeated. Of several failures of a document the last try counts."""
        query, clock = query_id(spark, checkpoint), int(time.time() * 1000)
        key, waiting = f"retry-{query}-{batch_id}", lambda n: f"{base}/_waiting/{query}-{n}"
        known = batch.where("file_name IS NOT NULL").select(
            "file_name", (F.col("attempt") + 1).alias("attempt"), F.lit(clock + wait_ms).alias("due_at"))
        if batch_id > 0:
            known = known.unionByName(spark.read.schema(schema).parquet(waiting(batch_id - 1)).where("ready = 0").drop("ready"))
        known = known.groupBy("file_name").agg(F.max("attempt").alias("attempt"), F.max("due_at").alias("due_at"))
        known.withColumn("ready", (F.col("due_at") <= clock).cast("int")).write.mode("overwrite").partitionBy("ready").parquet(waiting(batch_id))
        due = spark.read.schema(schema).parquet(waiting(batch_id)).where("ready = 1").select("file_name", "attempt")
        if due.head(1):
            store(to_documents(due), config, base, now, key, model, due)
        files.remove(spark, waiting(batch_id - 2))

    failed = spark.readStream.schema(RESULTS["errors"]).option("recursiveFileLookup", True).parquet(f"{base}/errors")
    fresh = failed.select("file_name", "attempt").where(F.col("attempt") < attempts).dropDuplicates()  # a failure may come twice
    tick = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(
        F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("int").alias("attempt"))
    return start_keyed(spark, fresh.unionByName(tick).writeStream.foreachBatch(process), checkpoint, every)


def open_errors(spark: SparkSession, base: str, batch: str = "") -> DataFrame:
    """Errors of documents that have no result yet; what ``batch`` itself stored does not count."""
    ended = results(spark, base, "fields").where(F.col("batch") != batch).select("file_name")
    return results(spark, base, "errors").where(F.col("batch") != batch).join(ended, "file_name", "left_anti")


def retry(documents: DataFrame, config: DataFrame, base: str, now: Column, attempt: str, model=None) -> None:
    """Read the failed documents again once, from (file_name, doc_type, text) as it is now.

    For a call by hand; ``retry_stream`` does it by itself. An attempt of the same name replaces what the
    earlier one stored.
    """
    spark = documents.sparkSession
    key = f"retry-{attempt}"
    failed = open_errors(spark, base, key).groupBy("file_name").agg((F.max("attempt") + 1).alias("attempt"))
    again = documents.dropDuplicates(["file_name"]).join(failed.select("file_name"), "file_name", "left_semi")
    store(again, config, base, now, key, model, failed)


def register_stream(listing: DataFrame, base: str, now: Column, doc_type: Column | str = "INVOICE",
                    prefix: str = "", every: str | None = None) -> StreamingQuery:
    """Register arriving files (a stream with ``file_name``) that are not registered yet."""
    spark = listing.sparkSession
    spark.createDataFrame([], schemas.RAW_DOCUMENTS).write.mode("ignore").parquet(f"{base}/raw/batch=-1")

    def process(batch: DataFrame, batch_id: int) -> None:
        key = batch_key(spark, checkpoint, batch_id)
        known = registry(spark, base).where(F.col("batch") != key)
        ingest.register(batch, known, now, doc_type, prefix).write.mode("overwrite").parquet(f"{base}/raw/batch={key}")

    checkpoint = f"{base}/_checkpoint_raw"
    return start(listing.writeStream.foreachBatch(process), checkpoint, every)


def registry(spark: SparkSession, base: str) -> DataFrame:
    """The rows ``register_stream`` has written so far, with their batch."""
    schema = T.StructType([*schemas.RAW_DOCUMENTS.fields, T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).parquet(f"{base}/raw")


def arriving_files(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000,
                   name: Callable[[Column], Column] = files.base_name) -> DataFrame:
    """Stream of new files below a folder (name and size); contents are not read. ``name`` makes a name of a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return (
        spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", per_trigger).load(path)
        .select(name(F.col("path")).alias("file_name"), F.col("length").alias("file_size_bytes"))
    )


def arriving_texts(spark: SparkSession, path: str, doc_type: Column, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """Stream of new text files as (file_name, doc_type, text)."""
    return (
        spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger)
        .option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(F.substring_index("_metadata.file_path", "/", -1).alias("file_name"), F.col("value").alias("text"))
        .withColumn("doc_type", doc_type)
    )


def alert_stream(spark: SparkSession, read_registry, base: str, as_of=F.current_timestamp, threshold: int = 3,
                 failure_time: str = "extracted_at", every: str = "60 minutes", hours: int = 24) -> StreamingQuery:
    """Append an alert row at every tick at which enough documents failed lately."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def check(_: DataFrame, batch_id: int) -> None:
        at = as_of().cast("timestamp_ntz")
        rows = health.alert(health.health(read_registry(), at, failure_time, hours), at, threshold)
        rows.write.mode("overwrite").parquet(f"{base}/alerts/batch={batch_key(spark, checkpoint, batch_id)}")

    checkpoint = f"{base}/_checkpoint_alerts"
    return start(ticks.writeStream.foreachBatch(check), checkpoint, every)


def alerts(spark: SparkSession, base: str) -> DataFrame:
    """The alert history that ``alert_stream`` has written, with the number of the tick."""
    schema = "alert_name string, fired_at timestamp_ntz, failed_count long, total_files long, message string, batch string"
    rows = spark.read.schema(schema).parquet(f"{base}/alerts")
    return rows.withColumn("tick", F.substring_index("batch", "-", -1).cast("long")).drop("batch")


def processed_message(result_rows: DataFrame) -> DataFrame:
    return result_rows.agg(F.count("*").alias("n")).select(
        F.format_string("Processed %d new invoice(s)", "n").alias("message"))


def batch_progress(query: StreamingQuery) -> DataFrame:
    """(batch_id, rows_in) of the micro-batches that the query still remembers (the newest 100 by default).

    A query also reports when a tick found nothing new; the greatest count of a batch is the one it worked on.
    """
    seen = [(p.batchId, p.numInputRows) for p in query.recentProgress]
    rows = small_table(SparkSession.active(), seen, "batch_id long, rows_in long")
    return rows.groupBy("batch_id").agg(F.max("rows_in").alias("rows_in"))


def backlog_by_batch(query: StreamingQuery, raw: DataFrame, base: str) -> DataFrame:
    """What was left after each micro-batch of ``extract_stream``: rows_in, processed, failed, waiting.

    ``waiting`` is the number of registered documents (``raw``) without a result of this or an earlier batch.
    Results are counted per batch before they meet the progress, a row per batch.
    """
    spark = raw.sparkSession
    batch = F.substring_index("batch", "-", -1).cast("long").alias("batch_id")
    named = raw.select("file_name").distinct()
    counted = lambda name, out: results(spark, base, name).where(
        F.col("batch").startswith(query.id)).join(named, "file_name", "left_semi").groupBy(batch).agg(F.count_distinct("file_name").alias(out))
    total = named.agg(F.count("*")).scalar()
    upto = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        batch_progress(query).join(counted("fields", "processed"), "batch_id", "left").join(counted("errors", "failed"), "batch_id", "left")
        .fillna(0, ["processed", "failed"]).withColumn("waiting", total - F.sum("processed").over(upto))
    )


def backlog(raw: DataFrame, result_rows: DataFrame) -> DataFrame:
    """Registered documents without a result, by type."""
    return (
        raw.join(result_rows.select("file_name"), "file_name", "left_anti")
        .groupBy("doc_type").agg(F.count("*").alias("waiting"))
    )


def status(raw: DataFrame, result_rows: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """The registry as it stands after the results and errors of the streams."""
    return tables.record_errors(tables.mark_extracted(raw, result_rows, now), errors)


def reextract(raw: DataFrame, fields: DataFrame, table_data: DataFrame, texts: DataFrame, config: DataFrame,
              now: Column, doc_type: str = "ALL", model=None) -> dict[str, DataFrame]:
    """Read all documents of a type (or of all active types) again.

    Stored rows are updated in place, so records keep their id and their reviews; line rows are replaced.
    The new results are written to the shared folder once and every changed table is made from there.
    """
    spark = raw.sparkSession
    base = shared_dir(spark, "reextract")
    active = config.where(F.coalesce(F.col("active"), F.lit(False))).select("doc_type")
    chosen = raw.join(active, "doc_type", "left_semi")
    if doc_type != "ALL":
        chosen = chosen.where(F.col("doc_type") == doc_type)
    docs = texts.select("file_name", "text").join(chosen.select("file_name", "doc_type"), "file_name")
    prepare(spark, base)
    store(docs, config, base, now, "0", model)
    done = {name: results(spark, base, name).drop("batch") for name in RESULTS}
    new_fields = tables.upsert(fields, done["fields"], "file_name", "record_id")
    ids = new_fields.select("file_name", F.col("record_id").cast("string").alias("record_id"))
    lines = number_lines(done["lines"].join(ids, "file_name"), table_data)
    old_lines = table_data.join(chosen.select("file_name"), "file_name", "left_anti").select(*table_data.columns)
    again = raw.join(chosen.select("file_name", F.lit(True).alias("_again")), "file_name", "left")
    reset = tables.reset_flags(again, F.col("_again")).select(*raw.columns)
    return {
        "fields": new_fields,
        "table_data": old_lines.unionByName(lines.select(*table_data.columns)),
        "raw_documents": status(reset, done["fields"], done["errors"], now),
    }


def number_lines(lines: DataFrame, table_data: DataFrame) -> DataFrame:
    """Give new line rows the next free line ids."""
    keyed = lines.withColumn("_key", F.concat_ws("#", "file_name", F.format_string("%09d", "line_number")))
    return number_rows(keyed, "_key", "line_id", start=table_data.agg(F.max("line_id"))).drop("_key")
