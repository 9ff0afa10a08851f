"""Streams that last: keyed state, retry by itself, timed runs, progress, working folders."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import config, health
from tallyspark.streaming import jobs

SCHEMA = "file_name string, doc_type string, text string"


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def deliver(spark, path, names):
    spark.createDataFrame([(n,) for n in names], "file_name string").coalesce(1).write.mode("append").parquet(path)


def names_feed(spark, path, per_batch=1):
    return spark.readStream.schema("file_name string").option("maxFilesPerTrigger", per_batch).parquet(path)


def documents(there=lambda names: F.lit(True)):
    return lambda names: names.select("file_name", F.lit("INVOICE").alias("doc_type"), F.when(
        there(names), F.concat(F.lit("Total: "), F.length("file_name"))).alias("text"))


def names_of(df):
    return sorted(r.file_name for r in df.select("file_name").collect())


def test_state_knows_names_across_runs_and_batches(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    asked = []

    def to_documents(names):
        asked.append(names_of(names))
        return documents()(names)

    def run():
        query = jobs.extract_stream(names_feed(spark, src), config.default_config(spark), base, now(), to_documents)
        query.awaitTermination()
        return query

    for part in (["a", "b", "a"], ["b", "c"], ["a"]):
        deliver(spark, src, part)
    run()
    deliver(spark, src, ["c", "d"])
    run()
    run()
    assert [x for x in asked if x] == [["a", "b"], ["c"], ["d"]]
    assert names_of(jobs.results(spark, base, "fields")) == ["a", "b", "c", "d"]
    assert jobs.results(spark, base, "fields").where("file_name IN ('a', 'c', 'd')").select("batch").distinct().count() == 3
    assert not os.listdir(f"{base}/read")
    state = os.listdir(f"{base}/_checkpoint/state/0/0")
    assert any(x.endswith((".changelog", ".zip")) for x in state)


def test_results_of_another_checkpoint_count(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    jobs.prepare(spark, base)
    docs = documents()(spark.createDataFrame([("a",)], "file_name string"))
    jobs.store(docs, config.default_config(spark), base, now(), "retry-1")
    deliver(spark, src, ["a", "b"])
    deliver(spark, src, ["a", "c"])
    jobs.extract_stream(names_feed(spark, src), config.default_config(spark), base, now(), documents()).awaitTermination()
    assert names_of(jobs.results(spark, base, "fields")) == ["a", "b", "c"]


def test_retry_comes_back_by_itself(spark, tmp_path):
    src, base, conf = str(tmp_path / "in"), str(tmp_path / "out"), config.default_config(spark)
    deliver(spark, src, ["good", "late", "later", "never"])
    jobs.extract_stream(names_feed(spark, src), conf, base, now(), documents(lambda _: F.col("file_name") == "good")).awaitTermination()
    assert {(r.file_name, r.attempt) for r in jobs.results(spark, base, "errors").collect()} == {(n, 1) for n in ("late", "later", "never")}

    def there(names):
        return (F.col("file_name") == "late") | ((F.col("file_name") == "later") & (F.col("attempt") == 3))

    again = jobs.retry_stream(documents(there), conf, base, now(), wait_ms=50, attempts=3, every="500 milliseconds")

    def settled():
        return not jobs.open_errors(spark, base).groupBy("file_name").agg(F.max("attempt").alias("n")).where("n < 3").head(1)

    jobs.follow(again, settled)
    assert names_of(jobs.results(spark, base, "fields")) == ["good", "late", "later"]
    failed = sorted((r.file_name, r.attempt) for r in jobs.results(spark, base, "errors").collect())
    assert failed == [("late", 1), ("later", 1), ("later", 2), ("never", 1), ("never", 2), ("never", 3)]
    # started again, the stream has nothing to do: what failed for good stays so
    jobs.run_ticks(jobs.retry_stream(documents(there), conf, base, now(), wait_ms=50, attempts=3, every="500 milliseconds"), 1)
    assert jobs.results(spark, base, "errors").count() == 6
    # a call by hand counts on
    jobs.retry(documents()(spark.createDataFrame([("never",)], "file_name string")), conf, base, now(), "x")
    assert names_of(jobs.results(spark, base, "fields"))[-1] == "never"


def test_retry_waits(spark, tmp_path):
    """Nothing is due before the wait is over."""
    src, base, conf = str(tmp_path / "in"), str(tmp_path / "out"), config.default_config(spark)
    deliver(spark, src, ["x"])
    jobs.extract_stream(names_feed(spark, src), conf, base, now(), documents(lambda _: F.lit(False))).awaitTermination()
    asked = []
    again = jobs.retry_stream(lambda due: asked.append(1) or documents()(due), conf, base, now(), wait_ms=3_600_000, every="300 milliseconds")
    jobs.run_ticks(again, 2)
    assert not asked and jobs.results(spark, base, "fields").count() == 0


def test_retry_runs_no_python_per_document(spark, tmp_path):
    """A hundred thousand failures come back without a call per document."""
    base, conf = str(tmp_path / "out"), config.default_config(spark)
    jobs.prepare(spark, base)
    failed = spark.range(100_000).select(F.concat(F.lit("f"), "id").alias("file_name"), F.lit("e").alias("error"),
                                         now().alias("failed_at"), F.lit(1).alias("attempt"))
    failed.write.parquet(f"{base}/errors/batch=x-0")
    failed.limit(10).write.parquet(f"{base}/errors/batch=x-1")  # the same failures twice
    asked = []

    def to_documents(due):
        asked.append(due.count())
        return documents()(due)

    again = jobs.retry_stream(to_documents, conf, base, now(), wait_ms=50, attempts=2, every="500 milliseconds")
    jobs.follow(again, lambda: bool(asked) and jobs.results(spark, base, "fields").count() >= 100_000)
    assert sum(asked) == 100_000 and jobs.results(spark, base, "fields").select("file_name").distinct().count() == 100_000
    assert "InPySpark" not in again._jsq.explainInternal(False)


def test_timed_run_and_backlog(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (["a", "b"], ["bad1", "c"], ["d"]):
        deliver(spark, src, part)
    raw = spark.createDataFrame([(n,) for n in ("a", "b", "c", "d", "bad1", "elsewhere")], "file_name string")
    ok = documents(lambda _: ~F.col("file_name").startswith("bad"))
    query = jobs.extract_stream(names_feed(spark, src), config.default_config(spark), base, now(), ok, every="200 milliseconds")
    jobs.follow(query, lambda: jobs.results(spark, base, "fields").count() >= 4)
    rows = {tuple(r) for r in jobs.backlog_by_batch(query, raw, base).select("batch_id", "rows_in", "processed", "failed", "waiting").collect()}
    assert rows >= {(0, 2, 2, 0, 4), (1, 2, 1, 1, 3), (2, 1, 1, 0, 2)}


def test_alerts_tick(spark, tmp_path):
    raw = spark.createDataFrame([("e", False, "2024-04-30 12:00:00")] * 3, "extraction_error string, extracted boolean, extracted_at string") \
        .withColumn("extracted_at", F.col("extracted_at").cast("timestamp_ntz"))
    base = str(tmp_path / "out")
    jobs.run_ticks(jobs.alert_stream(spark, lambda: raw, base, now, every="300 milliseconds"), 2)
    rows = jobs.alerts(spark, base).collect()
    assert {r.tick for r in rows} >= {0, 1} and {(r.alert_name, r.failed_count) for r in rows} == {(health.ALERT_NAME, 3)}


def test_follow_raises_what_the_stream_raised(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, src, ["a"])

    def broken(names):
        raise ValueError("no documents")

    query = jobs.extract_stream(names_feed(spark, src), config.default_config(spark), base, now(), broken, every="200 milliseconds")
    with pytest.raises(Exception, match="no documents"):
        jobs.follow(query, lambda: False, 60)
    raw = spark.createDataFrame([], "extraction_error string, extracted boolean, extracted_at timestamp_ntz")
    quiet = jobs.alert_stream(spark, lambda: raw, base, now, every="1 hour")
    with pytest.raises(TimeoutError):
        jobs.follow(quiet, lambda: False, 0.5)
