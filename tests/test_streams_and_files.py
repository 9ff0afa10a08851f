import json
import shutil

import pytest

from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators import config, extract, health
from tallyspark.sources import files
from tallyspark.streaming import jobs

DOCS = [(f"d{i}.txt", "INVOICE", f"Vendor {i}\nInvoice Number: {i}\nTotal: ${i}.50\n\n# | Product | Category | Qty | Unit Price | Total\n1 | p | c | 2 | $1 | $2")
        for i in range(6)]
SCHEMA = "file_name string, doc_type string, text string"


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def feed(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_stream_equals_batch_and_runs_once(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    conf = config.default_config(spark)
    run = lambda: jobs.extract_stream(feed(spark, src), conf, base, now()).awaitTermination()
    spark.createDataFrame(DOCS[:3], SCHEMA).write.mode("append").parquet(src)
    run()
    run()
    assert jobs.results(spark, base, "fields").count() == 3
    # a second delivery repeats a document, has one twice and one without text
    spark.createDataFrame([DOCS[0], *DOCS[3:], DOCS[5], ("empty", "INVOICE", "")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    streamed = jobs.results(spark, base, "fields").drop("batch")
    batch = extract.run(spark.createDataFrame(DOCS, SCHEMA), conf, now())
    assert streamed.count() == 6 and streamed.exceptAll(batch["fields"]).count() == 0
    assert jobs.results(spark, base, "lines").drop("batch").exceptAll(batch["lines"]).count() == 0
    assert [r.file_name for r in jobs.results(spark, base, "errors").collect()] == ["empty"]


def test_new_checkpoint_keeps_results(spark, tmp_path):
    """A second checkpoint over the same results: its batches count from 0 again and overwrite nothing."""
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    conf = config.default_config(spark)
    run = lambda: jobs.extract_stream(feed(spark, src), conf, base, now()).awaitTermination()
    spark.createDataFrame(DOCS[:4], SCHEMA).write.parquet(src)
    run()
    shutil.rmtree(f"{base}/_checkpoint")
    spark.createDataFrame(DOCS[4:], SCHEMA).write.mode("append").parquet(src)
    run()
    got = jobs.results(spark, base, "fields")
    assert sorted(r.file_name for r in got.collect()) == [d[0] for d in DOCS]
    assert got.select("batch").distinct().count() == 2


def test_repeated_batch_is_stored_once(spark, tmp_path):
    """The same files delivered again: the guard on names keeps results unique."""
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(src)
    conf = config.default_config(spark)
    jobs.extract_stream(feed(spark, src), conf, base, now()).awaitTermination()
    spark.createDataFrame(DOCS, SCHEMA).write.mode("append").parquet(src)
    jobs.extract_stream(feed(spark, src), conf, base, now()).awaitTermination()
    assert jobs.results(spark, base, "fields").groupBy("file_name").count().where("count > 1").count() == 0


def test_auto_ingest_of_text_files(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.txt").write_text("Acme\nInvoice Number: 1")
    (src / "skip.bin").write_text("x")
    run = lambda: jobs.register_stream(jobs.arriving_files(spark, str(src), "*.txt"), base, now()).awaitTermination()
    run()
    (src / "b.txt").write_text("Other")
    run()
    run()
    got = sorted((r.file_name, r.file_size_bytes, r.extracted) for r in jobs.registry(spark, base).collect())
    assert got == [("a.txt", 22, False), ("b.txt", 5, False)]
    texts = jobs.arriving_texts(spark, str(src), F.lit("INVOICE"), "*.txt")
    jobs.extract_stream(texts, config.default_config(spark), base, now()).awaitTermination()
    fields = jobs.results(spark, base, "fields")
    assert sorted((r.file_name, r.field_1, r.field_2) for r in fields.collect()) == [("a.txt", "Acme", "1"), ("b.txt", "Other", None)]
    state = jobs.status(jobs.registry(spark, base).drop("batch"), fields, jobs.results(spark, base, "errors"), now())
    assert state.where("extracted").count() == 2 and jobs.backlog(state, fields).count() == 0


def test_reextract_keeps_ids(spark):
    conf, raw = config.default_config(spark), None
    docs = spark.createDataFrame(DOCS, SCHEMA)
    raw = docs.select("file_name", "file_name", "doc_type").toDF("file_name", "file_path", "doc_type")
    for f in schemas.RAW_DOCUMENTS:
        if f.name not in raw.columns:
            raw = raw.withColumn(f.name, F.lit(None).cast(f.dataType))
    raw = raw.select(*schemas.RAW_DOCUMENTS.names).withColumn("extracted", F.lit(False))
    empty_fields = spark.createDataFrame([], schemas.FIELDS)
    empty_lines = spark.createDataFrame([], schemas.TABLE_DATA)
    first = jobs.reextract(raw, empty_fields, empty_lines, docs, conf, now())
    assert sorted(r.record_id for r in first["fields"].collect()) == [1, 2, 3, 4, 5, 6] and first["raw_documents"].where("extracted").count() == 6
    changed = docs.withColumn("text", F.concat("text", F.lit("\nPO Number: P9")))
    second = jobs.reextract(first["raw_documents"], first["fields"], first["table_data"], changed, conf, now(), "INVOICE")
    ids = lambda t: {r.file_name: r.record_id for r in t["fields"].collect()}
    assert ids(second) == ids(first) and {r.field_3 for r in second["fields"].collect()} == {"P9"}
    assert second["table_data"].count() == 6


def test_json_array_and_csv(spark, tmp_path):
    rows = [{"file_name": "r1", "merchant_name": "M", "subtotal": 1.5, "item_count": 2}, {"file_name": "r2", "receipt_number": "R", "total_paid": 3}]
    (tmp_path / "t.json").write_text(json.dumps(rows, indent=2))
    got = files.json_records(spark, str(tmp_path / "t.json"), schemas.RECEIPT_TRUTH).orderBy("file_name").collect()
    assert [(r.file_name, r.merchant_name, r.subtotal, r.item_count, r.total_paid) for r in got] == [("r1", "M", 1.5, 2, None), ("r2", None, None, None, 3.0)]
    df = spark.createDataFrame([("a,b", 'say "hi"\nthere', 1)], "x string, y string, z int")
    files.export_csv(df, str(tmp_path / "csv"))
    files.export_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), df.schema).collect() == df.collect()


def test_one_csv_file(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    rows = [(i, f"x,{i}", 'say "hi"\nthere') for i in range(100)]
    df = spark.createDataFrame(rows, 'id long, `a,b` string, c string').repartition(7)
    for _ in range(2):
        files.export_csv(df, path, order=["id"])
    with open(path) as f:
        assert f.readline() == 'id,"a,b",c\n' and f.readline().startswith('0,"x,0"')
    assert [tuple(r) for r in files.read_csv(spark, path, df.schema).collect()] == rows
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["one.csv"]
    files.export_csv(df.limit(0), path)
    assert open(path).read() == 'id,"a,b",c\n'


def test_csv_in_parallel(spark, tmp_path):
    """One file is read by many tasks, unless a value holds a line break; the values are the same either way."""
    schema = "id long, x string, y string"
    plain = [(i, f'a, "{i}"', None if i % 5 else "") for i in range(5000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for rows, parts in ((plain, range(3, 100)), ([*plain, (5000, "two\nlines", "c\rd"), (5001, "x", '"')], range(1, 2))):
            path = str(tmp_path / f"{len(rows)}.csv")
            df = spark.createDataFrame(rows, schema)
            files.export_csv(df, path, order=["id"])
            got = files.read_csv(spark, path, df.schema)
            assert got.rdd.getNumPartitions() in parts
            whole = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
            assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, whole.collect()), key=lambda r: r[0])
            assert got.select("id", "x").exceptAll(df.select("id", "x")).count() == 0 and got.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_array_in_parallel(spark, tmp_path):
    rows = [{"a": i, "b": f"text, {i}"} if i % 3 else {"a": i} for i in range(5000)]
    (tmp_path / "t.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "u.json").write_text("\ufeff" + json.dumps(rows[:3]))
    (tmp_path / "v.json").write_text("[]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.json_array(spark, str(tmp_path / "t.json"), "a int, b string")
        assert got.rdd.getNumPartitions() > 5 and sorted((r.a, r.b) for r in got.collect()) == sorted((x["a"], x.get("b")) for x in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.json_array(spark, str(tmp_path), "a int, b string").count() == 5003
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "t.json").write_text('[{"a": 1, "b": "a } in a text"}]')
    with pytest.raises(Exception):
        files.json_array(spark, str(tmp_path / "bad"), "a int, b string").collect()


def test_listing_and_texts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("x\fy")
    (tmp_path / "b.pdf").write_text("zz")
    listing = files.list_documents(spark, str(tmp_path))
    assert sorted((r.file_name, r.file_size_bytes) for r in listing.collect()) == [("a.txt", 3), ("b.pdf", 2)]
    assert [tuple(r) for r in files.documents(spark, str(tmp_path), "*.txt").collect()] == [("a.txt", "x\fy")]


def test_versions(spark, tmp_path):
    path = files.write_version(spark.range(3), str(tmp_path), 2)
    assert path.endswith("version=000002") and files.table(spark, path).count() == 3


def test_alert_needs_enough_failures(spark):
    raw = spark.createDataFrame([("e", False, "2024-04-30 12:00:00")] * 3 + [(None, False, None), (None, True, "2024-04-30 13:00:00")],
                                "extraction_error string, extracted boolean, extracted_at string").withColumn("extracted_at", F.col("extracted_at").cast("timestamp_ntz"))
    row = health.health(raw, now())
    assert tuple(row.first())[:4] == (5, 1, 3, 1) and row.first().recent_failures == 3
    assert health.alert(row, now()).count() == 1 and health.alert(row, now(), threshold=4).count() == 0
    assert health.message(row).first()[0].endswith("WARNING: failure threshold exceeded!")
