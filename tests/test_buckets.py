"""Bucketed tables rewrite what a change touches; versions are read when they are complete."""

import os
import time

import pytest

from conftest import tuples
from tallyspark.operators import buckets, tables
from tallyspark.sources import files


def listing(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def stored(spark, tmp_path, rows=200, n=16):
    table = buckets.BucketedTable(spark, str(tmp_path / "t"), "k", n)
    table.write(spark.createDataFrame([(i, f"k{i}", "old", i) for i in range(1, rows + 1)], "id long, k string, v string, at long"))
    return table


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = stored(spark, tmp_path)
    before = listing(table.path)
    new = spark.createDataFrame([("k7", "new", 1), ("brand new", "new", 1)], "k string, v string, at long")
    time.sleep(0.05)
    hit = table.upsert(new, "id")
    after = listing(table.path)
    assert hit == table.touched(new) and 1 <= len(hit) <= 2
    in_hit = lambda f: int(f.split("=")[1].split(os.sep)[0]) in hit
    assert {f: t for f, t in before.items() if not in_hit(f)} == {f: t for f, t in after.items() if not in_hit(f)}
    assert not {f for f in before if in_hit(f)} & set(after)
    rows = {r.k: (r.id, r.v) for r in table.read().collect()}
    assert len(rows) == 201 and rows["k7"] == (7, "new") and rows["brand new"] == (201, "new") and rows["k8"] == (8, "old")


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = stored(spark, tmp_path)
    hit = table.touched(spark.createDataFrame([("k7",)], "k string"))
    plan = table.rows().where(f"bucket IN ({hit[0]})")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and f"(bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_scoped_equals_whole(spark, tmp_path):
    table = stored(spark, tmp_path)
    old = table.read().select("id", "k", "v", "at")
    new = spark.createDataFrame([(f"k{i}", f"n{i}", i) for i in range(150, 260, 7)], "k string, v string, at long")
    want = sorted(tuples(tables.upsert(old, new, "k", "id", keep=("at",))))
    table.upsert(new, "id", keep=("at",))
    assert sorted(tuples(table.read().select("id", "k", "v", "at"))) == want
    table.upsert(new, "id", keep=("at",))
    assert sorted(tuples(table.read().select("id", "k", "v", "at"))) == want


def test_replace_children_and_empty_change(spark, tmp_path):
    table = stored(spark, tmp_path)
    assert table.upsert(table.read().limit(0)) == []
    table.replace_children(spark.createDataFrame([(1000, "k3", "child", 1), (1001, "k3", "child", 2)], "id long, k string, v string, at long"))
    assert sorted(r.id for r in table.read().where("k = 'k3'").collect()) == [1000, 1001] and table.read().count() == 201


def test_newest_change_wins(spark):
    old = spark.createDataFrame([("a", "x", 0), ("b", "y", 0)], "k string, v string, at int")
    new = spark.createDataFrame([("a", "zzz", 1), ("a", "aaa", 2), ("b", "n", None), ("b", "m", 5), ("c", "p", 1), ("c", "q", 1)], "k string, v string, at int")
    assert sorted(tuples(tables.upsert(old, new, "k", newest="at"))) == [("a", "aaa", 2), ("b", "m", 5), ("c", "q", 1)]
    assert sorted(tuples(tables.upsert(old, new, "k")))[0] == ("a", "zzz", 1)


def test_half_written_version_is_never_read(spark, tmp_path):
    base = str(tmp_path / "v")
    with pytest.raises(Exception):
        files.newest_version(spark, base).count()
    files.write_version(spark.range(3), base, 1)
    files.write_version(spark.range(5), base, 2)
    files.write_version(spark.range(9), base, 3, publish=False)
    os.remove(f"{base}/version=000003/_SUCCESS")
    assert files.newest_version(spark, base).count() == 5
    early = files.newest_version(spark, base)
    files.publish_version(spark, base, 3)
    assert files.newest_version(spark, base).count() == 9 and early.count() == 5
    assert sorted(r.version for r in files.versions(spark, base).collect()) == [1, 2, 3]
