"""Stored tables in hash buckets of their key: a change rewrites the buckets it touches, not the table.

A table is a folder with a partition per bucket. A change set names its buckets; only these are read
(partition pruning), changed, and replaced (dynamic partition overwrite). Everything a change does is first
written to a folder of its own, so a lost executor repeats tasks and a failed job leaves the table as it was;
readers that must not see buckets of two changes side by side read versions instead (``sources.files``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import files
from . import tables


@dataclass(frozen=True)
class BucketedTable:
    """Rows with equal ``key`` share one of ``buckets`` folders; the number stays as it was first written."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = 256

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int"))

    def write(self, df: DataFrame) -> None:
        """Replace the whole table."""
        self._dealt(df).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows().drop("bucket")

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets of a change set: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in self._dealt(changes.select(self.key)).select("bucket").distinct().collect())

    def upsert(self, new: DataFrame, id_col: str | None = None, keep: tuple[str, ...] = (),
               newest: str | None = None) -> list[int]:
        """``tables.upsert`` into the stored table; returns the buckets that were rewritten.

        Free ids follow the highest of the whole table, for which only that column is read.
        """
        def change(old: DataFrame, changes: DataFrame) -> DataFrame:
            start = self.rows().agg(F.max(id_col)) if id_col else None
            return tables.upsert(old, changes, self.key, id_col, keep, newest, start)

        return self._apply(new, change)

    def replace_children(self, new: DataFrame) -> list[int]:
        """All rows of the keys in ``new`` are replaced; returns the buckets that were rewritten."""
        return self._apply(new, lambda old, changes: tables.replace_children(old, changes, self.key))

    def _apply(self, new: DataFrame, change) -> list[int]:
        work = shared_dir(self.spark, "change")
        new.write.parquet(f"{work}/new")
        changes = self.spark.read.schema(new.schema).parquet(f"{work}/new")
        hit = self.touched(changes)
        if hit:
            old = self.rows().where(F.col("bucket").isin(hit)).drop("bucket")
            self._dealt(change(old, changes)).write.parquet(f"{work}/rows")
            self.spark.read.parquet(f"{work}/rows").repartition("bucket").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        files.remove(self.spark, work)
        return hit
