"""Session defaults and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Recommended settings. Every one is a default a cluster may override; none is needed for right results.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when that costs one more exchange after the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder for written tables and stream checkpoints.

    The cluster names a shared location in ``spark.checkpoint.dir``; where that is unset, folders are made in the
    warehouse, if a place is named for that or there is only this machine. Spark's default warehouse is a folder of the
    driver, which other machines do not see. Callers clear the folders when the results are no longer needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        named = spark.sparkContext.getConf().contains("spark.sql.warehouse.dir")
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir or spark.sql.warehouse.dir")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
