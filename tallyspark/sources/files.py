"""Files and stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def list_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder with size and time, newest first. File contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
        .select(base_name(F.col("path")).alias("file_name"), "path",
                F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_at"))
        .orderBy(F.desc("modified_at"), "file_name")
    )


def documents(spark: SparkSession, path: str, glob: str = "*", name: Callable[[Column], Column] = base_name) -> DataFrame:
    """One row per text file: (file_name, text). Nested folders are read too; ``name`` makes a name of a path."""
    return (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(name(F.col("_metadata.file_path")).alias("file_name"), F.col("value").alias("text"))
    )


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """Files that each hold one JSON array of objects, or one object per line.

    A file with an array is read by one task, a file with lines can be split.
    """
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold JSON arrays of flat objects, read in parallel however large a file is.

    A record ends at its brace, so files are split there by the text reader. Objects in objects, or braces in a
    text, would break a record in two; that raises an error, and ``json_records`` reads such files, each in one task.
    """
    piece = F.regexp_replace("value", r"^[\s,\[\]\x{FEFF}]+", "")
    records = spark.read.option("lineSep", "}").text(path).select(piece.alias("_piece")).where("_piece <> ''")
    read = F.from_json(F.concat("_piece", F.lit("}")), schema, {"mode": "FAILFAST"})
    return records.select(read.alias("_r")).select("_r.*")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working folder in whatever store it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, base: str, version: int, publish: bool = True) -> str:
    """Write a changed table as a new version folder and name it in the manifest.

    The manifest gets its row when all data are written, in one file that its commit renames into place. So
    readers (``newest_version``) never meet a version that is half written, and a version stays readable to
    those who began with it.
    """
    path = f"{base.rstrip('/')}/version={version:06d}"
    df.write.mode("overwrite").parquet(path)
    if publish:
        publish_version(df.sparkSession, base, version)
    return path


def publish_version(spark: SparkSession, base: str, version: int) -> None:
    """Name a completely written version in the manifest: the step after which it is read."""
    row = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("published_at"))
    row.coalesce(1).write.mode("append").json(f"{base.rstrip('/')}/manifest")


def versions(spark: SparkSession, base: str) -> DataFrame:
    """The manifest: (version, published_at)."""
    return spark.read.schema("version long, published_at timestamp").json(f"{base.rstrip('/')}/manifest")


def newest_version(spark: SparkSession, base: str) -> DataFrame:
    """The table as of the newest version that the manifest names, whatever other folders there are."""
    newest = versions(spark, base).agg(F.max("version")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no complete version in {base}")
    return table(spark, f"{base.rstrip('/')}/version={newest:06d}")


def export_csv(df: DataFrame, path: str, single_file: bool = True, order: list[str] | None = None) -> None:
    """CSV with header, replacing an earlier export: one file at ``path``, or a folder of files with ``single_file=False``.

    Rows are formatted, and sorted if ``order`` names columns, by all tasks into parts without a header. For one file
    the file system joins the parts: a store that can concatenate (HDFS) moves no bytes, others copy them in a stream.
    """
    rows = df.orderBy(*order) if order else df
    out = rows.write.option("escape", '"').mode("overwrite")
    if not single_file:
        return out.option("header", True).csv(path)
    spark, work = df.sparkSession, f"{path}.parts"
    out.option("header", False).csv(f"{work}/rows")
    header = F.lit(",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in df.columns))
    spark.range(1).select(header.alias("value")).coalesce(1).write.mode("overwrite").text(f"{work}/header")
    _join_files(spark, [f"{work}/header", f"{work}/rows"], path)
    remove(spark, work)


def _join_files(spark: SparkSession, folders: list[str], path: str) -> None:
    """The files of some folders, in order of their names, as one file; an earlier one is replaced when all is there."""
    fs_path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = fs_path(path).getFileSystem(conf)
    listed = [sorted(s.getPath().toString() for s in fs.listStatus(fs_path(folder))) for folder in folders]
    parts = [fs_path(p) for files in listed for p in files if "/part-" in p]
    whole = fs_path(f"{path}.joined")
    fs.delete(whole, False)
    if fs.hasPathCapability(parts[0], "fs.capability.paths.concat"):
        fs.rename(parts[0], whole)
        rest = spark._sc._gateway.new_array(fs_path, len(parts) - 1)
        for i, part in enumerate(parts[1:]):
            rest[i] = part
        fs.concat(whole, rest)
    else:
        target = fs.create(whole, True)
        for part in parts:
            source = fs.open(part)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, 1 << 20, False)
            source.close()
        target.close()
    fs.delete(fs_path(path), True)
    fs.rename(whole, fs_path(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header as ``export_csv`` writes it, line breaks in quoted values included.

    If every line holds an even number of quotes, no line break lies inside quotes, so lines are records and a file
    of any size is split among tasks. Only files with such a break (or a line of blanks) are read whole, a task each.
    """
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    broken = spark.read.text(path).where(odd | F.col("value").rlike(r"^[\x00-\x20]+$"))
    rows = spark.read.schema(schema).option("header", True).option("escape", '"')
    return rows.option("multiLine", not broken.isEmpty()).csv(path)
