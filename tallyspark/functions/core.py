"""Column helpers shared by all operators. Everything stays in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .values import AGING_BOUNDS, AGING_OPEN_END, DATE_PATTERNS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside higher-order functions Spark does not share common subexpressions, so an expression that is
    used several times there would be evaluated several times, and nested uses multiply. The fold over no elements
    starts and ends with the value, and ``body`` is its last step. An element of ``transform(array(value), body)`` would be
    the same, but reading it works out the type of the whole body again for every row, and once more per level of nesting.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def built_once(make: Callable[[], Column]) -> Callable[[], Column]:
    """A column without arguments, built once per Spark application.

    Columns never change and name their inputs, so one can serve many plans. Building a large one takes thousands of
    calls to the JVM: seconds that a stream would spend in every micro-batch.
    """
    kept: dict[str, Column] = {}

    @wraps(make)
    def get() -> Column:
        app = SparkSession.active().sparkContext.applicationId
        if app not in kept:
            kept.clear()
            kept[app] = make()
        return kept[app]

    return get


# --- safe casts -----------------------------------------------------------------------------

def to_amount(c: Column, precision: int = 12, scale: int = 2) -> Column:
    """Text or number to decimal; NULL where it does not fit."""
    return c.try_cast(f"decimal({precision},{scale})")


def clean_amount(c: Column, precision: int = 12, scale: int = 2) -> Column:
    """Keep digits and dots only, then cast. The minus sign is lost, as for all physical columns."""
    return to_amount(F.regexp_replace(c, r"[^0-9.]", ""), precision, scale)


def to_iso_date(c: Column) -> Column:
    """ISO text to date; NULL for anything else (a bare year is not a date)."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d"))


def to_any_date(c: Column) -> Column:
    """The first of the known date forms that fits; NULL if none does.

    A failed parse is slow (an exception inside), so a form is tried only on texts of its shape.
    """
    def first_fit(text: Column) -> Column:
        return F.coalesce(*[F.when(text.rlike(shape), F.try_to_date(text, form)) for form, shape in DATE_PATTERNS])

    return let(F.regexp_replace(c, r"\s+", " "), first_fit)


def trimmed(c: Column) -> Column:
    """``trim(c)`` of a bound text. Only a text with a blank at an end is trimmed: outside generated code a trim takes
    longer than most of what is done to a short text."""
    return F.when(c.startswith(" ") | c.endswith(" "), F.trim(c)).otherwise(c)


def blank(c: Column) -> Column:
    """``trim(c) == ""`` of a bound text, likewise; NULL for NULL."""
    return F.when(c.startswith(" "), F.trim(c) == "").otherwise(c == "")


# --- numbers ----------------------------------------------------------------------------------

def mean_of(c: Column | str, digits: int = 6) -> Column:
    """Average of an exact sum, rounded, as double: the same in every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.try_divide(F.sum(c).cast("double"), F.count(c)), digits)


def rate(part: Column, whole: Column, digits: int) -> Column:
    """part / whole rounded as exact decimals; NULL where whole is not positive."""
    exact = part.cast("decimal(28,9)") / whole.cast("decimal(20,0)")
    return F.when(whole > 0, F.round(exact, digits).cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both; NULL for constant input instead of an error."""
    x = F.when(y.isNotNull(), x.cast("double"))
    y = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def plain_number(c: Column) -> Column:
    """A double as text with at least one decimal and never an exponent: ``5.0``, ``10000000.0``."""
    digits = c.cast("string").try_cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", ".0")


def money_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def long_date(c: Column) -> Column:
    return F.date_format(c, "MMMM dd, yyyy")


# --- dates and aging ----------------------------------------------------------------------------

def days_past(due: Column, as_of: Column) -> Column:
    return F.datediff(as_of, due)


def aging_bucket(days: Column) -> Column:
    """Bucket name for days past due. NULL days fall through to the open end."""
    expr = F.lit(AGING_OPEN_END)
    for last_day, name in reversed(AGING_BOUNDS):
        expr = F.when(days <= last_day, F.lit(name)).otherwise(expr)
    return expr


def bucket_order(bucket: Column, extra: str, extra_order: int, first: int = 1) -> Column:
    """Display position of an aging bucket; ``extra`` is the bucket outside the day ranges."""
    names = [name for _, name in AGING_BOUNDS] + [AGING_OPEN_END]
    pairs = [(name, first + i) for i, name in enumerate(names)] + [(extra, extra_order)]
    return lookup(dict(pairs), bucket).cast("int")


def since(ts: Column, as_of: Column, amount: int, unit: str = "DAYS") -> Column:
    """ts lies within the last ``amount`` units before as_of."""
    return ts >= as_of - F.expr(f"INTERVAL {amount} {unit}")


def lookup(pairs: dict, key: Column) -> Column:
    """A small fixed dictionary as an expression; NULL for unknown keys."""
    flat = [F.lit(v) for kv in pairs.items() for v in kv]
    return F.try_element_at(F.create_map(*flat), key)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# --- JSON -----------------------------------------------------------------------------------------

def json_map(c: Column) -> Column:
    """Top level of a JSON object as map of text; nested values stay JSON text; NULL if invalid."""
    return F.from_json(c, "map<string,string>")


def json_number_text(c: Column, path: str) -> Column:
    """A JSON number or text as plain digits (no exponent for large fractions)."""
    return F.try_variant_get(F.try_parse_json(c), path, "string")


# --- reproducible picks ---------------------------------------------------------------------------

def key_text(*keys) -> Column:
    """Keys as one text, joined by ``|``."""
    return F.concat_ws("|", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys])


def pick(n: int | Column, *keys) -> Column:
    """0 .. n-1, the same for the same keys on any cluster and in any engine: 48 bits of their md5, modulo n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(F.md5(key_text(*keys)), 1, 12), 16, 10).cast("long"), n.cast("long"))


def pick_between(lo: int, hi: int, *keys) -> Column:
    return pick(hi - lo + 1, *keys) + F.lit(lo)


def pick_from(options: list, *keys) -> Column:
    """One of a fixed list, with lists of equal length allowed as options."""
    arr = F.array(*[F.array(*map(F.lit, o)) if isinstance(o, (list, tuple)) else F.lit(o) for o in options])
    return F.get(arr, pick(len(options), *keys).cast("int"))


def pick_amount(lo: str, hi: str, *keys) -> Column:
    """A decimal(12,2) between two bounds, in steps of a cent."""
    lo_c, hi_c = round(float(lo) * 100), round(float(hi) * 100)
    return ((pick(hi_c - lo_c + 1, *keys) + F.lit(lo_c)) / 100).cast("decimal(12,2)")


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few fixed rows as a frame whose size Spark knows, so that joins to it are planned well."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields)]
    return spark.createDataFrame(pa.table(dict(zip(schema.names, arrays))), schema)


# --- rows -------------------------------------------------------------------------------------------

def latest_per(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """The newest row per key.

    ``row_number() = 1`` lets Spark drop all but one row per key and task before the exchange
    (WindowGroupLimit), so a key that holds a large share of the rows stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row frames side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = [c for f in frames for c in f.columns]
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def id_bucket(key: Column, digits: int = 3) -> Column:
    """A bucket every engine computes alike: the first hexadecimal digits of the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, digits), 16, 10).cast("int")


def number_rows(df: DataFrame, key: str, out: str, start: DataFrame | None = None, digits: int = 3) -> DataFrame:
    """Dense unique ids 1..n for rows with a unique ``key``, in (md5 bucket, key) order.

    A global ``row_number`` would run in one task. Here rows are numbered inside 16 ** ``digits`` hash
    buckets (4,096; each is sorted by one task, so take more for tables of billions of rows) and shifted by
    the sizes of the buckets before, a table of as many rows. ``start`` is a one-row frame whose single column
    is the highest id in use.
    """
    bucketed = df.withColumn("_b", id_bucket(F.col(key), digits))
    sizes = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if start is not None:
        offsets = offsets.withColumn("_off", F.col("_off") + F.coalesce(start.scalar(), F.lit(0)))
    within = Window.partitionBy("_b").orderBy(key)
    return (
        bucketed.join(offsets, "_b")
        .withColumn(out, (F.col("_off") + F.row_number().over(within)).cast("long"))
        .drop("_b", "_off")
    )
