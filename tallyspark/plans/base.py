"""Registry of named queries with their SQL counterparts, and helpers to keep results comparable."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def _used(text: str, seen: list[str]) -> list[str]:
    for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
        if word in CTES and word not in seen:
            inner = CTES[word]
            mark = len(seen)
            _used(inner, seen)
            if word not in seen[mark:]:
                seen.append(word)
    return seen


def with_ctes(body: str) -> str:
    """Prefix a statement with the common table expressions it names."""
    names = _used(body, [])
    if not names:
        return body.strip()
    uses = Counter(w for t in [body, *(CTES[n] for n in names)] for w in re.findall(r"[a-z_0-9]+", t))
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if uses[n] > 1 else ''}({CTES[n].strip()})" for n in names)
    body = body.strip()
    return f"WITH {head},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {head}\n{body}"


def flat(df: DataFrame) -> DataFrame:
    """Plain column types: decimals as double, all whole numbers as bigint."""
    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        return c
    return df.select(*[plain(f) for f in df.schema.fields])


def draw(n: int | str, *keys) -> str:
    """SQL of ``core.pick``: a number under n from the md5 of the keys (expressions)."""
    return f"(('0x' || left(md5(concat_ws('|', {', '.join(map(str, keys))})), 12))::BIGINT % ({n}))"


def one_of(options: list, *keys) -> str:
    """SQL of ``core.pick_from`` for texts or numbers."""
    return f"[{', '.join(map(literal, options))}][{draw(len(options), *keys)} + 1]"


def literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name; ``sql`` may use the common table expressions."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, d: flat(fn(spark, d))
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn
    return add
