"""What the operators share: whole texts as numpy buffers, words, 64-bit names, stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import shared_dir

#: Words are maximal runs of other characters than these.
WORD_SPACE = "\\x20\\x09-\\x0D"
CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]
_PLAIN_LETTER = np.zeros(256, bool)
_PLAIN_LETTER[65:91] = _PLAIN_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:*#$%&")] = True
BASE = 0x9E3779B97F4A7C15


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        step = np.full(n, b, np.uint64)
        step[:1] = 1
        out.append(np.multiply.accumulate(step))
    return out[0], out[1]


_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def cached_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "at" not in _POWERS or len(_POWERS["at"][0]) < n:
        _POWERS["at"] = powers(max(n, CHUNK_BYTES + 4096))
    return _POWERS["at"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """64-bit names of all spans of a sequence: equal spans have equal names, wherever they start."""

    def __init__(self, values: np.ndarray):
        up, self.down = cached_powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Texts:
    """The UTF-8 bytes of some whole texts (null: empty) in one buffer; text d is data[at[d]:at[d+1]]."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def __len__(self):
        return len(self.at) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and where the words of each text begin (one more entry than texts)."""
        space = _SPACE[self.data]
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        full = np.flatnonzero(np.diff(self.at))
        first[self.at[full]] = ~space[self.at[full]]
        last[self.at[full + 1] - 1] = ~space[self.at[full + 1] - 1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.searchsorted(start, self.at)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like ``words``, but a word also ends where one of .,!?;:*#$%& follows an ASCII letter."""
        start, end, _ = self.words()
        cut = np.flatnonzero(_PLAIN_LETTER[self.data[:-1]] & _MARK[self.data[1:]]) + 1
        if len(cut):  # a text may begin with a mark after another text's last letter: that is no cut of a word
            cut = cut[~np.isin(cut, self.at)]
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        return start, end, np.searchsorted(start, self.at)

    def byte_values(self, fold: bool = False) -> np.ndarray:
        return (_FOLDED if fold else _LETTER)[self.data]


def texts_of(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Rows lo to hi of a string column at a time, of about ``limit`` bytes (one text at least)."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Texts(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
        lo = hi


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text; id and hash together name a row, also if ids repeat or are null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("text_hash"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again: lineage ends there."""
    spark: SparkSession = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def space_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def words_column(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+", -1), lambda w: w != "")
