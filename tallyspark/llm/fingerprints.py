"""Winnowing: fingerprints of documents with a match guarantee.

Every run of ``K`` bytes is hashed (a polynomial hash that is rolled along the text, then mixed); of each ``WINDOW`` consecutive
hashes the smallest is kept, of equal ones the rightmost, with its position. So two texts that share a run of ``K + WINDOW - 1``
bytes share a fingerprint inside it, and two equal texts have equal fingerprints. A text of fewer than ``WINDOW`` hashes keeps
the smallest of all, one shorter than ``K`` bytes the hash of all of it, an empty one (or null) nothing.

To meet its next document, a document is sent once, to a bucket of the order of doc_id; each bucket is sorted and read as a
stream, two neighbours at a time, and ends with a copy of the first document of the next bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import CHUNK_BYTES, Spans, Texts, documents, long_array, texts_of

K = 32
WINDOW = 64
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)
_HEX = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), np.uint32)


def winnow(texts: Texts, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, position in it and 32-bit hash of every fingerprint, by text and position."""
    at, size = texts.at, len(texts.data)
    length = np.diff(at)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    names = Spans(texts.byte_values())
    start = np.arange(size)
    # a hash above, the position counted down below: the smallest number is the smallest hash, of equal ones the rightmost
    value = names.names(start, np.minimum(start + k, size)) & ~_LOW
    short = np.flatnonzero((length > 0) & (length < k))
    value[at[short]] = names.names(at[short], at[short + 1]) & ~_LOW
    value |= _LOW - start.astype(np.uint64)
    grams = np.where(length < k, length > 0, length - k + 1)
    keep = np.zeros(size, bool)
    full = np.flatnonzero(grams >= window)
    if len(full):
        least, span = value, 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[:span - window], least[window - span:])
        begins = np.zeros(len(least) + 1, np.int32)  # the windows that lie inside one text
        np.add.at(begins, at[full], 1)
        np.add.at(begins, at[full] + grams[full] - window + 1, -1)
        chosen = least[np.cumsum(begins[:-1]) > 0]
        keep[(_LOW - (chosen & _LOW)).astype(np.int64)] = True
    few = np.flatnonzero((grams > 0) & (grams < window))
    if len(few):
        ends = np.stack([at[few], at[few] + grams[few]], 1).ravel()
        least = np.minimum.reduceat(np.append(value, ~np.uint64(0)), ends)[::2]
        keep[(_LOW - (least & _LOW)).astype(np.int64)] = True
    place = np.flatnonzero(keep)
    text = np.searchsorted(at, place, "right") - 1
    return text, place - at[text], value[place] >> _HIGH


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, and hashes and their byte positions in the text as two arrays, for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in texts_of(b.column(1)):
                text, place, value = winnow(texts, k, window)
                ends = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, long_array(value)),
                     pa.ListArray.from_arrays(ends, long_array(place))], ["doc_id", "hashes", "positions"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def hex_strings(text: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    """The hashes of each of n texts as eight hexadecimal digits, joined by commas."""
    out = np.empty((len(value), 9), np.uint8)
    for i, shift in ((0, 16), (4, 0)):
        part = _HEX[(value >> np.uint64(shift)).astype(np.int64) & 0xFFFF]
        out[:, i:i + 4] = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 4)
    out[:, 8] = ord(",")
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    keep = np.ones(out.shape, bool)
    keep[last, 8] = False
    ends = np.searchsorted(text, np.arange(n + 1))
    ends = ends * 9 - np.minimum(np.concatenate([[0], np.cumsum(last)])[ends], ends)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[keep]))


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard index of the hash sets of text i in a and in b (sorted distinct numbers: text above, hash below); 1 if both are empty."""
    both = np.bincount((np.intersect1d(a, b, assume_unique=True) >> _HIGH).astype(np.int64), minlength=n)
    size = [np.bincount((x >> _HIGH).astype(np.int64), minlength=n) for x in (a, b)]
    union = size[0] + size[1] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def edited(texts: Texts) -> tuple[Texts, np.ndarray]:
    """Every text but the last with its last quarter (in code points) replaced by the first as many of the next; lengths."""
    begins = np.flatnonzero((texts.data & 0xC0) != 0x80)
    first = np.searchsorted(begins, texts.at)
    n_chars = np.diff(first)
    quarter = n_chars[:-1] // 4
    begins = np.append(begins, len(texts.data))
    cut = begins[first[:-2] + n_chars[:-1] - quarter]
    take = begins[first[1:-1] + np.minimum(quarter, n_chars[1:])]
    parts, size = [], np.zeros(len(cut) + 1, np.int64)
    for i in range(len(cut)):
        parts += [texts.data[texts.at[i]:cut[i]], texts.data[texts.at[i + 1]:take[i]]]
        size[i + 1] = len(parts[-2]) + len(parts[-1])
    return Texts(np.concatenate(parts), np.cumsum(size)), n_chars[:-1]


def _pairs(texts: Texts, k: int, window: int) -> list[pa.Array]:
    """Columns for every text but the last, beside its edited text and the text after it."""
    n = len(texts) - 1
    changed, n_chars = edited(texts)
    text, _, value = winnow(texts, k, window)
    own = text < n
    e_text, _, e_value = winnow(changed, k, window)
    sets = [np.unique(t.astype(np.uint64) << _HIGH | v) for t, v in
            ((text[own], value[own]), (e_text, e_value), (text[text > 0] - 1, value[text > 0]))]
    sha = [hashlib.sha256(changed.data[a:b].tobytes()).hexdigest() for a, b in zip(changed.at[:-1], changed.at[1:])]
    return [long_array(n_chars), pa.array(sha, pa.large_string()), hex_strings(text[own], value[own], n), hex_strings(e_text, e_value, n),
            pa.array(likeness(sets[0], sets[1], n)), pa.array(likeness(sets[0], sets[2], n))]


def _neighbours(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Rows lo to hi, hi included, of about ``limit`` bytes, each beginning with the last of the one before."""
    size = np.concatenate([[0], np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False))])
    lo, n = 0, len(column)
    while lo < n - 1:
        hi = min(n - 1, max(lo + 1, int(np.searchsorted(size, size[lo] + limit, "right")) - 1))
        yield lo, hi, next(texts_of(column.slice(lo, hi - lo + 1), 1 << 62))[2]
        lo = hi


def _buckets(rows: DataFrame, n: int) -> Column:
    """Number (0 to n - 1) of a range of (at, text_hash) with about equally many rows; an id of many rows gets several."""
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = np.array(cuts or [], np.int64)

    @F.pandas_udf("int")
    def bucket(at: pd.Series, text_hash: pd.Series) -> pd.Series:
        x, share = at.to_numpy(), text_hash.to_numpy() / 2.0**64 + 0.5
        lo, hi = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
        return pd.Series(np.where(hi > lo, lo + 1 + np.minimum((share * (hi - lo)).astype(np.int64), hi - lo - 1), lo).astype(np.int32))

    return bucket("at", "text_hash")


def with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprint of every document, of its edited text, and the likeness to that and to the next document.

    The next document is the one after it by doc_id (null first, equal ids by a hash of the text), after the last the first;
    the edited text has its last quarter of code points replaced by the first as many of the next document. A null text counts
    as empty; one document alone is its own next. Rows of equal id and text stay rows, each the next of the one before.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    rows = rows.withColumn("bucket", _buckets(rows, n))
    # one row per bucket comes to the driver and goes out again: at most n
    heads = rows.groupBy("bucket").agg(F.min(F.struct("at", "text_hash")).alias("key")).select("bucket", "key.*").orderBy("bucket").collect()
    before = [(heads[i - 1]["bucket"], h["at"], h["text_hash"]) for i, h in enumerate(heads)]
    marks = F.broadcast(spark.createDataFrame(before, "mark int, at long, text_hash long"))
    first = rows.join(marks, ["at", "text_hash"]).dropDuplicates(["at", "text_hash"])
    flow = rows.withColumn("is_end", F.lit(0)).unionByName(
        first.select("doc_id", "text", "text_hash", "at", F.col("mark").alias("bucket"), F.lit(1).alias("is_end")))
    flow = flow.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "is_end", "at", "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            table = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks()
            ids, texts, is_end = (table.column(i).combine_chunks() for i in range(3))
            is_end = is_end.to_numpy()
            for lo, hi, some in _neighbours(texts):
                own = pa.array(is_end[lo:hi] == 0)
                out = [ids.slice(lo, hi - lo), *_pairs(some, k, window)]
                yield pa.RecordBatch.from_arrays([c.filter(own).cast(t) for c, t in zip(out, types)], list(names))
            kept = b.slice(b.num_rows - 1) if b.num_rows else kept

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return flow.select("doc_id", "text", "is_end").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))
