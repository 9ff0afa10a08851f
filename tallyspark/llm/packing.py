"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Pieces of one length are interchangeable, so best-fit decreasing only needs to know how many there are of each: a table
of at most ``capacity`` rows, whatever the input. The plan is made on it: lengths go from long to short, and a segment
tree over remaining capacities finds the tightest open bin. Bins of equal remaining capacity are handled together as a
range of bin numbers. The plan, a few rows per length, then meets the pieces, which are numbered within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import documents, keyed, stored, texts_of
from tallyspark.llm.tokens import encoder

#: Pieces of one length are numbered in this many blocks.
BLOCKS = 256


class OpenBins:
    """A segment tree over remaining capacities: the least one, of at least a given size, of which there are open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _update(self, r: int):
        i = r + self.leaves
        self.tree[i] = bool(self.bins[r])
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def add(self, r: int, first: int, count: int):
        if count and r:
            self.bins[r].append((first, count))
            self._update(r)

    def pop(self, r: int) -> tuple[int, int]:
        out = self.bins[r].pop()
        self._update(r)
        return out

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        if self.tree[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first bin, pieces per bin, offset) for all pieces, ranked within their length."""
    out, bins, opened = [], OpenBins(capacity), 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = bins.tightest(length)
            if r is None:
                r, first, have = capacity, opened, -(-left // (capacity // length))
                opened += have
            else:
                first, have = bins.pop(r)
            each = r // length
            full = min(have, left // each)
            if full:  # bins that take as many of this length as fit, one after another
                out.append((length, rank, full * each, first, each, capacity - r))
                bins.add(r - each * length, first, full)
            elif have:  # the last few
                out.append((length, rank, left, first, left, capacity - r))
                bins.add(r - left * length, first, 1)
                full, each = 1, left
            rank += full * each
            left -= full * each
            if have > full:
                if r == capacity:  # just opened: take back what is not needed yet
                    opened -= have - full
                else:
                    bins.add(r, first + full, have - full)
    return out


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, text_hash, piece, start, length, ids_crc32): every text's ids and ``end_id``, cut at ``capacity``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, texts in texts_of(b.column(1)):
                ids, at = encoder(tokenizer).encode(texts)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                n = -(-np.diff(at) // capacity)
                text = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                end = np.minimum(at[text] + start + capacity, at[text + 1])
                whole = memoryview(ids).cast("B")
                crc = [zlib.crc32(whole[4 * i:4 * j]) for i, j in zip((at[text] + start).tolist(), end.tolist())]
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(2).take(rows), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(end - at[text] - start), pa.array(crc, pa.int64())],
                    ["doc_id", "text_hash", "piece", "start", "length", "ids_crc32"])
    return keyed(docs).mapInArrow(
        run, "doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text; other columns are ignored) with sequence_id and offset.

    A null or empty text is the end id alone. Documents longer than ``capacity`` are cut into pieces of that length, the
    last one shorter. Sequences are filled gapless from offset 0. Ties (pieces of one length) are settled by hash order;
    repeated rows are packed as often as they occur.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, tokenizer, end_id).withColumn(
        "block", F.pmod(F.xxhash64("text_hash", "doc_id", "piece"), F.lit(BLOCKS)).cast("int")), "pieces")
    sizes = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = spark.createDataFrame(best_fit(counts, capacity), "length long, first long, n long, bin long, each long, base long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy("text_hash", "doc_id", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "block"]).withColumn(
        "rank", F.col("rank") + F.col("before")).drop("before", "block")
    at = F.col("rank") - F.col("first")
    return (ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("first"))
                        & (F.col("rank") < F.col("first") + F.col("n")))
            .select("doc_id", "piece", "start", ranked["length"], "ids_crc32",
                    (F.col("bin") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
                    (F.col("base") + at % F.col("each") * ranked["length"]).alias("offset")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
