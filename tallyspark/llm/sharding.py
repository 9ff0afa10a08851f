"""Minimax contiguous partition of atomic groups into shards.

Groups (rows of equal text) stand in the order of a 64-bit hash; a shard is a range of hashes. The smallest capacity that
lets ``n`` ranges hold everything is found by binary search with a greedy check. The driver never sees the groups: it
works on a list of segments of the hash range with their sums, at most some 100,000 rows. A check that treats segments
as whole gives a capacity that is feasible, one that may cut inside them gives a lower bound; segments in which a cut can
fall for any capacity in between are split further and summed again by Spark, until both agree. Groups larger than a
segment should be stand alone from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import documents, stored

SEGMENTS = 1 << 14
SPLIT = 64
#: Rows of one shard are numbered in this many blocks.
BLOCKS = 256


def _sums(groups: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per segment [bounds[i], bounds[i + 1]): size, groups; at most len(bounds) rows come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, count = np.zeros(len(bounds), np.int64), np.zeros(len(bounds), np.int64)
        for b in batches:
            seg = np.searchsorted(bounds, b.column(0).to_numpy(), "right") - 1
            np.add.at(size, seg, b.column(1).to_numpy())
            np.add.at(count, seg, 1)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, size[used], count[used])], ["seg", "size", "n"])
    rows = groups.select("position", "size").mapInArrow(run, "seg long, size long, n long").groupBy("seg").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, count = np.zeros(len(bounds), np.int64), np.zeros(len(bounds), np.int64)
    for r in rows:
        size[r["seg"]], count[r["seg"]] = r["size"], r["n"]
    return size, count


def greedy(sums: np.ndarray, whole: np.ndarray, shards: int, capacity: int, inside: bool) -> list[int] | None:
    """Ends of the shards but the last, as sums of sizes, each shard filled as far as it goes; None if it takes more.

    With ``inside`` a shard may end anywhere in a segment of several groups, otherwise only between segments.
    """
    ends, at, total = [], 0, int(sums[-1])
    while total - at > capacity:
        x = at + capacity
        i = int(np.searchsorted(sums, x, "right")) - 1
        if sums[i] < x and (not inside or whole[i]):
            x = int(sums[i])
        if x <= at or len(ends) == shards - 1:
            return None
        ends.append(x)
        at = x
    return ends


def smallest(sums: np.ndarray, whole: np.ndarray, shards: int, inside: bool, low: int) -> int:
    high = int(sums[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(sums, whole, shards, mid, inside) is None:
            low = mid + 1
        else:
            high = mid
    return low


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """First positions of the shards but the first; ``groups`` has distinct positions (long) and sizes (above 0)."""
    total = groups.agg(F.sum("size")).first()[0]
    if not total:
        return []
    heavy = np.array([r[0] for r in groups.where(F.col("size") > total / SEGMENTS).select("position").collect()], np.int64)
    even = np.arange(SEGMENTS).astype(np.float64) * (2.0**64 / SEGMENTS) - 2.0**63
    top = np.iinfo(np.int64).max
    bounds = np.unique(np.concatenate([even.astype(np.int64), heavy, heavy[heavy < top] + 1]))
    while True:
        size, count = _sums(groups, bounds)
        sums = np.concatenate([[0], np.cumsum(size)])
        whole = count <= 1
        low = smallest(sums, whole, shards, True, max(1, int(size[whole].max(initial=0)), -(-int(total) // shards)))
        high = smallest(sums, whole, shards, False, low)
        if low == high:
            break
        early, late = greedy(sums, whole, shards, high, False), greedy(sums, whole, shards, high, True)
        split = np.zeros(len(bounds), bool)
        for j, x in enumerate(late):  # where a cut can fall for capacities from low to high
            least = min([x - (j + 1) * (high - low), *early[j:j + 1]])
            lo = int(np.searchsorted(sums, least, "right")) - 1
            split[max(0, lo - 1):int(np.searchsorted(sums, x, "right"))] = True
        split &= ~whole
        if not split.any():
            split = ~whole
        nxt = np.append(bounds[1:], top)
        fine = [bounds]
        for i in np.flatnonzero(split):
            width = int(nxt[i]) - int(bounds[i])
            fine.append(np.array([int(bounds[i]) + width * k // SPLIT for k in range(1, SPLIT)], dtype=object).astype(np.int64))
        bounds = np.unique(np.concatenate(fine))
    # the least capacity is known; inside it, cut as near to equal shares as both greedy directions allow
    back, at = [], int(total)
    for _ in range(shards - 1):
        at = int(sums[np.searchsorted(sums, max(0, at - high), "left")])
        back.append(at)
    back = back[::-1]
    out, at = [], 0
    for j in range(shards - 1):
        hi = int(np.searchsorted(sums, at + high, "right")) - 1
        lo = int(np.searchsorted(sums, max(at, back[j]), "left"))
        want = int(np.searchsorted(sums, total * (j + 1) / shards, "left"))
        i = min(max(want, lo), hi)
        at = int(sums[i])
        # segments without groups share a sum: the first bound of that sum is the cut
        out.append(int(bounds[i]) if i < len(bounds) else top)
    return out


def shard(docs: DataFrame, shards: int = 40, extra: int = 16) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are ignored) with its size, shard and slot.

    size: UTF-8 bytes of the text (null: none) plus ``extra``. Rows of equal text, null texts among them, are one group
    and share a shard; the largest shard is as small as ranges of groups in hash order allow. slot numbers the rows of a
    shard from 0 without gaps. Shards may stay empty if there are fewer groups. Also text_crc32, unsigned.
    """
    text = F.col("text").cast("string")
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + extra).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("position")), "sizes")
    groups = stored(rows.groupBy("position").agg(F.sum("size").alias("size")), "groups")
    first = cuts(groups, shards)
    number = F.lit(0)
    for x in first:
        number = number + (F.col("position") >= F.lit(x)).cast("int")
    rows = rows.withColumn("shard", number.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("position", "doc_id"), F.lit(BLOCKS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "block").orderBy("position", "doc_id")
    return rows.withColumn("slot", F.row_number().over(inside) - 1).join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
