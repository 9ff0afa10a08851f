"""Repeated windows over a whole corpus, found from anchors; used by the two substring operators.

A *kernel* reads texts and picks anchors: places chosen by their surroundings alone, at least one in every window of
``length`` units (words or bytes). Every window start belongs to one anchor, so an anchor stands for a range of window
starts, and equal windows belong to anchors of equal name. The steps, all of them joins and aggregations:

1. Names that occur once in the corpus are dropped: none of their windows can repeat.
2. Occurrences of one anchor with the same whole surroundings (its *context*) are counted: two or more, and every
   window in the range repeats.
3. Where an anchor has several contexts, one text of each goes to the operator's own ``resolve`` step, which compares
   single windows.
4. The repeated windows of each document meet its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import long_array, same_document, stored, texts_of

ANCHOR = "doc_id long, text_hash long, anchor long, context long, first int, last int"
#: What a kernel returns for some texts: text number, anchor name, context name, first and last window start.
Kernel = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def choose(priority: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` places the place of the least priority, the leftmost if several have it.

    Of a priority the upper 36 bits count; fewer than 2**28 places at a time.
    """
    n = len(priority)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    least = (priority & ~low) | np.arange(n, dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    return (least & low).astype(np.int64)


def ranges(place: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window starts in ascending order, with their places, as (place, first start, last start, owner) of equal runs."""
    if not len(place):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(owner) != 0)]))
    end = np.concatenate([new[1:], [len(place)]]) - 1
    return place[new], starts[new], starts[end], owner[new]


def _anchors(docs: DataFrame, kernel: Kernel, names_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, texts in texts_of(b.column(b.schema.get_field_index("text"))):
                text, anchor, context, first, last = kernel(texts)
                if names_only:
                    yield pa.RecordBatch.from_arrays([long_array(anchor)], ["anchor"])
                    continue
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("doc_id")).take(rows),
                     b.column(b.schema.get_field_index("text_hash")).take(rows), long_array(anchor),
                     long_array(context), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    ["doc_id", "text_hash", "anchor", "context", "first", "last"])
    return (docs.select("text") if names_only else docs).mapInArrow(run, "anchor long" if names_only else ANCHOR)


def repeated(docs: DataFrame, kernel: Kernel, resolve: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Rows of ``keyed`` documents with ``windows``: ranges (first, last) of starts of windows that also start elsewhere.

    ``resolve`` gets (doc_id, text_hash, text, contexts) with contexts of several-faced anchors as array of
    (anchor, first, last, n, faces) and returns (doc_id, text_hash, first, last) for those windows that repeat.
    """
    # written first, so that both sides of the joins below are plain exchanges, whose hot keys Spark can split
    shared = stored(_anchors(docs, kernel, True).groupBy("anchor").count().where("count > 1").select("anchor"),
                    f"{label}-shared")
    found = stored(_anchors(docs, kernel, False).join(shared, "anchor", "left_semi"), f"{label}-anchors")
    faces = stored(found.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "first", "last")).alias("at")), f"{label}-faces")
    several = stored(faces.groupBy("anchor").agg(F.count("*").alias("faces")).where("faces > 1"), f"{label}-several")
    whole = found.join(faces.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select(
        "doc_id", "text_hash", "first", "last")
    open_ = faces.join(several, "anchor").select("at.*", "anchor", "n", "faces")
    asked = open_.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("anchor", "first", "last", "n", "faces")).alias("contexts"))
    texts = asked.join(docs, same_document(asked, docs)).select(
        asked["doc_id"], asked["text_hash"], docs["text"], asked["contexts"])
    single = resolve(texts)
    flags = whole.unionByName(single).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("first", "last")).alias("windows"))
    return docs.join(flags, same_document(docs, flags), "left").select(
        docs["doc_id"], docs["text"], flags["windows"])


def covered(n: int, windows, length: int) -> np.ndarray:
    """Which of n units some window covers."""
    step = np.zeros(n + 1, np.int64)
    at = np.asarray([(w["first"], w["last"] + length) for w in windows], np.int64)
    np.add.at(step, at[:, 0], 1)
    np.add.at(step, at[:, 1], -1)
    return np.cumsum(step[:-1]) > 0
