"""Substring deduplication over words by recompression.

Locally consistent parsing: rounds give one name to every run of equal symbols, then to every pair of neighbours whose
classes (a bit of the symbol's name) are left and right. A name is a 64-bit hash of what it stands for, so all tasks
agree on it without exchanging a table. Only symbols of a bounded number of words take part in a round (restricted
recompression), so whether a boundary between symbols survives depends on a bounded number of words around it, and equal
word sequences get the same symbols except near their ends.

The rounds put a height on every boundary: how long it survives. In each window the highest boundary, with the names of
the words beside it breaking ties, is the window's anchor; equal windows have equal anchors. Spark counts the anchor
names over the corpus; names that occur twice reveal candidates, whose contexts and then single windows are compared by
name and counted (see ``repeats``). Window names are compared within one anchor, so two 64-bit names have to agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Spans, Texts, documents, keyed, long_array, mix, stored, texts_of
from tallyspark.llm.repeats import choose, covered, ranges, repeated

#: Longest symbol, in words, that takes part in each round.
ROUNDS = (1, 1, 2)
#: Words on either side of a boundary that its fate depends on: two steps a round.
REACH = 2 * sum(ROUNDS)


def word_names(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A name for every word, and where the words of each text begin."""
    start, end, at = texts.words()
    return Spans(texts.byte_values()).names(start, end), at


def recompress(names: np.ndarray, at: np.ndarray, rounds=ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all rounds as (name, first word), and the height of the boundary before every word.

    The height is the number of the step that removed the boundary, or one more than all steps if it stays.
    """
    n = len(names)
    height = np.full(n, 2 * len(rounds) + 1, np.int64)
    symbol, start = names.copy(), np.arange(n)
    fixed = np.zeros(n + 1, bool)
    fixed[at] = True
    for r, longest in enumerate(rounds):
        for pairs in (False, True):
            if len(symbol) < 2:
                break
            span = np.diff(start, append=n)
            short = span <= longest
            join = short[1:] & short[:-1] & ~fixed[start[1:]]
            if pairs:
                side = (mix(symbol + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
                join &= ~side[:-1] & side[1:]
            else:
                join &= symbol[1:] == symbol[:-1]
            height[start[1:][join]] = 2 * r + 1 + pairs
            head = np.concatenate([[True], ~join])
            first = np.flatnonzero(head)
            size = np.diff(first, append=len(symbol))
            name = symbol[first]
            many = size > 1
            if pairs:
                name[many] = mix(name[many] * np.uint64(3) + symbol[first[many] + 1])
            else:
                name[many] = mix(name[many] + size[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            symbol, start = name, start[first]
    return np.stack([symbol, start.astype(np.uint64)]), height


def kernel(length: int):
    reach = REACH
    if length < 2 * reach + 1:
        raise ValueError(f"windows of {2 * reach + 1} words at least")

    def anchors(texts: Texts):
        names, at = word_names(texts)
        n = len(names)
        _, height = recompress(names, at)
        spans = Spans(names)
        place = np.arange(reach, max(reach, n - reach + 1))
        around = spans.names(place - reach, place + reach)
        # high boundaries first, then by the names around them; boundaries in other texts never win
        steps = np.uint64(2 * len(ROUNDS) + 1)
        h = np.concatenate([height, [0]])[place].astype(np.uint64)
        priority = ((steps - h) << np.uint64(60)) | (around >> np.uint64(4))
        width = length - 2 * reach + 1
        best = choose(priority, width) + reach
        owner = np.searchsorted(at, np.arange(len(best)), "right") - 1
        inside = np.arange(len(best)) + length <= at[owner + 1] if len(best) else np.zeros(0, bool)
        starts = np.flatnonzero(inside)
        place, first, last, text = ranges(best[starts], starts, owner[starts])
        anchor = spans.names(place - reach, place + reach)
        context = spans.names(first, last + length) + mix((place - first).astype(np.uint64))
        base = at[text]
        return text, anchor, context, first - base, last - base
    return anchors


def _windows(length: int):
    """resolve step: names of single windows, counted within their anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in texts_of(b.column(2)):
                names, at = word_names(texts)
                spans = Spans(names)
                part = b.column(3).slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(part).to_numpy(False))
                rows = part.flatten()
                anchor, first, last, n = (rows.field(k).to_numpy(False) for k in range(4))
                size = last - first + 1
                row = np.repeat(np.arange(len(size)), size)
                start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                at_word = at[owner[row]] + start
                doc = pa.array(owner[row] + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(doc), b.column(1).take(doc), long_array(anchor[row]),
                     long_array(spans.names(at_word, at_word + length)), pa.array(start.astype(np.int32)),
                     long_array(n[row])], ["doc_id", "text_hash", "anchor", "window", "start", "n"])

    def resolve(texts: DataFrame) -> DataFrame:
        rows = stored(texts.mapInArrow(
            run, "doc_id long, text_hash long, anchor long, window long, start int, n long"), "windows")
        twice = rows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "window")
        return rows.where("n = 1").join(twice, ["anchor", "window"], "left_semi").select(
            "doc_id", "text_hash", F.col("start").alias("first"), F.col("start").alias("last"))
    return resolve


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """Every text without the words that a repeated window of ``length`` words covers.

    ``docs`` has doc_id and text; other columns are ignored. One row per row of docs: doc_id, n_words, n_removed,
    kept (the words that stay, joined by one space; empty for a null text), and removed, the ranges of removed words as
    (first, last). Windows lie within one document and are judged on the input: the second of two copies goes, and so
    does the first. Repeated rows count as separate places, so all of a row that occurs twice goes if it has ``length``
    words. Documents with fewer words lose nothing.
    """
    docs = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, windows in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = (text or "").encode().split()
                if not windows:
                    out.append((len(words), 0, b" ".join(words).decode(), []))
                    continue
                gone = covered(len(words), windows, length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((len(words), int(gone.sum()), kept.decode(),
                            [{"first": int(i), "last": int(j) - 1} for i, j in zip(edge[::2], edge[1::2])]))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                ["doc_id", "n_words", "n_removed", "kept", "removed"])
    found = repeated(docs, kernel(length), _windows(length), "substring")
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, "
                                 "removed array<struct<first: int, last: int>>")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
