"""Suffix-array deduplication over bytes by induced sorting.

Anchors (the least of the hashed 48-byte strings in every window of ``length`` bytes, see ``repeats``) deal the corpus
into shards: equal windows have equal anchors, so they meet in one shard. A shard holds the different contexts of its
anchors, one text of each, joined by separators, and sorts their suffixes by induction:

* every suffix is classified as smaller (S) or larger (L) than the one after it; an S after an L is leftmost-smaller;
* one induction pass from unsorted leftmost-smaller suffixes sorts the substrings between them, which get names;
* the string of names, at most half as long, is sorted the same way in spirit: while names repeat, pairs of names at
  doubling distance get new names;
* the sorted leftmost-smaller suffixes induce the order of all L suffixes, and these that of all S suffixes, in one pass
  over the buckets each way. Buckets are handled as vectors, so the work is linear and runs in numpy.

The permuted common prefixes (of each suffix, in text order, with the one before it in the array) then tell which
windows occur twice: a prefix of ``length`` bytes that a neighbour shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Spans, Texts, documents, keyed, mix, texts_of
from tallyspark.llm.repeats import choose, covered, ranges, repeated

#: Bytes that name an anchor.
GRAM = 48
#: Bytes of contexts whose suffixes are sorted at a time, and contexts of one anchor that may sit in a shard together;
#: the windows of anchors with more are spread over all tasks by a hash of their own.
SHARD_BYTES = 1 << 21
SHARD_FACES = 4096


def kernel(length: int):
    gram = min(GRAM, length)

    def anchors(texts: Texts):
        n = len(texts.data)
        spans = Spans(texts.byte_values())
        at = texts.at
        width = length - gram + 1
        if n < length:
            e = np.zeros(0, np.int64)
            return e, e.astype(np.uint64), e.astype(np.uint64), e, e
        place = np.arange(n - gram + 1)
        best = choose(spans.names(place, place + gram), width)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(best)]
        starts = np.flatnonzero(np.arange(len(best)) + length <= at[owner + 1])
        place, first, last, text = ranges(best[starts], starts, owner[starts])
        anchor = spans.names(place, place + gram)
        context = spans.names(first, last + length) + mix((place - first).astype(np.uint64))
        return text, anchor, context, first - at[text], last - at[text]
    return anchors


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last character is the single least."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    up = s[differs] < s[differs + 1]
    small = np.repeat(up, np.diff(np.concatenate([[-1], differs])))
    return np.concatenate([small, np.zeros(n - 1 - len(small), bool), [True]])


def _deal(keys: np.ndarray, values: np.ndarray, head: np.ndarray, out: np.ndarray, down: bool) -> None:
    """Put values, in order, into the next free places of the buckets their keys name."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(first, append=len(k))
    rank = np.arange(len(k)) - np.repeat(first, size)
    if down:
        out[head[k] - 1 - rank] = values[order]
        head[k[first]] -= size
    else:
        out[head[k] + rank] = values[order]
        head[k[first]] += size


def induce(s: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order: L forwards, then S backwards."""
    n = len(s)
    count = np.bincount(s, minlength=letters)
    end = np.cumsum(count)
    begin = end - count
    out = np.full(n, -1, np.int64)
    lms_of = np.searchsorted(s[sorted_lms], np.arange(letters + 1))  # sorted suffixes: first letters ascend
    head = begin.copy()
    used = np.flatnonzero(count)
    for c in used:  # L suffixes: forwards, also those that the bucket itself adds
        done = begin[c]
        while done < head[c]:
            now = out[done:head[c]]
            done = head[c]
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                _deal(s[before], before, head, out, False)
        before = sorted_lms[lms_of[c]:lms_of[c + 1]]
        before = before[before > 0] - 1
        if len(before):
            _deal(s[before], before, head, out, False)
    middle = head
    tail = end.copy()
    for c in used[::-1]:  # S suffixes: backwards
        done = end[c]
        while done > tail[c]:
            now = out[tail[c]:done][::-1]
            done = tail[c]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _deal(s[before], before, tail, out, True)
        now = out[begin[c]:middle[c]][::-1]
        before = now[now > 0] - 1
        before = before[small[before]]
        if len(before):
            _deal(s[before], before, tail, out, True)
    out[0] = n - 1
    return out


def sort_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names: names of pairs at doubling distance, until all differ."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        order = np.argsort(rank, kind="stable")
        r = rank[order]
        rank[order] = np.cumsum(np.concatenate([[0], r[1:] != r[:-1]]))
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        step *= 2


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Induced sorting of a string whose last character is its single least."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return induce(s, small, lms, letters)
    rough = induce(s, small, lms[np.argsort(s[lms], kind="stable")], letters)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    stop = np.concatenate([lms[1:] + 1, [n]])  # a leftmost-smaller substring ends with the start of the next
    size = (stop - lms)[number[order]]
    spans = Spans(mix(s.astype(np.uint64) * np.uint64(2) + small))
    name = spans.names(order, order + size)
    new = np.concatenate([[0], (name[1:] != name[:-1]) | (size[1:] != size[:-1])])
    names = np.zeros(len(lms), np.int64)
    names[number[order]] = np.cumsum(new)
    return induce(s, small, lms[sort_names(names)], letters)


def common_prefixes(s: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """In text order: how many characters, ``most`` at the most, each suffix shares with the one before it in the array."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    out = np.zeros(n, np.int64)
    padded = np.concatenate([s.astype(np.uint8), np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1)).copy().view(np.uint64).ravel()
    alive = np.flatnonzero(before >= 0)
    done = 0
    while len(alive) and done < most:
        a, b = np.minimum(alive + done, n), np.minimum(before[alive] + done, n)
        same = eight[a] == eight[b]
        last = alive[~same]
        x = eight[np.minimum(last + done, n)] ^ eight[np.minimum(before[last] + done, n)]
        low = x & (~x + np.uint64(1))  # the lowest bit that differs tells the first byte that does
        out[last] = done + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        alive = alive[same]
        done += 8
    out[alive] = most
    return np.minimum(out, most)


def twice(texts: list[bytes], length: int) -> np.ndarray:
    """For all bytes of the texts, each followed by a separator: whether a window of ``length`` that starts there occurs twice."""
    joined = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int64) + 2
    at = np.cumsum([len(t) + 1 for t in texts])
    joined[at - 1] = 1
    s = np.concatenate([joined, [0]])
    array = suffix_array(s, 258)
    # a separator reads as the byte 0 here; windows that hold one are left out below
    shared = common_prefixes(np.where(s < 2, 0, s - 2).astype(np.uint8), array, length)
    left = np.repeat(at - 1, np.diff(np.concatenate([[0], at]))) - np.arange(len(joined))
    full = np.concatenate([left >= length, [False]])
    before = np.full(len(s), -1, np.int64)
    before[array[1:]] = array[:-1]
    hit = (shared >= length) & full & full[before]
    out = hit.copy()
    out[before[hit]] = True
    return out[:-1]


def _shards(length: int):
    """resolve step: suffix arrays of shards of contexts."""
    bytes_row = "doc_id long, text_hash long, anchor long, first int, last int, n long, faces long, part binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in texts_of(b.column(2)):
                part = b.column(3).slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(part).to_numpy(False))
                rows = part.flatten()
                first, last = rows.field(1).to_numpy(False), rows.field(2).to_numpy(False)
                whole = texts.data.tobytes()
                i, j = texts.at[owner] + first, texts.at[owner] + last + length
                doc = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(doc), b.column(1).take(doc), *[rows.field(k) for k in range(5)],
                     pa.array([whole[x:y] for x, y in zip(i.tolist(), j.tolist())], pa.binary())],
                    ["doc_id", "text_hash", "anchor", "first", "last", "n", "faces", "part"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            hit = twice([r[7] for r in rows], length)
            out, base = [], 0
            for r in rows:
                if r[5] == 1:
                    out += [(r[0], r[1], r[3] + int(k)) for k in np.flatnonzero(hit[base:base + len(r[7])])]
                base += len(r[7]) + 1
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[2], pa.int32())], ["doc_id", "text_hash", "first", "last"])
        rows, size = [], 0
        for b in batches:  # rows come sorted by shard key; one key stays together
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if size >= SHARD_BYTES and rows[-1][8] != r[8]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[7])
        if rows:
            yield solve(rows)

    def resolve(texts: DataFrame) -> DataFrame:
        rows = texts.mapInArrow(cut, bytes_row)
        # anchors with very many contexts: each window goes by itself to the shard that its own bytes name
        start = F.explode(F.sequence("first", "last"))
        single = rows.where(F.col("faces") > SHARD_FACES).withColumn("at", start).select(
            "doc_id", "text_hash", "anchor", F.col("at").alias("first"), F.col("at").alias("last"), "n", "faces",
            F.expr(f"substring(part, at - first + 1, {length})").alias("part"))
        alike = single.groupBy("part").agg(F.sum("n").alias("n")).where("n > 1").select("part")
        apart = single.where("n = 1").join(alike, "part", "left_semi").select(
            "doc_id", "text_hash", "first", "last")
        few = rows.where(F.col("faces") <= SHARD_FACES).withColumn("key", F.col("anchor"))
        dealt = few.repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(sort, "doc_id long, text_hash long, first int, last int").unionByName(apart)
    return resolve


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Every text without the bytes that a repeated string of ``length`` bytes covers.

    ``docs`` has doc_id and text; other columns are ignored. One row per row of docs: doc_id, n_bytes, n_removed, kept
    (binary: the bytes that stay; empty for a null text) and removed (ranges of removed bytes, first to last). Strings lie
    within one document and are judged on the input; repeated rows count as separate places; texts of fewer bytes lose
    nothing.
    """
    docs = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, windows in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = (text or "").encode()
                if not windows:
                    out.append((len(data), 0, data, []))
                    continue
                gone = covered(len(data), windows, length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                out.append((len(data), int(gone.sum()), np.frombuffer(data, np.uint8)[~gone].tobytes(),
                            [{"first": int(i), "last": int(j) - 1} for i, j in zip(edge[::2], edge[1::2])]))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.binary()),
                 pa.array(cols[3], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                ["doc_id", "n_bytes", "n_removed", "kept", "removed"])
    return repeated(docs, kernel(length), _shards(length), "suffix").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<first: int, last: int>>")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
