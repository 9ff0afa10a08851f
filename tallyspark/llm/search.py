"""Ranked lexical search by presence masks.

Documents are reduced to their length and the counts of the terms that any item of a block of items holds, once and stored; the
statistics of all documents come from there. A task then takes some thousand documents at a time and makes one bitmap per term.
For an item, the bitmaps of its terms turned by a transposition give every document a mask of the terms it matches; documents
with one mask form a group, whose score is at most the sum of its terms' greatest parts. Groups are evaluated exactly by
descending maximum until no group left can reach the tenth score found so far, in this block or before. The best of every task
are ranked at the end.

Items are taken in blocks of about ``TERMS`` pairs of item and term, so what a task holds of them is bounded by that number or by
the longest item; all documents are read once per block of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Texts, documents, stored, texts_of

#: Terms are the longest runs of digits, ASCII letters and code points from U+0080 on.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
TERMS = 50_000
STEP = 64

_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def terms(texts: Texts) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, and where those of each text begin (one more entry than texts)."""
    inside = _IN_TERM[texts.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(texts.at))
    first[texts.at[full]] = inside[texts.at[full]]
    last[texts.at[full + 1] - 1] = inside[texts.at[full + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(_FOLD[texts.data[inside]]))
    return found, np.searchsorted(start, texts.at)


def matches(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (all terms of the text) and, for the terms of the vocabulary, their numbers and counts; documents with a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(vocabulary, pa.large_string()), len(vocabulary)
        for b in batches:
            for lo, hi, texts in texts_of(b.column(1)):
                found, at = terms(texts)
                number = pc.index_in(found, known)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))[number.is_valid().to_numpy(zero_copy_only=False)]
                pair, tf = np.unique(doc * size + number.drop_null().to_numpy(), return_counts=True)
                n = np.diff(at)
                ends = np.searchsorted(pair, np.arange(hi - lo + 1) * size).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array((pair % max(size, 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64)))],
                    ["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Best:
    """The k best (score, doc_id) so far; equal scores by doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        some = score > 0
        score, doc, null = (np.concatenate(x) for x in zip((self.score, self.doc, self.null), (score[some], doc[some], null[some])))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]

    def least(self) -> int:
        """What a score has to reach to get in, alone or by its doc_id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


class Postings:
    """Some documents by term: which hold it, its part of their scores, its greatest part, and a bitmap."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.doc, self.part, self.n = doc[order], part[order], n_docs
        self.at = np.searchsorted(term[order], np.arange(n_terms + 1))
        held = np.flatnonzero(np.diff(self.at))
        self.most = np.zeros(n_terms, np.int64)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.part, self.at[held])
        self.row = np.zeros(n_terms, np.int64)
        self.row[held] = np.arange(len(held))
        flags = np.zeros((len(held), -(-n_docs // 8)), np.uint8)
        np.bitwise_or.at(flags, (self.row[term[order]], self.doc >> 3), (128 >> (self.doc & 7)).astype(np.uint8))
        self.bitmaps = flags

    def masks(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct masks over the wanted terms (a row of 0 and 1 each), and the number of every document's mask."""
        flags = np.unpackbits(self.bitmaps[self.row[wanted]], axis=1, count=self.n)
        packed = np.packbits(flags, axis=0).T
        wide = np.zeros((self.n, -(-packed.shape[1] // 8) * 8), np.uint8)
        wide[:, :packed.shape[1]] = packed
        kind = np.uint64 if wide.shape[1] == 8 else np.dtype((np.void, wide.shape[1]))
        _, first, group = np.unique(wide.view(kind)[:, 0], return_index=True, return_inverse=True)
        return np.unpackbits(packed[first], axis=1, count=len(wanted)), group.reshape(-1)

    def scores(self, docs: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t, w in zip(wanted, weight):
            lo, hi = self.at[t], self.at[t + 1]
            i = np.minimum(np.searchsorted(self.doc[lo:hi], docs), hi - lo - 1)
            out += np.where(self.doc[lo:hi][i] == docs, self.part[lo:hi][i] * w, 0)
        return out


def evaluate(postings: Postings, wanted: np.ndarray, weight: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> int:
    """Add one item's best documents; returns how many documents were scored. weight: times the term's weight."""
    some = (weight > 0) & (postings.most[wanted] > 0)
    wanted, weight = wanted[some], weight[some]
    if not len(wanted):
        return 0
    masks, group = postings.masks(wanted)
    most = (masks.astype(np.int64) @ (weight * postings.most[wanted]))[group]
    order = np.argsort(-most, kind="stable")
    order = order[:int((most >= best.least()).sum())]
    at, step = 0, STEP
    while at < len(order) and most[order[at]] >= best.least():
        docs = order[at:at + step]
        best.add(postings.scores(docs, wanted, weight), ids[docs], null[docs])
        at, step = at + len(docs), step * 2
    return at


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * n * n_docs) div total."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * n_docs // total for x in n], np.int64)
    return 25 + 75 * n * n_docs // total


def rank_block(docs: DataFrame, item_terms: list, k: int) -> DataFrame:
    """(item, doc_id, score): what may be among the k best of the items given by rows (item, term, times)."""
    vocabulary = sorted({r["term"] for r in item_terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    found = stored(matches(docs, vocabulary), "matches")
    n_docs, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = {r[0]: r[1] for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    items: dict[int, list] = {}
    for r in item_terms:
        items.setdefault(r["item"], []).append((number[r["term"]], r["times"]))
    items = {i: (np.array([t for t, _ in x]), np.array([c for _, c in x], np.int64)) for i, x in items.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i: Best(k) for i in items}
        for b in batches:
            ids, n, term, tf = (b.column(i) for i in range(4))
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids, n = ids.fill_null(0).to_numpy(), n.to_numpy()
            doc = np.repeat(np.arange(len(n)), pc.list_value_length(term).to_numpy())
            term, tf = term.flatten().to_numpy(), tf.flatten().to_numpy()
            part = 1_000_000_000 * tf // (1000 * tf + 8 * lengths(n, n_docs, total)[doc])
            postings = Postings(doc, term, part, len(n), len(vocabulary))
            for i, (wanted, times) in items.items():
                evaluate(postings, wanted, times * weights[wanted], ids, null, best[i])
        for i, x in best.items():
            if len(x.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x.score), i)), pa.array(x.doc, mask=x.null), pa.array(x.score)], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents with the highest score above 0 for each of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Null texts have no terms; such items, and items whose terms no document holds, have no rows. Equal rows of ``items`` are one
    item; rows of one item_id with different texts are items of their own, ranked apart. Every row of ``docs`` is a document, so
    repeated rows take several ranks; a null doc_id comes last among equal scores. Other columns are ignored.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).distinct()
    item = F.xxhash64("item_id", "text")
    held = stored(rows.select("item_id", item.alias("item"), F.explode(F.regexp_extract_all("text", F.lit(TERM), 0)).alias("term"))
                  .groupBy("item_id", "item", "term").agg(F.count("*").alias("times")), "items")
    blocks = max(1, -(-held.count() // TERMS))
    found = [rank_block(docs, held.where(F.pmod("item", F.lit(blocks)) == i).collect(), k) for i in range(blocks)]
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(held.select("item_id", "item").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(ts) AS term FROM d) GROUP BY r, doc_id, term),
size AS (SELECT r, sum(tf) AS n FROM tf GROUP BY r), total AS (SELECT count(*) AS docs, sum(n) AS len FROM size),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
scored AS (SELECT item_id, tf.r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN size ON size.r = tf.r, total GROUP BY item_id, tf.r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
