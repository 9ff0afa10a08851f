"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w . x): one vector of weights for all thresholds, which stay in order because each
is the one before plus a positive step. x tells which of a fixed list of words a text has. The fit runs on a bounded
sample of labelled documents; the model, a few thousand numbers, then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Spans, Texts, documents, keyed, stored, texts_of

#: Labelled documents of each grade class (toxic or not) that the model is fitted on, those of the least hashes of id and text.
SAMPLE = 3000
#: Words in the model, the most telling ones, and in how many sample documents a word must be.
FEATURES, LEAST_DOCS = 2000, 10
#: A word is a cue if toxic documents have it this many times as often; toxic documents grade by their cues.
CUE_RATIO, CUE_STEPS = 20.0, (3, 6)
GRADES = 1 + 1 + len(CUE_STEPS)


def word_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, word name) for all different words, case folded, marks after words apart."""
    start, end, at = texts.parts()
    names = Spans(texts.byte_values(True)).names(start, end)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    return owner, names


@dataclass
class Model:
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 50.0))

    def features(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the model's list), each once."""
        owner, names = word_sets(texts)
        if not len(self.names) or not len(names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        hit = self.names[at] == names
        both = np.unique(owner[hit] * len(self.names) + at[hit])
        return both // len(self.names), both % len(self.names)

    def at_most(self, latent: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - latent[:, None], -60, 60)))


def fit_ordinal(owner: np.ndarray, feature: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_features: int,
                grades: int = GRADES, decay: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the weighted likelihood, by Adam on the whole sample."""
    w = np.zeros(n_features)
    share = np.array([weight[grade <= k].sum() for k in range(grades - 1)]) / weight.sum()
    share = np.clip(share, 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    both = np.concatenate([w, t])
    m, v = np.zeros_like(both), np.zeros_like(both)
    weight = weight / weight.sum()
    row = np.arange(len(grade))
    for step in range(1, steps + 1):
        w, t = both[:n_features], both[n_features:]
        theta = t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])
        latent = np.bincount(owner, w[feature], len(grade))
        c = 1 / (1 + np.exp(-np.clip(theta[None, :] - latent[:, None], -60, 60)))
        c = np.concatenate([np.zeros((len(c), 1)), c, np.ones((len(c), 1))], 1)
        p = np.maximum(c[row, grade + 1] - c[row, grade], 1e-12)
        d = c * (1 - c)
        up, low = d[row, grade + 1] / p * weight, d[row, grade] / p * weight
        g_theta = np.zeros(grades + 1)
        np.add.at(g_theta, grade + 1, -up)
        np.add.at(g_theta, grade, low)
        g_theta = g_theta[1:grades]
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, (up - low)[owner], n_features) + decay * w,
                            [tail[0]], tail[1:] * np.exp(t[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        both = both - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, t = both[:n_features], both[n_features:]
    return w, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` toxic and ``sample`` other labelled documents; ``labels`` has doc_id and toxic.

    The labels only tell toxic from not. Toxic documents get grades by how many cue words they have: 1 for under three,
    2 for under six, 3 for more. Sample rows weigh as much as the rows of their label they stand for. Without documents
    of both labels the model predicts grade 0.
    """
    label = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    own = keyed(docs)
    held = own.select("doc_id", "text_hash").join(label, F.col("doc_id") == F.col("_id")).select(
        "_id", F.col("text_hash").alias("_hash"), "toxic").distinct()  # an id may carry several texts
    held = stored(held, "labelled")
    count = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    chosen = [held.where(F.col("toxic") == k).orderBy(F.xxhash64("_id", "_hash"), "_id", "_hash").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    own = own.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(
        "doc_id", "text_hash", "text", "toxic").dropDuplicates(["doc_id", "text_hash"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in texts_of(b.column(2)):
                owner, names = word_sets(texts)
                at = np.searchsorted(owner, np.arange(hi - lo + 1))  # the words of a text lie together
                words = [np.unique(names[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo),
                     pa.array(words, pa.binary())], ["doc_id", "text_hash", "toxic", "words"])
    rows = own.mapInArrow(sets, "doc_id long, text_hash long, toxic int, words binary").toPandas()  # the bounded sample
    rows = rows.sort_values(["doc_id", "text_hash"], ignore_index=True)
    toxic = rows["toxic"].to_numpy(np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return Model()
    words = [np.frombuffer(x, np.uint64) for x in rows["words"]]
    owner = np.repeat(np.arange(len(words)), [len(x) for x in words])
    names, place = np.unique(np.concatenate(words), return_inverse=True)
    bad = np.bincount(place, toxic[owner], len(names))
    good = np.bincount(place, 1 - toxic[owner], len(names))
    n_bad, n_good = toxic.sum(), (1 - toxic).sum()
    p, q = (bad + 0.5) / (n_bad + 1), (good + 0.5) / (n_good + 1)
    telling = np.abs(p - q) / np.sqrt(p * (1 - p) / n_bad + q * (1 - q) / n_good)
    telling[bad + good < LEAST_DOCS] = -1
    best = np.sort(np.argsort(-telling, kind="stable")[:FEATURES])
    best = best[telling[best] > 3]
    cue = (p > CUE_RATIO * q) & (bad >= LEAST_DOCS)
    cues = np.bincount(owner, cue[place], len(words))
    grade = np.where(toxic == 1, 1 + np.searchsorted(CUE_STEPS, cues, "right"), 0)
    number = np.full(len(names), -1)
    number[best] = np.arange(len(best))
    used = number[place] >= 0
    weight = np.where(toxic == 1, count[1] / n_bad, count[0] / n_good)
    w, thresholds = fit_ordinal(owner[used], number[place[used]], grade, weight, len(best))
    return Model(names[best], w, thresholds)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, text_hash, n_features (words of the
    model in the text), expected_severity (mean of the predicted grades), grade (the likeliest, the least of equals),
    p_toxic (of grade 1 or more) and toxic (p_toxic at least 0.5). A null text has no words; repeated rows and equal texts
    are scored alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in texts_of(b.column(1)):
                owner, place = model.features(texts)
                latent = np.bincount(owner, model.weights[place], hi - lo) if len(owner) else np.zeros(hi - lo)
                c = model.at_most(latent)
                p = np.diff(np.concatenate([np.zeros((len(c), 1)), c, np.ones((len(c), 1))], 1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                     pa.array(np.bincount(owner, minlength=hi - lo).astype(np.int64)),
                     pa.array(np.round((1 - c).sum(1), 6)), pa.array(p.argmax(1).astype(np.int32)),
                     pa.array(np.round(1 - c[:, 0], 6)), pa.array(1 - c[:, 0] >= 0.5)],
                    ["doc_id", "text_hash", "n_features", "expected_severity", "grade", "p_toxic", "toxic"])
    return keyed(docs).mapInArrow(run, "doc_id long, text_hash long, n_features long, expected_severity double, grade int, "
                                       "p_toxic double, toxic boolean")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text_hash")
