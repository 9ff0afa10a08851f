"""The likelihood ratio, its cross-fitted threshold and the verdict beside a plain-Python version, on all documents of sf0.001 and on a fixture."""

import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from tallyspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def name(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def grams(text):
    names = [name(w) for w in WORD.findall(text or "")]
    return [x & 8191 for x in names] + [name(a, b) & 8191 for a, b in zip(names, names[1:])]


def base_failed(text):
    w = WORD.findall(text or "")
    three = list(zip(w, w[1:], w[2:]))
    count = Counter(three)
    n = len({k + j for k, x in enumerate(three) if count[x] > 1 for j in range(3)})
    return len(w) < 50 or 100 * n > 50 * len(w)


def want(rows, good, loss=quality.LOSS):
    found = {t: grams(t) for _, t in rows}
    fold = {t: (42 if t is None else name(t)) % quality.FOLDS for _, t in rows}
    raw, parts = Counter(), [Counter() for _ in range(quality.FOLDS)]
    for i, t in rows:
        raw.update(found[t])
        if i in good:
            parts[fold[t]].update(found[t])
    target = sum(parts, Counter())
    r_all = sum(raw.values()) + 8192

    def scorer(counts):
        t_all = sum(counts.values()) + 8192
        return lambda t: sum(math.log((counts[b] + 1) / t_all) - math.log((raw[b] + 1) / r_all) for b in found[t]) / max(len(found[t]), 1)
    score = scorer(target)
    others = [scorer(target - p) for p in parts]
    trusted = sorted(others[fold[t]](t) for i, t in rows if i in good and not base_failed(t))
    at = loss * (len(trusted) - 1)
    low = trusted[int(at):int(at) + 2]
    limit = low[0] + (at - int(at)) * (low[-1] - low[0])
    return {(i, t): (score(t), base_failed(t), limit) for i, t in rows}


def compare(spark, docs, labels, loss):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    expected = want(rows, good, loss)
    hashes = {r.h: r.text for r in docs.selectExpr("text", "xxhash64(cast(text as string)) h").collect()}
    once = quality.fit_and_judge(docs, labels, loss).collect()
    for r in once:
        score, failed, limit = expected[r.doc_id, hashes[r.text_hash]]
        assert abs(r.score - score) < 1e-8 and r.base_failed == failed
        assert abs(score - limit) < 1e-9 or r.kept == (not failed and score >= limit)
    assert len(once) == len(rows)
    twice = quality.judge(docs, quality.fit(docs, labels, loss)).collect()
    plain = lambda found: sorted((repr(r.doc_id), r.text_hash, r.kept, r.n_repeat_words, round(r.score, 8)) for r in found)
    assert plain(once) == plain(twice)
    return once


@pytest.mark.parametrize("loss", [quality.LOSS, 0.3])
def test_given_documents(spark, sf, loss):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = sum(r.kept for r in compare(spark, docs, labels, loss))
    assert 0 < kept < docs.count()


def test_nulls_repeats_and_extra_columns(spark):
    long = " ".join(f"w{i % 70}" for i in range(60))
    rows = [(1, long), (1, long), (1, None), (2, ""), (None, long + " more"), (3, "a\tb\x0bc  d\n\n" * 20), (4, " ".join(f"x{i}" for i in range(80))),
            (5, long + " é ß"), (6, " \n ")]
    docs = spark.createDataFrame([(i, t, 0, 1.5, "z") for i, t in rows], "doc_id long, text string, fold int, others double, m string")
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 1), (4, 0)], "doc_id long, quality int")
    compare(spark, docs, labels, 0.1)


def test_without_trusted(spark):
    docs = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(80))), (2, "short")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.doc_id, r.kept) for r in quality.fit_and_judge(docs, none).collect()} == {(1, True), (2, False)}
    assert quality.fit_and_judge(docs.limit(0), none).count() == 0
