"""Ranked search beside brute force and SQL: ties, repeated rows, nulls, long items, several blocks of items, empty tables."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import check
from tallyspark.llm import search

DOCS = "doc_id long, text string, n long, score long, item_id long"
ITEMS = "item_id long, text string, rank int, doc_id long"
FOLD = str.maketrans(search.UPPER, search.LOWER)


def terms(text):
    return re.findall(search.TERM, (text or "").translate(FOLD))


def want(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def make(seed=0):
    r = random.Random(seed)
    words = ["the", "The", "THE", "of", "é1", "日本", "x_y", "a-b", "rare%d", "İ", "ß", "the", "in", "0"]
    text = lambda n: r.choice([" ", ". ", "\x00", "_"]).join(w % r.randint(0, 50) if "%" in w else w for w in r.choices(words, k=n))
    docs = [(i, text(r.randint(0, 60))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)] + [docs[3]] * 3 + [(None, docs[9][1]), (None, None), (5, "other text the"), (999, None), (1000, " .,")]
    docs += [(2000, text(60_000))]
    items = [(i, text(r.randint(1, 12))) for i in range(25)]
    items += [(50, text(400) + " ".join(f"rare{k}" for k in range(200))), (51, None), (52, ""), (53, "nowhere"), items[0], (1, "of"), (None, "the of"), (54, docs[7][1])]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], DOCS).repartition(6),
            spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS))


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("block,step", [(50_000, 64), (100, 1)])
def test_search(spark, monkeypatch, block, step):
    monkeypatch.setattr(search, "TERMS", block)
    monkeypatch.setattr(search, "STEP", step)
    docs, items = make()
    assert rows_of(search.search(*frames(spark, docs, items))) == want(docs, items)


def test_other_k(spark):
    docs, items = make(2)
    assert rows_of(search.search(*frames(spark, docs, items), k=3)) == want(docs, items, 3)


def test_empty(spark):
    docs, items = make()
    assert search.search(*frames(spark, [], items)).count() == 0
    assert search.search(*frames(spark, docs, [])).count() == 0
    assert search.search(*frames(spark, [(1, None)], items)).count() == 0


def test_masks_leave_documents_out():
    """Documents whose mask cannot reach the best are never scored."""
    r = np.random.default_rng(0)
    n, n_terms = 5000, 12
    flags = r.random((n, n_terms)) < 0.3
    doc, term = np.nonzero(flags)
    part = r.integers(900, 1000, len(doc))
    postings = search.Postings(doc, term, part, n, n_terms)
    weight = np.arange(1, n_terms + 1)
    best = search.Best(10)
    scored = search.evaluate(postings, np.arange(n_terms), weight, np.arange(n), np.zeros(n, bool), best)
    every = np.zeros(n, np.int64)
    np.add.at(every, doc, part * weight[term])
    assert best.score.tolist() == sorted(every.tolist(), reverse=True)[:10] and scored < n / 4


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(search.ORACLE)
    sql = check.rows_of([c[0] for c in result.description], result.fetchall())
    df = search.op13_ranked_search(spark, sf)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == sql
