"""Winnowing beside brute force, its match guarantee, and the next document in every layout of rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import fingerprints as fp
from tallyspark.llm.common import texts_of

SCHEMA = "doc_id long, text string, n_chars int, bucket int, fingerprint string"


def texts(values):
    return next(texts_of(pa.array(values, pa.string()), 1 << 40))[2]


def names_of(data, k):
    spans = fp.Spans(texts([data.decode()]).byte_values())
    n = len(data)
    if n < k:
        return [int(spans.names(np.array([0]), np.array([n]))[0] >> np.uint64(32))] if n else []
    s = np.arange(n - k + 1)
    return [int(x) for x in spans.names(s, s + k) >> np.uint64(32)]


def brute(text, k, w):
    """(position, hash) by the definition: the smallest of each window, of equal ones the rightmost."""
    h = names_of(text.encode(), k)
    out = set()
    for i in range(max(1, len(h) - w + 1) if h else 0):
        window = h[i:i + w]
        least = min(window)
        out.add((i + max(j for j, x in enumerate(window) if x == least), least))
    return sorted(out)


def samples(seed=0):
    r = random.Random(seed)
    words = ["the", "of", "é", "日本", "word", "x" * 9]
    out = ["", "a", "é", "ab", "aaaaaaaaaaaaaaaaaaaa" * 9, " ".join(r.choice(words) for _ in range(4000))]
    return out + [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(60)]


@pytest.mark.parametrize("k,w", [(1, 1), (3, 2), (5, 7), (32, 64)])
def test_winnow(k, w):
    values = samples()
    text, place, value = fp.winnow(texts(values), k, w)
    got = [[] for _ in values]
    for t, p, v in zip(text.tolist(), place.tolist(), value.tolist()):
        got[t].append((p, v))
    assert got == [brute(v, k, w) for v in values]


def test_guarantee():
    """A shared run of K + WINDOW - 1 bytes has a common fingerprint inside it, at the same place of the run."""
    r = random.Random(4)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(200):
        run = line(fp.K + fp.WINDOW - 1)
        before = [line(r.randint(0, 300)) for _ in range(2)]
        text, place, value = fp.winnow(texts([before[0] + run + line(50), before[1] + run + line(99)]))
        inside = [{(p - len(before[d]), v) for t, p, v in zip(text.tolist(), place.tolist(), value.tolist())
                   if t == d and 0 <= p - len(before[d]) <= len(run) - fp.K} for d in (0, 1)]
        assert inside[0] & inside[1]


def want(rows, k=fp.K, w=fp.WINDOW):
    hashes = {t: int(h) for t, h in rows["hash"].items()}
    order = sorted(rows["rows"], key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        changed = t[:len(t) - q] + nxt[:q]
        prints = [brute(x, k, w) for x in (t, changed, nxt)]
        sets = [{v for _, v in p} for p in prints]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), *[",".join(f"{v:08x}" for _, v in p) for p in prints[:2]], *like))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 9, "x") for d, t in rows], SCHEMA)
    hashes = {r.t: r.h for r in df.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    got = sorted([tuple(r) for r in fp.with_next(df.repartition(5)).collect()], key=repr)
    assert got == want({"rows": rows, "hash": hashes})
    return got


def test_next_document(spark):
    values = samples(2)
    rows = [(7 * i, v) for i, v in enumerate(values)]
    got = run(spark, rows)
    near = [r[5] for r in got if r[1] > 2000]
    assert near and min(near) > 0.3


def test_repeated_ids_nulls_and_ties(spark):
    values = samples(3)
    rows = [(i, v) for i, v in enumerate(values)] + [(5, v) for v in values] + [(5, values[8])] * 3 + [(None, "null id"), (None, None), (9, None)]
    run(spark, rows)


def test_few_documents(spark):
    run(spark, [(1, "alone " * 90)])
    run(spark, [(1, "one " * 90), (2, "")])
    assert run(spark, [(3, None)])[0][5:] == (1.0, 1.0)
    assert fp.with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    """Texts above the size of a chunk of bytes."""
    r = random.Random(1)
    long = "".join(r.choice("abcdefghij klmno") for _ in range(2_500_000))
    df = spark.createDataFrame([(1, "short", 1, 1, ""), (2, long, 1, 1, ""), (3, long, 1, 1, ""), (4, "é" * 1000, 1, 1, "")], SCHEMA)
    got = {x.doc_id: x for x in fp.with_next(df).collect()}
    assert got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1.0
    assert 0.74 < got[2].near_edited < 0.76  # its next has the same text, so its last quarter became its first
    assert got[3].edited_sha256 == hashlib.sha256((long[:len(long) - len(long) // 4] + "é" * 1000).encode()).hexdigest()
    assert got[4].n_chars == 1000


def test_operator_keeps_positions(spark):
    values = samples(5)[:20] + [None]
    df = spark.createDataFrame([(i, t, 1, 9, "x") for i, t in enumerate(values)], SCHEMA)
    for r in fp.fingerprints(df, 3, 4).collect():
        assert list(zip(r.positions, r.hashes)) == brute(values[r.doc_id] or "", 3, 4)
