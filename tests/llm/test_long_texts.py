"""Texts above the 2 MB that tasks work on at a time, beside brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_search import want
from tokenizers import Tokenizer

from tallyspark.llm import decontam, fingerprints, jaccard, packing, quality, search, secrets, sharding, substring, suffix, tokens
from tallyspark.llm.common import CHUNK_BYTES

WORDS = [f"word{k}" for k in range(5000)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage = prose(80)
    long = prose(150_000) + "\n" + passage + "\n" + prose(150_000)
    near = long.split(" ")
    near[77] = "changed"
    out = [(1, long), (2, " ".join(near)), (3, passage), (4, prose(200)), (5, prose(60_000) + " password=hunter2secret " + prose(10)), (6, None)]
    assert len(long) > CHUNK_BYTES
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")


def gone(units, length):
    """Which places are covered by a window that starts anywhere else; windows by the hash of their content."""
    names = [[hash(tuple(u[k:k + length])) if isinstance(u, list) else hash(u[k:k + length]) for k in range(len(u) - length + 1)] for u in units]
    count = Counter(itertools.chain.from_iterable(names))
    out = []
    for u, mine in zip(units, names):
        flags = np.zeros(len(u) + 1, np.int64)
        for k, x in enumerate(mine):
            if count[x] > 1:
                flags[k] += 1
                flags[k + length] -= 1
        out.append(np.cumsum(flags[:-1]) > 0)
    return out


def test_repeats(docs, rows):
    words = [(t or "").split() for _, t in rows]
    want = {i: (len(u), int(g.sum())) for (i, _), u, g in zip(rows, words, gone(words, 35))}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect()} == want
    data = [(t or "").encode() for _, t in rows]
    want = {i: (len(u), int(g.sum()), bytes(np.frombuffer(u, np.uint8)[~g])) for (i, _), u, g in zip(rows, data, gone(data, 200))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix.remove_repeats(docs).collect()} == want


def test_tokens_and_packing(docs, rows):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = {i: encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = {r.length: r.n_docs for r in tokens.histogram(docs).collect()}
    assert got == Counter(len(x) for x in ids.values())
    want = Counter((i, k // 2048, zlib.crc32(np.array((x + [0])[k:k + 2048], "<u4").tobytes())) for i, x in ids.items() for k in range(0, len(x) + 1, 2048))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packing.pack(docs).collect()) == want


def test_pairs_and_windows(spark, docs, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
    items = spark.createDataFrame([(0, rows[2][1])], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.similarity) for r in decontam.leaks(docs, items).collect()} == {(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0)}


def test_rows_of_one_text(docs, rows):
    texts = dict(rows)
    for r in quality.judge(docs, quality.Model([0.0] * 8192, [], -1.0)).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        three = list(zip(w, w[1:], w[2:]))
        count = Counter(three)
        assert r.n_words == len(w) and r.n_repeat_words == len({k + j for k, x in enumerate(three) if count[x] > 1 for j in range(3)})
    found = {r.doc_id: [(s.start, s.end) for s in r.base] for r in secrets.scan(docs).collect()}
    at = texts[5].index("password")
    assert found == {**{i: [] for i, _ in rows}, 5: [(at, at + len("password=hunter2secret"))]}
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in sharding.shard(docs, 3).collect()}
    assert sizes == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}


def test_prints_and_terms(spark, docs, rows):
    got = {r.doc_id: r for r in fingerprints.with_next(docs).collect()}
    assert got[1].near_next > 0.99 and got[2].near_next < 0.01 and [got[i].n_chars for i, t in rows] == [len(t or "") for _, t in rows]
    items = [(0, rows[2][1]), (1, "changed")]
    found = search.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == want(rows, items)
