"""The whole pipeline beside plain Python: which documents pass each stage, their redacted texts and their pieces."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_links import STRONG, shingles, want_parts
from test_quality_score import want as quality_want
from tokenizers import Tokenizer

import corpus_pipeline
from tallyspark.llm import secrets

WORDS = [f"w{k}" for k in range(250)]


def make(seed=5):
    r = random.Random(seed)
    prose = lambda n: [r.choice(WORDS) for _ in range(n)]
    items = [prose(30), prose(24), prose(3)]
    rows = [(i, " ".join(prose(r.randint(55, 160)))) for i in range(40)]
    near = rows[4][1].split()
    rows += [(100, rows[3][1]), (101, " ".join(near[:20] + ["extra"] + near[20:])), (102, rows[4][1].replace(" ", "  ")),  # copies and near copies
             (103, " ".join(prose(40) + items[0] + prose(40))), (104, " ".join(prose(60) + items[1][:12] + ["typo"] + items[1][13:] + prose(9))),
             (105, " ".join(prose(60) + items[2] + prose(20))),                                                                # benchmark passages
             (106, " ".join(prose(30)) + " password=hunter2secret " + " ".join(prose(40))),
             (107, " ".join(prose(30)) + " user=bob then Zx9Kq2Lm8Np4Rt6Vw1Yb " + " ".join(prose(40))),
             (108, " ".join(prose(60)) + " Zx9Kq2Lm8Np4Rt6Vw1Yb alone"), (109, " ".join(["again and again"] * 40)), (110, "short text"),
             (111, None), (112, ""), (113, " ".join(f"#{k}%" for k in range(90))), (None, " ".join(prose(70))), (None, rows[7][1]), rows[8], rows[8],
             (114, " ".join(prose(2500)))]
    labels = [(i, 1, 0) for i in range(0, 30)] + [(113, 0, 0), (9999, 1, 0), (None, 1, 0)]
    return rows, labels, [" ".join(x) for x in items] + [None]


def near(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def first_of_groups(rows):
    named = sorted({(i, t) for i, t in rows if i is not None and t and t.split()})
    sets = {x: shingles(tuple(x[1].split())) for x in named}
    up = {x: x for x in named}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, a in enumerate(named):
        for b in named[:k]:
            if near(sets[a], sets[b]):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return [x for x in rows if x not in up or root(x) == x]


def grams(words):
    return Counter(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def holds(text, item):
    words, wanted = (text or "").split(), (item or "").split()
    b = grams(wanted)
    for at in range(max(1, len(words) - len(wanted) + 1)):
        a = grams(words[at:at + len(wanted)])
        total = sum((a | b).values())
        if wanted and total and sum((a & b).values()) >= 0.8 * total:
            return True
    return False


def redacted(text):
    spans = sorted([(m.start(), m.end()) for k, p in STRONG.items() for m in re.finditer(p, text) if k or len(m[2]) >= 6]
                   + [(s, e) for s, _, e in want_parts(text, secrets.SCOPE)])
    out, at = [], 0
    for s, e in spans:
        if e > at:
            out += [] if s < at else [text[at:s], "[SECRET]"]
            at = e
    return "".join(out) + text[at:]


def test_pipeline_beside_brute_force(spark, tmp_path):
    rows, labels, items = make()
    columns = "doc_id long, text string, lang string, source string, n_chars int, item_id string, kept boolean"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", True) for i, t in rows], columns)
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    scores = quality_want(rows, good)
    assert all(abs(s - limit) > 1e-9 or i in good for (i, _), (s, _, limit) in scores.items())
    left = [x for x in rows if not scores[x][1] and scores[x][0] >= scores[x][2]]
    expected = [sorted(map(repr, left))]
    left = first_of_groups(left)
    expected.append(sorted(map(repr, left)))
    left = [x for x in left if not any(holds(x[1], item) for item in items)]
    expected.append(sorted(map(repr, left)))
    left = [(i, redacted(t)) for i, t in left]
    expected.append(sorted(map(repr, left)))

    frame = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], expected):
        frame = spark.createDataFrame(stage(spark, frame, str(tmp_path)).collect(), docs.schema)
        assert frame.columns == docs.columns
        assert sorted(repr((r.doc_id, r.text)) for r in frame.collect()) == want, name
    assert {len(x) for x in expected[:3]} != {len(rows)} and any("[SECRET]" in x for x in expected[3])

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    pieces = Counter()
    for i, t in left:
        ids = encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            pieces[i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
