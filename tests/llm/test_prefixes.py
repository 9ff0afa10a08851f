"""The prefix trie beside brute force: short, long, repeated and turnless conversations, ties, nulls, empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

import check
from tallyspark.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth int, block string"


def name(t):
    role, text = t[1] or "", t[2] or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest() + len(text).to_bytes(4, "big")


def want(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role, text))
    for c in own:
        own[c].sort(key=lambda t: (t[0] is not None, t[0] or 0, name(t)))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - c % 100
        paths[c] = tuple((r or "", t or "") for _, r, t in own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        kids = children[p]
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(paths[c]) == len(p))))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def make(seed=1):
    r = random.Random(seed)
    texts = ["", "a", "bb", "é ß", "long text " * 40, None]
    rows = []
    for c in [*range(0, 30), *range(98, 130), 205, 207, 300, 1999, 100000, 5_000_000_000]:
        n = r.choice([1, 1, 2, 3, 5, 8, 9, 17, 40])
        turns = [(c, k, r.choice(["user", "system", None]), r.choice(texts[:3] if r.random() < 0.8 else texts)) for k in range(n)]
        rows += turns
    rows += [(c, k, "user", "same") for c in range(400, 440) for k in range(20)]       # copies longer than a block
    rows += [(500, k * 500, "u", "x" * (k % 3)) for k in range(30)]                    # turns in several pieces
    rows += [(501, None, "u", "n"), (501, None, None, None), (501, 1, "u", "n"), (501, 1, "a", "tie"), (501, 1, "a", "tie")]
    rows += [(None, 1, "u", "nobody"), (-3, 0, "u", "minus")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_trie(spark, tmp_path):
    rows = [r for r in make() if r[0] is None or r[0] >= 0]
    frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(prefixes.op11_prefix_trie(spark, str(tmp_path))) == want(rows)


def test_trie_in_small_pieces(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(prefixes, "PIECE", 2)
    monkeypatch.setattr(prefixes, "ENDS", 4)
    rows = [r for r in make(2) if r[0] is None or r[0] >= 0]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(prefixes.op11_prefix_trie(spark, str(tmp_path))) == want(rows)


def test_plain_conversations(spark):
    """The operator itself, on conversations as they are, with a negative id."""
    rows = make(3)
    own = prefixes.numbered(frame(spark, rows))
    lengths = own.groupBy("conv_id").count().withColumnRenamed("count", "length")
    got = prefixes.trie(lengths, own)
    assert rows_of(got.drop("n_ends")) == want(rows, rebuild=False)
    assert got.agg({"n_ends": "sum"}).first()[0] == lengths.count()


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "conversations.parquet"))
    assert prefixes.op11_prefix_trie(spark, str(tmp_path)).count() == 0


def test_only_turnless(spark, tmp_path):
    """A conversation whose own turns are all dropped and whose first is absent still is a member of the root."""
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    rows = [(c, 0, "u", "dropped")]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(prefixes.op11_prefix_trie(spark, str(tmp_path)))
    assert got == want(rows) and got[0][:7] == (c, 0, None, 1, 0, 1, 0)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    result = con.execute(prefixes.ORACLE)
    sql = check.rows_of([c[0] for c in result.description], result.fetchall())
    df = prefixes.op11_prefix_trie(spark, sf)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == sql
