"""Near-duplicate join on word shingles: MinHash bands, Bayesian pruning, exact check.

1. Every text gets 128 MinHash values of its five-word shingles. Texts of equal words form a class, of which one text
   goes on. Bands of five values are counted over the corpus; only bands that two texts share are kept (two texts of
   similarity 0.8 miss all 25 bands with probability 5e-5, at 0.85 with 1e-6).
2. Texts that share a band are compared value by value, sixteen at a time, on four bits of each. After each step the
   posterior probability of reaching the threshold (uniform prior, Beta posterior) is looked up; the pair is dropped when
   it falls below ``tolerance``. This is the condition of the join itself, so dropped pairs are never emitted.
3. What is left is checked exactly on the sets of shingle names.

A band that more than ``HOT`` texts share would emit their square. Texts that such bands connect form a hot group, whose
pairs are compared inside tasks, block against block, by the same steps; a task returns a row per text: how many links
it found, and the least text that they connect it with. Inside a hot group every pair is compared, so the few links
whose texts share no band are found there as well; elsewhere they are missed (see 1).

A node is a class of equal words with a number of its own; ids of documents only name it, so different texts may share an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Spans, Texts, documents, keyed, long_array, mix, same_document, stored, texts_of
from tallyspark.llm.substring import word_names

WORDS = 5
VALUES, BAND_VALUES, STEP, BITS = 128, 5, 16, 4
#: Texts in a band that are paired by the join; texts of a block; shingles of a block that are counted at a time.
HOT, BLOCK, COLUMNS = 32, 128, 8192
_FACTOR = np.random.default_rng(31).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, least matches): with fewer of n values equal, the posterior of reaching the threshold is under the tolerance.

    Values agree with probability p = threshold + (1 - threshold) / 16 on four bits at the threshold. With m of n equal
    and a uniform prior, the posterior P(agreement >= p) is the probability of at most m successes in n + 1 trials at p.
    """
    p = threshold + (1 - threshold) / 2**BITS
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * p**m * (1 - p)**(n + 1 - m)
            if total >= tolerance:
                out.append((n, m))
                break
    return out


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of all shingles, where those of each text begin, word names, and where the words of each text begin.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    names, at = word_names(texts)
    n = np.diff(at)
    place = np.arange(len(names))
    owner = np.repeat(np.arange(len(n)), n)
    end = np.minimum(place + size, at[owner + 1]) if len(names) else place
    good = (end - place == size) | ((n[owner] < size) & (place == at[owner]))
    place, end = place[good], end[good]
    return Spans(names).names(place, end), np.concatenate([[0], np.cumsum(np.bincount(owner[good], minlength=len(n)))]), \
        names, at


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, texts in texts_of(b.column(1)):
            names, at, words, word_at = shingles(texts, WORDS)
            full = np.flatnonzero(np.diff(at))
            least = np.empty((VALUES, len(full)), np.uint64)
            if len(full):
                x = names ^ (names >> np.uint64(29))
                for k in range(VALUES):
                    least[k] = np.minimum.reduceat(x * _FACTOR[k], at[full])
            bands = []
            for k in range(0, VALUES - BAND_VALUES + 1, BAND_VALUES):
                key = np.full(len(full), k + 1, np.uint64)
                for v in least[k:k + BAND_VALUES]:
                    key = mix(key * np.uint64(5) + v)
                bands.append(key)
            digit = mix(least) & np.uint64(2**BITS - 1)
            sketch = [reduce(lambda a, v: (a << np.uint64(BITS)) | v, digit[k:k + STEP]) for k in range(0, VALUES, STEP)]
            first, last = word_at[full], word_at[full + 1]
            copy = Spans(words).names(first, last)
            total = np.add.reduceat(mix(names), at[full]) if len(full) else copy
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo).take(pa.array(full)), b.column(2).slice(lo, hi - lo).take(pa.array(full)),
                 long_array(copy), long_array(total),
                 pa.FixedSizeListArray.from_arrays(long_array(np.stack(bands, 1).ravel()), len(bands)).cast(
                     pa.list_(pa.int64())),
                 *map(long_array, sketch)],
                ["doc_id", "text_hash", "copy", "total", "bands", *[f"s{k}" for k in range(len(sketch))]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, texts in texts_of(b.column(1)):
            names, at, _, _ = shingles(texts, WORDS)
            sets = [np.unique(names[i:j]).view(np.int64) for i, j in zip(at[:-1], at[1:])]
            size = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo),
                 pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.array(np.concatenate(sets)))],
                ["node", "names"])


SKETCH = [f"s{k}" for k in range(VALUES // STEP)]


def alike(a: Column, b: Column) -> Column:
    """Of sixteen four-bit values each, how many are equal."""
    x = a.bitwiseXOR(b)
    y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    y = y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.lit(STEP) - F.bit_count(y)


def components(links: DataFrame) -> DataFrame:
    """(node, class_id): the least node that links (a, b) connect a node with, by large-star and small-star rounds.

    The least neighbours are written before they are joined: a side straight from an aggregate keeps Spark from splitting
    the partition of a node that a large group hangs on.
    """
    def seen(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
                   "links")
    state = seen(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), "large-star")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = stored(small.distinct(), "small-star")
        now = seen(edges)
        if now == state:
            return edges.unionByName(edges.select(F.col("b").alias("a"), "b")).groupBy("a").agg(
                F.min("b").alias("class_id")).withColumnRenamed("a", "node")
        state = now


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _survivors(a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of rows of two tables of sketches pass every step."""
    i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    same = np.zeros(len(i), np.int64)
    for k, (_, need) in enumerate(least):
        x = a[i, k] ^ b[j, k]
        y = x | (x >> np.uint64(1))
        y = (y | (y >> np.uint64(2))) & np.uint64(0x1111111111111111)
        same = same + STEP - _popcount(y)
        good = same >= need
        i, j, same = i[good], j[good], same[good]
    out = np.zeros((len(a), len(b)), bool)
    out[i, j] = True
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many names each set of a shares with each set of b."""
    names = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)

    def places(sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(names, flat)
        hit = at < len(names)
        hit[hit] = names[at[hit]] == flat[hit]
        return row[hit], at[hit]
    (ra, ca), (rb, cb) = places(a), places(b)
    for lo in range(0, len(names), COLUMNS):
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            here = (c >= lo) & (c < lo + COLUMNS)
            m[r[here], c[here] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _compare(part: Fraction, least: list[tuple[int, int]]):
    """One block against another (or itself): links per text, and the least text of what they connect."""
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node = table.column("node").to_numpy()
        sketch = np.stack([table.column(s).to_numpy().view(np.uint64) for s in SKETCH], 1)
        sets = [np.array(x, np.int64) for x in table.column("names").to_pylist()]
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if (side == 1).any() else one
        alone = not (side == 1).any()
        linked = _survivors(sketch[one], sketch[two], least)
        if alone:
            np.fill_diagonal(linked, False)
        i, j = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if len(i):
            both = _common([sets[k] for k in one[i]], [sets[k] for k in two[j]])
            total = np.array([len(sets[k]) for k in one[i]])[:, None] + np.array([len(sets[k]) for k in two[j]])
            exact = both * (part.denominator + part.numerator) >= total * part.numerator
            linked[np.ix_(i, j)] &= exact
        n, label = np.zeros(len(node), np.int64), node.copy()
        n[one] += linked.sum(1)
        if not alone:
            n[two] += linked.sum(0)
        a, b = np.nonzero(linked)
        a, b = one[a], two[b]
        while True:  # the least text of each connected part
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            if (label == before).all():
                break
        found = np.flatnonzero(n)
        return pa.table({"node": node[found], "n_links": n[found], "least": label[found]})
    return run


def links(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Classes of equal words, and the links between them.

    ``docs`` has doc_id and text; other columns are ignored. First: doc_id, text_hash, node, a number of the class of
    documents of the same words, and head, the least (doc_id, text_hash) of that class (documents without a word, or
    without an id, are left out: they have no links). Second: node, n_links, least: partial counts of the other nodes whose sets of five-word shingles have a Jaccard
    similarity of ``threshold`` or more, each link counted once at either end, and a node that such links connect it
    with. A text of one to four words is one shingle. Words are runs of other characters than white space, unchanged.
    """
    docs = keyed(docs).where("doc_id IS NOT NULL")
    fields = "doc_id long, text_hash long, copy long, total long, bands array<long>, " + ", ".join(
        f"{s} long" for s in SKETCH)
    part, least = Fraction(str(threshold)), least_matches(threshold, tolerance)
    signed = stored(docs.mapInArrow(_signatures, fields), "signatures")
    node = stored(signed.groupBy("copy", "total").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).withColumn(
        "node", F.monotonically_increasing_id()), "classes")
    members = signed.select("doc_id", "text_hash", "copy", "total").join(node, ["copy", "total"]).select(
        "doc_id", "text_hash", "node", F.col("at").alias("head"))
    # rows of the same id and text are one
    heads = signed.join(node.select("at.*", "node"), ["doc_id", "text_hash"]).select("node", "bands", *SKETCH)
    heads = stored(heads.dropDuplicates(["node"]), "heads")
    keys = heads.select("node", F.explode("bands").alias("band"))
    shared = stored(keys.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"),
                    "shared-bands")
    rows = stored(keys.join(shared, "band"), "rows")
    group = stored(components(rows.where(F.col("n") > HOT).select(F.col("node").alias("a"), F.col("least").alias("b")))
                   .withColumnRenamed("class_id", "hot"), "hot-groups")

    # pairs of the bands that few share
    few = rows.where(F.col("n") <= HOT).select("band", "node").join(heads.select("node", *SKETCH), "node").join(
        group, "node", "left")
    left = few.select(*[F.col(c).alias(f"a_{c}") for c in ("band", "node", "hot", *SKETCH)])
    right = few.select(*[F.col(c).alias(f"b_{c}") for c in ("band", "node", "hot", *SKETCH)])
    same, keep = None, (F.col("a_node") < F.col("b_node")) & F.coalesce(F.col("a_hot") != F.col("b_hot"), F.lit(True))
    for (_, need), s in zip(least, SKETCH, strict=True):
        step = alike(F.col(f"a_{s}"), F.col(f"b_{s}"))
        same = step if same is None else same + step
        keep = keep & (same >= need)
    pairs = left.join(right, (F.col("a_band") == F.col("b_band")) & keep).select(
        F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    pairs = stored(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(
        group.select("node")).distinct()
    at = node.join(asked, "node", "left_semi").select("at.*", "node")
    texts = docs.join(at, same_document(docs, at)).select("node", "text").dropDuplicates(["node"])
    sets = stored(texts.mapInArrow(_sets, "node long, names array<long>"), "sets")
    both = F.size(F.array_intersect("x", "y"))
    checked = stored(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("names").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("names").alias("y")), "b")
        .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
        .where(F.col("both") * (part.denominator + part.numerator) >= F.col("sum") * part.numerator)
        .select("a", "b"), "checked")
    ends = checked.select(F.col("a").alias("node"), F.col("a").alias("least")).unionByName(
        checked.select(F.col("b").alias("node"), F.col("a").alias("least")))

    # hot groups, block against block
    blocks = group.groupBy("hot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = group.join(blocks, "hot").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "hot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"))
    inside = dealt.join(heads.select("node", *SKETCH), "node").join(sets, "node").groupBy("hot", "i", "j").applyInArrow(
        _compare(part, least), "node long, n_links long, least long")
    return members, stored(ends.withColumn("n_links", F.lit(1).cast("long")).unionByName(inside), "links-of")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, copy_id, class_id, n_links, and class_hash.

    copy_id is the least doc_id of the same words, class_id the least doc_id that chains of links connect the document
    with (class_hash: the hash of that document's text, the least if its id has several), n_links the number of other
    texts (copies count once) of similarity ``threshold`` or more. Different texts of one id are documents of their own:
    each has its own links and class. Documents without words (null, empty, white space) are classes of their own without
    links; so are documents without an id, whose class_id is null.
    """
    members, found = links(docs, threshold, tolerance)
    members = stored(members.dropDuplicates(), "members")
    count = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    group = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    nodes = stored(members.select("node", "head").dropDuplicates(["node"]).join(group, "node", "left").join(
        count, "node", "left").withColumn("class", F.coalesce("class_id", "node")), "nodes")
    # written before the join, so that the partition of a large class can be split
    least = stored(nodes.groupBy("class").agg(F.min("head").alias("least")), "least-of-class")
    named = nodes.join(least, "class").select("node", "head", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    member = members.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "node").join(named, "node")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.join(member, (rows["doc_id"] == member["id"]) & (rows["text_hash"] == member["hash"]), "left").select(
        "doc_id", "text_hash", F.coalesce("head.doc_id", "doc_id").alias("copy_id"),
        F.coalesce("least.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("least.text_hash", "text_hash").alias("class_hash"))


def keep_one(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """The documents, all columns, without those of which an equal or near copy of lesser doc_id (or of the same id and
    a text of lesser hash) stays.

    Of repeated rows all go on or none.
    """
    found = near_duplicates(docs, threshold, tolerance).where("class_id <> doc_id OR class_hash <> text_hash").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hash_ = F.xxhash64(docs["text"].cast("string"))
    return docs.join(found, (docs["doc_id"].cast("long") == F.col("_id")) & (hash_ == F.col("_hash")), "left_anti")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_id", "n_links")
