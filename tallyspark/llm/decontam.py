"""Benchmark decontamination by SimHash, in DataFrame functions only.

1. Five-word shingles that a benchmark item has are looked for in all documents. Where one occurs, it places the item:
   the window of the item's size that would hold the shingle at the same place is a candidate. A window without a common
   shingle has similarity 0 and needs no fingerprint.
2. Windows and items get 64-bit SimHash fingerprints of their shingles, counted as often as they occur. The bits are cut
   into ``RADIUS + 1`` blocks; two fingerprints within the radius agree on a block at least, so joins on the blocks
   (and the window's size) find all of them. At similarity 0.8 a pair lies within radius 19 of 64 with probability 0.999.
3. Candidates are verified exactly: weighted Jaccard similarity of the two multisets of shingles.

An item of fewer than five words is one shingle of all its words. Its windows, of as many words, have one shingle too, so
they are like it only if they are equal to it: documents are also cut into runs of each such width, and joined by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.core import let
from tallyspark.llm.common import documents, keyed, words_column

WORDS = 5
RADIUS = 19
#: Benchmark shingles up to which the table is broadcast (8 MB of names); beyond, Spark shuffles both sides.
BROADCAST_SHINGLES = 500_000


def shingled(text: Column) -> Column:
    """A struct: n, the number of words, and names, hashes of five words each, or of all if there are fewer but some."""
    def of(names: Column) -> Column:
        each = F.transform(names, lambda x, i: F.xxhash64(x, *[F.get(names, i + k) for k in range(1, WORDS)]))
        whole = F.when(F.size(names) == 0, F.array().cast("array<bigint>")).otherwise(F.array(_whole(names)))
        return F.struct(F.size(names).alias("n"), F.when(F.size(names) < WORDS, whole).otherwise(
            F.slice(each, 1, F.greatest(F.size(names) - (WORDS - 1), F.lit(1)))).alias("names"))
    return let(F.transform(words_column(text), lambda w: F.xxhash64(w)), of)


def _whole(names: Column) -> Column:
    """The one shingle of a text of few words."""
    return F.xxhash64(F.concat(F.array(F.lit(0).cast("long")), names))


def _runs(width: int):
    """The shingle of every run of so many words, from their names."""
    return lambda names: F.transform(F.slice(names, 1, F.greatest(F.size(names) - (width - 1), F.lit(0))),
                                     lambda _, i: _whole(F.slice(names, i + 1, width)))


def simhash(column: str) -> Column:
    """Bit b is set if more of the names have it set than not."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (out, b) -> out | if(
        aggregate({column}, 0, (a, x) -> a + cast(shiftright(x, b) & 1L as int) * 2 - 1) > 0, shiftleft(1L, b), 0L))""")


def blocks(column: str, radius: int) -> Column:
    """The fingerprint in radius + 1 blocks of bits, each with its number."""
    n = radius + 1
    edge = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(
        F.lit(k).alias("block"),
        F.expr(f"shiftrightunsigned({column}, {a}) & {(1 << (b - a)) - 1}L").alias("bits"))
        for k, (a, b) in enumerate(zip(edge, edge[1:]))])


def weighted(a: str, b: str) -> Column:
    """Sum of the lesser counts over the sum of the greater counts, of two arrays of names."""
    common = F.expr(f"""aggregate(array_distinct({a}), 0, (t, x) -> t + least(
        size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))""")
    return common / (F.size(a) + F.size(b) - common)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, start, distance, similarity): documents that hold a window like an item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. start is the first word of
    the best window (the earliest of equals). Windows have as many words as the item, or the whole document if it is
    shorter. Null texts, texts without words and items without words match nothing; repeated rows give one row.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), shingled(F.col("text").cast("string")).alias("s")).select(
        "item_id", F.col("s.n").alias("width"), F.col("s.names").alias("of_item")).where("width > 0")
    items = items.withColumn("print", simhash("of_item"))
    placed = items.select("item_id", "width", F.posexplode_outer("of_item").alias("at", "shingle"))
    known = placed.select("shingle", "at", "width").distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    docs = keyed(docs)
    # the outer form: Spark would push a filter on the size of what is exploded below it, and shingle every text twice
    each = docs.select("doc_id", "text_hash", shingled(F.col("text")).alias("s")).select(
        "doc_id", "text_hash", F.col("s.n").alias("_n"), F.posexplode_outer("s.names").alias("pos", "shingle"))
    start = F.greatest(F.least(F.col("pos") - F.col("at"), F.col("_n") - F.col("width")), F.lit(0))
    windows = each.join(known, "shingle").select("doc_id", "text_hash", start.alias("start"), "width").distinct()
    asked = windows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_list(F.struct("start", "width")).alias("windows"))
    held = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(
        "doc_id", "text_hash", "text", "windows")
    cut = held.select("doc_id", "text_hash", shingled(F.col("text")).alias("s"), "windows").select(
        "doc_id", "text_hash", "s", F.explode_outer("windows").alias("w")).select(
        "doc_id", "text_hash", F.col("w.start").alias("start"), F.col("w.width").alias("width"),
        F.expr(f"slice(s.names, w.start + 1, greatest(w.width - {WORDS - 1}, 1))").alias("part"))
    prints = cut.withColumn("own", simhash("part"))
    left = prints.select("*", F.explode(blocks("own", radius)).alias("key"))
    right = items.select("item_id", F.col("width").alias("_w"), "of_item", "print",
                         F.explode(blocks("print", radius)).alias("_key"))
    far = F.bit_count(F.col("own").bitwiseXOR(F.col("print")))
    near = left.join(right, (F.col("width") == F.col("_w")) & (F.col("key") == F.col("_key")) & (far <= radius)).select(
        "doc_id", "text_hash", "start", "item_id", "part", "of_item", far.alias("distance")).dropDuplicates(
        ["doc_id", "text_hash", "start", "item_id"])
    checked = near.withColumn("similarity", weighted("part", "of_item")).where(F.col("similarity") >= threshold).select(
        "doc_id", "text_hash", "item_id", "start", "distance", "similarity")
    short = items.where(F.col("width") < WORDS)
    widths = sorted(r[0] for r in short.select("width").distinct().collect())  # four at most
    for width in widths:
        each = docs.select("doc_id", "text_hash", F.posexplode_outer(let(F.transform(
            words_column(F.col("text")), lambda w: F.xxhash64(w)), _runs(width))).alias("start", "shingle"))
        equal = each.join(short.where(F.col("width") == width).select("item_id", F.col("of_item")[0].alias("shingle")), "shingle")
        checked = checked.unionByName(equal.select(
            "doc_id", "text_hash", "item_id", "start", F.lit(0).alias("distance"), F.lit(1.0).alias("similarity")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("distance")).alias("distance")))
    return checked.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select(
        "doc_id", "text_hash", "item_id", (-F.col("best.start")).alias("start"), (-F.col("best.distance")).alias("distance"),
        "best.similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no window like an item of the benchmark."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_id"))
                     & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start", "distance", F.round("similarity", 6).alias("similarity"))
