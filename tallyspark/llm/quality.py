"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over the buckets, smoothed by one, are
counted: of the whole corpus, and of trusted target documents. A document's score is the mean over its n-grams of
log(target share / corpus share), so long and short texts compare; it is kept if the score reaches a threshold, which is
a low quantile of the scores of the trusted documents. For the threshold a trusted document is scored like a document that
is not trusted: without the target counts of its own hash fold. Folds are of texts, so copies of a text share one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.core import let
from tallyspark.llm.common import WORD_SPACE, documents, stored

BUCKETS = 8192
#: Hash folds of the trusted texts: each is scored by the target counts of the other folds.
FOLDS = 16
#: Trusted ids up to which their table is broadcast (16 MB of ids); beyond, Spark shuffles both sides.
BROADCAST_IDS = 2_000_000
#: Share of trusted documents (that pass the base rules) that may score under the threshold.
LOSS = 0.002
_BLANK = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    plain = F.btrim(F.translate(F.coalesce(text.cast("string"), F.lit("")), _BLANK[1:], " " * 5))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +", -1))


def _bucket(name: Column) -> Column:
    return name.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _names(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _repeated(names: Column) -> Column:
    """How many words three-word windows cover that occur twice or more."""
    def with_windows(three: Column, mask: Column, packed: Column) -> Column:
        high = F.bitwise_not(mask)

        def equal(x: Column, y: Column) -> Column:
            return F.coalesce((x.bitwiseXOR(y).bitwiseAND(high) == 0) & (
                F.get(three, x.bitwiseAND(mask).cast("int")) == F.get(three, y.bitwiseAND(mask).cast("int"))), F.lit(False))
        twice = F.filter(packed, lambda x, i: equal(x, F.get(packed, i - 1)) | equal(x, F.get(packed, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[
            x.bitwiseAND(mask) + k for k in range(3)])))))

    def covered(three: Column) -> Column:
        # in the order of their names: the low bits of a name give way to the window's place
        return let(F.pow(F.lit(2), F.ceil(F.log2(F.size(three) + 1))).cast("long") - 1, lambda mask: let(
            F.sort_array(F.transform(three, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))),
            lambda packed: with_windows(three, mask, packed)))
    windows = F.slice(F.transform(names, lambda x, i: F.xxhash64(x, F.get(names, i + 1), F.get(names, i + 2))), 1,
                      F.greatest(F.size(names) - 2, F.lit(0)))
    return let(windows, lambda three: F.when(F.size(F.array_distinct(three)) == F.size(three), F.lit(0)).otherwise(covered(three)))


def measures(text: Column) -> Column:
    """A struct of the base counts, and of the buckets of all words and of all pairs of neighbours.

    Values used more than once are bound once: see ``let``.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def counts(words: Column, names: Column, lines: Column) -> Column:
        pairs = F.slice(F.transform(names, lambda x, i: _bucket(F.xxhash64(x, F.get(names, i + 1)))), 1,
                        F.greatest(F.size(names) - 1, F.lit(0)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(names).cast("long").alias("n_repeat_words"),
            F.transform(names, _bucket).alias("ones"), pairs.alias("twos"))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    return let(_words(text), lambda words: let(_names(words), lambda names: let(
        lines, lambda full: counts(words, names, full))))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the fold of the text and its ``measures``; from here on no text is read again."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), measures(text).alias("_m")).select(
        "doc_id", "text_hash", F.pmod("text_hash", F.lit(FOLDS)).cast("int").alias("fold"), "_m.*",
        ((F.col("_m.n_words") < 50) | (100 * F.col("_m.n_repeat_words") > 50 * F.col("_m.n_words"))).alias("base_failed"))


def score(table: Column) -> Column:
    """Mean weight of the words and pairs of a row of ``measures``; null without a table."""
    found = F.concat("ones", "twos")
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return F.when(table.isNotNull(), total / F.greatest(F.size("ones") + F.size("twos"), F.lit(1)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of quality 1, marked for broadcast if they are few enough."""
    chosen = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).distinct(
    ).withColumn("_target", F.lit(1))
    return F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen


def _counted(measured: DataFrame, *keys: str) -> DataFrame:
    rows = measured.select(*keys, F.explode(F.concat("ones", "twos")).alias("bucket"))
    return rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


class Model:
    """Weights of the buckets, those without the target counts of each fold, and the threshold."""

    def __init__(self, weights: list[float], others: list[list[float]], threshold: float = -1.0):
        self.weights, self.others, self.threshold = weights, others, threshold


def weigh(measured: DataFrame, chosen: DataFrame) -> Model:
    """Corpus counts over all documents, target counts by fold over the ``chosen`` ones; without any, all weights are 0."""
    raw, part = [0] * BUCKETS, [[0] * BUCKETS for _ in range(FOLDS)]
    for r in _counted(measured).collect():  # at most BUCKETS rows
        raw[r["bucket"]] = r["n"]
    for r in _counted(measured.join(chosen, F.col("doc_id") == F.col("_id")), "fold").collect():  # FOLDS times as many
        part[r["fold"]][r["bucket"]] = r["n"]
    target = [sum(x) for x in zip(*part)]
    r_all = sum(raw) + BUCKETS

    def ratios(trusted: list[int]) -> list[float]:
        t_all = sum(trusted) + BUCKETS
        return [math.log((t + 1) / t_all) - math.log((r + 1) / r_all) for t, r in zip(trusted, raw)]
    if not sum(target):
        return Model([0.0] * BUCKETS, [[0.0] * BUCKETS] * FOLDS)
    return Model(ratios(target), [ratios([t - x for t, x in zip(target, p)]) for p in part])


def threshold(scores: DataFrame, loss: float = LOSS) -> float:
    """The quantile ``loss`` of the column ``cross``, without all scores on the driver; -1 if there are none."""
    scores = scores.where("cross IS NOT NULL")
    n = scores.count()
    if not n:
        return -1.0
    at = loss * (n - 1)
    low = [r[0] for r in scores.select("cross").orderBy("cross").offset(int(at)).limit(2).collect()]
    return low[0] + (at - int(at)) * (low[-1] - low[0])


def _fitted(docs: DataFrame, labels: DataFrame, loss: float) -> tuple[Model, DataFrame]:
    """The model, and doc_id, text_hash, base counts, base_failed and score of every document, stored."""
    measured, chosen = stored(_measured(docs), "measures"), trusted_ids(labels)
    model = weigh(measured, chosen)
    others = docs.sparkSession.createDataFrame(list(enumerate(model.others)), "fold int, others array<double>")
    rows = measured.join(chosen, F.col("doc_id") == F.col("_id"), "left").join(F.broadcast(others), "fold")  # FOLDS rows
    cross = F.when((F.col("_target") == 1) & ~F.col("base_failed"), score(F.col("others")))
    rows = stored(rows.select("doc_id", "text_hash", *COUNTS, "base_failed", score(_literal(model.weights)).alias("score"),
                              cross.alias("cross")), "scores")
    model.threshold = threshold(rows, loss)
    return model, rows


def _decided(rows: DataFrame, limit: float) -> DataFrame:
    return rows.select("doc_id", "text_hash", *COUNTS, F.round("score", 9).alias("score"), "base_failed",
                       (~F.col("base_failed") & (F.col("score") >= limit)).alias("kept"))


def _literal(weights: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{w!r}D' for w in weights)})")  # one literal


def fit(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> Model:
    """Weights and threshold.

    ``labels`` has doc_id and quality. The weights count every document of quality 1; the threshold is the quantile
    ``loss`` of those documents' scores by the counts of the other folds. Without such documents every document is kept
    that passes the base rules.
    """
    return _fitted(docs, labels, loss)[0]


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, text_hash, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept.

    A null text is empty; texts of under 50 words, or of which more than half lies in repeated three-word windows, fail
    the base rules and are not kept, whatever their score. Repeated rows and equal texts are judged alike.
    """
    return _decided(_measured(docs).withColumn("score", score(_literal(model.weights))), model.threshold)


def fit_and_judge(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> DataFrame:
    """The rows of ``judge`` by the model of ``fit``. Every text is read once: counts, scores and threshold come from the
    stored measures."""
    model, rows = _fitted(docs, labels, loss)
    return _decided(rows, model.threshold)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that ``fit_and_judge`` keeps."""
    gone = fit_and_judge(docs, labels).where("NOT kept").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_id"))
                     & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left_anti")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_hash")
