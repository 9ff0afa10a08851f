"""Token ids of whole texts with a public tokenizer, and exact counts for every context limit."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Spans, Texts, documents, stored, texts_of

#: A tokenizer that folds case and drops white space, so that a text's ids are those of its parts one after another.
TOKENIZER = "word_bpe_49k.json"
#: Different words whose ids a Python worker remembers at most; beyond that it starts anew.
REMEMBERED = 1 << 22
#: Lengths per block of the suffix sums.
BLOCK = 4096


class Encoder:
    """Encodes texts part by part and each part once; for tokenizers that fold case and take words, and marks after a
    letter, apart before they merge."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.forget()

    def forget(self):
        self.names, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, names: np.ndarray, words: list[str]):
        flat, size = [], []
        for lo in range(0, len(words), 4096):
            for e in self.tokenizer.encode_batch_fast(words[lo:lo + 4096], add_special_tokens=False):
                ids = e.ids
                flat += ids
                size.append(len(ids))
        size = np.array(size, np.int64)
        entry = len(self.size) + np.arange(len(words))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        place = np.searchsorted(self.names, names)
        self.names, self.entry = np.insert(self.names, place, names), np.insert(self.entry, place, entry)

    def parts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """For each part its entry, and where the parts of each text begin."""
        whole = texts.data.tobytes()
        start, end, at = texts.parts()
        fold = b"<|" not in whole  # special tokens are found before case is folded
        names, first, entry = np.unique(Spans(texts.byte_values(fold)).names(start, end), return_index=True,
                                        return_inverse=True)
        if len(self.names) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.names, names)
        new = np.ones(len(names), bool)
        inside = place < len(self.names)
        new[inside] = self.names[place[inside]] != names[inside]
        if new.any():
            s, e = start[first[new]].tolist(), end[first[new]].tolist()
            self.learn(names[new], [whole[a:b].decode() for a, b in zip(s, e)])
            place = np.searchsorted(self.names, names)
        return (self.entry[place][entry] if len(names) else np.zeros(0, np.int64)), at

    def counts(self, texts: Texts) -> np.ndarray:
        entry, at = self.parts(texts)
        sums = np.concatenate([[0], np.cumsum(self.size[entry])])
        return np.diff(sums[at])

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin."""
        entry, at = self.parts(texts)
        n = self.size[entry]
        sums = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(sums[-1]) + np.repeat(self.begin[entry] - sums[:-1], n)
        return self.ids[place], sums[at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The encoder of a Python worker, kept from task to task."""
    path = tokenizer_path(path)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length): the number of tokens of every text of ``docs``, a null text 0. ``tokenizer``: path of a file of
    a tokenizer as ``Encoder`` takes it; default: a public one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in texts_of(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(encoder(tokenizer).counts(texts))], ["length"])
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "length long")


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs): one row per length that occurs."""
    return lengths(docs, tokenizer).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length that occurs: n_docs, n_at_least and tokens_at_least (documents of that length or more and their
    tokens), and truncated_tokens (what stays of all documents when each is cut to that length).

    Sums run inside blocks of lengths and over the blocks, of which there are (longest length / 4096). Empty in, empty out.
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    per = h.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = per.select("block", F.coalesce(F.sum("docs").over(down), F.lit(0)).alias("docs_above"),
                       F.coalesce(F.sum("toks").over(down), F.lit(0)).alias("toks_above"))
    total = per.agg(F.sum("toks").alias("total"))
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    return (h.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside))
            .join(above, "block").withColumn("total", F.coalesce(total.scalar(), F.lit(0)))
            .select("length", "n_docs", (F.col("d") + F.col("docs_above")).alias("n_at_least"),
                    (F.col("t") + F.col("toks_above")).alias("tokens_at_least"), "total")
            .select("length", "n_docs", "n_at_least", "tokens_at_least",
                    (F.col("total") - F.col("tokens_at_least") + F.col("length") * F.col("n_at_least")).alias("truncated_tokens")))


def quantile(sums: DataFrame, share: float) -> int | None:
    """The least length that ``share`` of all documents do not exceed; None for no documents."""
    n = sums.agg(F.max("n_at_least")).first()[0]
    if n is None:
        return None
    return sums.where(F.lit(n) - F.col("n_at_least") + F.col("n_docs") >= F.ceil(F.lit(share) * n)).agg(F.min("length")).first()[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens that stay when every document is cut to ``limit``: what is shorter in full, and ``limit`` of each other."""
    r = sums.agg(F.sum(F.when(F.col("length") <= limit, F.col("length") * F.col("n_docs"))).alias("short"),
                 F.sum(F.when(F.col("length") > limit, F.col("n_docs"))).alias("long")).first()
    return (r.short or 0) + limit * (r.long or 0)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(stored(histogram(documents(spark, sf_dir)), "lengths"))  # encoded once: the sums read it three times
