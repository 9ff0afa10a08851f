"""Secret scan with linked credentials, in DataFrame functions only.

Strong kinds (assignments, access identifiers, long hex) count by themselves. Weak parts, which are everywhere in
ordinary text, count only together: a part is reported if a complementary part starts within its scope, the interval of
less than ``SCOPE`` code points either way. The interval join only asks whether there is a partner, so it goes by the nearest
one on either side: a window over the parts of a document in order of their starts, which makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import documents, keyed, stored

ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Maximal runs of the class that are long enough; a shorter run fails whole, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: who, where, and what looks like a key.
IDENTITY = r"""(?i)\b(user|username|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""\b(?:[a-z][a-z0-9+]+://[A-Za-z0-9_.-]{3,}[A-Za-z0-9_.:/@-]*|\d{1,3}(?:\.\d{1,3}){3}:\d{2,5})"""
KEY = r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}"""
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identity", "endpoint", "key")
SCOPE = 400


def _spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Matches as (start, kind, end) in code points, end exclusive: what lies between matches gives their places."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sized = F.zip_with(
        F.transform(match, lambda m: F.length(m)),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)),
        lambda a, b: F.struct(a.alias("size"), b.alias("own")))
    both = F.zip_with(sized, F.slice(F.transform(between, lambda b: F.length(b)), 1, F.size(match)),
                      lambda s, b: F.struct(b.alias("gap"), s["size"].alias("size"), s["own"].alias("own")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    walked = F.aggregate(
        both, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, m: F.struct(
            (a["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(m["own"] >= least, F.concat(a["out"], F.array(F.struct(
                (a["at"] + m["gap"]).alias("start"), F.lit(kind).alias("kind"),
                (a["at"] + m["gap"] + m["size"]).alias("end"))))).otherwise(a["out"]).alias("out")))["out"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, text_hash, base and linked.

    base: the spans of the strong kinds; linked: weak parts that a complementary part accompanies. Both are arrays of
    (start, kind, end), sorted, in code points, kind an index of ``KINDS``. Weak parts that overlap a strong span are left
    out. Secrets are strong assignments, long hex and keys; places are identities, access identifiers and endpoints. A
    weak identity or endpoint counts if a secret, a key if a place, starts less than ``scope`` code points before or after
    its own start. A null or empty text has no spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = keyed(docs).select(
        "doc_id", "text_hash",
        F.sort_array(F.concat(_spans(text, ASSIGN, 0, 6, 2), _spans(text, ACCESS, 1), _spans(text, HEX, 2))).alias("base"),
        F.concat(_spans(text, IDENTITY, 3), _spans(text, ENDPOINT, 4), _spans(text, KEY, 5)).alias("weak"))
    found = stored(found, "spans")
    part = found.where(F.size("weak") > 0).dropDuplicates(["doc_id", "text_hash"]).select(
        "doc_id", "text_hash", "base", F.explode(F.concat("base", "weak")).alias("part")).where(
        (F.col("part.kind") < 3) | ~F.exists("base", lambda b: (b["start"] < F.col("part.end")) & (F.col("part.start") < b["end"])))
    kind, start = F.col("part.kind"), F.col("part.start")
    one = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    before, after = one.rangeBetween(Window.unboundedPreceding, 0), one.rangeBetween(0, Window.unboundedFollowing)
    secret, place = F.when(kind.isin(0, 2, 5), start), F.when(kind.isin(1, 3, 4), start)
    near = part.withColumn("start", start).withColumns({
        "s0": F.max(secret).over(before), "s1": F.min(secret).over(after), "p0": F.max(place).over(before), "p1": F.min(place).over(after)})

    def within(last: str, following: str) -> Column:
        return F.coalesce(F.col("start") - F.col(last) < scope, F.lit(False)) | F.coalesce(F.col(following) - F.col("start") < scope, F.lit(False))
    linked = near.where((kind.isin(3, 4) & within("s0", "s1")) | ((kind == 5) & within("p0", "p1"))).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "part")
    linked = linked.groupBy("_id", "_hash").agg(F.collect_set("part").alias("linked"))
    return found.join(linked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "text_hash", "base",
        F.sort_array(F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>"))).alias("linked"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns, with every span that ``scan`` reports replaced by ``mark`` (overlapping spans by one);
    n_chars, if there is such a column, follows. Texts without spans stay as they are."""
    columns = docs.columns
    found = scan(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
                              F.sort_array(F.concat("base", "linked")).alias("_spans")).where(F.size("_spans") > 0)
    found = found.dropDuplicates(["_id", "_hash"])
    text = docs["text"].cast("string")
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    clean = F.aggregate(
        "_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(
                a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"),
            s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.col("_spans").isNotNull(), clean).otherwise(docs["text"])
    out = joined.withColumn("_text", new)
    return out.select(*[
        F.col("_text").alias(c) if c == "text"
        else F.when(F.col("_spans").isNotNull(), F.length("_text").cast(docs.schema[c].dataType)).otherwise(docs[c]).alias(c)
        if c == "n_chars" else docs[c] for c in columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.sort_array(F.concat("base", "linked"))).alias("spans"))
