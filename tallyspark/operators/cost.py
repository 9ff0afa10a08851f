"""Usage and cost of extraction calls, attributed to documents and document types.

Inputs: ``usage`` (query_id, start_time, function_name, credits, metrics JSON), ``queries`` (query_id,
query_text, total_elapsed_time in ms, rows_produced), ``metering`` (start_time, resource, credits_used),
``raw`` (registry) and ``fields`` (results). ``as_of`` stands for the current time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import correlation, let, mean_of, one_row, rate, since, small_table
from ..functions.values import TOKENS_PER_PAGE
from ..session import shared_dir

UNKNOWN = "UNKNOWN"
#: Most characters of an anchor of a name; anchors under ``SHORT`` characters are taken if that saves ``CHANCE`` times the
#: forms for each character they lack.
PIECE, SHORT, CHANCE = 12, 4, 16
#: So many windows per occurrence of an anchor are not avoided.
WINDOWS = 8


def tokens(metrics: Column) -> Column:
    """Token count of the first metric."""
    return F.get_json_object(metrics, "$[0].value").try_cast("long")


def calls(usage: DataFrame, function_name: str, as_of: Column, days: int = 90) -> DataFrame:
    """Calls of one function in the last ``days`` days, with their token count."""
    return (
        usage.where((F.col("function_name") == function_name) & since(F.col("start_time"), as_of, days))
        .select("query_id", "start_time", F.col("credits").alias("ai_credits"), tokens(F.col("metrics")).alias("tokens"))
    )


def with_queries(call_df: DataFrame, queries: DataFrame) -> DataFrame:
    seconds = (F.col("total_elapsed_time").cast("decimal(18,3)") / 1000).cast("decimal(18,3)")
    text = queries.select("query_id", "query_text", seconds.alias("elapsed_sec"), "rows_produced")
    return call_df.join(text, "query_id", "left")


# --- which documents a call is about ---------------------------------------------------------------

def _name_forms(docs: DataFrame) -> DataFrame:
    """(_anchor, _end, _len, _mask): how to find names in a text.

    A name is made of runs between its underscores; the anchor is the last ``PIECE`` characters of one of them, which
    ends at place ``_end``. Names of one shape (length, places of ``_``) take the same run: wherever its anchor occurs in
    a text, a window is cut for every shape that shares the anchor, so a run that few shapes share is taken (see
    ``SHORT``), up to ``WINDOWS`` of them counting alike; of those, the run with the fewest different anchors, which for
    names of one pattern is the part they have in common.
    """
    chars = F.transform(F.split("_name", ""), lambda c, i: F.when(c == "_", i + 1))
    shaped = docs.select("_name", F.length("_name").alias("_len"), F.array_compact(chars).alias("_mask")).where("_len > 0")
    ends = F.concat(F.transform("_mask", lambda p: p - 1), F.array("_len"))
    runs = shaped.select("*", F.explode(ends).alias("_end")).select(
        F.expr(f"right(substring_index(left(_name, _end), '_', -1), {PIECE})").alias("_anchor"), "_end", "_len", "_mask").distinct()
    shared = runs.groupBy("_anchor").agg(F.count("*").alias("_forms"))
    size = F.length("_anchor")
    # a short anchor is met by chance as well: each character under SHORT counts like so many times the forms
    cost = F.col("_forms") * F.pow(F.lit(CHANCE), F.greatest(SHORT - size, F.lit(0)))
    by_run = runs.join(shared, "_anchor").groupBy("_len", "_mask", "_end").agg(
        F.min(size).alias("_least"), F.greatest(F.max(cost), F.lit(WINDOWS)).alias("_cost"), F.count("*").alias("_n"))
    best = by_run.groupBy("_len", "_mask").agg(
        F.min_by("_end", F.struct(F.col("_least") == 0, "_cost", "_n", -F.col("_least"), "_end")).alias("_end"))
    return runs.join(best, ["_len", "_mask", "_end"]).select("_anchor", "_end", "_len", "_mask")


def _pieces(text: Column, lengths: Column, letters: Column) -> Column:
    """Every piece of the text with one of the lengths and no other letters, with the position it ends at."""
    def piece(t: Column, end: Column, k: Column) -> Column:
        return F.substring(t, end - k + 1, k)

    def of_length(t: Column, k: Column) -> Column:
        ends = F.filter(F.sequence(k, F.length(t)), lambda end: F.call_function("translate", piece(t, end, k), letters, F.lit("")) == "")
        return F.transform(ends, lambda end: F.struct(end.alias("at"), piece(t, end, k).alias("anchor")))

    return let(text, lambda t: F.flatten(F.transform(F.filter(lengths, lambda k: k <= F.length(t)), lambda k: of_length(t, k))))


def _places(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(query_id, _start, _len, _mask): where a text has the anchor of a form."""
    lengths = forms.agg(F.collect_set(F.length("_anchor"))).scalar()  # at most PIECE + 1 numbers
    letters = forms.select(F.explode(F.split("_anchor", "")).alias("_c")).distinct().agg(  # an alphabet
        F.array_join(F.collect_set("_c"), "")).scalar()
    found = texts.withColumn("_ks", lengths).withColumn("_cs", letters).select(
        "query_id", F.explode_outer(_pieces(F.col("_t"), F.col("_ks"), F.col("_cs"))).alias("_a"))
    return (
        found.select("query_id", F.col("_a.at").alias("_at"), F.col("_a.anchor").alias("_anchor")).join(forms, "_anchor")
        .withColumn("_start", F.col("_at") - F.col("_end") + 1).where("_start >= 1")
        .select("query_id", "_start", "_len", "_mask").distinct()
    )


def match_documents(call_df: DataFrame, raw: DataFrame, columns: list[str]) -> DataFrame:
    """Left join of calls to the documents whose file name occurs in the query text, ignoring case.

    The condition is ``query_text ILIKE '%' || file_name || '%'``: ``_`` in a name stands for any
    character, a text that holds several names counts for each, a text without any stays with NULLs.

    Names have forms (length, places of ``_``), which are written to the shared folder once. Wherever the anchor of a form (see ``_name_forms``) occurs in a text, the
    piece with the form's length is cut out, masked like the names of that form, and compared with them for equality, all
    by joins on equal keys. Names must not hold ``%`` or backslashes, which ``ingest.sanitize`` removes; equal query ids
    have equal texts.
    """
    docs = raw.select(F.lower("file_name").alias("_name"), "file_name", *[c for c in columns if c != "file_name"])
    texts = call_df.where(F.length("query_text") > 0).select("query_id", F.lower("query_text").alias("_t")).distinct()
    window = F.substring("_t", F.col("_start"), F.col("_len"))
    masked = F.aggregate("_mask", window, lambda w, p: F.overlay(w, F.lit("_"), p, F.lit(1)))
    path = shared_dir(raw.sparkSession, "name-forms")
    forms = _name_forms(docs)
    forms.write.parquet(path)
    forms = raw.sparkSession.read.schema(forms.schema).parquet(path)
    found = _places(texts, forms).join(texts, "query_id").where(
        "_start + _len - 1 <= length(_t)").select("query_id", masked.alias("_name")).distinct()
    return call_df.join(found.join(docs, "_name").drop("_name"), "query_id", "left")


# --- daily usage -----------------------------------------------------------------------------------

def daily(usage: DataFrame, metering: DataFrame, fields: DataFrame, function_name: str, warehouse: str,
          as_of: Column) -> DataFrame:
    """Calls, credits, tokens, warehouse credits and documents per day, 0 where a source has none."""
    day = lambda c: F.to_date(c).alias("usage_date")
    ai = calls(usage, function_name, as_of).groupBy(day("start_time")).agg(
        F.sum("ai_credits").alias("ai_credits"), F.count("*").alias("ai_calls"), F.sum("tokens").alias("total_tokens"))
    wh = metering.where((F.col("resource") == warehouse) & since(F.col("start_time"), as_of, 90)).groupBy(
        day("start_time")).agg(F.sum("credits_used").alias("warehouse_credits"))
    docs = fields.where(F.col("extracted_at").isNotNull()).groupBy(day("extracted_at")).agg(
        F.count("*").alias("docs_extracted"))
    joined = ai.join(wh, "usage_date", "full").join(docs, "usage_date", "full")
    zero = {c: 0 for c in ("ai_credits", "ai_calls", "total_tokens", "docs_extracted", "warehouse_credits")}
    return joined.fillna(zero).select("usage_date", *zero).orderBy(F.desc("usage_date"))


def per_document(daily_df: DataFrame) -> DataFrame:
    """Credits per call for days with calls."""
    return daily_df.where("ai_calls > 0").select(
        "usage_date", "ai_credits", "ai_calls", "total_tokens", "docs_extracted",
        rate(F.col("ai_credits"), F.col("ai_calls"), 6).alias("credits_per_doc"))


def by_doc_type(usage: DataFrame, queries: DataFrame, raw: DataFrame, function_name: str, as_of: Column) -> DataFrame:
    matched = match_documents(with_queries(calls(usage, function_name, as_of), queries), raw, ["doc_type"])
    return (
        matched.groupBy(F.coalesce("doc_type", F.lit(UNKNOWN)).alias("doc_type"),
                        F.to_date("start_time").alias("usage_date"))
        .agg(
            F.count("*").alias("call_count"),
            F.round(F.sum("ai_credits"), 6).alias("ai_credits"),
            F.sum("tokens").alias("total_tokens"),
            F.round(F.sum("elapsed_sec"), 1).alias("total_elapsed_sec"),
            mean_of("elapsed_sec", 1).alias("avg_elapsed_sec"),
        )
        .orderBy(F.desc("usage_date"), "doc_type")
    )


def call_log(usage: DataFrame, queries: DataFrame, raw: DataFrame, function_name: str, as_of: Column,
             n: int = 500) -> DataFrame:
    """The newest calls of the last 30 days with their document type."""
    matched = match_documents(with_queries(calls(usage, function_name, as_of, 30), queries), raw, ["doc_type"])
    return matched.orderBy(F.desc("start_time"), "query_id", "file_name").limit(n).select(
        "query_id", "start_time", "ai_credits", "tokens", F.coalesce("doc_type", F.lit(UNKNOWN)).alias("doc_type"),
        "elapsed_sec", "rows_produced", "query_text")


def summary(usage: DataFrame, metering: DataFrame, fields: DataFrame, function_name: str, warehouse: str,
            as_of: Column) -> DataFrame:
    """Headline row over 7, 30 and 90 days; each table is read once."""
    def within(value: str, days: int) -> Column:
        c = F.col(value)
        return F.sum(c if days == 90 else F.when(since(F.col("start_time"), as_of, days), c).otherwise(0))

    spans = (7, 30, 90)
    ai = calls(usage, function_name, as_of).agg(
        *[within("ai_credits", d).alias(f"_c{d}") for d in spans],
        *[within("tokens", d).alias(f"tokens_{d}d") for d in spans],
        F.count("*").alias("total_calls"))
    wh = metering.where((F.col("resource") == warehouse) & since(F.col("start_time"), as_of, 90)).agg(
        *[F.round(within("credits_used", d), 4).alias(f"wh_credits_last_{d}d") for d in spans])
    docs = fields.agg(F.count("*").alias("unique_docs"))
    return one_row(ai, wh, docs).select(
        *[F.round(f"_c{d}", 4).alias(f"ai_credits_last_{d}d") for d in spans],
        *[f"tokens_{d}d" for d in spans], "total_calls", "unique_docs",
        F.coalesce(rate(F.col("_c90"), F.col("total_calls"), 6), F.lit(0.0)).alias("avg_credits_per_doc"),
        F.coalesce(rate(F.col("_c90"), F.col("unique_docs"), 6), F.lit(0.0)).alias("amortized_credits_per_unique_doc"),
        *[f"wh_credits_last_{d}d" for d in spans],
    )


def breakdown(metering_daily: DataFrame, services: list[str], as_of_day: Column) -> DataFrame:
    return (
        metering_daily.where(F.col("service_type").isin(services) & since(F.col("usage_date"), as_of_day, 90))
        .select("usage_date", "service_type", F.round("credits_used", 4).alias("credits_used"),
                F.round("credits_billed", 4).alias("credits_billed"))
        .orderBy(F.desc("usage_date"), "service_type")
    )


# --- attribution -----------------------------------------------------------------------------------

def per_call_detail(usage: DataFrame, queries: DataFrame, raw: DataFrame, field_counts: DataFrame,
                    function_name: str, as_of: Column) -> DataFrame:
    """Each call with the document it is about, its size and its cost per page."""
    matched = match_documents(with_queries(calls(usage, function_name, as_of), queries), raw,
                              ["doc_type", "page_count", "file_size_bytes"])
    return (
        matched.where(F.col("file_name").isNotNull()).join(field_counts, "doc_type", "left")
        .select("query_id", "start_time", "file_name", "doc_type", "page_count", "file_size_bytes", "ai_credits",
                "tokens", "elapsed_sec", "field_count",
                rate(F.col("ai_credits"), F.col("page_count"), 6).alias("credits_per_page"),
                rate(F.col("tokens"), F.col("page_count"), 0).alias("tokens_per_page"))
    )


def drivers(detail: DataFrame) -> DataFrame:
    avg = mean_of
    return detail.groupBy("doc_type").agg(
        F.count("*").alias("total_calls"),
        avg("page_count", 1).alias("avg_pages"),
        avg("file_size_bytes", 0).alias("avg_file_size"),
        avg("tokens", 0).alias("avg_tokens"),
        avg("ai_credits", 6).alias("avg_credits"),
        avg("credits_per_page", 6).alias("avg_credits_per_page"),
        avg("tokens_per_page", 0).alias("avg_tokens_per_page"),
        F.avg("field_count").alias("fields_extracted"),
        avg("elapsed_sec", 1).alias("avg_elapsed_sec"),
        F.round(correlation(F.col("page_count"), F.col("tokens")), 4).alias("page_token_correlation"),
        F.round(correlation(F.col("tokens"), F.col("ai_credits")), 4).alias("token_credit_correlation"),
    ).orderBy(F.desc_nulls_first("avg_credits"), "doc_type")


def driver_means(drivers_df: DataFrame) -> DataFrame:
    """Unweighted means over document types; types without a correlation do not count for it."""
    return drivers_df.agg(*[F.round(F.avg(c), 6).alias(c) for c in (
        "avg_credits_per_page", "avg_tokens_per_page", "token_credit_correlation", "page_token_correlation")])


# upper bound (exclusive), name
TOKEN_RANGES = [(1500, "< 1.5K tokens"), (3000, "1.5K - 3K"), (6000, "3K - 6K"), (15000, "6K - 15K"), (None, "15K+ tokens")]


def token_histogram(call_df: DataFrame) -> DataFrame:
    position = F.lit(len(TOKEN_RANGES))
    for i in range(len(TOKEN_RANGES) - 1, 0, -1):
        position = F.when(F.col("tokens") < TOKEN_RANGES[i - 1][0], F.lit(i)).otherwise(position)
    name = F.get(F.array(*[F.lit(n) for _, n in TOKEN_RANGES]), F.col("sort_order") - 1)
    return call_df.groupBy(position.alias("sort_order")).agg(
        F.count("*").alias("calls"),
        mean_of("ai_credits", 6).alias("avg_credits"),
        F.round(F.min("ai_credits"), 6).alias("min_credits"),
        F.round(F.max("ai_credits"), 6).alias("max_credits"),
        mean_of("tokens", 0).alias("avg_tokens"),
    ).withColumn("token_range", name).orderBy("sort_order")


def document_confidence(payloads: DataFrame) -> DataFrame:
    """Mean score per document from the stored payload (file_name, doc_type, raw_extraction); row-local."""
    scores = F.map_values(F.from_json(F.get_json_object("raw_extraction", "$._confidence"), "map<string,double>"))
    # scores have two decimals: an exact sum does not depend on their order
    total = F.aggregate("_s", F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x.cast("decimal(4,2)")).cast("decimal(18,2)"))
    return payloads.withColumn("_s", scores).where(F.size("_s") > 0).select(
        "file_name", "doc_type", F.size("_s").alias("n_fields"),
        F.round(total.cast("double") / F.size("_s"), 6).alias("avg_confidence"))


def confidence_and_cost(conf: DataFrame, detail: DataFrame) -> DataFrame:
    """Scored documents that have at least one costed call."""
    cost = detail.where(F.col("ai_credits").isNotNull()).select("file_name", "ai_credits", "tokens", "page_count")
    return conf.join(cost, "file_name")


def confidence_by_type(joined: DataFrame, low: float = 0.7) -> DataFrame:
    return joined.groupBy("doc_type").agg(
        F.round(F.avg("avg_confidence"), 6).alias("avg_confidence"),
        mean_of("ai_credits").alias("avg_credits"),
        F.count("file_name").alias("doc_count"),
        F.count_if(F.col("avg_confidence") < low).alias("low_confidence"),
    )


def credits_by_type(detail: DataFrame, as_of: Column, days: int) -> DataFrame:
    return (
        detail.where(since(F.col("start_time"), as_of, days)).groupBy("doc_type")
        .agg(F.count("*").alias("calls"), F.round(F.sum("ai_credits"), 6).alias("total_credits"),
             F.sum("tokens").alias("tokens"))
        .orderBy(F.desc_nulls_first("total_credits"), "doc_type")
    )


def resource_daily(metering: DataFrame, resource: str, as_of: Column, days: int) -> DataFrame:
    return (
        metering.where((F.col("resource") == resource) & since(F.col("start_time"), as_of, days))
        .groupBy(F.to_date("start_time").alias("usage_date"))
        .agg(F.sum("credits_used").alias("credits"))
        .orderBy("usage_date")
    )


def resource_totals(metering: DataFrame, resources: list[str], as_of: Column, days: int, rate_per_credit: float = 0.0) -> DataFrame:
    """Credits of each resource over the days, and in currency if there is a rate; one row per resource, unused ones with 0."""
    used = metering.where(F.col("resource").isin(resources) & since(F.col("start_time"), as_of, days))
    per_day = used.groupBy("resource", F.to_date("start_time").alias("_day")).agg(F.sum("credits_used").alias("_c"))
    totals = per_day.groupBy("resource").agg(F.sum("_c").alias("credits"), F.count("*").alias("days_used"))
    all_of = small_table(metering.sparkSession, [(r,) for r in resources], "resource string")
    return in_currency(all_of.join(totals, "resource", "left").fillna(0, ["credits", "days_used"]), "credits", rate_per_credit, "estimate")


def in_currency(df: DataFrame, credits_col: str, rate_per_credit: float, out: str) -> DataFrame:
    """Add an estimate in currency; without a positive rate the frame stays as it is."""
    return df if rate_per_credit <= 0 else df.withColumn(out, F.round(F.col(credits_col) * rate_per_credit, 2))


def estimate(docs: DataFrame, credits_per_token: float, prompt_tokens: int, output_tokens: int) -> DataFrame:
    """Expected tokens and credits per document from its page count."""
    total = F.col("page_count") * TOKENS_PER_PAGE + prompt_tokens + output_tokens
    return docs.select("file_name", "doc_type", "page_count", total.cast("long").alias("estimated_tokens"),
                       F.round(total * F.lit(credits_per_token), 6).alias("estimated_credits"))
