"""Document type configuration: prompts, labels, types, rules and table schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import values as V
from ..functions.core import json_map, lookup, small_table
from . import validate

RULE = "struct<required:boolean,min:string,max:string,date_min:string,date_max:string,pattern:string>"


def prompt_text(display_name: str, fields: list[str], rules_text: str = V.FORMATTING_RULES) -> str:
    return f"Extract the following fields from this {display_name.lower()}: {', '.join(fields)}. {rules_text}"


def _config_row(doc_type: str) -> tuple:
    spec = V.DOC_TYPES[doc_type]
    names = [f[0] for f in spec["fields"]]
    labels = {f"field_{i}": f[1] for i, f in enumerate(spec["fields"], 1)} | spec["meta_labels"]
    table = {"columns": [c for c, _ in spec["columns"]], "descriptions": [d for _, d in spec["columns"]]}
    review = {
        "correctable": spec["correctable"] or names,
        "display_order": names,
        "types": {f[0]: f[2] for f in spec["fields"]},
    }
    pack = lambda x: json.dumps(x, separators=(",", ":"))
    return (doc_type, spec["display_name"], prompt_text(spec["display_name"], names, spec["rules_text"]),
            pack(labels), pack(table), pack(review), pack(spec["validation"]), True)


def default_rows() -> list[tuple]:
    return [_config_row(t) for t in V.DOC_TYPES]


def default_config(spark: SparkSession) -> DataFrame:
    """The five document types known from the start."""
    return small_table(spark, default_rows(), schemas.DOC_TYPE_CONFIG)


# --- parsing ---------------------------------------------------------------------------------

def parse_fields(prompt: Column) -> Column:
    """Field names of a prompt: the list after the colon, before the formatting rules. NULL without one."""
    head = F.get(F.split(prompt, r"\.\s*FORMATTING\s+RULES", 2), F.lit(0))
    listed = F.regexp_extract(head, r":\s*(.+)$", 1)
    names = F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(x), r"\.+$", ""))
    return F.when(listed != "", F.array_distinct(names))


def comma_field_count(prompt: Column) -> Column:
    """Number of comma-separated parts of the whole prompt, formatting rules included."""
    return F.size(F.split(prompt, ","))


def field_types(review_fields: Column) -> Column:
    return F.coalesce(json_map(F.get_json_object(review_fields, "$.types")), F.expr("map()").cast("map<string,string>"))


def rules_list(validation_rules: Column) -> Column:
    """Rules as array of (field, rule), in the order of the JSON."""
    return F.transform(
        F.map_entries(json_map(validation_rules)),
        lambda e: F.struct(e["key"].alias("field"), F.from_json(e["value"], RULE).alias("rule")),
    )


def table_columns(schema: Column) -> Column:
    return F.from_json(F.get_json_object(schema, "$.columns"), "array<string>")


def plain_label(label: Column) -> Column:
    """Label for comparison: lower case, without a remark in parentheses."""
    return F.lower(F.trim(F.regexp_replace(label, r"\([^)]*\)", "")))


def listed_label(label: Column) -> Column:
    """A label as it stands in a list that commas separate."""
    return F.replace(label, F.lit(","), F.lit("\u0002"))


FIRST_LINE = "@first line"


def parsed(config: DataFrame) -> DataFrame:
    """Active types with everything the extraction job needs, ready to join on doc_type."""
    other = F.create_map(*[
        x for field, labels in V.OTHER_LABELS.items()
        for x in (F.lit(field), F.array(*[F.lit(label.lower()) for label in labels]))
    ])
    none = F.array().cast("array<string>")
    labels, types = json_map(F.col("field_labels")), field_types(F.col("review_fields"))

    def spec(name: Column, i: Column) -> Column:
        own = try_label(labels, i + 1)
        first = F.when(i == 0, F.array(F.lit(FIRST_LINE))).otherwise(none)
        return F.struct(
            name.alias("name"),
            F.coalesce(F.try_element_at(types, name), F.lit("VARCHAR")).alias("ftype"),
            F.transform(F.concat(F.array(plain_label(own)), F.coalesce(F.try_element_at(other, name), none), first), listed_label).alias("labels"),
        )

    names = parse_fields(F.col("extraction_prompt"))
    rules = F.coalesce(rules_list(F.col("validation_rules")), F.array().cast(f"array<struct<field:string,rule:{RULE}>>"))
    return config.where(F.coalesce(F.col("active"), F.lit(False)) & names.isNotNull()).select(
        "doc_type",
        F.transform(names, spec).alias("specs"),
        types.alias("types"),
        validate.typed_rules(rules, types, names).alias("rules"),
        table_columns(F.col("table_extraction_schema")).alias("table_cols"),
    )


def try_label(labels: Column, position: Column) -> Column:
    return F.try_element_at(labels, F.concat(F.lit("field_"), position.cast("string")))


def field_table(config: DataFrame) -> DataFrame:
    """One row per type and field: position, name, type, label."""
    return config.select(
        "doc_type", json_map(F.col("field_labels")).alias("l"), field_types(F.col("review_fields")).alias("t"),
        F.posexplode(parse_fields(F.col("extraction_prompt"))).alias("i", "field"),
    ).select(
        "doc_type", (F.col("i") + 1).alias("pos"), "field",
        F.coalesce(F.try_element_at("t", F.col("field")), F.lit("VARCHAR")).alias("ftype"),
        try_label(F.col("l"), F.col("i") + 1).alias("label"),
    )


def question(field: Column) -> Column:
    """Known question for a field, else one made from its name."""
    generic = F.concat(F.lit("What is the "), F.lower(F.replace(field, F.lit("_"), F.lit(" "))), F.lit("? Return the value."))
    return F.coalesce(lookup(V.QUESTIONS, field), generic)


# --- building --------------------------------------------------------------------------------

def from_fields(fields: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Config rows from a long table (doc_type, display_name, pos, name, label, type, correctable).

    ``type`` is Text, Number or Date. ``columns`` optionally holds (doc_type, pos, name, description).
    The groups are the fields of one document type, at most a request's worth of questions.
    """
    item = F.struct("pos", "name", "label", "type", F.coalesce("correctable", F.lit(True)).alias("correctable"))
    g = fields.groupBy("doc_type").agg(F.max("display_name").alias("display_name"),
                                       F.sort_array(F.collect_list(item)).alias("f"))

    def label_of(kind: str, index: int) -> Column:
        return F.try_element_at(F.filter("f", lambda x: x["type"] == kind), F.lit(index))["label"]

    numbered = F.map_from_entries(F.transform("f", lambda x, i: F.struct(
        F.concat(F.lit("field_"), (i + 1).cast("string")).alias("k"), x["label"].alias("v"))))
    meta = F.map_filter(F.create_map(
        F.lit("sender_label"), F.try_element_at("f", F.lit(1))["label"],
        F.lit("amount_label"), label_of("Number", -1),
        F.lit("date_label"), label_of("Date", -1),
        F.lit("reference_label"), label_of("Text", 2),
        F.lit("secondary_ref_label"), label_of("Text", 3),
    ), lambda k, v: v.isNotNull())
    names = F.transform("f", lambda x: x["name"])
    types = F.map_from_entries(F.transform("f", lambda x: F.struct(x["name"].alias("k"), F.when(
        x["type"] == "Number", "NUMBER").when(x["type"] == "Date", "DATE").otherwise("VARCHAR").alias("v"))))
    out = g.select(
        "doc_type", "display_name",
        F.concat(F.lit("Extract the following fields from this "), F.lower("display_name"), F.lit(": "),
                 F.concat_ws(", ", names), F.lit(". " + V.FORMATTING_RULES)).alias("extraction_prompt"),
        F.to_json(F.map_concat(numbered, meta)).alias("field_labels"),
        F.to_json(F.struct(
            F.transform(F.filter("f", lambda x: x["correctable"]), lambda x: x["name"]).alias("correctable"),
            types.alias("types"))).alias("review_fields"),
    )
    if columns is None:
        return out.withColumn("table_extraction_schema", F.lit(None).cast("string"))
    col = F.struct("pos", "name", F.coalesce("description", "name").alias("description"))
    schema = columns.groupBy("doc_type").agg(F.sort_array(F.collect_list(col)).alias("c")).select(
        "doc_type", F.to_json(F.struct(F.col("c.name").alias("columns"), F.col("c.description").alias("descriptions")))
        .alias("table_extraction_schema"))
    return out.join(schema, "doc_type", "left")


def add_types(config: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New types with their code cleaned (upper case, ``_`` for blanks): (config with them, rejected rows)."""
    clean = new.withColumn("doc_type", F.replace(F.upper(F.trim("doc_type")), F.lit(" "), F.lit("_")))
    invalid = (F.coalesce("doc_type", F.lit("")) == "") | (F.coalesce(F.trim("display_name"), F.lit("")) == "")
    known = config.select("doc_type")
    rejected = clean.where(invalid).withColumn("reason", F.lit("code and display name are required")).unionByName(
        clean.where(~invalid).join(known, "doc_type", "left_semi").withColumn("reason", F.lit("already exists")))
    accepted = clean.where(~invalid).join(known, "doc_type", "left_anti").dropDuplicates(["doc_type"])
    return config.unionByName(accepted.withColumn("active", F.lit(True)), allowMissingColumns=True), rejected


def set_active(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (doc_type, active[, updated_at]) changes."""
    from .tables import set_columns

    return set_columns(config, "doc_type", changes)


def summary(config: DataFrame) -> DataFrame:
    keys = F.filter(F.map_keys(json_map(F.col("field_labels"))), lambda k: k.startswith("field_"))
    return config.select("doc_type", "display_name", F.size(keys).alias("field_count"),
                         F.coalesce("active", F.lit(True)).alias("active"))


def attach(docs: DataFrame, config: DataFrame, default_type: str = "INVOICE") -> DataFrame:
    """Labels, types and table schema for each document, those of the default type where none exist."""
    default = config.where(F.col("doc_type") == default_type)
    wanted = {"labels": "field_labels", "review_fields": "review_fields", "table_schema": "table_extraction_schema"}
    names = config.select("doc_type", *[F.col(c).alias(a) for a, c in wanted.items()], F.lit(True).alias("has_config"))
    joined = docs.join(names, "doc_type", "left")
    filled = {a: F.when(F.col("has_config"), F.col(a)).otherwise(default.select(c).scalar()) for a, c in wanted.items()}
    return joined.withColumns({**filled, "has_config": F.coalesce("has_config", F.lit(False))})


def request_limits(raw: DataFrame, config: DataFrame) -> DataFrame:
    """Which documents exceed the request limits, with the questions their type asks."""
    asked = config.select(
        "doc_type", F.size(parse_fields(F.col("extraction_prompt"))).alias("entity_questions"),
        F.when(F.size(table_columns(F.col("table_extraction_schema"))) > 0, 1).otherwise(0).alias("table_questions"))
    total = F.col("entity_questions") + F.col("table_questions") * V.ENTITY_QUESTIONS_PER_TABLE
    return raw.join(asked, "doc_type").select(
        "file_name", "doc_type", total.alias("question_count"),
        (total <= V.MAX_ENTITY_QUESTIONS).alias("questions_ok"),
        (F.col("table_questions") <= V.MAX_TABLE_QUESTIONS).alias("tables_ok"),
        (F.col("page_count") <= V.MAX_PAGES).alias("pages_ok"),
        (F.col("file_size_bytes") <= V.MAX_FILE_BYTES).alias("size_ok"),
    )
