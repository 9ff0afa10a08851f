"""Rule checks, confidence scores and the mapping preview, all as row-local expressions.

Inputs are columns of one document: ``normalized`` (array of name, ftype, value), ``values`` (map of
name to value), ``types`` (map) and ``rules`` (array of field, rule) as made by ``config.rules_list``. What a rule says
of itself (``typed_rules``) is worked out once per type in ``config.parsed``. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import blank, let, plain_number, to_iso_date

WARNING = "struct<field:string,rule:string,message:string>"


def values_map(normalized: Column) -> Column:
    return F.map_from_arrays(normalized["name"], normalized["value"])


def typed_rules(rules: Column, types: Column, names: Column | None = None) -> Column:
    """``rules`` with the type of their field, their bounds as numbers and dates, the whole pattern, and the field's
    place (from 0) among ``names``, NULL without."""
    def typed(r: Column) -> Column:
        field, rule = r["field"], r["rule"]
        place = F.lit(None).cast("int") if names is None else F.nullif(F.array_position(names, field), F.lit(0)).cast("int") - 1
        return F.struct(
            field.alias("field"), rule.alias("rule"), place.alias("place"),
            F.coalesce(F.try_element_at(types, field), F.lit("VARCHAR")).alias("ftype"),
            rule["min"].try_cast("double").alias("low"), rule["max"].try_cast("double").alias("high"),
            to_iso_date(rule["date_min"]).alias("first"), to_iso_date(rule["date_max"]).alias("last"),
            # a pattern counts from the start of the value but need not reach its end
            F.concat(F.lit("^(?:"), rule["pattern"], F.lit(")")).alias("regex"))

    return F.transform(rules, typed)


def _rule_warnings(typed: Column, value: Column) -> Column:
    field, rule, ftype = typed["field"], typed["rule"], typed["ftype"]

    def warn(condition: Column, name: str, *message: Column | str) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        return F.when(condition, F.struct(field.alias("field"), F.lit(name).alias("rule"), text.alias("message")))

    def checks(v: Column) -> Column:
        empty = v.isNull() | blank(v) | ((v == "0") & (ftype != "NUMBER"))
        number = F.when(ftype == "NUMBER", v.try_cast("double"))
        day = F.when(ftype == "DATE", to_iso_date(v))
        found = F.array_compact(F.array(
            warn(rule["required"] & empty, "required", field, " is required but missing or empty"),
            warn(number < typed["low"], "min", field, "=", plain_number(number), " is below minimum ", rule["min"]),
            warn(number > typed["high"], "max", field, "=", plain_number(number), " exceeds maximum ", rule["max"]),
            warn(day < typed["first"], "date_min", field, "=", v, " is before ", rule["date_min"]),
            warn(day > typed["last"], "date_max", field, "=", v, " is after ", rule["date_max"]),
            warn(~F.regexp_like(v, typed["regex"]), "pattern", field, "=", v, " does not match pattern ", rule["pattern"]),
        ))
        # most rules hold: messages are made only of those that do not
        outside = F.when(ftype == "NUMBER", let(v.try_cast("double"), lambda n: (n < typed["low"]) | (n > typed["high"]))) \
            .when((ftype == "DATE") & (typed["first"].isNotNull() | typed["last"].isNotNull()),
                  let(to_iso_date(v), lambda d: (d < typed["first"]) | (d > typed["last"])))
        broken = (rule["required"] & empty) | outside | ~F.regexp_like(v, typed["regex"])
        return F.when(broken, found).otherwise(F.array().cast(f"array<{WARNING}>"))

    return let(value, checks)


def typed_warnings(typed: Column, value_of: Callable[[Column], Column]) -> Column:
    """Flags for review as array of (field, rule, message), in the order of the ``typed_rules``."""
    found = F.transform(typed, lambda r: _rule_warnings(r, value_of(r)))
    return F.coalesce(F.flatten(found), F.array().cast(f"array<{WARNING}>"))


def warnings(values: Column, types: Column, rules: Column) -> Column:
    """The flags of plain ``rules``."""
    return let(typed_rules(rules, types), lambda typed: typed_warnings(typed, lambda r: F.try_element_at(values, r["field"])))


def score(value: Column, ftype: Column, warning_count: Column) -> Column:
    """0.0 .. 1.0: 0.1 when missing; otherwise 1.0 less a part for zero, unreadable or flagged values."""
    def minus(condition: Column, hundredths: int) -> Column:
        return F.when(condition, F.lit(hundredths)).otherwise(F.lit(0))

    def scored(v: Column) -> Column:
        unreadable = let(v.try_cast("double"), lambda n: F.when(n.isNull(), F.lit(30)).otherwise(minus(n == 0, 10)))
        own = F.when(ftype == "NUMBER", unreadable).when(
            ftype == "DATE", minus(~v.rlike(r"^\d{4}-\d{2}-\d{2}$"), 20)).otherwise(F.lit(0))
        left = F.greatest(F.lit(100) - own - warning_count * 30, F.lit(0)) / 100
        missing = v.isNull() | blank(v)
        return F.when(missing, F.lit(0.1)).otherwise(left)

    return let(value, scored)


def confidence(normalized: Column, found: Column) -> Column:
    """Map of field name to score."""
    def scores(flagged: Column) -> Column:
        count = lambda name: F.when(F.size(flagged) == 0, F.lit(0)).otherwise(
            F.size(F.filter(flagged, lambda field: field == name)))
        return F.transform(normalized, lambda x: score(x["value"], x["ftype"], count(x["name"])))

    return F.map_from_arrays(normalized["name"], let(found["field"], scores))


def band(value: Column) -> Column:
    return F.when(value >= 0.8, "HIGH").when(value >= 0.5, "MED").otherwise("LOW")


def physical_type(position: Column) -> Column:
    """Type of the stored column at a 1-based position, whatever the field means."""
    return F.when(position.isin(4, 5), "DATE").when(position.isin(8, 9, 10), "NUMBER").otherwise("VARCHAR")


def mapping_preview(long: DataFrame) -> DataFrame:
    """How each field (pos, field, ftype, raw, normalized) of a document would be stored."""
    pos, value = F.col("pos"), F.col("normalized")
    phys = physical_type(pos)
    present = F.coalesce(value, F.lit("")) != ""
    conf = score(value, F.col("ftype"), F.lit(0))
    bad = F.when((phys == "DATE") & present & ~value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "bad format") \
        .when((phys == "NUMBER") & present & value.try_cast("double").isNull(), "non-numeric")
    return long.select(
        *[c for c in long.columns if c not in ("pos", "field", "ftype", "raw", "normalized")],
        F.when(pos <= 10, F.concat(F.lit("field_"), pos.cast("string"))).otherwise("raw_extraction (overflow)").alias("target_column"),
        "field", F.coalesce("raw", F.lit("(null)")).alias("raw_value"),
        F.coalesce(value, F.lit("(null)")).alias("normalized"), phys.alias("db_type"),
        F.when(bad.isNotNull(), F.concat(F.lit("NULL ("), bad, F.lit(": "), value, F.lit(")")))
        .when(present, value).otherwise("(NULL)").alias("cast_preview"),
        conf.alias("confidence"), band(conf).alias("confidence_band"),
        ((pos <= 10) & (bad.isNotNull() | ~present)).alias("casts_to_null"),
    )
