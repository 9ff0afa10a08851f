"""Value normalisation by declared type, and safe converters for review input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, lookup, to_any_date
from .values import AMOUNT_LIMIT, COMPANY_NAMES, NULL_WORDS, ORDINAL_SUFFIX, UNITS


def _strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _stripped(c: Column) -> Column:
    """``_strip`` of a bound value; most have nothing to strip, which one look finds out."""
    return F.when(c.rlike(r"^\s|\s$"), _strip(c)).otherwise(c)


def normalize_date(text: Column) -> Column:
    parsed = to_any_date(F.regexp_replace(text, ORDINAL_SUFFIX, "$1"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), text)


def normalize_number(text: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(text, UNITS, ""), r"[^0-9.\-]", "")
    return let(digits, lambda x: F.when(x.isin("", ".", "-"), F.lit("0")).otherwise(x))


def normalize(value: Column, ftype: Column) -> Column:
    """Text of a field in its canonical form.

    NUMBER: digits, dot and minus; ``"0"`` when missing. DATE: ISO, or the text unchanged when no
    form fits. Anything else: trimmed text. Missing and null words give NULL except for NUMBER.
    """
    def canonical(text: Column) -> Column:
        present = (
            F.when(ftype == "NUMBER", normalize_number(text))
            .when(ftype == "DATE", normalize_date(text))
            .otherwise(text)
        )
        missing = text.isNull() | F.lower(text).isin(*NULL_WORDS)
        return F.when(missing, F.when(ftype == "NUMBER", F.lit("0"))).otherwise(present)

    return let(let(value, _stripped), canonical)


def company_name(value: Column) -> Column:
    """Full name for a known abbreviation, else the value unchanged."""
    return F.coalesce(lookup(COMPANY_NAMES, F.lower(_strip(value))), value)


def safe_text(c: Column) -> Column:
    text = _strip(c.cast("string"))
    return F.when(text != "", text)


def safe_number(c: Column) -> Column:
    """Double within the amount range, else NULL."""
    number = _strip(c.cast("string")).try_cast("double")
    limit = F.lit(float(AMOUNT_LIMIT))
    return F.when(~F.isnan(number) & (F.abs(number) <= limit), number)


def safe_date(c: Column) -> Column:
    """Any known date form, with or without a time after it, as ISO text; else NULL."""
    text = F.regexp_replace(_strip(c.cast("string")), r"[T ]\d{1,2}:\d{2}.*$", "")
    return F.date_format(to_any_date(text), "yyyy-MM-dd")


def change_text(c: Column) -> Column:
    """Comparable text of a cell: trimmed, empty for NULL."""
    return F.coalesce(_strip(c.cast("string")), F.lit(""))
