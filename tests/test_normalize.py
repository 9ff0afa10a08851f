import pytest
from pyspark.sql import functions as F

from tallyspark.functions.normalize import change_text, company_name, normalize, safe_date, safe_number, safe_text

# (value, type, canonical text)
CASES = [
    ("2024-01-15", "DATE", "2024-01-15"), ("01/15/2024", "DATE", "2024-01-15"), ("01-15-2024", "DATE", "2024-01-15"),
    ("15/01/2024", "DATE", "2024-01-15"), ("1/5/2024", "DATE", "2024-01-05"), ("January 15, 2024", "DATE", "2024-01-15"),
    ("Jan 15, 2024", "DATE", "2024-01-15"), ("January 15 2024", "DATE", "2024-01-15"), ("Jan 15 2024", "DATE", "2024-01-15"),
    ("15 January 2024", "DATE", "2024-01-15"), ("15 Jan 2024", "DATE", "2024-01-15"), ("2024/01/15", "DATE", "2024-01-15"),
    ("January 1st, 2024", "DATE", "2024-01-01"), ("March 22nd, 2024", "DATE", "2024-03-22"), ("May 3rd, 2024", "DATE", "2024-05-03"),
    ("4th July 2024", "DATE", "2024-07-04"), ("MARCH 5, 2024", "DATE", "2024-03-05"), ("may 5 2024", "DATE", "2024-05-05"),
    ("March  5,  2024", "DATE", "2024-03-05"), ("2024-02-30", "DATE", "2024-02-30"), ("not-a-date", "DATE", "not-a-date"),
    ("13/13/2024", "DATE", "13/13/2024"), ("  2024-01-15\t", "DATE", "2024-01-15"), ("n/a", "DATE", None), (None, "DATE", None),
    ("123.45", "NUMBER", "123.45"), ("$1,234.56", "NUMBER", "1234.56"), ("898 kWh", "NUMBER", "898"), ("45.2 kW", "NUMBER", "45.2"),
    ("85%", "NUMBER", "85"), ("-12.34", "NUMBER", "-12.34"), ("0", "NUMBER", "0"), (None, "NUMBER", "0"), ("", "NUMBER", "0"),
    ("NULL", "NUMBER", "0"), ("None", "NUMBER", "0"), (".", "NUMBER", "0"), ("-", "NUMBER", "0"), ("abc", "NUMBER", "0"),
    ("  hello world  ", "VARCHAR", "hello world"), ("N/A", "VARCHAR", None), ("", "VARCHAR", None), ("PSE&G", "VARCHAR", "PSE&G"),
    ("2024-01-15", "VARCHAR", "2024-01-15"), ("héllo ☃", "VARCHAR", "héllo ☃"),
]


def test_normalize_cases(spark):
    df = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(CASES)], "i int, v string, t string")
    got = {r.i: r.n for r in df.select("i", normalize(F.col("v"), F.col("t")).alias("n")).collect()}
    assert {i: (CASES[i], got[i]) for i in got if got[i] != CASES[i][2]} == {}


@pytest.mark.parametrize("short, full", [
    ("PSE&G", "Public Service Electric and Gas"), ("  pse&g ", "Public Service Electric and Gas"), ("Con Ed", "Consolidated Edison"),
    ("O&R", "Orange and Rockland Utilities"), ("National Grid", "National Grid"), ("Acme", "Acme"), ("", ""), (None, None)])
def test_company_name(spark, short, full):
    df = spark.createDataFrame([(short,)], "v string")
    assert df.select(company_name(F.col("v"))).first()[0] == full


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("value, text", [("  hello ", "hello"), ("   ", None), (None, None), ("0", "0")])
def test_safe_text(spark, value, text):
    assert one(spark, value, safe_text) == text


@pytest.mark.parametrize("value, number", [
    ("99.50", 99.5), (" -5.5 ", -5.5), ("abc", None), ("", None), ("9999999999.99", 9999999999.99),
    ("-9999999999.99", -9999999999.99), ("10000000000", None), ("NaN", None), (None, None)])
def test_safe_number(spark, value, number):
    assert one(spark, value, safe_number) == number


@pytest.mark.parametrize("value, day", [
    ("2025-03-15", "2025-03-15"), ("03/15/2025", "2025-03-15"), ("2025-01-15 14:30:00", "2025-01-15"), ("2025-13-01", None),
    ("soon", None), ("", None), ("1970-01-01", "1970-01-01"), ("2099-12-31", "2099-12-31"), (None, None)])
def test_safe_date(spark, value, day):
    assert one(spark, value, safe_date) == day


def test_change_text(spark):
    assert one(spark, None, change_text) == "" and one(spark, "  x ", change_text) == "x"
