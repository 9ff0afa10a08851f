import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.core import plain_number
from tallyspark.operators import config, validate


def run(spark, values, types, rules):
    df = spark.createDataFrame([(values, types, json.dumps(rules) if rules is not None else None)],
                               "v map<string,string>, t map<string,string>, r string")
    out = df.select(validate.warnings(F.col("v"), F.col("t"), config.rules_list(F.col("r"))).alias("w")).first().w
    return [(w.field, w.rule, w.message) for w in out]


@pytest.mark.parametrize("values, types, rules, expected", [
    ({"x": "1"}, {"x": "NUMBER"}, None, []),
    ({"x": "1"}, {"x": "NUMBER"}, {}, []),
    ({"x": "1"}, {"x": "NUMBER"}, {"x": "bad"}, []),
    ({"n": "Acme"}, {}, {"n": {"required": True}}, []),
    ({"n": None}, {}, {"n": {"required": True}}, [("n", "required", "n is required but missing or empty")]),
    ({"n": " "}, {}, {"n": {"required": True}}, [("n", "required", "n is required but missing or empty")]),
    ({}, {}, {"n": {"required": True}}, [("n", "required", "n is required but missing or empty")]),
    ({"n": None}, {}, {"n": {"required": False}}, []),
    ({"a": "0"}, {"a": "NUMBER"}, {"a": {"required": True}}, []),
    ({"a": "0"}, {"a": "VARCHAR"}, {"a": {"required": True}}, [("a", "required", "a is required but missing or empty")]),
    ({"a": "50"}, {"a": "NUMBER"}, {"a": {"min": 0, "max": 100}}, []),
    ({"a": "0"}, {"a": "NUMBER"}, {"a": {"min": 0}}, []),
    ({"a": "-5"}, {"a": "NUMBER"}, {"a": {"min": 0}}, [("a", "min", "a=-5.0 is below minimum 0")]),
    ({"a": "200000"}, {"a": "NUMBER"}, {"a": {"max": 100000}}, [("a", "max", "a=200000.0 exceeds maximum 100000")]),
    ({"a": "12345678.5"}, {"a": "NUMBER"}, {"a": {"max": 10000000}}, [("a", "max", "a=12345678.5 exceeds maximum 10000000")]),
    ({"a": "1.2.3"}, {"a": "NUMBER"}, {"a": {"min": 5}}, []),
    ({"a": "3"}, {"a": "VARCHAR"}, {"a": {"min": 5}}, []),
    ({"d": "2019-12-31"}, {"d": "DATE"}, {"d": {"date_min": "2020-01-01"}}, [("d", "date_min", "d=2019-12-31 is before 2020-01-01")]),
    ({"d": "2031-01-01"}, {"d": "DATE"}, {"d": {"date_max": "2030-12-31"}}, [("d", "date_max", "d=2031-01-01 is after 2030-12-31")]),
    ({"d": "soon"}, {"d": "DATE"}, {"d": {"date_min": "2020-01-01"}}, []),
    ({"i": "INV-12x"}, {}, {"i": {"pattern": r"INV-\d+"}}, []),
    ({"i": "xINV-1"}, {}, {"i": {"pattern": r"INV-\d+"}}, [("i", "pattern", r"i=xINV-1 does not match pattern INV-\d+")]),
    ({"i": "b1"}, {}, {"i": {"pattern": "a|b"}}, []),
    ({"b": None, "a": "-1"}, {"a": "NUMBER"}, {"b": {"required": True}, "a": {"min": 0, "max": -2}},
     [("b", "required", "b is required but missing or empty"), ("a", "min", "a=-1.0 is below minimum 0"), ("a", "max", "a=-1.0 exceeds maximum -2")]),
])
def test_rules(spark, values, types, rules, expected):
    assert run(spark, values, types, rules) == expected


@pytest.mark.parametrize("value, ftype, warned, expected", [
    ("Acme", "VARCHAR", 0, 1.0), (None, "VARCHAR", 0, 0.1), ("  ", "VARCHAR", 0, 0.1), (None, "VARCHAR", 3, 0.1),
    ("100", "NUMBER", 0, 1.0), ("0", "NUMBER", 0, 0.9), ("0.00", "NUMBER", 0, 0.9), ("1.2.3", "NUMBER", 0, 0.7),
    ("2024-01-15", "DATE", 0, 1.0), ("Jan 15", "DATE", 0, 0.8), ("2024-1-5", "DATE", 0, 0.8),
    ("Acme", "VARCHAR", 1, 0.7), ("Acme", "VARCHAR", 2, 0.4), ("Acme", "VARCHAR", 4, 0.0), ("0", "NUMBER", 1, 0.6), ("x", "DATE", 1, 0.5)])
def test_score(spark, value, ftype, warned, expected):
    df = spark.createDataFrame([(value, ftype, warned)], "v string, t string, n int")
    assert df.select(validate.score(F.col("v"), F.col("t"), F.col("n"))).first()[0] == expected


@pytest.mark.parametrize("value, text", [(5.0, "5.0"), (0.1, "0.1"), (1e7, "10000000.0"), (-12.5, "-12.5"), (100.0, "100.0"), (0.0, "0.0")])
def test_plain_number(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(plain_number(F.col("v"))).first()[0] == text


def test_bands(spark):
    df = spark.createDataFrame([(0.8,), (0.5,), (0.49,)], "v double")
    assert [r[0] for r in df.select(validate.band(F.col("v"))).collect()] == ["HIGH", "MED", "LOW"]
