"""Tables in texts: headers by name, in any order, several in one document."""

from pyspark.sql import functions as F

from tallyspark.operators import extract

COLS = ["Line", "Product", "Qty", "Total"]


def read(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("table_cols", F.array(*map(F.lit, COLS)))
    return [r.line_items for r in extract.tables(df).orderBy("i").collect()]


def test_columns_by_name(spark):
    a, b = read(spark, "x\nLine | Product | Qty | Total\n1 | pen | 2 | $3\n2 | ink |  | $4\nend",
                "total | QTY | Line | Product\n$3 | 2 | 1 | pen")
    assert a == {"Line": ["1", "2"], "Product": ["pen", "ink"], "Qty": ["2", ""], "Total": ["$3", "$4"]}
    assert b == {"Line": ["1"], "Product": ["pen"], "Qty": ["2"], "Total": ["$3"]}


def test_two_tables(spark):
    got, = read(spark, "Line | Product | Qty | Total\n1 | pen | 2 | $3\n\nShipping: later\n\nProduct | Total | Line\nink | $4 | 2\n\nnib | $5 | 3")
    assert got == {"Line": ["1", "2", "3"], "Product": ["pen", "ink", "nib"], "Qty": ["2", None, None], "Total": ["$3", "$4", "$5"]}


def test_unknown_names_go_by_place(spark):
    got, = read(spark, "# | Product | Qty | Total\n1 | pen | 2 | $3")
    assert got["Line"] == ["1"] and got["Total"] == ["$3"]
    got, = read(spark, "a | b | c\n1 | pen | 2")  # no header known: the first line is one, columns by position
    assert got == {"Line": ["1"], "Product": ["pen"], "Qty": ["2"], "Total": [None]}


def test_words_of_a_row_do_not_make_it_a_header(spark):
    got, = read(spark, "Line | Product | Qty | Total\n1 | Total | 2 | $3\n2 | Line | 5 | $4")
    assert got["Product"] == ["Total", "Line"]


def test_no_table(spark):
    none, only_header, null = read(spark, "nothing here", "Line | Product | Qty | Total", None)
    assert none == {c: [] for c in COLS} and only_header == {c: [] for c in COLS}
    assert null is None or null == {c: None for c in COLS}
