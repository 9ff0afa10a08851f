"""From document text to typed rows.

The default extractor reads labelled lines and pipe-separated tables out of the text with built-in
expressions. A model can be plugged in with ``with_model``. Every later step is row-local: one
document stays one row from its text to its stored payload, and no step shuffles. Jobs deal documents
over the tasks (``dealt``) before they read them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.core import blank, built_once, clean_amount, json_map, json_number_text, let, to_iso_date, trimmed
from ..functions.normalize import company_name, normalize
from . import validate
from .config import FIRST_LINE, listed_label, parsed

_JOIN = "\u0001"


# --- extractors ----------------------------------------------------------------------------------

def dealt(docs: DataFrame) -> DataFrame:
    """Documents over all tasks by a hash of their name, for a job that reads them next.

    Reading costs by the document and hardly by the byte, while scans and adaptive exchanges cut partitions by bytes:
    left to them, a file of 100,000 short documents is one task's work.
    """
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_name")


def _unix(text: Column) -> Column:
    """The text with ``\\n`` for every line end, by plain replacement: most texts have no other."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _logical_lines(text: Column) -> Column:
    """The text, a line that has neither label nor table cell glued to the one before it."""
    return F.regexp_replace(_unix(text), r"\n(?=[^\n:|]+(?:\n|\z))", _JOIN)


#: A line ``Label: value`` of the glued text: its label and the rest. Only ``\\n`` ends a line.
_LABELLED = r"(?md)^([^:|A-Za-z\n]*+[A-Za-z][^:|\n]*+):([^\n]*)"


def _labels(printed: Column) -> Column:
    """Labels for comparison (see ``config.plain_label``) as a list for ``find_in_set``, the first line's last. They are cleaned
    as one text, a label a line, and stay one: a lambda on the elements of an array is interpreted for every element, and so
    is a search among them."""
    one = F.array_join(F.concat(printed, F.array(F.lit(FIRST_LINE))), "\n")
    one = F.regexp_replace(F.regexp_replace(one, rf"(?md)^[^\n]*{_JOIN}|\([^)\n]*\)", ""), r" *\n *", "\n")
    return F.replace(listed_label(F.lower(F.trim(one))), F.lit("\n"), F.lit(","))


def _texts(printed: Column, first: Column) -> Column:
    """Values, one per label; a label alone on its line takes the lines below it. Cleaned as one text like the labels."""
    one = F.array_join(F.concat(printed, F.array(first)), "\n")
    trimmed = F.trim(F.regexp_replace(one, rf" *([\n{_JOIN}]) *", "$1"))
    own = F.regexp_replace(trimmed, rf"(?md)^([^\n{_JOIN}]+){_JOIN}[^\n]*|^{_JOIN}+|{_JOIN}+$", "$1")
    return F.split(F.regexp_replace(own, f"{_JOIN}+", ", "), "\n")


def entities(docs: DataFrame, config: DataFrame, how: str = "inner") -> DataFrame:
    """Answers per configured field as ``response`` (map of field to text) for (file_name, doc_type, text).

    The text is read once into labels and values; each field then looks up its labels in order.
    A field that is not printed gives NULL. ``how="left"`` keeps documents of types without active
    configuration, with a NULL response.
    """
    glued = docs.join(parsed(config), "doc_type", how).withColumn("_lines", _logical_lines(F.col("text")))
    return glued.withColumn("response", _response()).drop("_lines")


@built_once
def _response() -> Column:
    """``response`` of ``_lines`` and ``specs``. A column used several times is worked out once, an expression is not."""
    lines = F.col("_lines")
    first = F.substring_index(F.substring_index(lines, "\n", 1), _JOIN, 1)
    labels = _labels(F.regexp_extract_all(lines, F.lit(_LABELLED), 1))
    texts = _texts(F.regexp_extract_all(lines, F.lit(_LABELLED), 2), first)
    return F.map_from_entries(let(labels, lambda names: let(texts, lambda values: F.transform(
        F.col("specs"), lambda spec: _answer(spec, names, values)))))


def _answer(spec: Column, labels: Column, texts: Column) -> Column:
    """The text of the first label that has one. Most fields are printed under their own label, so the others wait."""
    under = lambda x: F.get(texts, F.find_in_set(x, labels) - 1)
    rest = F.get(F.filter(F.transform(spec["labels"], under), lambda text: text != ""), F.lit(0))
    answer = let(under(F.get(spec["labels"], F.lit(0))), lambda own: F.when(own != "", own).otherwise(rest))
    return F.struct(spec["name"].alias("k"), answer.alias("v"))


def _cells(line: Column) -> Column:
    return F.split(trimmed(line), r"\s*\|\s*", -1)


def _table_rows(lines: Column, wanted: Column) -> Column:
    """Rows of the pipe-separated tables among ``lines``, each as an array of cells in the order of ``wanted``.

    One pass over the lines: a line most of whose cells name wanted columns (in any case and order) is a header and holds for
    the rows below it, until the next header. A line without a pipe between two tables changes nothing, so a table that goes on
    below a gap keeps its columns. Where no line is a header, the first one with a pipe counts as one, columns by position.
    """
    def under(known: Column) -> Column:
        def named(cells: Column) -> Column:
            """Position of each wanted column in a header, from 1; one without its name takes an unknown name's place, else 0."""
            by_place = lambda x, i: F.when(~F.array_contains(known, F.get(x, i)), i + 1).otherwise(0)
            return let(F.transform(cells, lambda c: F.lower(c)), lambda x: F.transform(known, lambda w, i: F.coalesce(
                F.nullif(F.array_position(x, w).cast("int"), F.lit(0)), by_place(x, i))))

        def is_header(cells: Column) -> Column:
            return 2 * F.size(F.array_intersect(F.transform(cells, lambda c: F.lower(c)), known)) > F.size(cells)

        def read(table: Column) -> Column:
            def rows(start: Column, end: Column, places: Column) -> Column:
                return F.transform(F.slice(table, start + 2, F.greatest(end - start - 1, F.lit(0))), lambda r: F.transform(
                    places, lambda p: F.get(r, p - 1)))

            def split(heads: Column) -> Column:
                parts = F.flatten(F.transform(heads, lambda h, i: let(named(F.get(table, h)), lambda places: rows(
                    h, F.coalesce(F.get(heads, i + 1), F.size(table)), places))))
                whole = rows(F.lit(0), F.size(table), F.transform(known, lambda _, i: i + 1))
                return F.when(F.size(heads) == 0, whole).otherwise(parts)

            return let(F.filter(F.transform(table, lambda c, i: F.when(is_header(c), i)), lambda i: i.isNotNull()), split)

        return let(F.transform(F.filter(lines, lambda x: x.contains("|")), _cells), read)

    return let(F.transform(wanted, lambda w: F.lower(w)), under)


def tables(docs: DataFrame) -> DataFrame:
    """Pipe-separated tables as ``line_items``: configured column to array of cells (needs ``table_cols``).

    Columns are found by the names in the header of each table, whatever their order; the rows of several
    tables of a document follow each other. A column that a table does not have is NULL in its rows.
    """
    return docs.withColumn("line_items", _line_items())


@built_once
def _line_items() -> Column:
    """``line_items`` of ``text`` and ``table_cols``."""
    lines = F.split(_unix(F.col("text")), "\n")
    rows = _table_rows(lines, F.col("table_cols"))
    cells = let(rows, lambda r: F.transform(F.col("table_cols"), lambda _, i: F.transform(r, lambda cell: F.get(cell, i))))
    return F.map_from_arrays("table_cols", cells)


def with_model(docs: DataFrame, config: DataFrame,
               model: Callable[[str, str, list[str]], dict], how: str = "inner") -> DataFrame:
    """Like ``entities`` and ``tables`` with a model ``(file_name, text, fields) -> {field: value}`` run in the tasks.

    The answer may hold ``line_items``, a dict of column to list of cells. A document the model fails
    on gets NULL answers and its error text; the others go on.
    """
    needed = docs.join(parsed(config), "doc_type", how)
    text_or_null = lambda x: None if x is None else str(x)

    def answer(name, text, fields):
        if fields is None or text is None:
            return None, None, None
        try:
            got = model(name, text, list(fields))
            cells = got.get("line_items")
            return ({f: text_or_null(got.get(f)) for f in fields},
                    cells and {c: [text_or_null(x) for x in column] for c, column in cells.items()}, None)
        except Exception as problem:
            return None, None, (str(problem) or type(problem).__name__)[:V.ERROR_TEXT_LENGTH]

    @F.pandas_udf("response map<string,string>, line_items map<string,array<string>>, error string")
    def run(names: pd.Series, texts: pd.Series, fields: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([answer(*x) for x in zip(names, texts, fields)], columns=["response", "line_items", "error"])

    # the model is no function of its text alone: asked once per document
    done = needed.withColumn("_m", run.asNondeterministic()("file_name", "text", F.col("specs.name")))
    return done.withColumns({c: F.col(f"_m.{c}") for c in ("response", "line_items", "error")}).drop("_m")


def response_json(response: Column) -> Column:
    return F.to_json(F.struct(response.alias("response")))


# --- post-processing -----------------------------------------------------------------------------

@built_once
def _normalized() -> Column:
    """``normalized`` of ``response`` and ``specs``."""
    def canonical(answer: Column, spec: Column) -> Column:
        def named(value: Column) -> Column:
            return F.struct(
                spec["name"].alias("name"), spec["ftype"].alias("ftype"),
                F.when(spec["name"].isin(V.NAME_FIELDS), company_name(value)).otherwise(value).alias("value"))

        return let(normalize(answer, spec["ftype"]), named)

    def answers(response: Column) -> Column:
        """One per spec. A response mostly holds the fields in their order; only another one is searched for every name."""
        names = F.col("specs.name")
        return F.when(F.map_keys(response) == names, F.map_values(response)).otherwise(
            F.transform(names, lambda name: F.try_element_at(response, name)))

    # bound first: a column that is merged into a lambda would be evaluated for every element
    return let(let(F.col("response"), answers), lambda given: F.transform(
        F.col("specs"), lambda spec, i: canonical(F.get(given, i), spec)))


@built_once
def _warnings() -> Column:
    """``warnings`` of ``normalized`` and ``rules``, which hold the places of their fields."""
    return let(F.col("normalized.value"), lambda v: validate.typed_warnings(F.col("rules"), lambda r: F.get(v, r["place"])))


@built_once
def _confidence() -> Column:
    """``confidence`` of ``normalized`` and ``warnings``."""
    return let(F.col("warnings"), lambda w: let(F.col("normalized"), lambda n: validate.confidence(n, w)))


def post_process(df: DataFrame) -> DataFrame:
    """``response`` to normalised fields, warnings, confidence and the payload to store.

    Each is a column of its own, so that Spark leaves out those that a job does not use.
    """
    done = df.withColumn("normalized", _normalized()).withColumn("values", validate.values_map(F.col("normalized")))
    done = done.withColumn("warnings", _warnings()).withColumn("confidence", _confidence())
    return done.withColumn("raw_extraction", payload(F.col("values"), F.col("confidence"), F.col("warnings")))


def payload(values: Column, confidence: Column, found: Column) -> Column:
    """JSON of all values (NULL kept), with scores and, if there are any, warnings."""
    flags = F.when(F.size(found) > 0, F.concat(F.lit(',"_validation_warnings":'), F.to_json(found))).otherwise("")
    return F.concat(F.rtrim(F.to_json(values), F.lit("}")), F.lit(',"_confidence":'), F.to_json(confidence),
                    flags, F.lit("}"))


def field_columns(normalized: Column) -> list[Column]:
    """field_1 .. field_10 with their physical types; further fields live in the payload only."""
    def cell(i: int) -> Column:
        value = F.get(normalized, F.lit(i - 1))["value"]
        if i in (4, 5):
            value = to_iso_date(value)
        elif i in (8, 9, 10):
            value = clean_amount(value)
        return value.alias(f"field_{i}")

    return [cell(i) for i in range(1, 11)]


def stored_fields(df: DataFrame, now: Column) -> DataFrame:
    """Rows for the fields table, without record ids."""
    return df.select("file_name", *field_columns(F.col("normalized")), "raw_extraction",
                     F.lit("EXTRACTED").alias("status"), now.alias("extracted_at"))


def long_fields(df: DataFrame) -> DataFrame:
    """One row per document and field: position, raw and normalised text, score.

    The outer form of explode, because for the inner form Spark adds a filter on the array's size, and
    pushing that filter down would evaluate the whole extraction a second time.
    """
    return df.select(
        "file_name", "doc_type", "response", "confidence", F.posexplode_outer("normalized").alias("i", "n"),
    ).select(
        "file_name", "doc_type", (F.col("i") + 1).alias("pos"), F.col("n.name").alias("field"),
        F.col("n.ftype").alias("ftype"), F.try_element_at("response", F.col("n.name")).alias("raw"),
        F.col("n.value").alias("normalized"), F.try_element_at("confidence", F.col("n.name")).alias("confidence"),
    )


# --- shredding -----------------------------------------------------------------------------------

def shred_header(df: DataFrame) -> DataFrame:
    """``extraction`` (JSON with ``response``) to typed invoice columns, status PENDING."""
    text = lambda k: F.get_json_object("extraction", f"$.response.{k}")
    amount = lambda k: clean_amount(json_number_text(F.col("extraction"), f"$.response.{k}"))
    return df.select(
        "file_name",
        *[text(k).alias(k) for k in ("vendor_name", "invoice_number", "po_number")],
        *[to_iso_date(text(k)).alias(k) for k in ("invoice_date", "due_date")],
        *[text(k).alias(k) for k in ("payment_terms", "bill_to")],
        *[amount(k).alias(k) for k in ("subtotal", "tax_amount", "total_amount")],
        F.lit("PENDING").alias("status"),
    )


LINE_COLUMNS = ["Line", "Product", "Category", "Qty", "Unit Price", "Total"]


def line_arrays(extraction: Column) -> Column:
    """``response.line_items`` as map of column to array of text."""
    return F.from_json(F.get_json_object(extraction, "$.response.line_items"), "map<string,array<string>>")


def zip_shortest(arrays: list[Column], names: list[str]) -> Column:
    """Parallel arrays as rows, as many as the shortest has; no rows when an array is missing."""
    size = F.least(*[F.size(a) for a in arrays])
    whole = F.lit(True)
    for a in arrays:
        whole = whole & a.isNotNull()
    zipped = F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, names)])
    return F.when(whole, F.slice(zipped, 1, size))


def shred_lines(df: DataFrame, columns: list[str] = LINE_COLUMNS) -> DataFrame:
    """``extraction`` to typed line items plus the row as JSON; ragged arrays end with the shortest."""
    names = [f"c{i}" for i in range(len(columns))]
    arrays = [F.try_element_at("_items", F.lit(c)) for c in columns]
    rows = (
        df.withColumn("_items", line_arrays(F.col("extraction")))
        .withColumn("_x", F.explode_outer(zip_shortest(arrays, names))).where("_x IS NOT NULL")
    )
    cell = lambda i: F.col(f"_x.c{i}")
    return rows.select(
        *[c for c in df.columns if c != "extraction"],
        cell(0).try_cast("int").alias("line_number"), cell(1).alias("product_name"), cell(2).alias("category"),
        clean_amount(cell(3), 10).alias("quantity"), clean_amount(cell(4), 10).alias("unit_price"),
        clean_amount(cell(5), 12).alias("line_total"),
        F.to_json(F.struct(*[cell(i).alias(c) for i, c in enumerate(columns)])).alias("raw_line_data"),
    )


# which configured column feeds col_1 .. col_5
NAMED_COLUMNS = [["Description", "Product", "Item", "Milestone", "Tier", "Month"], ["Category", "Status", "kWh Range"],
                 ["Qty", "Escalation"], ["Unit Price", "Price", "Rate per kWh", "Rent"], ["Total", "Amount"]]


def rows_by_first_column(df: DataFrame, mapping: str = "named") -> DataFrame:
    """``line_items`` (map) and ``table_cols`` to stored line rows.

    The first configured column decides how many rows there are; shorter columns are padded.
    ``mapping="positional"`` puts the first five columns into col_1 .. col_5 whatever they are;
    ``"named"`` picks description, category, quantity, unit price and total by name.
    """
    def by_row(items: Column) -> Column:
        first = F.try_element_at(items, F.get("table_cols", F.lit(0)))
        return F.transform(first, lambda _, i: F.transform(
            F.col("table_cols"), lambda c: F.get(F.try_element_at(items, c), i)))

    # turned to rows before the explode: exploded rows must not carry the whole table with them
    rows = (
        df.withColumn("_rows", let(F.col("line_items"), by_row)).drop("line_items")
        .select("*", F.posexplode_outer("_rows").alias("_i", "_cells")).drop("_rows").where("_i IS NOT NULL")
        .withColumn("_row", F.map_from_arrays("table_cols", "_cells"))
    )

    def source(i: int) -> Column:
        if mapping == "positional":
            return F.try_element_at("_row", F.get("table_cols", F.lit(i)))
        return F.coalesce(*[F.try_element_at("_row", F.lit(n)) for n in NAMED_COLUMNS[i]])

    return rows.select(
        *[c for c in df.columns if c not in ("line_items", "table_cols")],
        (F.col("_i") + 1).alias("line_number"), source(0).alias("col_1"), source(1).alias("col_2"),
        clean_amount(source(2), 10).alias("col_3"), clean_amount(source(3), 10).alias("col_4"),
        clean_amount(source(4), 12).alias("col_5"), F.to_json("_row").alias("raw_line_data"),
    )


def display_rows(df: DataFrame) -> DataFrame:
    """``extraction`` as (key, position, value): lists joined to text, columns of tables by row."""
    entry = df.select(*[c for c in df.columns if c != "extraction"],
                      F.explode(json_map(F.get_json_object("extraction", "$.response"))).alias("key", "_v"))
    as_list = F.array_join(F.from_json("_v", "array<string>"), ", ")
    table = F.from_json("_v", "map<string,array<string>>")
    plain = entry.where(~F.coalesce(F.col("_v").startswith("{"), F.lit(False))).withColumns({
        "column": F.lit(None).cast("string"), "position": F.lit(0),
        "value": F.when(F.col("_v").startswith("["), as_list).otherwise(F.coalesce("_v", F.lit("None"))),
    })
    cells = (
        entry.where(F.col("_v").startswith("{"))
        .select("*", F.explode(table).alias("column", "_cells"))
        .select("*", F.posexplode("_cells").alias("position", "value")).drop("_cells")
    )
    return plain.unionByName(cells).drop("_v")


def snake(label: Column) -> Column:
    return F.replace(F.lower(label), F.lit(" "), F.lit("_"))


def field_name(index: Column, correctable: Column, label: Column) -> Column:
    """Extraction name of the 1-based field: the correctable list by position, else from its label."""
    return F.coalesce(F.get(correctable, (index - 1).cast("int")), F.nullif(snake(label), F.lit("")))


def field_value(index: Column, row_columns: list[Column], raw: Column, label: Column) -> Column:
    """Value of the 1-based field: columns for 1 to 10, then the payload by label, else by position."""
    stored = F.get(F.array(*[c.cast("string") for c in row_columns]), (index - 1).cast("int"))
    by_label = F.try_element_at(raw, snake(label))
    by_place = F.get(F.map_values(raw), (index - 1).cast("int"))
    return F.when(index <= 10, stored).otherwise(F.coalesce(by_label, by_place))


def overflow(payload: Column, names: Column) -> Column:
    """JSON of the fields beyond the ten stored columns, from the stored payload; ``{}`` where there are none.

    ``names`` are the configured fields in order. Keys of the payload that are not configured, its scores and its
    warnings are left out.
    """
    beyond = F.slice(names, 11, F.greatest(F.size(names), F.lit(1)))
    return let(json_map(payload), lambda found: F.to_json(F.map_from_entries(F.transform(
        F.filter(beyond, lambda n: F.array_contains(F.map_keys(found), n)),
        lambda n: F.struct(n.alias("k"), F.try_element_at(found, n).alias("v"))))))


# --- the job -------------------------------------------------------------------------------------

def work_list(raw: DataFrame, fields: DataFrame, doc_type: str = "ALL") -> DataFrame:
    """Pending documents (of one type) that have no result yet. Filter before reading any text."""
    todo = raw.where(~F.coalesce(F.col("extracted"), F.lit(False)))
    if doc_type != "ALL":
        todo = todo.where(F.col("doc_type") == doc_type)
    return todo.join(fields.select("file_name"), "file_name", "left_anti")


def read_documents(docs: DataFrame, config: DataFrame, model=None, doc_type: str = "ALL") -> DataFrame:
    """Documents of all types (or of one), read in one pass: one row each, much smaller than its text.

    ``model`` replaces the built-in reader, see ``with_model``. Documents without text, documents of
    types without active configuration and documents that the model fails on get an error.
    """
    if doc_type != "ALL":
        docs = docs.where(F.col("doc_type") == doc_type)
    if model is None:
        answered = tables(entities(docs, config, "left")).withColumn("error", F.lit(None).cast("string"))
    else:
        answered = with_model(docs, config, model, "left")
    no_text = blank(F.coalesce("text", F.lit("")))
    no_type = F.concat(F.lit("No active config found for doc_type="), F.coalesce("doc_type", F.lit("")))
    error = F.when(F.col("specs").isNull(), no_type).when(no_text, "document has no text").otherwise(F.col("error"))
    return post_process(answered).select("file_name", "normalized", "raw_extraction", "table_cols", "line_items",
                                         error.alias("error"))


def split_results(done: DataFrame, now: Column, mapping: str = "named") -> dict[str, DataFrame]:
    """Rows for the fields and line tables, and the errors, from ``read_documents``."""
    good = done.where("error IS NULL")
    return {
        "fields": stored_fields(good, now),
        "lines": rows_by_first_column(good.select("file_name", "table_cols", "line_items"), mapping),
        "errors": done.where("error IS NOT NULL").select("file_name", "error", now.alias("failed_at")),
    }


def run(docs: DataFrame, config: DataFrame, now: Column, mapping: str = "named", model=None,
        doc_type: str = "ALL") -> dict[str, DataFrame]:
    """All documents of all types (or of one) in one job: stored fields, line rows and errors.

    Each of the three frames reads the documents when it is used; to read them once, write the result of
    ``read_documents`` and split that (``streaming.jobs.store`` does).
    """
    return split_results(read_documents(docs, config, model, doc_type), now, mapping)


def message(fields: DataFrame, config: DataFrame, doc_type: str = "ALL") -> DataFrame:
    """One row: how many documents were processed, or that no active configuration exists."""
    active = config.where(F.coalesce(F.col("active"), F.lit(False)))
    if doc_type != "ALL":
        active = active.where(F.col("doc_type") == doc_type)
    known = active.agg(F.count("*")).scalar()
    return fields.agg(F.count("*").alias("processed")).select(
        F.when(known == 0, F.lit(f"No active config found for doc_type={doc_type}"))
        .otherwise(F.format_string("Processed %d document(s) via config-driven extraction", "processed")).alias("message")
    )
