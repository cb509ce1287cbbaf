"""Classes of names, cells and payloads, as column expressions; the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which names begin how, in the order in which they are tried.
KIND_PREFIXES = (
    (("graph", "layer"), "graph"),
    (("function",), "function"),
    (("excel",), "excel"),
    (("msheet", "matrix_"), "matrix"),
    (("pdm", "matrix", "spread"), "matrix"),
    (("book", "n2n", "o2o", "sheet", "spreadsheet"), "worksheet"),
    (("mbook",), "worksheet"),
    (("note",), "note"),
    (("__",), "meta"),
)
#: Kinds of names such as t_x, and names of workbook files.
LETTER_KINDS = {"t": "worksheet", "m": "matrix", "e": "excel", "f": "function"}
EXCEL_SUFFIXES = (".xlsx", ".xls", ".xlsm", ".xlsb")
#: Cell designations by code, value types by format code.
DESIGNATIONS = {3: "X", 0: "Y", 5: "Z", 6: "XErr", 2: "YErr", 4: "Label"}
VALUE_TYPES = {0x00: "numeric", 0x10: "numeric", 0x20: "numeric", 0x30: "numeric", 0x09: "text_numeric", 0x19: "text_numeric", 0x29: "text_numeric", 0x39: "text_numeric", 0x02: "time", 0x03: "date", 0x33: "date", 0x31: "text", 0x04: "month", 0x34: "month", 0x05: "day", 0x35: "day"}
CELL_NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: Fixed values; members that others imply are left out.
PLACEHOLDERS = ("plot", "intercept", "slope", "slope_2", "intercept_2")
MARKDOWN = ("# ", "- ", "* ", "```", "> ")


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = F.when(*(rules[0][0], F.lit(rules[0][1])))
    for test, value in rules[1:]:
        out = out.when(test, F.lit(value))
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def object_kind(name: Column) -> Column:
    """The kind that a name's prefix or suffix gives; null if none does."""
    low = F.lower(name)
    any_of = lambda test, parts: F.coalesce(*[F.when(test(low, F.lit(p)), F.lit(True)) for p in parts], F.lit(False))
    letter = F.when(low.rlike("(?s)^._."), F.create_map(*[F.lit(x) for pair in LETTER_KINDS.items() for x in pair])[F.substring(low, 1, 1)])
    return F.coalesce(letter, _by_affix(any_of))


def _by_affix(any_of) -> Column:
    return first_rule([(any_of(F.endswith, EXCEL_SUFFIXES), "excel")] + [(any_of(F.startswith, parts), kind) for parts, kind in KIND_PREFIXES])


def dataset_kind(name: Column, data_type: Column, data_type3: Column) -> Column:
    """From record fields first, then from the name."""
    own = object_kind(name)
    return first_rule([(F.contains(name, F.lit("_")), "worksheet"), (data_type == 0x6081, "function"), (data_type3.bitwiseAND(0x4000) != 0, "matrix"), (own == "function", "function"), (own == "matrix", "matrix")], "meta")


def note_payload_type(text: Column) -> Column:
    low = F.lower(text)
    marked = F.lit(False)
    for m in MARKDOWN:
        marked = marked | F.contains(text, F.lit(m))
    return first_rule([(text.isNull() | (F.length(text) == 0), "unknown_text"), (F.contains(low, F.lit("<html")) | F.contains(low, F.lit("</html>")), "html_like"), (marked, "markdown_like")], "plain_text")


def text_issues(text: Column) -> Column:
    """A struct of replacement_characters and control_characters."""
    n = F.length(text)
    return F.struct((n - F.length(F.regexp_replace(text, "�", ""))).alias("replacement_characters"), (n - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))).alias("control_characters"))


def designation(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in DESIGNATIONS.items() for x in pair])[code]


def value_type(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in VALUE_TYPES.items() for x in pair])[code]
    return F.when(code.isNull(), "unknown").otherwise(F.coalesce(known, F.lit("text")))


def content_class(cells: DataFrame, table: str, row: str, value: str) -> DataFrame:
    """A table's class from its cells: empty, internal_references, corrupt_text or data."""
    v = F.trim(F.col(value))
    some = F.coalesce(F.length(v) > 0, F.lit(False))
    inner = (v == "??") | F.startswith(v, F.lit("cell://"))
    number = v.rlike(CELL_NUMBER)  # one is enough for data
    odd = (F.length(v) > 160) | v.rlike(r'[<>\\"@]') | F.substring(v, 1, 1).isin("!", ")", ";")
    own = cells.groupBy(table, row).agg(F.count("*").alias("_width"), F.count_if(some).alias("_n"), F.count_if(some & inner).alias("_inner"), F.count_if(some & odd).alias("_odd"), F.count_if(some & number).alias("_numbers"))
    all_ = own.groupBy(table).agg(F.max("_width").alias("_width"), F.sum("_n").alias("n_values"), F.sum("_inner").alias("_inner"), F.sum("_odd").alias("_odd"), F.sum("_numbers").alias("_numbers"))
    kind = first_rule([(F.col("n_values") == 0, "empty"), (F.col("_inner") == F.col("n_values"), "internal_references"), ((F.col("_width") == 1) & (F.col("n_values") >= 8) & (F.col("_numbers") == 0) & (F.col("_odd") * 2 > F.col("n_values")), "corrupt_text")], "data")
    return all_.select(table, "n_values", kind.alias("content_class"))


def meaningful(cells: DataFrame, table: str, row: str, value: str) -> DataFrame:
    """Whether a table's cells look like data: a row of several cells, or one column whose distinct values aren't placeholders."""
    v = F.trim(F.col(value))
    rows = cells.groupBy(table, row).agg(F.count_if(F.length(v) > 0).alias("n"), F.min(F.when(F.length(v) > 0, v)).alias("v"))
    wide = rows.groupBy(table).agg(F.max(F.col("n") > 1).alias("wide"))
    v, low = F.col("v"), F.lower("v")
    marked = F.startswith(v, F.lit("cell://")) | v.rlike(CELL_NUMBER) | v.rlike("^[0-9.eE+ -]+(;[0-9.eE+ -]+)+$")
    word = (F.length(v) > 3) & ~F.endswith(v, F.lit("*")) & ~F.startswith(low, F.lit("sheet")) & ~F.startswith(low, F.lit("page")) & v.rlike("^[A-Za-z0-9._-]+( [A-Za-z0-9._-]+)*$")
    found = rows.where("n = 1").select(F.col(table).alias("of"), "v").distinct().groupBy("of").agg(F.count("*").alias("n"), F.count_if(low.isin(*PLACEHOLDERS)).alias("stop"), F.count_if(marked).alias("marked"), F.count_if(marked | word).alias("good"))
    n = F.coalesce("n", F.lit(0))
    good = F.col("wide") | ((n == 1) & (F.col("marked") == 1)) | ((n > 1) & (F.col("stop") == 0) & (F.col("good") > 0) & (F.col("good") >= 0.25 * n))
    return wide.join(found, F.col(table).eqNullSafe(F.col("of")), "left").select(table, F.coalesce(good, F.lit(False)).alias("meaningful"))


def retrieval_formats(kind: Column) -> Column:
    tabular = kind.isin("worksheet", "matrix", "excel", "function", "worksheet_column")
    return F.when(tabular, F.array(*[F.lit(x) for x in ("json", "jsonl", "csv", "tsv", "xlsx")])).when(F.startswith(kind, F.lit("image_")), F.array(F.lit("json"), F.substring(kind, 7, 10))).otherwise(F.array(F.lit("json")))
