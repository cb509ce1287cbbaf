"""Column expressions, all of them built-ins under whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_ordinal(letters: Column) -> Column:
    """A, B, ..., Z, AA, ... as 1, 2, ..., 26, 27, ...; null if other characters are in it."""
    value = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.when(letters.rlike("^[A-Z]+$"), value)


def dataset_name(name: Column) -> Column:
    """Book_Col@Sheet as a struct: book, column, sheet (1 without a suffix; null if it isn't a positive integer)."""
    base = F.regexp_extract(name, r"^(.*?)(?:@([^@]*))?$", 1)
    suffix = F.regexp_extract(name, r"^(.*?)(?:@([^@]*))?$", 2)
    sheet = F.when(~F.contains(name, F.lit("@")), F.lit(1)).when(suffix.rlike("^[1-9][0-9]{0,8}$"), F.expr("1") * suffix.try_cast("int"))
    return F.struct(
        F.regexp_extract(base, r"^(.*)_([^_]*)$", 1).alias("book"),
        F.when(F.contains(base, F.lit("_")), F.regexp_extract(base, r"^(.*)_([^_]*)$", 2)).otherwise(base).alias("column"),
        sheet.alias("sheet"),
    )


def strict_identity(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z][A-Za-z0-9_.-]*_[A-Z]+(@[1-9][0-9]*)?$")


def safe_name(name: Column) -> Column:
    """A portable file name: other characters become underscores, reserved stems get one in front, nothing is empty."""
    cleaned = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), r"^[. ]+|[. ]+$", "")
    cleaned = F.when(F.lower(cleaned).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"), F.concat(F.lit("_"), cleaned)).otherwise(cleaned)
    return F.when(F.length(cleaned) == 0, F.lit("item")).otherwise(cleaned)


def julian_epoch_seconds(day: Column) -> Column:
    """A Julian day as epoch seconds, for days in [2350000, 2500000]; the format counts from 2440587."""
    return F.when(day.between(2350000, 2500000), F.floor((day - 2440587) * 86400 + 0.5))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    runs = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n)
    return F.when(n > 0, -F.aggregate(runs, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(F.lit(0.0))


def note_type(text: Column) -> Column:
    """What a note's payload is, by its first characters: rtf, html, xml, text or empty."""
    head = F.lower(F.substring(F.ltrim(text), 1, 64))
    return (
        F.when(text.isNull() | (F.length(F.trim(text)) == 0), "empty")
        .when(F.startswith(head, F.lit("{\\rtf")), "rtf")
        .when(F.startswith(head, F.lit("<!doctype html")) | F.startswith(head, F.lit("<html")), "html")
        .when(F.startswith(head, F.lit("<?xml")) | F.startswith(head, F.lit("<")), "xml")
        .otherwise("text")
    )


def printable_spans(text: Column, least: int = 4) -> Column:
    """Runs of printable ASCII of at least `least` characters, in order."""
    return F.regexp_extract_all(text, F.lit(rf"([ -~]{{{least},}})"), 1)


def cell_reference(text: Column) -> Column:
    """cell://[book]sheet!a.b.c as a struct: book, sheet, parts."""
    pattern = r"^cell://\[([^\]]*)\]([^!]*)!(.*)$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("book"), F.regexp_extract(text, pattern, 2).alias("sheet"), F.split(F.regexp_extract(text, pattern, 3), r"\.").alias("parts")))


def range_references(text: Column) -> Column:
    """All [Book]Sheet!Column references in a text."""
    return F.regexp_extract_all(text, F.lit(r"(\[[^\]\[]+\][A-Za-z0-9_ ]+![A-Za-z0-9_]+)"), 1)


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers (of up to `width` digits)."""
    padded = F.regexp_replace(F.lower(text), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def leaf_values(text: Column, tag: str) -> Column:
    """Texts of all <tag>...</tag> leaves, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?:\s[^<>]*)?>([^<>]*)</{tag}>"), 1)
