"""Names, paths, headers and markup of project files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import LETTER_KINDS

#: How names of objects begin and end.
KNOWN_PREFIXES = ("Book", "Graph", "Matrix", "Sheet", "Page", "Note", "Layer", "Excel", "Function", "Curve", "Legend", "Axis", "PdM", "MBook", "MSheet", "MMatrix", "N2N_", "__")
KNOWN_SUFFIXES = ("_Data_", "__LayerGridStyle", "__WIOTN", "__BCO2", "OriginStorage")
#: Extensions of attachments, and markers of storage regions.
ATTACHMENT_EXTENSIONS = ("csv", "doc", "docx", "jpeg", "jpg", "odt", "ods", "pdf", "ppt", "pptx", "png", "rtf", "tsv", "xls", "xlsm", "xlsx")
FUNCTION_TEXTS = ("<iy1", "<iy2", "<oy", "<operand", "<operator", "<formula", "<functionlist", "__xf", "__fitcurve", "expgraph", "xfname", "xfunctionname", "nlfitxfname", "<mathtool")
FUNCTION_TAGS = ("formula", "func", "function", "functionlist", "__xf", "__fitcurve", "expgraph", "xfname", "xfunctionname", "nlfitxfname", "mathtool", "operator", "operand", "iy1", "iy2", "oy")
GRAPH_TAGS = ("graph", "layer", "plot", "sheet")
#: Words that a project's description is near.
DESCRIPTION_MARKERS = ("Requires OriginPro", "Signed-rank", "Origin", "Project", "analysis")
#: Kinds of viewer leaves by rank.
TABULAR, MEDIA, TEXT = ("worksheet", "matrix", "excel", "report_table"), ("graph", "graph_preview", "image"), ("note", "function", "analysis_report")


def any_text(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def plausible_name(token: Column) -> Column:
    """Whether a token can be an object's name: 4 to 64 characters without white space, no digit first, and a known beginning or end, or capitals with an underscore, or letters, digits and perhaps one more part."""
    known = token.rlike("^(" + "|".join(KNOWN_PREFIXES) + ")") | token.rlike("(" + "|".join(KNOWN_SUFFIXES) + ")$")
    capital = (F.length(token) > 4) & F.contains(token, F.lit("_")) & token.rlike("[A-Z]") & (F.upper(token) == token)
    return F.length(token).between(4, 64) & ~token.rlike(r"\s") & ~token.rlike("^[0-9]") & (known | capital | token.rlike("^[A-Za-z]+[0-9]+(_[A-Za-z0-9]+)?$"))


def source_path(name: Column) -> Column:
    """The path an object's name stands for: its own segments, the kind of a one-letter prefix, meta, what comes before the first underscore (without digits behind its letters), a known beginning, or object."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9._@-]", "_")
    parts = F.filter(F.split(name, r"[\\/]+"), lambda x: x != "")
    joined = F.array_join(F.transform(parts, safe), "/")
    letter = F.when(name.rlike("^._.") & (F.length(name) >= 3), F.create_map(*[F.lit(x) for pair in LETTER_KINDS.items() for x in pair])[F.lower(F.substring(name, 1, 1))])
    head = F.substring_index(name, "_", 1)
    stem = F.when(head.rlike("^[A-Za-z]+[0-9]+$"), F.regexp_extract(head, "^([A-Za-z]+)", 1)).otherwise(head)
    prefix = F.regexp_extract(name, "^(" + "|".join(KNOWN_PREFIXES) + ").", 1)
    return (
        F.when(name.rlike(r"[\\/]"), F.when(F.size(parts) >= 2, joined).otherwise(F.concat(F.lit("object/"), F.when(F.size(parts) == 1, joined).otherwise(F.lit("item")))))
        .when(letter.isNotNull(), F.concat(letter, F.lit("/"), safe(F.substr(name, F.lit(3)))))
        .when(F.startswith(name, F.lit("__")), F.concat(F.lit("meta/"), safe(name)))
        .when(name.rlike("^[^_]+_."), F.concat(safe(stem), F.lit("/"), safe(name)))
        .when(prefix != "", F.concat(prefix, F.lit("/"), safe(name)))
        .when((F.length(name) > 1) & name.rlike("^[A-Za-z]"), F.concat(F.lit("object/"), safe(name)))
        .otherwise(F.concat(F.lit("object/item_"), safe(name)))
    )


def matrix_aliases(name: Column) -> Column:
    """Other names of a matrix (lower-cased): pdmN as N, mN and mbookN, msheetN as mbookN and the reverse, mN as mbookN; sorted."""
    low = F.lower(name)
    after = F.when(F.startswith(low, F.lit("pdm")) & (F.length(low) > 3), F.substr(low, F.lit(4)))
    digits = F.regexp_replace(after, "^m", "")
    number = lambda prefix: F.nullif(F.regexp_extract(low, f"^{prefix}([0-9]+)$", 1), F.lit(""))
    found = F.array(
        after,
        F.when(~F.startswith(after, F.lit("m")), F.concat(F.lit("m"), after)),
        F.when(digits.rlike("^[0-9]+$"), F.concat(F.lit("mbook"), digits)),
        F.concat(F.lit("mbook"), number("msheet")),
        F.concat(F.lit("msheet"), number("mbook")),
        F.concat(F.lit("mbook"), number("m")),
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def clean_text(raw: Column) -> Column:
    """Markup text as plain text: the five entities, escaped quotes, line ends, the first tag that has text before it (and those before), control bytes 0 and 1."""
    out = raw
    for pattern, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&")):
        out = F.regexp_replace(out, pattern, char)
    out = F.regexp_replace(F.regexp_replace(out, r'\\(["\'])', "$1"), "\r\n?", "\n")
    out = F.regexp_replace(out, r"(?s)^(?:<[^>]*>)*([^<]*)(?:<[^>]*>)?", "$1")
    return F.trim(F.regexp_replace(out, "[\x00\x01]", ""))


def attachment_name(text: Column) -> Column:
    """The first path in a text that ends in an attachment's extension, its last segment; null if there is none."""
    pattern = r"(?i)([^\\/\s\"'<>=:;,]+\.(?:" + "|".join(sorted(ATTACHMENT_EXTENSIONS, key=len, reverse=True)) + r"))(?:[^A-Za-z0-9]|$)"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def storage_region_kind(text: Column) -> Column:
    """What a storage region holds; the first of these decides: an attachment's name, a preview's signature, a function's text, a label, tags of functions, graphs, notes."""
    low = F.lower(text)
    tags = F.transform(F.regexp_extract_all(low, F.lit(r"</?\s*([a-z_][a-z0-9_:.-]*)"), 1), lambda x: F.regexp_replace(x, "[:.-].*$", ""))
    return (
        F.when(attachment_name(text).isNotNull(), "attachment")
        .when(any_text(low, ("%pdf-", "<svg")), "preview")
        .when(any_text(low, FUNCTION_TEXTS), "function")
        .when(low.rlike(r"<label\b|\blabel\s*="), "report")
        .when(F.exists(tags, lambda x: any_text(x, FUNCTION_TAGS)), "function")
        .when(F.exists(tags, lambda x: x.isin(*GRAPH_TAGS)), "graph")
        .when(F.exists(tags, lambda x: F.contains(x, F.lit("note"))), "note")
        .otherwise("unknown")
    )


def header(content: Column) -> Column:
    """A project file's first line as a struct: kind (opj, opju or null), version, build (opj) or length (opju)."""
    line = F.regexp_extract(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), r"^([^\n]*)\n", 1)
    words = F.split(line, " ")
    kind = F.when(words[0] == "CPYUA", "opju").when(words[0] == "CPYA", "opj")
    third = F.regexp_extract(F.try_element_at(words, F.lit(3)), "^([0-9]+)#?$", 1)
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), F.try_element_at(words, F.lit(2))).alias("version"), F.when(kind.isNotNull(), third.try_cast("bigint")).alias("number"))


def description(content: Column, most: int = 160) -> Column:
    """What a unicode project says of itself near its start: the longest span around one of the markers, the first of equal ones; null without any."""
    text = F.decode(F.when(F.startswith(content, F.lit(b"CPYUA")), F.when(F.octet_length(content) < 256, content).otherwise(F.substring(content, 1, 512))), "ISO-8859-1")
    spans = []
    for k, marker in enumerate(DESCRIPTION_MARKERS):
        at = F.instr(text, marker) - 1
        low, high = F.greatest(F.lit(0), at - most // 4), F.least(F.length(text), at + most)
        spans.append(F.when(at >= 0, F.struct((high - low).alias("n"), F.lit(-k).alias("k"), F.substr(text, low + 1, high - low).alias("span"))))
    best = F.regexp_replace(F.array_max(F.filter(F.array(*spans), lambda x: x.isNotNull()))["span"], "^\\s+|\\s+$|\x00", "")
    return F.when(F.length(best) > most, F.concat(F.substring(best, 1, most - 3), F.lit("..."))).when(F.length(best) > 1, best)


def formula_token(token: Column, least: int = 2, most: int = 512) -> Column:
    """Whether a token is a formula: printable ASCII that begins with = and has a letter or digit."""
    return F.length(token).between(least, most) & token.rlike(r"^=[ -~]*[A-Za-z0-9][ -~]*$")


def leaf_rank(kind: Column) -> Column:
    """How soon a viewer shows a leaf: tables, then media, then texts, dumps last."""
    return F.when(kind.isin(*TABULAR), 0).when(kind.isin(*MEDIA) | (kind == "project_page"), 1).when(kind.isin(*TEXT), 2).when(kind == "raw_dump", 9).otherwise(5)


def omission(kind: Column, name: Column, status: Column, path: Column, size: Column, content_class: Column, formula: Column) -> Column:
    """Why an item has no artifact for readers; null if it has one."""
    return (
        F.when(status == "partial", "partial artifacts")
        .when(path.isNull() | (path == ""), "items without an artifact file")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty artifact files")
        .when(kind.isin(*TABULAR) & content_class.isin("corrupt_text", "empty", "internal_references"), F.concat(F.replace(content_class, F.lit("_"), F.lit(" ")), F.lit(" content")))
        .when((kind == "matrix") & F.startswith(name, F.lit("origin_storage_family_")), "unowned storage family")
        .when((kind == "function") & formula.isNull(), "functions without a decoded formula")
    )


def support_class(detected: Column, parser_status: Column, backed: Column, all_backed: Column, gaps: Column) -> Column:
    """A file's class from its items' flags: failed, heuristic, partial or parser."""
    return (
        F.when(parser_status == "error", "failed")
        .when(~detected.isin("opj", "opju") | (parser_status == "unsupported"), "heuristic")
        .when((detected == "opj") & (parser_status == "empty"), "parser")
        .when(~backed, "heuristic")
        .when(gaps | ~all_backed, "partial")
        .otherwise("parser")
    )
