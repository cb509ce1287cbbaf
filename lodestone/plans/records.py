"""Queries for names, links, selections, summaries and reshapes, each beside its SQL.

The records of project files are played by the star-schema tables: a customer's
orders stand for a file's objects, line items for the rows in them, and so on."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lodestone.functions import classify, names
from lodestone.functions import scalar as S
from lodestone.operators import dedup, intervals, links, reshape, resolve, selection, text

from .catalog import query, t

#: Beginnings of object names that the queries make.
STEMS = ("Graph", "layer", "t_", "f_", "x_", "spreadsheet", "spread", "Book", "MBook", "MSheet", "matrix_", "PdM", "Note", "__", "zzz", "Function", "N2N_", "excel")
ENDS = ("", ".xlsx", ".csv", "_Data_", "_A", "@2", "")


def pick(values: tuple, number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))


def sql_pick(values: tuple, number: str) -> str:
    return "([" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"])[({number}) % {len(values)} + 1]"


def made_name(key: str = "p_partkey", other: str = "p_size") -> Column:
    return F.concat(pick(STEMS, F.col(key)), F.col(key).cast("string"), pick(ENDS, F.col(other)))


SQL_NAME = f"({sql_pick(STEMS, 'p_partkey')} || p_partkey || {sql_pick(ENDS, 'p_size')})"
SQL_KIND = """CASE WHEN {n} ~ '(?s)^._..*' AND lower({n})[1] IN ('t', 'm', 'e', 'f') THEN CASE lower({n})[1] WHEN 't' THEN 'worksheet' WHEN 'm' THEN 'matrix' WHEN 'e' THEN 'excel' ELSE 'function' END
WHEN lower({n}) LIKE '%.xlsx' OR lower({n}) LIKE '%.xls' OR lower({n}) LIKE '%.xlsm' OR lower({n}) LIKE '%.xlsb' THEN 'excel'
WHEN regexp_matches(lower({n}), '^(graph|layer)') THEN 'graph' WHEN starts_with(lower({n}), 'function') THEN 'function' WHEN starts_with(lower({n}), 'excel') THEN 'excel'
WHEN regexp_matches(lower({n}), '^(msheet|matrix_|pdm|matrix|spread)') THEN 'matrix' WHEN regexp_matches(lower({n}), '^(book|n2n|o2o|sheet|spreadsheet|mbook)') THEN 'worksheet'
WHEN starts_with(lower({n}), 'note') THEN 'note' WHEN starts_with({n}, '__') THEN 'meta' END"""


def parts(spark, folder):
    return t(spark, folder, "part")


# ------------------------------------------------------------- names and classes


@query(f"SELECT p_partkey, name, {SQL_KIND.format(n='name')} AS kind FROM (SELECT p_partkey, {SQL_NAME} AS name FROM part)")
def object_kind_by_name(spark, folder):
    return parts(spark, folder).select("p_partkey", made_name().alias("name")).select("p_partkey", "name", classify.object_kind(F.col("name")).alias("kind"))


@query(f"""
WITH n AS (SELECT p_partkey, {SQL_NAME} AS name, CASE WHEN p_size % 5 = 0 THEN 24705 ELSE 1 END AS data_type, (p_partkey % 16)::INTEGER * 4096 AS data_type3 FROM part), k AS (SELECT *, {SQL_KIND.format(n='name')} AS own FROM n)
SELECT p_partkey, CASE WHEN contains(name, '_') THEN 'worksheet' WHEN data_type = 24705 THEN 'function' WHEN data_type3 & 16384 <> 0 THEN 'matrix' WHEN own IN ('function', 'matrix') THEN own ELSE 'meta' END AS kind FROM k""")
def dataset_kinds(spark, folder):
    own = parts(spark, folder).select("p_partkey", made_name().alias("name"), F.when(F.col("p_size") % 5 == 0, 0x6081).otherwise(1).alias("a"), ((F.col("p_partkey") % 16).cast("int") * 4096).alias("b"))
    return own.select("p_partkey", classify.dataset_kind(F.col("name"), F.col("a"), F.col("b")).alias("kind"))


RANKS = ["matrix", "excel", "worksheet", "function", "graph", "note"]


@query(f"""
WITH h AS (SELECT 'Book' || (s_suppkey % 40) AS name, min(s_nationkey % 6) AS rank FROM supplier GROUP BY 1),
w AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Graph' ELSE 'Book' END || (p_partkey % 60) AS name FROM part)
SELECT p_partkey, w.name, CASE WHEN rank IS NOT NULL THEN {str(RANKS)}[rank + 1] WHEN starts_with(w.name, 'Graph') THEN 'graph' ELSE 'worksheet' END AS kind FROM w LEFT JOIN h ON h.name = w.name""")
def window_kind_by_context(spark, folder):
    hints = t(spark, folder, "supplier").select(F.concat(F.lit("Book"), F.col("s_suppkey") % 40).alias("name"), pick(tuple(RANKS), F.col("s_nationkey")).alias("kind"))
    windows = parts(spark, folder).select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "Graph").otherwise("Book"), F.col("p_partkey") % 60).alias("name"))
    return links.kind_by_hints(windows, "name", hints, RANKS, classify.object_kind(F.col("name")))


PREFIXES, SUFFIXES = "|".join(names.KNOWN_PREFIXES), "|".join(names.KNOWN_SUFFIXES)


@query(f"""
WITH n AS (SELECT DISTINCT unnest([{SQL_NAME}, p_name, p_type, p_brand, upper(p_type) || '_' || p_size, 'Book', 'ab' || p_size || '_x', p_size || 'Book']) AS token FROM part)
SELECT token FROM n WHERE length(token) BETWEEN 4 AND 64 AND NOT regexp_matches(token, '\\s') AND NOT regexp_matches(token, '^[0-9]') AND (regexp_matches(token, '^({PREFIXES})') OR regexp_matches(token, '({SUFFIXES})$')
OR (length(token) > 4 AND contains(token, '_') AND regexp_matches(token, '[A-Z]') AND upper(token) = token) OR regexp_matches(token, '^[A-Za-z]+[0-9]+(_[A-Za-z0-9]+)?$'))""")
def plausible_names(spark, folder):
    size = F.col("p_size").cast("string")
    tokens = F.array(made_name(), F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.concat(F.upper("p_type"), F.lit("_"), size), F.lit("Book"), F.concat(F.lit("ab"), size, F.lit("_x")), F.concat(size, F.lit("Book")))
    return parts(spark, folder).select(F.explode(tokens).alias("token")).distinct().where(names.plausible_name(F.col("token")))


@query(f"SELECT p_partkey, kind FROM (SELECT p_partkey, {SQL_KIND.format(n='name')} AS kind FROM (SELECT p_partkey, {SQL_NAME} AS name FROM part)) WHERE kind IN ('graph', 'note', 'matrix')")
def allowed_kinds(spark, folder):
    return parts(spark, folder).select("p_partkey", classify.object_kind(made_name()).alias("kind")).where(F.col("kind").isin("graph", "note", "matrix"))


SAFE = "regexp_replace({}, '[^A-Za-z0-9._@-]', '_', 'g')"


@query(f"""
WITH n AS (SELECT p_partkey, unnest([{SQL_NAME}, p_name, p_brand || '/' || p_type || '\\' || p_size, p_type || '\\', 'Ab12_' || p_size, p_size::VARCHAR, 'Curve' || p_size]) AS name FROM part), s AS (SELECT p_partkey, name, list_filter(string_split_regex(name, '[\\\\/]+'), lambda x: x <> '') AS parts, regexp_extract(name, '^([^_]*)', 1) AS head FROM n)
SELECT p_partkey, name, CASE WHEN regexp_matches(name, '[\\\\/]') THEN CASE WHEN len(parts) >= 2 THEN array_to_string(list_transform(parts, lambda x: {SAFE.format('x')}), '/') WHEN len(parts) = 1 THEN 'object/' || {SAFE.format('parts[1]')} ELSE 'object/item' END
WHEN regexp_matches(name, '^[tmefTMEF]_.') THEN CASE lower(name[1]) WHEN 't' THEN 'worksheet' WHEN 'm' THEN 'matrix' WHEN 'e' THEN 'excel' ELSE 'function' END || '/' || {SAFE.format('name[3:]')}
WHEN starts_with(name, '__') THEN 'meta/' || {SAFE.format('name')} WHEN regexp_matches(name, '^[^_]+_.') THEN {SAFE.format("CASE WHEN regexp_matches(head, '^[A-Za-z]+[0-9]+$') THEN regexp_extract(head, '^([A-Za-z]+)', 1) ELSE head END")} || '/' || {SAFE.format('name')}
WHEN regexp_matches(name, '^({PREFIXES}).') THEN regexp_extract(name, '^({PREFIXES}).', 1) || '/' || {SAFE.format('name')} WHEN length(name) > 1 AND regexp_matches(name, '^[A-Za-z]') THEN 'object/' || {SAFE.format('name')} ELSE 'object/item_' || {SAFE.format('name')} END AS path FROM s""")
def source_paths(spark, folder):
    size = F.col("p_size").cast("string")
    made = F.array(made_name(), F.col("p_name"), F.concat("p_brand", F.lit("/"), "p_type", F.lit("\\"), size), F.concat("p_type", F.lit("\\")), F.concat(F.lit("Ab12_"), size), size, F.concat(F.lit("Curve"), size))
    return parts(spark, folder).select("p_partkey", F.explode(made).alias("name")).withColumn("path", names.source_path(F.col("name")))


@query("""
WITH n AS (SELECT DISTINCT lower((['PdM', 'PdMM', 'MSheet', 'MBook', 'M', 'Other', 'pdmx'])[p_partkey % 7 + 1] || p_size) AS name FROM part),
a AS (SELECT name, unnest([CASE WHEN starts_with(name, 'pdm') THEN name[4:] END, CASE WHEN starts_with(name, 'pdm') AND NOT starts_with(name[4:], 'm') THEN 'm' || name[4:] END, CASE WHEN regexp_matches(name, '^pdmm?[0-9]+$') THEN 'mbook' || regexp_extract(name, '([0-9]+)$', 1) END,
CASE WHEN regexp_matches(name, '^msheet[0-9]+$') THEN 'mbook' || name[7:] END, CASE WHEN regexp_matches(name, '^mbook[0-9]+$') THEN 'msheet' || name[6:] END, CASE WHEN regexp_matches(name, '^m[0-9]+$') THEN 'mbook' || name[2:] END]) AS alias FROM n)
SELECT DISTINCT name, alias FROM a WHERE alias IS NOT NULL""")
def matrix_alias_names(spark, folder):
    made = F.lower(F.concat(pick(("PdM", "PdMM", "MSheet", "MBook", "M", "Other", "pdmx"), F.col("p_partkey")), F.col("p_size").cast("string")))
    return parts(spark, folder).select(made.alias("name")).distinct().select("name", F.explode(names.matrix_aliases(F.col("name"))).alias("alias"))


ATTACHED = r"(?i)([^\\/\s" + chr(34) + r"<>=:;,'']+\.(?:" + "|".join(sorted(names.ATTACHMENT_EXTENSIONS, key=len, reverse=True)) + r"))(?:[^A-Za-z0-9]|$)"


def region_text() -> Column:
    return F.concat(pick(("", "<label>x</label>", "see C:\\data\\Run 1\\in put.XLSX;", "<Formula>", "<svg/>", "", "<note1>", "<plot>"), F.col("page_id")), F.substring(F.regexp_replace("html", "(?i)label|plot|graph|layer|sheet|func|note", "q"), 1, 400))


SQL_REGION = f"""({sql_pick(("", "<label>x</label>", "see C:" + chr(92) + "data" + chr(92) + "Run 1" + chr(92) + "in put.XLSX;", "<Formula>", "<svg/>", "", "<note1>", "<plot>"), "page_id")} || substr(regexp_replace(html, '(?i)label|plot|graph|layer|sheet|func|note', 'q', 'g'), 1, 400))"""


@query(f"""
WITH r AS (SELECT page_id, {SQL_REGION} AS x FROM pages), l AS (SELECT page_id, x, lower(x) AS low, list_transform(regexp_extract_all(lower(x), '</?\\s*([a-z_][a-z0-9_:.-]*)', 1), lambda k: regexp_replace(k, '[:.-].*$', '')) AS tags FROM r)
SELECT page_id, CASE WHEN regexp_extract(x, '{ATTACHED}', 1) <> '' THEN 'attachment' WHEN contains(low, '%pdf-') OR contains(low, '<svg') THEN 'preview'
WHEN {' OR '.join(f"contains(low, '{x}')" for x in names.FUNCTION_TEXTS)} THEN 'function' WHEN regexp_matches(low, '<label\\b|\\blabel\\s*=') THEN 'report'
WHEN len(list_filter(tags, lambda k: {' OR '.join(f"contains(k, '{x}')" for x in names.FUNCTION_TAGS)})) > 0 THEN 'function' WHEN list_has_any(tags, {list(names.GRAPH_TAGS)}) THEN 'graph'
WHEN len(list_filter(tags, lambda k: contains(k, 'note'))) > 0 THEN 'note' ELSE 'unknown' END AS kind, nullif(regexp_extract(x, '{ATTACHED}', 1), '') AS attachment FROM l""")
def storage_region_kinds(spark, folder):
    own = t(spark, folder, "pages").select("page_id", region_text().alias("x"))
    return own.select("page_id", names.storage_region_kind(F.col("x")).alias("kind"), names.attachment_name(F.col("x")).alias("attachment"))


@query(r"""
WITH r AS (SELECT page_id, ((['', '<p class=\"a\">', 'a < b', chr(13) || chr(10)])[page_id % 4 + 1] || '&lt;x&gt; &amp;amp; ' || chr(1) || substr(url, 1, 30) || '<i>' || chr(13) || 'z\''') AS raw FROM pages),
u AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\(["''])', '\1', 'g'), '\r\n?', chr(10), 'g') AS x FROM r)
SELECT page_id, trim(replace(replace(regexp_replace(x, '^(?:<[^>]*>)*([^<]*)(?:<[^>]*>)?', '\1'), chr(1), ''), chr(0), ''), ' ') AS cleaned FROM u""")
def cleaned_texts(spark, folder):
    raw = F.concat(pick(("", '<p class=\\"a\\">', "a < b", "\r\n"), F.col("page_id")), F.lit("&lt;x&gt; &amp;amp; \x01"), F.substring("url", 1, 30), F.lit("<i>\rz\\'"))
    return t(spark, folder, "pages").select("page_id", names.clean_text(raw).alias("cleaned"))


@query("""
WITH h AS (SELECT p_partkey, (['CPYA 4.2673 ', 'CPYUA 4.3380 ', 'CPYX 1 ', 'CPYA '])[p_partkey % 4 + 1] || p_size || (['#', '', 'q'])[p_partkey % 3 + 1] || chr(10) || p_name AS x FROM part), w AS (SELECT p_partkey, string_split(string_split(x, chr(10))[1], ' ') AS w FROM h)
SELECT p_partkey, CASE w[1] WHEN 'CPYUA' THEN 'opju' WHEN 'CPYA' THEN 'opj' END AS kind, CASE WHEN w[1] IN ('CPYUA', 'CPYA') THEN w[2] END AS version, CASE WHEN w[1] IN ('CPYUA', 'CPYA') THEN TRY_CAST(nullif(regexp_extract(w[3], '^([0-9]+)#?$', 1), '') AS BIGINT) END AS number FROM w""")
def file_headers(spark, folder):
    line = F.concat(pick(("CPYA 4.2673 ", "CPYUA 4.3380 ", "CPYX 1 ", "CPYA "), F.col("p_partkey")), F.col("p_size").cast("string"), pick(("#", "", "q"), F.col("p_partkey")), F.lit("\n"), F.col("p_name"))
    return parts(spark, folder).select("p_partkey", names.header(line.cast("binary")).alias("h")).select("p_partkey", "h.*")


@query(f"SELECT p_partkey, regexp_full_match(name, '[A-Za-z][A-Za-z0-9_.-]*_[A-Z]+(@[1-9][0-9]*)?') AS strict FROM (SELECT p_partkey, {SQL_NAME} AS name FROM part)")
def strict_identities(spark, folder):
    return parts(spark, folder).select("p_partkey", S.strict_identity(made_name()).alias("strict"))


@query(r"""
WITH n AS (SELECT p_partkey, (['con', 'Aux.', '..', 'a b/c', '', 'é', 'lpt1.txt', ' x. '])[p_partkey % 8 + 1] || CASE WHEN p_size % 4 = 0 THEN p_name ELSE '' END AS name FROM part), c AS (SELECT p_partkey, name, regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS x FROM n)
SELECT p_partkey, name, CASE WHEN regexp_matches(lower(x), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$') THEN '_' || x WHEN length(x) = 0 THEN 'item' ELSE x END AS safe FROM c""")
def safe_names(spark, folder):
    name = F.concat(pick(("con", "Aux.", "..", "a b/c", "", "é", "lpt1.txt", " x. "), F.col("p_partkey")), F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(""))
    return parts(spark, folder).select("p_partkey", name.alias("name")).withColumn("safe", S.safe_name(F.col("name")))


@query("SELECT event_id, CASE WHEN d BETWEEN 2350000 AND 2500000 THEN floor((d - 2440587) * 86400 + 0.5)::BIGINT END AS seconds FROM (SELECT event_id, 2340000 + event_id * 17 + value / 1024 AS d FROM events)")
def julian_days(spark, folder):
    day = 2340000 + F.col("event_id") * 17 + F.col("value") / 1024
    return t(spark, folder, "events").select("event_id", S.julian_epoch_seconds(day).cast("bigint").alias("seconds"))


SQL_TYPES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in classify.VALUE_TYPES.items())


@query(f"SELECT p_partkey, CASE p_size % 8 {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in classify.DESIGNATIONS.items())} END AS designation, CASE WHEN p_size % 9 = 0 THEN 'unknown' ELSE CASE (p_partkey % 64)::INTEGER {SQL_TYPES} ELSE 'text' END END AS value_type FROM part")
def code_maps(spark, folder):
    code = F.when(F.col("p_size") % 9 != 0, (F.col("p_partkey") % 64).cast("int"))
    return parts(spark, folder).select("p_partkey", classify.designation(F.col("p_size") % 8).alias("designation"), classify.value_type(code).alias("value_type"))


@query("""
SELECT kind, format FROM (SELECT DISTINCT (['worksheet', 'matrix', 'image_png', 'image_jpeg', 'note', 'function', 'excel'])[p_partkey % 7 + 1] AS kind FROM part) k,
LATERAL (SELECT unnest(CASE WHEN kind IN ('worksheet', 'matrix', 'excel', 'function') THEN ['json', 'jsonl', 'csv', 'tsv', 'xlsx'] WHEN starts_with(kind, 'image_') THEN ['json', kind[7:]] ELSE ['json'] END) AS format)""")
def retrieval_formats(spark, folder):
    kind = pick(("worksheet", "matrix", "image_png", "image_jpeg", "note", "function", "excel"), F.col("p_partkey"))
    return parts(spark, folder).select(kind.alias("kind")).distinct().select("kind", F.explode(classify.retrieval_formats(F.col("kind"))).alias("format"))


@query(f"""
SELECT p_brand, p_partkey, name, row_number() OVER (PARTITION BY p_brand ORDER BY regexp_extract(name, '^([^0-9]*)', 1), regexp_extract(name, '([0-9]+)', 1)::BIGINT, p_partkey)::INTEGER AS place FROM (SELECT p_brand, p_partkey, lower((['Book', 'Graph', 'note'])[p_size % 3 + 1]) || (p_partkey * 7 % 1013) AS name FROM part)""")
def natural_order(spark, folder):
    own = parts(spark, folder).select("p_brand", "p_partkey", F.concat(F.lower(pick(("Book", "Graph", "note"), F.col("p_size"))), F.col("p_partkey") * 7 % 1013).alias("name"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(S.natural_key(F.col("name")), "p_partkey")))


# ------------------------------------------------------------- filters and evidence


@query("""
WITH c AS (SELECT user_id AS tab, event_id AS row, unnest(CASE WHEN user_id % 10 = 0 AND event_id % 50 = 0 THEN [event_type, 'x'] ELSE [CASE WHEN user_id % 4 = 0 THEN 'Sheet1' WHEN user_id % 4 = 1 THEN event_type WHEN user_id % 7 = 2 THEN event_id::VARCHAR ELSE '*' || event_id END] END) AS v FROM events),
r AS (SELECT tab, row, count(*) FILTER (length(trim(v)) > 0) AS n, min(trim(v)) FILTER (length(trim(v)) > 0) AS v FROM c GROUP BY 1, 2), w AS (SELECT tab, max(n) > 1 AS wide FROM r GROUP BY 1), d AS (SELECT DISTINCT tab, v FROM r WHERE n = 1),
f AS (SELECT tab, count(*) AS n, count(*) FILTER (lower(v) IN ('plot', 'intercept', 'slope', 'slope_2', 'intercept_2')) AS stop, count(*) FILTER (starts_with(v, 'cell://') OR regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') OR regexp_matches(v, '^[0-9.eE+ -]+(;[0-9.eE+ -]+)+$')) AS marked,
count(*) FILTER (starts_with(v, 'cell://') OR regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') OR regexp_matches(v, '^[0-9.eE+ -]+(;[0-9.eE+ -]+)+$') OR (length(v) > 3 AND NOT ends_with(v, '*') AND NOT starts_with(lower(v), 'sheet') AND NOT starts_with(lower(v), 'page') AND regexp_matches(v, '^[A-Za-z0-9._-]+( [A-Za-z0-9._-]+)*$'))) AS good FROM d GROUP BY 1)
SELECT w.tab, wide OR (coalesce(f.n, 0) = 1 AND marked = 1) OR (coalesce(f.n, 0) > 1 AND stop = 0 AND good > 0 AND good >= 0.25 * f.n) AS meaningful FROM w LEFT JOIN f ON f.tab = w.tab""")
def meaningful_tables(spark, folder):
    user, event = F.col("user_id"), F.col("event_id")
    one = F.when(user % 4 == 0, "Sheet1").when(user % 4 == 1, F.col("event_type")).when(user % 7 == 2, event.cast("string")).otherwise(F.concat(F.lit("*"), event.cast("string")))
    cells = F.when((user % 10 == 0) & (event % 50 == 0), F.array(F.col("event_type"), F.lit("x"))).otherwise(F.array(one))
    return classify.meaningful(t(spark, folder, "events").select(user.alias("tab"), event.alias("row"), F.explode(cells).alias("v")), "tab", "row", "v")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag || l_linestatus AS kind, l_discount > 0.05 AND l_returnflag <> 'N' AS parser FROM lineitem), f AS (SELECT kind, bool_or(parser) AS has FROM r GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_extendedprice, kind, parser FROM r JOIN f USING (kind) WHERE parser OR NOT (has OR kind = 'NO')""")
def parser_rows_only(spark, folder):
    own = t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").alias("kind"), ((F.col("l_discount") > 0.05) & (F.col("l_returnflag") != "N")).alias("parser"))
    return selection.kinds_with_parser_rows(own, "kind", F.col("parser"), ["NO"])


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = event_id + 2)")
def media_signature_filter(spark, folder):
    events = t(spark, folder, "events").select("event_id", "user_id", "event_type")
    media = t(spark, folder, "orders").where("o_orderstatus = 'F'")
    free = links.without_twins(events.where("event_type <> 'purchase'"), media, [F.col("event_id") + 2], [F.col("o_orderkey")])
    return events.where("event_type = 'purchase'").unionByName(free).drop("event_type")


KINDS = ("worksheet", "matrix", "function", "note", "graph", "report_table")
CLASSES = ("data", "empty", "corrupt_text", "internal_references")


@query(f"""
WITH i AS (SELECT p_partkey, {sql_pick(KINDS, 'p_partkey')} AS kind, CASE WHEN p_size % 2 = 0 THEN 'origin_storage_family_' || p_size ELSE p_name END AS name, CASE WHEN p_size % 11 = 0 THEN 'partial' ELSE 'extracted' END AS status, CASE WHEN p_size % 13 <> 0 THEN p_brand END AS path, p_size % 17 AS size, {sql_pick(CLASSES, 'p_size')} AS cls, CASE WHEN p_size % 3 = 0 THEN 'x' END AS formula FROM part)
SELECT p_partkey, kind, CASE WHEN status = 'partial' THEN 'partial artifacts' WHEN path IS NULL THEN 'items without an artifact file' WHEN size = 0 THEN 'empty artifact files' WHEN kind IN ('worksheet', 'matrix', 'excel', 'report_table') AND cls <> 'data' THEN replace(cls, '_', ' ') || ' content'
WHEN kind = 'matrix' AND starts_with(name, 'origin_storage_family_') THEN 'unowned storage family' WHEN kind = 'function' AND formula IS NULL THEN 'functions without a decoded formula' END AS omitted FROM i""")
def artifact_omissions(spark, folder):
    size = F.col("p_size")
    kind = pick(KINDS, F.col("p_partkey"))
    reason = names.omission(kind, F.when(size % 2 == 0, F.concat(F.lit("origin_storage_family_"), size)).otherwise(F.col("p_name")), F.when(size % 11 == 0, "partial").otherwise("extracted"), F.when(size % 13 != 0, F.col("p_brand")), size % 17, pick(CLASSES, size), F.when(size % 3 == 0, "x"))
    return parts(spark, folder).select("p_partkey", kind.alias("kind"), reason.alias("omitted"))


@query("""
WITH f AS (SELECT c_nationkey, bool_or(c_acctbal > 9500) AS backed, bool_and(c_acctbal > -900) AS all_backed, bool_or(c_acctbal < -950) AS gaps FROM customer GROUP BY 1), n AS (SELECT n_nationkey, (['opj', 'opju', 'zip'])[n_nationkey % 3 + 1] AS detected, (['ok', 'ok', 'ok', 'empty', 'error', 'unsupported'])[n_nationkey % 6 + 1] AS parser_status FROM nation)
SELECT n_nationkey, CASE WHEN parser_status = 'error' THEN 'failed' WHEN detected = 'zip' OR parser_status = 'unsupported' THEN 'heuristic' WHEN detected = 'opj' AND parser_status = 'empty' THEN 'parser' WHEN NOT coalesce(backed, false) THEN 'heuristic' WHEN coalesce(gaps, false) OR NOT coalesce(all_backed, true) THEN 'partial' ELSE 'parser' END AS support FROM n LEFT JOIN f ON f.c_nationkey = n_nationkey""")
def support_classes(spark, folder):
    flags = t(spark, folder, "customer").groupBy("c_nationkey").agg(F.max(F.col("c_acctbal") > 9500).alias("backed"), F.min(F.col("c_acctbal") > -900).alias("all_backed"), F.max(F.col("c_acctbal") < -950).alias("gaps"))
    own = t(spark, folder, "nation").join(flags, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    flag = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    number = F.col("n_nationkey")
    return own.select("n_nationkey", names.support_class(pick(("opj", "opju", "zip"), number), pick(("ok", "ok", "ok", "empty", "error", "unsupported"), number), flag("backed", False), flag("all_backed", True), flag("gaps", False)).alias("support"))


@query("SELECT event_id, event_type, event_type IN ('error', 'search') OR value < 5 AS hidden FROM events")
def hidden_by_default(spark, folder):
    return t(spark, folder, "events").select("event_id", "event_type", (F.col("event_type").isin("error", "search") | (F.col("value") < 5)).alias("hidden"))


# ------------------------------------------------------------- owners


def windows(spark, folder):
    return t(spark, folder, "events").select((F.col("user_id") % 50).alias("file"), F.col("event_id").alias("win"), F.col("event_id").alias("w_start"), (F.col("event_id") + 40 + F.col("event_id") % 300).alias("w_end"), (F.col("event_type") == "purchase").alias("parser"))


SQL_WINDOWS = "w AS (SELECT user_id % 50 AS file, event_id AS win, event_id AS w_start, event_id + 40 + event_id % 300 AS w_end, event_type = 'purchase' AS parser FROM events)"


def points(spark, folder):
    return t(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("file"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 60).alias("at_end"))


SQL_POINTS = "p AS (SELECT o_orderkey, o_custkey % 50 AS file, o_orderkey AS pos, o_orderkey + 1 + o_custkey % 60 AS pos_end FROM orders)"


@query(f"WITH {SQL_WINDOWS}, {SQL_POINTS} SELECT p.o_orderkey, (min({{'a': NOT parser, 'b': win}}) FILTER (win IS NOT NULL)).b AS owner FROM p LEFT JOIN w ON w.file = p.file AND pos >= w_start AND pos < w_end GROUP BY 1")
def first_owner_by_priority(spark, folder):
    own = windows(spark, folder).withColumn("guess", ~F.col("parser"))
    return links.first_owner(points(spark, folder), own, "file", "o_orderkey", "at", "w_start", "w_end", "win", ["guess"], 512)


@query(f"WITH {SQL_WINDOWS}, {SQL_POINTS} SELECT o_orderkey FROM p WHERE EXISTS (SELECT 1 FROM w WHERE w.file = p.file AND pos >= w_start AND pos < w_end)")
def point_in_interval(spark, folder):
    return links.inside(points(spark, folder), windows(spark, folder), "file", "at", "w_start", "w_end", 512).select("o_orderkey")


@query(f"WITH {SQL_WINDOWS}, {SQL_POINTS} SELECT o_orderkey FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE parser AND w.file = p.file AND pos >= w_start AND pos < w_end)")
def report_span_filter(spark, folder):
    return links.inside(points(spark, folder), windows(spark, folder).where("parser"), "file", "at", "w_start", "w_end", 512, "left_anti").select("o_orderkey")


@query(f"WITH {SQL_WINDOWS}, {SQL_POINTS} SELECT o_orderkey, EXISTS (SELECT 1 FROM w WHERE parser AND w.file = p.file AND pos < w_end AND w_start < pos_end) AS overlaps FROM p")
def overlap_exists(spark, folder):
    return links.overlapping(points(spark, folder), windows(spark, folder).where("parser"), "file", "at", "at_end", "w_start", "w_end", 512).select("o_orderkey", "overlaps")


@query(f"""
WITH {SQL_WINDOWS}, {SQL_POINTS}, h AS (SELECT o_orderkey, count(win) AS n_owners, min(win) AS one, bool_or(parser) AS good FROM p LEFT JOIN w ON w.file = p.file AND pos >= w_start AND pos_end <= w_end GROUP BY 1)
SELECT o_orderkey, n_owners, CASE WHEN n_owners = 1 AND good THEN one END AS owner, CASE WHEN n_owners = 1 AND good THEN 'resolved' WHEN n_owners > 0 THEN 'ambiguous' ELSE 'missing' END AS status FROM h""")
def graph_owner(spark, folder):
    return links.range_owner(points(spark, folder), windows(spark, folder), "file", "o_orderkey", "at", "at_end", "w_start", "w_end", "win", "parser", 512)


# ------------------------------------------------------------- lookups


def status_sql(left: str, keys: str, on: str, target: str) -> str:
    return f"WITH d AS ({keys}) SELECT l.*, CASE WHEN lo = hi THEN lo END AS {target}, CASE WHEN lo = hi THEN 'resolved' WHEN lo IS NOT NULL THEN 'ambiguous' ELSE 'missing' END AS status FROM ({left}) l LEFT JOIN d ON {on}"


@query("""
WITH f AS (SELECT p_size AS ref, string_agg(p_partkey::VARCHAR, '|' ORDER BY p_partkey) AS functions, count(*) AS n FROM part WHERE p_type = 'PROMO' GROUP BY 1)
SELECT s_suppkey, coalesce(functions, '') AS functions, coalesce(n, 0) > 0 AS resolved FROM supplier LEFT JOIN f ON ref = s_suppkey % 70""")
def calculation_functions(spark, folder):
    found = parts(spark, folder).where("p_type = 'PROMO'").groupBy(F.col("p_size").alias("ref")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")), "|").alias("functions"))
    own = t(spark, folder, "supplier").join(found, F.col("s_suppkey") % 70 == F.col("ref"), "left")
    return own.select("s_suppkey", F.coalesce("functions", F.lit("")).alias("functions"), F.col("functions").isNotNull().alias("resolved"))


@query(status_sql("SELECT DISTINCT o_custkey, o_orderkey, o_orderkey // 4 AS a, o_orderkey // 4 + o_custkey % 5 AS b FROM orders", "SELECT l_orderkey // 4 AS a, l_orderkey // 4 + l_linenumber AS b, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1, 2", "d.a = l.a AND d.b = l.b", "target"))
def exact_span_twin(spark, folder):
    left = t(spark, folder, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_orderkey") / 4).alias("a"), (F.floor(F.col("o_orderkey") / 4) + F.col("o_custkey") % 5).alias("b")).distinct()
    right = t(spark, folder, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("a"), (F.floor(F.col("l_orderkey") / 4) + F.col("l_linenumber")).alias("b"), "l_partkey")
    return resolve.resolve(left, right, ["a", "b"], "l_partkey")


@query(status_sql("SELECT o_orderkey, o_orderkey + 5 AS terminal FROM orders", "SELECT event_id + (event_id % 7 + 10) - 8 AS terminal, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1", "d.terminal = l.terminal", "image"))
def terminal_offset_image(spark, folder):
    left = t(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") + 5).alias("terminal"))
    images = t(spark, folder, "events").select("event_id", (F.col("event_id") + (F.col("event_id") % 7 + 10) - 8).alias("terminal"))
    return resolve.resolve(left, images, ["terminal"], "event_id", "image")


@query("""
WITH n AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer)
SELECT s_suppkey, s_nationkey, number, c_custkey AS target FROM (SELECT s_suppkey, s_nationkey, (s_suppkey * 7 % 90)::INTEGER AS number FROM supplier) LEFT JOIN n ON c_nationkey = s_nationkey AND place = number""")
def positional_key(spark, folder):
    left = t(spark, folder, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") * 7 % 90).cast("int").alias("number"))
    return links.positional(left.withColumnRenamed("s_nationkey", "c_nationkey"), t(spark, folder, "customer"), "c_nationkey", "number", ["c_custkey"], "c_custkey").withColumnRenamed("c_nationkey", "s_nationkey")


@query("""
WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_layers, count(*) FILTER (l_returnflag = 'A') AS n_curves, count(*) FILTER (l_returnflag = 'N') AS n_annotations FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n_layers, 0) AS n_layers, coalesce(n_curves, 0) AS n_curves, coalesce(n_annotations, 0) AS n_annotations FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def window_children(spark, folder):
    kind = F.col("l_returnflag")
    children = t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count_if(kind == "R").alias("n_layers"), F.count_if(kind == "A").alias("n_curves"), F.count_if(kind == "N").alias("n_annotations"))
    own = t(spark, folder, "orders").join(children, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return own.select("o_orderkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_layers", "n_curves", "n_annotations")))


@query("""
WITH a AS (SELECT p_size % 5 AS layer, p_brand AS name, min(p_name) AS lo, max(p_name) AS hi FROM part WHERE p_type = 'SMALL' GROUP BY 1, 2)
SELECT p_partkey, layer, name, CASE WHEN NOT starts_with(name, '__') AND lo = hi THEN lo END AS formula FROM (SELECT p_partkey, p_size % 5 AS layer, CASE WHEN p_partkey % 9 = 0 THEN '__' || p_brand ELSE p_brand END AS name FROM part) LEFT JOIN a USING (layer, name)""")
def column_annotations(spark, folder):
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("__"), "p_brand")).otherwise(F.col("p_brand"))
    left = parts(spark, folder).select("p_partkey", (F.col("p_size") % 5).alias("layer"), name.alias("name"))
    notes = parts(spark, folder).where("p_type = 'SMALL'").select((F.col("p_size") % 5).alias("layer"), F.col("p_brand").alias("name"), "p_name").where(~F.startswith("name", F.lit("__")))
    return resolve.resolve(left, notes, ["layer", "name"], "p_name", "formula").drop("status")


@query("""
WITH m AS (SELECT c_nationkey AS file, c_custkey % 80 AS ordinal, min(c_name) AS label FROM customer GROUP BY 1, 2 HAVING count(*) = 1)
SELECT file, ordinal, s_suppkey, label FROM (SELECT s_nationkey AS file, s_suppkey % 80 AS ordinal, s_suppkey FROM supplier) LEFT JOIN m USING (file, ordinal)""")
def ordinal_metadata(spark, folder):
    meta = t(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("mf"), (F.col("c_custkey") % 80).alias("mo")).agg(F.min("c_name").alias("label"), F.count("*").alias("n")).where("n = 1")
    left = t(spark, folder, "supplier").select(F.col("s_nationkey").alias("file"), (F.col("s_suppkey") % 80).alias("ordinal"), "s_suppkey")
    return left.join(meta, (F.col("file") == F.col("mf")) & (F.col("ordinal") == F.col("mo")), "left").select("file", "ordinal", "s_suppkey", "label")


@query("SELECT c_nationkey, c_custkey % 80 AS ordinal, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2 HAVING count(*) = 1")
def duplicate_ordinals(spark, folder):
    return t(spark, folder, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 80).alias("ordinal")).agg(F.min("c_custkey").alias("c_custkey"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("""
WITH s AS (SELECT DISTINCT p_brand AS tab, chr((65 + p_size % 26)::INTEGER) AS col FROM part WHERE p_type <> 'SMALL'), a AS (SELECT DISTINCT p_brand AS tab, 'Sheet' || (p_partkey % 40) AS alias FROM part WHERE p_size < 8),
b AS (SELECT p_partkey, CASE WHEN p_partkey % 19 <> 0 THEN 'Sheet' || (p_partkey % 50) END AS sheet, chr((65 + p_size % 26)::INTEGER) AS x, chr((65 + p_partkey % 26)::INTEGER) AS y, p_size % 26 + 1 AS x_no, CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE (p_partkey % 26 + 1)::INTEGER END AS y_no FROM part),
h AS (SELECT p_partkey, count(DISTINCT a.tab) AS n, min(a.tab) AS one FROM b JOIN a ON alias = sheet JOIN s sx ON sx.tab = a.tab AND sx.col = x JOIN s sy ON sy.tab = a.tab AND sy.col = y GROUP BY 1)
SELECT p_partkey, CASE WHEN sheet IS NULL THEN 'unresolved_missing_source_fields' WHEN y_no = 0 THEN 'invalid_column_ordinal_invariant' WHEN n = 1 THEN 'resolved_exact' WHEN n > 1 THEN 'ambiguous_exact_candidates' ELSE 'unresolved' END AS status, CASE WHEN sheet IS NOT NULL AND y_no <> 0 AND n = 1 THEN one END AS "table" FROM b LEFT JOIN h USING (p_partkey)""")
def source_bindings(spark, folder):
    letter = lambda c: F.char((65 + c % 26).cast("int"))
    size, key = F.col("p_size"), F.col("p_partkey")
    sheets = parts(spark, folder).where("p_type <> 'SMALL'").select(F.col("p_brand").alias("table"), letter(size).alias("column"))
    aliases = parts(spark, folder).where("p_size < 8").select(F.col("p_brand").alias("table"), F.concat(F.lit("Sheet"), key % 40).alias("alias"))
    own = parts(spark, folder).select("p_partkey", F.when(key % 19 != 0, F.concat(F.lit("Sheet"), key % 50)).alias("sheet"), letter(size).alias("x"), letter(key).alias("y"), (size % 26 + 1).cast("bigint").alias("x_no"), F.when(key % 23 == 0, 0).otherwise(key % 26 + 1).cast("bigint").alias("y_no"))
    return links.candidates(own, ["p_partkey"], sheets, aliases, "sheet", "x", "y", "x_no", "y_no", S.column_ordinal)


@query(status_sql("SELECT s_suppkey, s_nationkey AS workbook, (s_suppkey % 100)::INTEGER AS sheet FROM supplier", "SELECT c_nationkey AS workbook, (c_custkey % 100)::INTEGER AS sheet, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1, 2", "d.workbook = l.workbook AND d.sheet = l.sheet", "report"))
def report_address(spark, folder):
    left = t(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("workbook"), (F.col("s_suppkey") % 100).cast("int").alias("sheet"))
    right = t(spark, folder, "customer").select(F.col("c_nationkey").alias("workbook"), (F.col("c_custkey") % 100).cast("int").alias("sheet"), "c_custkey")
    return resolve.resolve(left, right, ["workbook", "sheet"], "c_custkey", "report")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def unowned_images(spark, folder):
    return links.without_twins(parts(spark, folder).select("p_partkey", "p_name"), t(spark, folder, "lineitem").where("l_returnflag = 'R'"), [F.col("p_partkey")], [F.col("l_partkey")])


@query("""
WITH w AS (SELECT DISTINCT lower(p_brand) AS root, p_type AS kind FROM part WHERE p_size < 4)
SELECT p_partkey, section, kind FROM (SELECT p_partkey, upper(p_brand) || '_' || p_size AS section, p_type AS kind FROM part) s WHERE NOT EXISTS (SELECT 1 FROM w WHERE root = lower(string_split(section, '_')[1]) AND w.kind = s.kind)""")
def data_section_suppression(spark, folder):
    sections = parts(spark, folder).select("p_partkey", F.concat(F.upper("p_brand"), F.lit("_"), F.col("p_size").cast("string")).alias("section"), F.col("p_type").alias("kind"))
    return links.without_twins(sections, parts(spark, folder).where("p_size < 4"), [F.lower(F.substring_index("section", "_", 1)), F.col("kind")], [F.lower("p_brand"), F.col("p_type")])


@query("""
WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 WHEN c_custkey % 3 = 1 THEN c_custkey * 1000 END AS pid, 'N' || (c_custkey % 1200) AS name, CASE WHEN c_custkey % 5 <> 0 THEN '[N' || (c_custkey * 7 % 1300) || ']child' ELSE 'plain' END AS ref FROM customer), u AS (SELECT name, min(id) AS id FROM n GROUP BY 1 HAVING count(*) = 1)
SELECT n.id, coalesce(p.id, u.id) AS parent, CASE WHEN p.id IS NOT NULL THEN 'node_id' WHEN u.id IS NOT NULL THEN 'reference' END AS found_by FROM n LEFT JOIN n p ON p.id = n.pid LEFT JOIN u ON u.name = nullif(regexp_extract(n.ref, '^\\[([^\\]]+)\\]', 1), '')""")
def tree_ownership(spark, folder):
    key = F.col("c_custkey")
    nodes = t(spark, folder, "customer").select(key.alias("id"), F.when(key % 3 == 0, F.floor(key / 3)).when(key % 3 == 1, key * 1000).alias("pid_of"), F.concat(F.lit("N"), key % 1200).alias("name"), F.when(key % 5 != 0, F.concat(F.lit("[N"), key * 7 % 1300, F.lit("]child"))).otherwise("plain").alias("ref"))
    return links.tree_parents(nodes, "id", "pid_of", "ref", "name")


@query("""
WITH a AS (SELECT p_name AS name, min(p_brand) AS x FROM part WHERE p_size = 3 GROUP BY 1 HAVING min(p_brand) = max(p_brand)), b AS (SELECT p_name AS name, min(p_type) AS x FROM part WHERE p_size = 4 GROUP BY 1 HAVING min(p_type) = max(p_type)), c AS (SELECT p_partkey % 700 AS k, min(p_type) AS x FROM part GROUP BY 1 HAVING min(p_type) = max(p_type))
SELECT p_partkey, coalesce(a.x, b.x, c.x, 'derived/' || p_name) AS path, CASE WHEN a.x IS NOT NULL THEN 'project' WHEN b.x IS NOT NULL THEN 'tree' WHEN c.x IS NOT NULL THEN 'reference' ELSE 'derived' END AS found_by FROM part LEFT JOIN a ON a.name = p_name LEFT JOIN b ON b.name = p_name LEFT JOIN c ON k = p_partkey % 900""")
def source_path_chain(spark, folder):
    own = parts(spark, folder).select("p_partkey", F.col("p_name").alias("name"), (F.col("p_partkey") % 900).alias("k"))
    at = lambda n, c: parts(spark, folder).where(f"p_size = {n}").select(F.col("p_name").alias("name"), F.col(c).alias("x"))
    found = resolve.resolve_first(own, [(at(3, "p_brand"), ["name"], "x"), (at(4, "p_type"), ["name"], "x"), (parts(spark, folder).select((F.col("p_partkey") % 700).alias("k"), "p_type"), ["k"], "p_type")], "path", "step")
    return found.select("p_partkey", F.coalesce("path", F.concat(F.lit("derived/"), "name")).alias("path"), F.when(F.col("step") == 1, "project").when(F.col("step") == 2, "tree").when(F.col("step") == 3, "reference").otherwise("derived").alias("found_by"))


@query("""
WITH k AS (SELECT DISTINCT (['Book', 'A_B', 'Data'])[p_partkey % 3 + 1] || p_size AS sheet FROM part WHERE p_size < 30), s AS (SELECT DISTINCT (['Book', 'A_B', 'Data', 'Book'])[p_partkey % 4 + 1] || p_size || (['', '_C', '@2', '_C@3', '@x_y', '_D_E'])[p_partkey % 6 + 1] AS section FROM part),
c AS (SELECT section, string_split(section, '@')[1] AS bare, contains(section, '@') AS has FROM s), h AS (SELECT section, [CASE WHEN has AND contains(bare, '_') THEN string_split(bare, '_')[1] END, CASE WHEN has THEN bare END, CASE WHEN contains(section, '_') THEN string_split(section, '_')[1] END, CASE WHEN contains(bare, '_') THEN string_split(bare, '_')[1] END, section]
|| list_filter(list_transform(range(1, length(section)), lambda i: CASE WHEN section[i + 1] IN ('_', '@') THEN section[1:i] END), lambda x: x IS NOT NULL) AS heads FROM c), p AS (SELECT section, unnest(heads) AS head, generate_subscripts(heads, 1) AS rank FROM h)
SELECT section, arg_min(sheet, rank) FILTER (sheet IS NOT NULL) AS worksheet FROM p LEFT JOIN k ON sheet = head GROUP BY 1""")
def worksheet_names(spark, folder):
    size = F.col("p_size").cast("string")
    sheets = parts(spark, folder).where("p_size < 30").select(F.concat(pick(("Book", "A_B", "Data"), F.col("p_partkey")), size).alias("sheet"))
    sections = parts(spark, folder).select(F.concat(pick(("Book", "A_B", "Data", "Book"), F.col("p_partkey")), size, pick(("", "_C", "@2", "_C@3", "@x_y", "_D_E"), F.col("p_partkey"))).alias("section"))
    return links.sheet_of(sections, "section", sheets, "sheet")


@query("""
WITH tok AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM conversations), nam AS (SELECT DISTINCT item_id AS name, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark), s AS (SELECT conv_id, name, count(*) AS n FROM tok JOIN nam USING (token) GROUP BY 1, 2), m AS (SELECT conv_id, max(n) AS n_shared FROM s GROUP BY 1)
SELECT conv_id, n_shared, CASE WHEN count(*) = 1 THEN min(name) END AS name FROM s JOIN m USING (conv_id) WHERE n = n_shared GROUP BY 1, 2""")
def token_bindings(spark, folder):
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)
    talks = t(spark, folder, "conversations").select("conv_id", F.explode(tokens("text")).alias("token")).groupBy("conv_id").agg(F.collect_set("token").alias("tokens"))
    return links.bound_by_tokens(talks, "conv_id", F.col("tokens"), t(spark, folder, "benchmark"), "item_id", tokens("text"))


@query("SELECT e.event_id, s.o_orderkey AS state FROM (SELECT event_id, event_id + event_id % 9 AS report_end FROM events) e LEFT JOIN (SELECT min(o_orderkey) AS o_orderkey, o_orderkey * 2 AS start FROM orders GROUP BY o_orderkey * 2) s ON start = report_end")
def adjacent_state(spark, folder):
    reports = t(spark, folder, "events").select("event_id", (F.col("event_id") + F.col("event_id") % 9).alias("report_end"))
    states = t(spark, folder, "orders").groupBy((F.col("o_orderkey") * 2).alias("start")).agg(F.min("o_orderkey").alias("state"))
    return reports.join(states, F.col("report_end") == F.col("start"), "left").select("event_id", "state")
