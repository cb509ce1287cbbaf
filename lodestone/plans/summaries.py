"""Queries for summaries, order-dependent choices, sets and reshapes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import classify, names
from lodestone.functions import scalar as S
from lodestone.operators import reshape, selection, text

from .catalog import contents, query, t
from .records import SQL_KIND, SQL_NAME, made_name, parts, pick, sql_pick

# ------------------------------------------------------------- summaries

SQL_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def lines(spark, folder):
    return t(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", F.col("pos") + 1)


@query(f"""
WITH {SQL_LINES}
SELECT doc_id, sum(octet_length(encode(line))) FILTER (length(line) = 0)::BIGINT AS blank_bytes, sum(octet_length(encode(line))) FILTER (length(line) BETWEEN 1 AND 80)::BIGINT AS short_bytes, sum(octet_length(encode(line))) FILTER (length(line) > 80)::BIGINT AS long_bytes,
sum(octet_length(encode(line)) + 1) - 1 = (SELECT octet_length(encode(d.text)) FROM documents d WHERE d.doc_id = l.doc_id) AS complete, sha256(string_agg(line, chr(10) ORDER BY n)) AS digest FROM l GROUP BY 1""")
def byte_accounting(spark, folder):
    own = t(spark, folder, "documents").select("doc_id", F.octet_length("text").alias("size"), F.col("text"))
    parts_ = F.split("text", "\n")
    total = lambda test: F.when(F.exists(parts_, test), F.aggregate(F.filter(parts_, test), F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x)))
    classes = [("blank_bytes", lambda x: F.length(x) == 0), ("short_bytes", lambda x: F.length(x).between(1, 80)), ("long_bytes", lambda x: F.length(x) > 80)]
    all_ = F.aggregate(parts_, F.lit(-1).cast("bigint"), lambda a, x: a + F.octet_length(x) + 1)
    return own.where("text is not null").select("doc_id", *(total(f).alias(n) for n, f in classes), (all_ == F.col("size")).alias("complete"), F.sha2(F.array_join(parts_, "\n").cast("binary"), 256).alias("digest"))


@query("SELECT p_brand AS workbook, p_type AS sheet, count(*) AS n_columns, string_agg(p_name, '|' ORDER BY p_partkey) AS columns FROM part GROUP BY ALL")
def worksheet_columns(spark, folder):
    columns = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "|")
    return parts(spark, folder).groupBy(F.col("p_brand").alias("workbook"), F.col("p_type").alias("sheet")).agg(F.count("*").alias("n_columns"), columns.alias("columns"))


@query("SELECT l_suppkey, min(l_linenumber) AS first_row, max(l_linenumber) AS last_row, min(l_orderkey) AS first_offset, max(l_orderkey) AS last_offset FROM lineitem GROUP BY 1")
def extents(spark, folder):
    return t(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.min("l_linenumber").alias("first_row"), F.max("l_linenumber").alias("last_row"), F.min("l_orderkey").alias("first_offset"), F.max("l_orderkey").alias("last_offset"))


@query("""
WITH v AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS x FROM events), f AS (SELECT user_id, count(*) AS n, count(x) AS stored, max(event_id) FILTER (x IS NOT NULL) AS last_at, arg_min(x, event_id) FILTER (x IS NOT NULL) AS head FROM v GROUP BY 1),
c AS (SELECT user_id, min(event_id) AS change FROM v JOIN f USING (user_id) WHERE x IS DISTINCT FROM head GROUP BY 1)
SELECT f.user_id, any_value(f.stored) AS stored, any_value(n - stored) AS missing, count(*) FILTER (last_at IS NULL OR event_id > last_at) AS trailing_missing, count(*) FILTER (change IS NULL OR event_id < change) AS repeated_prefix FROM f JOIN v USING (user_id) LEFT JOIN c ON c.user_id = f.user_id GROUP BY 1""")
def value_shapes(spark, folder):
    own = t(spark, folder, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("x"))
    return reshape.value_shapes(own, "user_id", "event_id", "x")


@query("""
SELECT count(*) AS symbol_count, count(DISTINCT l_suppkey) AS analysis_count, count(*) FILTER (l_returnflag = 'R') AS equation_count, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS linked_symbol_count, count(*) FILTER (l_discount = 0) AS unresolved_count,
sum(CASE WHEN l_quantity > 25 THEN l_linenumber ELSE 0 END)::BIGINT AS reference_count, bool_or(l_tax > 0.07) AS partial FROM lineitem""")
def semantic_summary(spark, folder):
    c = F.col
    return t(spark, folder, "lineitem").agg(F.count("*").alias("symbol_count"), F.count_distinct("l_suppkey").alias("analysis_count"), F.count_if(c("l_returnflag") == "R").alias("equation_count"), F.count_if((c("l_linestatus") == "O") & (c("l_returnflag") == "N")).alias("linked_symbol_count"), F.count_if(c("l_discount") == 0).alias("unresolved_count"), F.sum(F.when(c("l_quantity") > 25, c("l_linenumber")).otherwise(0)).alias("reference_count"), F.max(c("l_tax") > 0.07).alias("partial"))


@query("SELECT l_suppkey % 20 AS book, l_linenumber AS sheet, count(*) AS n_cells, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS owners, min(l_orderkey) AS span_start, max(l_orderkey) AS span_end FROM lineitem GROUP BY ALL")
def report_accumulator(spark, folder):
    own = t(spark, folder, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("book"), F.col("l_linenumber").alias("sheet"))
    return own.agg(F.count("*").alias("n_cells"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("owners"), F.min("l_orderkey").alias("span_start"), F.max("l_orderkey").alias("span_end"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_columns, count(DISTINCT l_orderkey) AS n_analyses, count(*) AS n_occurrences FROM lineitem GROUP BY 1")
def reference_groups(spark, folder):
    return t(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_columns"), F.count_distinct("l_orderkey").alias("n_analyses"), F.count("*").alias("n_occurrences"))


@query("""
WITH m AS (SELECT event_type AS hypothesis, user_id AS marker FROM events WHERE value > 30), n AS (SELECT count(DISTINCT user_id) AS total FROM events), c AS (SELECT hypothesis, count(DISTINCT marker) AS matched FROM m GROUP BY 1)
SELECT hypothesis, matched, matched / total AS coverage, row_number() OVER (ORDER BY matched DESC, hypothesis)::INTEGER AS place FROM c, n""")
def framing_coverage(spark, folder):
    events = t(spark, folder, "events")
    total = events.agg(F.count_distinct("user_id")).first()[0]
    found = events.where("value > 30").groupBy(F.col("event_type").alias("hypothesis")).agg(F.count_distinct("user_id").alias("matched"))
    return found.select("hypothesis", "matched", (F.col("matched") / F.lit(total)).alias("coverage"), F.row_number().over(Window.orderBy(F.col("matched").desc(), "hypothesis")).alias("place"))


@query(f"SELECT kind, count(*) AS n, 'heuristic rows of this kind reached the limit of 100' AS warning FROM (SELECT {SQL_KIND.format(n='name')} AS kind FROM (SELECT {SQL_NAME} AS name FROM part)) GROUP BY 1 HAVING count(*) >= 100")
def heuristic_cap_warnings(spark, folder):
    return parts(spark, folder).groupBy(classify.object_kind(made_name()).alias("kind")).agg(F.count("*").alias("n")).where("n >= 100").withColumn("warning", F.lit("heuristic rows of this kind reached the limit of 100"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type IN ('purchase', 'view', 'click') AS good FROM events), i AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e)
SELECT user_id, count(*) AS n_runs, sum(n)::BIGINT AS n_rows FROM (SELECT user_id, island, count(*) AS n FROM i WHERE good GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1""")
def numeric_runs_per_span(spark, folder):
    runs = text.islands(t(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], F.col("event_type").isin("purchase", "view", "click"), 2)
    return runs.groupBy("user_id").agg(F.count("*").alias("n_runs"), F.sum("n_rows").alias("n_rows"))


@query("""
WITH c AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 AND event_id % 400 = 7 THEN event_type WHEN event_id % 5 = 0 THEN ' ' ELSE event_id || '.5' END AS cell FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM c WHERE length(trim(cell)) > 0)
SELECT user_id, bool_and(TRY_CAST(cell AS DOUBLE) IS NOT NULL) AS numeric FROM r WHERE k <= 100 GROUP BY 1""")
def numeric_columns(spark, folder):
    cell = F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 400 == 7), F.col("event_type")).when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return reshape.numeric_columns(t(spark, folder, "events").select("user_id", "event_id", cell.alias("cell")), "user_id", "event_id", "cell", 100)


# ------------------------------------------------------------- order-dependent


@query("SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey % 40, o_orderpriority ORDER BY o_orderkey) AS next_offset FROM orders")
def scoped_next_offset(spark, folder):
    scope = Window.partitionBy(F.col("o_custkey") % 40, "o_orderpriority").orderBy("o_orderkey")
    return t(spark, folder, "orders").select("o_orderkey", "o_custkey", F.lead("o_orderkey").over(scope).alias("next_offset"))


SQL_SPANS = "s AS (SELECT user_id AS file, event_id, event_id AS a, event_id + 1 + (event_id * 37 % 400) AS b FROM events)"


def spans(spark, folder):
    e = F.col("event_id")
    return t(spark, folder, "events").select(F.col("user_id").alias("file"), "event_id", e.alias("a"), (e + 1 + e * 37 % 400).alias("b"))


@query(f"""
WITH RECURSIVE {SQL_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY b - a DESC, a, event_id) AS n FROM s),
w AS (SELECT file, n, event_id, [{{'a': a, 'b': b}}] AS taken, true AS kept FROM o WHERE n = 1
UNION ALL SELECT o.file, o.n, o.event_id, CASE WHEN len(list_filter(w.taken, lambda x: x.a < o.b AND o.a < x.b)) = 0 THEN list_append(w.taken, {{'a': o.a, 'b': o.b}}) ELSE w.taken END, len(list_filter(w.taken, lambda x: x.a < o.b AND o.a < x.b)) = 0 FROM w JOIN o ON o.file = w.file AND o.n = w.n + 1)
SELECT file, event_id FROM w WHERE kept""")
def longest_first(spark, folder):
    return selection.longest_first(spans(spark, folder), "file", "a", "b", "event_id").select("file", "event_id")


@query(f"""
WITH RECURSIVE {SQL_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY a, b - a DESC, event_id) AS n FROM s),
w AS (SELECT file, n, event_id, a, b, NULL::BIGINT AS done FROM o WHERE n = 1
UNION ALL SELECT o.file, o.n, CASE WHEN o.b <= w.b THEN w.event_id ELSE o.event_id END, CASE WHEN o.b <= w.b THEN w.a ELSE o.a END, greatest(o.b, w.b), CASE WHEN o.b > w.b AND w.b <= o.a THEN w.event_id END FROM w JOIN o ON o.file = w.file AND o.n = w.n + 1)
SELECT file, done AS event_id FROM w WHERE done IS NOT NULL UNION ALL SELECT file, arg_max(event_id, n) FROM w GROUP BY 1""")
def containing_wins(spark, folder):
    return selection.containing_wins(spans(spark, folder), "file", "a", "b", "event_id").select("file", "event_id")


@query("SELECT l_suppkey, l_partkey, min(l_orderkey) AS first_at FROM lineitem GROUP BY 1, 2")
def first_seen_values(spark, folder):
    return selection.first_seen(t(spark, folder, "lineitem"), ["l_suppkey"], "l_partkey", "l_orderkey")


@query("SELECT user_id, event_id, least(coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), event_id + 256), event_id + 256) AS record_end FROM events")
def record_ends(spark, folder):
    return selection.record_ends(t(spark, folder, "events").select("user_id", "event_id"), ["user_id"], "event_id", 256)


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'N' AS marker FROM lineitem), x AS (SELECT l_orderkey, max(l_linenumber) FILTER (NOT marker) AS last_row FROM m GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey FROM m JOIN x USING (l_orderkey) WHERE l_linenumber <= last_row""")
def trailing_trim(spark, folder):
    own = t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return selection.trim_trailing(own, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "N").drop("l_returnflag")


@query("""
WITH d AS (SELECT user_id, event_id, event_id * 10 AS a, event_id * 10 + 1 + event_id % 300 AS b, event_type = 'view' AS prelude FROM events), p AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY a, b) AS before FROM d)
SELECT user_id, event_id, CASE WHEN a - before BETWEEN 0 AND 64 OR (a - before > 0 AND a - before <= 512 AND prelude) THEN before ELSE a END AS extended_start FROM p""")
def start_extension(spark, folder):
    e = F.col("event_id")
    own = t(spark, folder, "events").select("user_id", "event_id", (e * 10).alias("a"), (e * 10 + 1 + e % 300).alias("b"), (F.col("event_type") == "view").alias("prelude"))
    return selection.extended_starts(own, "user_id", "a", "b", F.col("prelude")).select("user_id", "event_id", "extended_start")


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, o_orderpriority)::INTEGER AS place FROM orders")
def catalog_order(spark, folder):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_orderstatus", "o_orderpriority")
    return t(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.row_number().over(order).alias("place"))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(CASE WHEN p_size % 3 <> 0 THEN p_type END, ''), p_size, p_name, p_partkey)::INTEGER AS place FROM part")
def manifest_order(spark, folder):
    order = Window.partitionBy("p_brand").orderBy(F.coalesce(F.when(F.col("p_size") % 3 != 0, F.col("p_type")), F.lit("")), "p_size", "p_name", "p_partkey")
    return parts(spark, folder).select("p_brand", "p_partkey", F.row_number().over(order).alias("place"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS table_no FROM orders), x AS (SELECT o_custkey, table_no, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS row_no FROM r JOIN lineitem ON l_orderkey = o_orderkey WHERE table_no <= 4)
SELECT o_custkey, table_no::INTEGER AS table_no, l_orderkey, l_linenumber FROM x WHERE row_no <= 2""")
def table_and_row_limits(spark, folder):
    tables = t(spark, folder, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("table_no")).where("table_no <= 4")
    rows = tables.join(t(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    numbered = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")))
    return numbered.where("row_no <= 2").select("o_custkey", "table_no", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, x.d AS l_partkey, x.c AS l_linenumber FROM (SELECT l_orderkey, min({'a': l_returnflag = 'R', 'b': l_discount, 'c': l_linenumber, 'd': l_partkey}) AS x FROM lineitem GROUP BY 1)")
def best_candidates(spark, folder):
    score = [(F.col("l_returnflag") == "R").alias("s"), F.col("l_discount"), F.col("l_linenumber"), F.col("l_partkey")]
    return selection.best(t(spark, folder, "lineitem"), ["l_orderkey"], score, ["l_partkey", "l_linenumber"])


LEAVES = ("raw_dump", "note", "graph", "worksheet", "meta", "function", "image")


@query(f"""
WITH l AS (SELECT p_brand, p_partkey, {sql_pick(LEAVES, 'p_partkey * 5 + p_size')} AS kind, p_name AS label FROM part WHERE p_size % 9 = 1), r AS (SELECT *, CASE WHEN kind = 'worksheet' THEN 0 WHEN kind IN ('graph', 'image') THEN 1 WHEN kind IN ('note', 'function') THEN 2 WHEN kind = 'raw_dump' THEN 9 ELSE 5 END AS rank FROM l)
SELECT p_brand, p_partkey, kind FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY rank, label, p_partkey) = 1""")
def preferred_leaves(spark, folder):
    own = parts(spark, folder).where("p_size % 9 = 1").select("p_brand", "p_partkey", pick(LEAVES, F.col("p_partkey") * 5 + F.col("p_size")).alias("kind"), "p_name")
    return selection.best(own, ["p_brand"], [names.leaf_rank(F.col("kind")).alias("r"), S.natural_key(F.col("p_name")).alias("k"), F.col("p_partkey")], ["p_partkey", "kind"])


# ------------------------------------------------------------- sets


@query("""
WITH a AS (SELECT o_custkey AS key, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS key, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, coalesce(b.value, a.value) AS value, b.key IS NOT NULL AS overlaid FROM a FULL JOIN b ON a.key = b.key""")
def map_overlay(spark, folder):
    of = lambda s: t(spark, folder, "orders").where(f"o_orderstatus = '{s}'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("value"))
    return reshape.overlay(of("F"), of("O"), ["key"], ["value"])


@query("SELECT event_id FROM events EXCEPT SELECT o_orderkey - 2 FROM orders WHERE o_orderstatus <> 'P'")
def set_difference(spark, folder):
    decoded = t(spark, folder, "orders").where("o_orderstatus <> 'P'").select((F.col("o_orderkey") - 2).alias("event_id"))
    return t(spark, folder, "events").select("event_id").subtract(decoded)


@query("SELECT p_partkey FROM part WHERE list_has_any([p_name, p_brand || '-' || p_size, p_type], (SELECT list(DISTINCT p_name) || list(DISTINCT p_brand || '-' || (p_size + 1)) FROM part WHERE p_size = 9))")
def evidence_intersection(spark, folder):
    size = F.col("p_size")
    evidence = parts(spark, folder).where("p_size = 9").select(F.explode(F.array(F.col("p_name"), F.concat("p_brand", F.lit("-"), size + 1))).alias("name")).distinct()
    tried = parts(spark, folder).select("p_partkey", F.explode(F.array(F.col("p_name"), F.concat("p_brand", F.lit("-"), size), F.col("p_type"))).alias("name"))
    return tried.join(evidence, "name", "left_semi").select("p_partkey").distinct()


# ------------------------------------------------------------- reshapes


@query("""
SELECT l_orderkey, coalesce(min(l_partkey) FILTER (l_linenumber = 1)::VARCHAR, '') || chr(9) || coalesce(min(l_partkey) FILTER (l_linenumber = 2)::VARCHAR, '') || chr(9) || coalesce(min(l_partkey) FILTER (l_linenumber = 3)::VARCHAR, '') || chr(9) || coalesce(min(l_partkey) FILTER (l_linenumber = 4)::VARCHAR, '') AS row_text FROM lineitem GROUP BY 1""")
def text_rows(spark, folder):
    cells = t(spark, folder, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3, 4]).agg(F.min("l_partkey"))
    return cells.select("l_orderkey", F.concat_ws("\t", *(F.coalesce(F.col(str(k)).cast("string"), F.lit("")) for k in (1, 2, 3, 4))).alias("row_text"))


@query("SELECT p_brand AS workbook, p_partkey, p_size % 4 AS sheet_index, CASE WHEN max(p_size % 4) OVER (PARTITION BY p_brand, p_type) > 1 THEN 'excel' ELSE 'worksheet' END AS kind FROM part")
def workbook_split(spark, folder):
    top = parts(spark, folder).groupBy(F.col("p_brand").alias("b"), F.col("p_type").alias("ty")).agg(F.max(F.col("p_size") % 4).alias("top"))
    own = parts(spark, folder).join(top, (F.col("p_brand") == F.col("b")) & (F.col("p_type") == F.col("ty")))
    return own.select(F.col("p_brand").alias("workbook"), "p_partkey", (F.col("p_size") % 4).alias("sheet_index"), F.when(F.col("top") > 1, "excel").otherwise("worksheet").alias("kind"))


@query("""
WITH n AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_linenumber) FILTER (l_returnflag = 'R') AS counts, list(l_suppkey ORDER BY l_suppkey, l_linenumber) FILTER (l_returnflag = 'A') AS percentiles, list(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag = 'N') AS custom FROM lineitem GROUP BY 1), k AS (SELECT *, least(len(counts), len(percentiles), len(custom)) AS n FROM n)
SELECT l_orderkey, i::INTEGER AS row_no, counts[i] AS counts, percentiles[i] AS percentiles, custom[i] AS custom FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM k WHERE counts IS NOT NULL AND percentiles IS NOT NULL AND custom IS NOT NULL)""")
def family_rows(spark, folder):
    of = lambda flag, c: F.transform(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct(F.col(c).alias("v"), "l_linenumber")))), lambda x: x["v"])
    lists = t(spark, folder, "lineitem").groupBy("l_orderkey").agg(of("R", "l_partkey").alias("counts"), of("A", "l_suppkey").alias("percentiles"), of("N", "l_linenumber").alias("custom"))
    return reshape.zipped(lists, "l_orderkey", ["counts", "percentiles", "custom"])


@query("""
WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, p_brand AS name FROM part), w AS (SELECT id, name AS path, 0 AS depth FROM c WHERE parent IS NULL UNION ALL SELECT c.id, w.path || '/' || c.name, w.depth + 1 FROM w JOIN c ON c.parent = w.id)
SELECT id, path, depth FROM w""")
def folder_paths(spark, folder):
    key = F.col("p_partkey")
    nodes = parts(spark, folder).select(key.alias("id"), F.when(key > 0, F.floor(key / 3)).alias("parent"), F.col("p_brand").alias("name"))
    return reshape.paths(nodes, "id", "parent", "name")


@query("""
WITH p AS (SELECT DISTINCT p_brand || '/' || p_type AS folder, p_name AS leaf FROM part), f AS (SELECT DISTINCT unnest([p_brand, p_brand || '/' || p_type]) AS path FROM part)
SELECT path, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] END AS parent, CASE WHEN contains(path, '/') THEN 2 ELSE 1 END AS depth, (SELECT count(*) FROM p WHERE folder = path) AS n_leaves FROM f""")
def project_tree(spark, folder):
    leaves = parts(spark, folder).select(F.concat("p_brand", F.lit("/"), "p_type").alias("folder"), F.col("p_name").alias("leaf")).distinct()
    return reshape.branches(leaves, "folder")


@query("""
SELECT event_id, 'props' AS section, 'props.' || k AS name, json_extract_string(props, '$."' || k || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
UNION ALL SELECT event_id, 'event', 'type', event_type FROM events""")
def property_rows(spark, folder):
    events = t(spark, folder, "events")
    nested = events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "value")).select("event_id", F.lit("props").alias("section"), F.concat(F.lit("props."), "k").alias("name"), "value")
    return nested.unionByName(events.select("event_id", F.lit("event").alias("section"), F.lit("type").alias("name"), F.col("event_type").alias("value")))


@query("""
WITH c AS (SELECT l_orderkey AS "row", l_linenumber AS col, min(l_partkey)::VARCHAR AS v FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 AND l_orderkey BETWEEN 100 AND 900 GROUP BY 1, 2)
SELECT "row", coalesce(min(v) FILTER (col = 2), '') || chr(9) || coalesce(min(v) FILTER (col = 3), '') || chr(9) || coalesce(min(v) FILTER (col = 4), '') AS line FROM c GROUP BY 1""")
def table_region(spark, folder):
    cells = t(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.min("l_partkey").cast("string").alias("v"))
    return reshape.region(cells, "row", "col", "v", 100, 2, 900, 4)


# ------------------------------------------------------------- scans of texts


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '([ -~]{4,})', 1)) AS text FROM documents""")
def decoded_region_strings(spark, folder):
    from lodestone.sources import codecs, files

    packed = files.transcoded(contents(spark, folder), "content", "packed", lambda b: len(b).to_bytes(4, "little") + codecs.lz4_encode(b)).drop("content")
    back = files.transcoded(packed, "packed", "content", lambda b: codecs.lz4_decode(b[4:], int.from_bytes(b[:4], "little"))[0])
    return files.strings(back.select("doc_id", "content"), 4, "doc_id").select("doc_id", "text")


@query(f"""
WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9_.@-]+)', 1)) AS token, generate_subscripts(regexp_extract_all(text, '([A-Za-z0-9_.@-]+)', 1), 1) AS pos FROM documents), n AS (SELECT doc_id, pos, token, {SQL_KIND.format(n='token')} AS kind FROM k),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) AS r FROM n WHERE kind IS NOT NULL), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS q FROM c WHERE r <= 2)
SELECT doc_id, pos::INTEGER AS pos, token, kind FROM d WHERE q <= 24""")
def object_token_scan(spark, folder):
    return text.object_tokens(t(spark, folder, "documents"), "doc_id", "text", classify.object_kind, 2, 24)


@query("SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1197) || '...' ELSE text END AS note FROM documents")
def note_texts(spark, folder):
    return t(spark, folder, "documents").select("doc_id", text.shortened(F.col("text"), 1200).alias("note"))


@query(r"""
WITH x AS (SELECT page_id, (['a', chr(10) || '=[C:\d\' || page_id || '.xlsx]S!A', 'b[' || page_id || '.xlsx', '[x' || page_id || '.XLSX]Sheet1!B2'])[page_id % 4 + 1] || chr(1) || 'tail' AS s FROM pages)
SELECT page_id, nullif(ltrim(string_split(s, chr(1))[1], chr(10)), '') AS reference, regexp_extract(s, '(?i)\[([^\[\]\x01]*\.xlsx)\]', 1) AS workbook FROM x WHERE regexp_matches(s, '(?i)\[[^\[\]\x01]*\.xlsx\]')""")
def external_links(spark, folder):
    key = F.col("page_id").cast("string")
    made = F.element_at(F.array(F.lit("a"), F.concat(F.lit("\n=[C:\\d\\"), key, F.lit(".xlsx]S!A")), F.concat(F.lit("b["), key, F.lit(".xlsx")), F.concat(F.lit("[x"), key, F.lit(".XLSX]Sheet1!B2"))), (F.col("page_id") % 4 + 1).cast("int"))
    return text.workbook_links(t(spark, folder, "pages").select("page_id", F.concat(made, F.lit("\x00tail")).alias("s")), "page_id", "s")


@query(r"""
WITH k AS (SELECT p_partkey, unnest(string_split(x, chr(1))) AS token FROM (SELECT p_partkey, (['=A' || p_size || chr(1) || '=', '=col(a)*' || p_size, 'x' || chr(1) || '=-', '==' || p_brand])[p_partkey % 4 + 1] AS x FROM part))
SELECT p_partkey, token FROM k WHERE length(token) BETWEEN 2 AND 512 AND regexp_matches(token, '^=[ -~]*[A-Za-z0-9][ -~]*$')""")
def formula_tokens(spark, folder):
    size = F.col("p_size").cast("string")
    made = F.element_at(F.array(F.concat(F.lit("=A"), size, F.lit("\x00=")), F.concat(F.lit("=col(a)*"), size), F.lit("x\x00=-"), F.concat(F.lit("=="), "p_brand")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return parts(spark, folder).select("p_partkey", F.explode(F.split(made, "\x00")).alias("token")).where(names.formula_token(F.col("token")))


@query(r"""
WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z]+)(?:\s[^<>]*)?>[^<>]*</', 1)) AS tag, unnest(regexp_extract_all(html, '<[a-z]+(?:\s[^<>]*)?>([^<>]*)</', 1)) AS value FROM pages)
SELECT page_id, tag, trim(value, ' ') AS value FROM f WHERE tag IN ('title', 'h1')""")
def selected_fields(spark, folder):
    return text.leaf_fields(t(spark, folder, "pages"), "page_id", "html", ["title", "h1"])


# ------------------------------------------------------------- sinks as rows


@query("""SELECT l_orderkey, 'orders/' || l_orderkey AS path, string_agg(replace(l_returnflag || ';' || l_linestatus, ';', '%3B'), ';' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS cells FROM lineitem GROUP BY 1""")
def packed_rows(spark, folder):
    cell = F.replace(F.concat("l_returnflag", F.lit(";"), "l_linestatus"), F.lit(";"), F.lit("%3B"))
    own = t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", cell.alias("cell")))).alias("rows"))
    return own.select("l_orderkey", F.concat(F.lit("orders/"), F.col("l_orderkey")).alias("path"), F.array_join(F.transform("rows", lambda x: x["cell"]), ";").alias("cells"))


@query("""
SELECT n_regionkey AS file, 0::BIGINT AS line_no, '{"columns":["n_nationkey","n_name"],"rows":' || count(*) || '}' AS line FROM nation GROUP BY 1
UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' FROM nation""")
def jsonl_lines(spark, folder):
    return reshape.jsonl(t(spark, folder, "nation"), "n_regionkey", ["n_nationkey", "n_name"], ["n_nationkey"])


@query("""
SELECT p_brand AS file, string_agg('{' || CASE WHEN p_size % 3 <> 0 THEN '"path":"' || p_type || '",' ELSE '' END || '"kind":"' || (CASE WHEN p_size > 20 THEN 'worksheet' ELSE 'note' END) || '","name":"' || p_name || '","id":' || p_partkey || '}', ',' ORDER BY CASE WHEN p_size % 3 <> 0 THEN p_type ELSE '' END, CASE WHEN p_size > 20 THEN 'worksheet' ELSE 'note' END, p_name, p_partkey) AS items FROM part GROUP BY 1""")
def manifest_items(spark, folder):
    own = parts(spark, folder).select("p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("path"), F.when(F.col("p_size") > 20, "worksheet").otherwise("note").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    rows = F.sort_array(F.collect_list(F.struct(F.coalesce("path", F.lit("")).alias("o"), "kind", "name", "id", F.to_json(F.struct("path", "kind", "name", "id")).alias("json"))))
    return own.groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.transform(rows, lambda x: x["json"]), ",").alias("items"))


@query("""
WITH d AS (SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ' | ' ORDER BY l_suppkey::VARCHAR) AS links, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, 'symbol:' || l_partkey || chr(9) || n || chr(9) || links AS line FROM d""")
def provenance_lines(spark, folder):
    own = t(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))).alias("links"))
    return own.select("l_partkey", F.concat_ws("\t", F.concat(F.lit("symbol:"), F.col("l_partkey")), F.size("links"), F.array_join("links", " | ")).alias("line"))


@query("""SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || CASE WHEN o_orderstatus <> 'P' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}' AS identity FROM orders""")
def identity_projection(spark, folder):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    return t(spark, folder, "orders").select("o_orderkey", F.to_json(F.struct("o_custkey", "o_orderkey", status)).alias("identity"))


@query("SELECT p_name AS name, p_type AS kind, NULL::VARCHAR AS path, p_size AS size FROM part")
def canonical_items(spark, folder):
    return reshape.canonical(parts(spark, folder).select(F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_name").alias("name"), "p_retailprice"), [("name", "string"), ("kind", "string"), ("path", "string"), ("size", "int")])
