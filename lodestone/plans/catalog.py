"""The operators as queries on the star-schema tables, each beside its SQL.

Every entry is a name, a function of (spark, folder) and the SQL that gives the
same rows, or None where SQL can't.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import classify
from lodestone.functions import scalar as S
from lodestone.operators import compare, dedup, intervals, reshape, resolve, text
from lodestone.sources import codecs, files, legacy

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day(column: str):
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


# ------------------------------------------------------------- counting and dedup


@query("""
WITH g AS (SELECT lang, sha256(text) AS digest, min(doc_id) AS kept_id, count(*) AS n_copies FROM documents GROUP BY ALL)
SELECT d.doc_id, d.lang, g.digest, g.kept_id, g.n_copies, d.doc_id <> g.kept_id AS is_alias
FROM documents d JOIN g ON g.lang = d.lang AND g.digest = sha256(d.text)""")
def content_dedup_aliases(spark, folder):
    out = dedup.content_dedup(t(spark, folder, "documents").select("doc_id", "lang", "text"), ["lang"], F.sha2(F.col("text").cast("binary"), 256), ["doc_id"])
    return out.select("doc_id", "lang", "digest", F.col("kept.doc_id").alias("kept_id"), "n_copies", "is_alias")


@query("""
WITH o AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS occurrence FROM lineitem)
SELECT l_orderkey, l_partkey, occurrence, 'item:v1:' || sha256(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, occurrence::VARCHAR)) AS item_id FROM o""")
def item_identity_id(spark, folder):
    rows = dedup.occurrence(t(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_partkey"], ["l_linenumber"])
    return rows.select("l_orderkey", "l_partkey", F.col("occurrence").cast("bigint"), dedup.identity("l_orderkey", "l_partkey", "occurrence").alias("item_id"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_kind(spark, folder):
    return t(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS n_large FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def evidence_counts_sets(spark, folder):
    return t(spark, folder, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"))


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25")
def signature_summary_topk(spark, folder):
    return dedup.cap_per_kind(t(spark, folder, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], 25)


@query("""
SELECT event_id, event_type FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, event_type FROM (SELECT * FROM events WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 24)""")
def cap_per_kind(spark, folder):
    events = t(spark, folder, "events").select("event_id", "event_type", "ts")
    return dedup.cap_per_kind(events, "event_type", ["ts", "event_id"], 24, F.col("event_type") == "purchase").select("event_id", "event_type")


@query("""
SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R') DESC, l_orderkey, l_linenumber, l_extendedprice) <= 2""")
def cap_per_name_slots(spark, folder):
    lines = t(spark, folder, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return dedup.cap_with_slots(lines, "l_partkey", F.col("l_returnflag") == "R", ["l_orderkey", "l_linenumber", "l_extendedprice"], 2)


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '__' || n END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def unique_suffix_names(spark, folder):
    return dedup.unique_suffix(t(spark, folder, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("""
SELECT 'customer' AS origin, c_custkey AS key, c_nationkey AS nation FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""")
def union_first_wins(spark, folder):
    a = t(spark, folder, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    b = t(spark, folder, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return dedup.union_first_wins([a, b], ["key"])


# ------------------------------------------------------------- lookups

@query("""
WITH d AS (SELECT p_size AS k, count(DISTINCT p_brand) AS n, min(p_brand) AS b FROM part WHERE p_type = 'ECONOMY' AND p_retailprice < 1000 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = 1 THEN b END AS target, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM (SELECT *, (l_partkey % 60)::INTEGER AS k FROM lineitem) LEFT JOIN d USING (k)""")
def resolve_unique_match(spark, folder):
    names = t(spark, folder, "part").where("p_type = 'ECONOMY' and p_retailprice < 1000").select(F.col("p_size").alias("k"), "p_brand")
    lines = t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 60).cast("int").alias("k"))
    return resolve.resolve(lines, names, ["k"], "p_brand").drop("k")


@query("""
WITH d AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(DISTINCT c_custkey) AS n, min(c_custkey) AS b FROM customer WHERE c_acctbal > 9000 GROUP BY 1, 2)
SELECT s_suppkey, CASE WHEN n = 1 THEN b END AS target, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM (SELECT s_suppkey, s_nationkey AS nation, CASE WHEN s_suppkey % 2 = 0 THEN 'MACHINERY' ELSE 'BUILDING' END AS segment FROM supplier) LEFT JOIN d USING (nation, segment)""")
def resolve_with_owner(spark, folder):
    names = t(spark, folder, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_custkey")
    left = t(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 2 == 0, "MACHINERY").otherwise("BUILDING").alias("segment"))
    return resolve.resolve(left, names, ["nation", "segment"], "c_custkey").select("s_suppkey", "target", "status")


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_size FROM part), a AS (SELECT p_partkey AS k, p_brand AS x FROM p WHERE p_size > 25),
b AS (SELECT p_name AS n, CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) END AS y FROM p WHERE p_size = 1 GROUP BY 1)
SELECT p.p_partkey, coalesce(a.x, b.y) AS target, CASE WHEN a.x IS NOT NULL THEN 1 WHEN b.y IS NOT NULL THEN 2 END AS resolved_by
FROM p LEFT JOIN a ON a.k = p.p_partkey LEFT JOIN b ON b.n = p.p_name""")
def two_key_fallback(spark, folder):
    part = t(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    left = part.select("p_partkey", "p_name")
    return resolve.resolve_first(left, [(part.where("p_size > 25"), ["p_partkey"], "p_brand"), (part.where("p_size = 1"), ["p_name"], "p_brand")]).select("p_partkey", "target", "resolved_by")


@query(r"""
WITH x AS (SELECT page_id, regexp_extract(url, '^[^?#]*', 0) AS path FROM pages), y AS (SELECT page_id, path, nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS parent FROM x),
g AS (SELECT parent AS p, count(*) AS n_siblings, count(DISTINCT path) AS n_paths FROM y GROUP BY 1)
SELECT page_id, parent, n_siblings, n_paths FROM y JOIN g ON g.p = y.parent""")
def parent_by_path(spark, folder):
    own = t(spark, folder, "pages").select("page_id", F.regexp_extract("url", r"^[^?#]*", 0).alias("path"))
    own = own.withColumn("parent", resolve.parent_path(F.col("path")))
    groups = own.groupBy("parent").agg(F.count("*").alias("n_siblings"), F.count_distinct("path").alias("n_paths"))
    return own.join(groups, "parent").select("page_id", "parent", "n_siblings", "n_paths")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_matched FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 3")
def relational_division(spark, folder):
    return resolve.containing_groups(t(spark, folder, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""
WITH v AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS s FROM lineitem), d AS (SELECT s_suppkey AS s, 'low' AS dictionary FROM supplier WHERE s_suppkey < 60 UNION ALL SELECT s_suppkey, 'high' FROM supplier WHERE s_suppkey >= 40),
z AS (SELECT g, count(*) AS n FROM v GROUP BY 1), h AS (SELECT g, dictionary, count(*) AS hits FROM v JOIN d USING (s) GROUP BY 1, 2)
SELECT g AS l_orderkey, min(dictionary) AS dictionary, min(n) AS n_values FROM h JOIN z USING (g) WHERE hits = n GROUP BY 1 HAVING count(*) = 1""")
def dictionary_all_match(spark, folder):
    supplier = t(spark, folder, "supplier").select("s_suppkey")
    names = supplier.where("s_suppkey < 60").withColumn("name", F.lit("low")).unionByName(supplier.where("s_suppkey >= 40").withColumn("name", F.lit("high")))
    return resolve.all_in_one_dictionary(t(spark, folder, "lineitem"), "l_orderkey", "l_suppkey", names, "s_suppkey", "name")


@query("""
SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY 1
HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AND max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) = 0""")
def group_reject(spark, folder):
    return resolve.clean_groups(t(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_discount") > 0.09)


@query("""
SELECT n.n_nationkey, CASE WHEN count(DISTINCT c.c_mktsegment) = 1 THEN min(c.c_mktsegment) END AS only_segment, count(c.c_custkey) AS n_customers
FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900 GROUP BY 1""")
def distinct_singleton(spark, folder):
    rich = t(spark, folder, "customer").where("c_acctbal > 9900").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = t(spark, folder, "nation").select("n_nationkey").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.groupBy("n_nationkey").agg(F.when(F.min("c_mktsegment") == F.max("c_mktsegment"), F.min("c_mktsegment")).alias("only_segment"), F.count("c_custkey").alias("n_customers"))


# ------------------------------------------------------------- intervals


def order_days(spark, folder):
    return t(spark, folder, "orders").select(F.col("o_custkey").alias("k"), day("o_orderdate").alias("s"), (day("o_orderdate") + 30).alias("e"), "o_orderkey", "o_orderstatus")


DAYS = "(SELECT o_custkey AS k, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS s, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER + 30 AS e, o_orderkey, o_orderstatus FROM orders)"
MERGED = f"""
a AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {DAYS}),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM a),
m AS (SELECT k, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM b GROUP BY k, i)"""


@query("SELECT event_id, user_id, epoch_us(ts) AS start_us, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 1735689600000000) AS window_end FROM events")
def object_windows(spark, folder):
    events = t(spark, folder, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"))
    return intervals.windows_to_next(events, "user_id", "start_us", ["event_id"], F.lit(1735689600000000))


@query(f"WITH {MERGED} SELECT k, s, e, n_merged FROM m")
def merged_ranges(spark, folder):
    return intervals.merged(order_days(spark, folder), "k", "s", "e")


@query(f"""
WITH d AS (SELECT * FROM {DAYS}), i AS (SELECT k, coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 8000) AS gap_start, s AS gap_end FROM d
UNION ALL SELECT k, max(e), 12000 FROM d GROUP BY 1)
SELECT k, gap_start, gap_end FROM i WHERE gap_end - gap_start >= 7""")
def gap_ranges(spark, folder):
    return intervals.gaps(order_days(spark, folder), "k", "s", "e", F.lit(8000), F.lit(12000), F.lit(7))


RANKED = f"(SELECT k, s, e, CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'P' THEN 3 ELSE 1 END AS r FROM {DAYS})"


@query(f"""
WITH x AS (SELECT * FROM {RANKED}), p AS (SELECT DISTINCT k, s AS p FROM x UNION SELECT DISTINCT k, e FROM x),
c AS (SELECT k, p AS s, lead(p) OVER (PARTITION BY k ORDER BY p) AS e FROM p), g AS (SELECT c.k, c.s, c.e, coalesce(max(x.r), 0) AS r FROM c LEFT JOIN x ON x.k = c.k AND x.s <= c.s AND x.e >= c.e WHERE c.e IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT *, CASE WHEN lag(r) OVER (PARTITION BY k ORDER BY s) = r THEN 0 ELSE 1 END AS f FROM g), i AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM n)
SELECT k, min(s) AS "start", max(e) AS "end", min(r) AS rank FROM i GROUP BY k, i""")
def sweep_partition(spark, folder):
    ranked = order_days(spark, folder).withColumn("r", F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 3).otherwise(1))
    return intervals.sweep(ranked, "k", "s", "e", "r")


@query(f"""
WITH v AS (SELECT event_id, user_id AS k, 9000 + (value * 25)::INTEGER AS at FROM events), d AS (SELECT * FROM {DAYS})
SELECT v.event_id, v.k, v.at, count(d.o_orderkey) AS n_owners, CASE WHEN count(d.o_orderkey) = 1 THEN min(d.o_orderkey) END AS owner
FROM v LEFT JOIN d ON d.k = v.k AND v.at >= d.s AND v.at < d.e GROUP BY 1, 2, 3""")
def contain_unique_owner(spark, folder):
    points = t(spark, folder, "events").select("event_id", F.col("user_id").alias("k"), (F.lit(9000) + F.bround(F.col("value") * 25).cast("int")).alias("at"))
    return intervals.contained_in_one(points, order_days(spark, folder), "k", "at", "s", "e", "o_orderkey", 90)


@query(f"""
WITH {MERGED}, d AS (SELECT * FROM {DAYS} WHERE o_orderstatus = 'F')
SELECT m.k, m.s, m.e, d.o_orderkey, least(m.e, d.e) - greatest(m.s, d.s) AS overlap FROM m JOIN d ON d.k = m.k AND m.s < d.e AND d.s < m.e""")
def overlap_collect(spark, folder):
    own = order_days(spark, folder)
    right = own.where("o_orderstatus = 'F'").select("k", F.col("s").alias("s2"), F.col("e").alias("e2"), "o_orderkey")
    return intervals.overlap_counts(intervals.merged(own, "k", "s", "e").select("k", "s", "e"), right, "k", ("s", "e"), ("s2", "e2"), 120).select("k", "s", "e", "o_orderkey", "overlap")


@query(f"""
WITH d AS (SELECT * FROM {DAYS})
SELECT a.o_orderkey, b.o_orderkey AS best, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM d a JOIN d b ON b.k = a.k AND b.o_orderstatus = 'P' AND a.o_orderstatus = 'F' AND a.s < b.e AND b.s < a.e
QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, b.o_orderkey) = 1""")
def best_overlap(spark, folder):
    own = order_days(spark, folder)
    left = own.where("o_orderstatus = 'F'").select("k", "s", "e", "o_orderkey")
    right = own.where("o_orderstatus = 'P'").select("k", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("o_orderkey").alias("other"))
    pairs = intervals.overlap_counts(left, right, "k", ("s", "e"), ("s2", "e2"), 60)
    best = pairs.groupBy("o_orderkey").agg(F.max(F.struct("overlap", (-F.col("other")).alias("n"))).alias("b"))
    return best.select("o_orderkey", (-F.col("b.n")).alias("best"), F.col("b.overlap").alias("overlap"))


@query("""
WITH e AS (SELECT event_id, user_id AS k, 800000000000000 + event_id * 20000000000 AS "at" FROM events), o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS "at", o_orderkey, o_totalprice FROM orders)
SELECT event_id, e.k, e.at, o.o_totalprice AS as_of_value, o.at AS as_of_at FROM e LEFT JOIN o ON o.k = e.k AND o.at <= e.at
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY o.at DESC NULLS LAST, o.o_orderkey DESC) = 1""")
def as_of_preceding(spark, folder):
    events = t(spark, folder, "events").select("event_id", F.col("user_id").alias("k"), (F.lit(800000000000000) + F.col("event_id") * 20000000000).alias("at"))
    orders = t(spark, folder, "orders").select(F.col("o_custkey").alias("k"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderkey", "o_totalprice")
    return intervals.as_of(events, orders, "k", "at", "at", "o_totalprice", "o_orderkey")


@query(f"""
WITH RECURSIVE d AS (SELECT k, s, e, o_orderkey, row_number() OVER (PARTITION BY k ORDER BY s, o_orderkey) AS n FROM {DAYS}),
r AS (SELECT k, n, s, o_orderkey, TRUE AS keep, e AS lim FROM d WHERE n = 1
UNION ALL SELECT d.k, d.n, d.s, d.o_orderkey, d.s >= r.lim, CASE WHEN d.s >= r.lim THEN d.e ELSE r.lim END FROM r JOIN d ON d.k = r.k AND d.n = r.n + 1)
SELECT k, s, o_orderkey FROM r WHERE keep""")
def greedy_suppression(spark, folder):
    return intervals.suppress_overlaps(order_days(spark, folder).select("k", "s", "e", "o_orderkey"), "k", "s", "e", "o_orderkey").select("k", "s", "o_orderkey")


# ------------------------------------------------------------- text


@query(r"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ -~]{4,}')) AS span, generate_subscripts(regexp_extract_all(text, '[ -~]{4,}'), 1) - 1 AS ordinal FROM documents)
SELECT doc_id, ordinal::INTEGER AS ordinal, length(span)::INTEGER AS n, sha256(span) AS digest FROM s""")
def text_spans(spark, folder):
    spans = t(spark, folder, "documents").select("doc_id", F.posexplode(S.printable_spans(F.col("text"))).alias("ordinal", "span"))
    return spans.select("doc_id", "ordinal", F.length("span").alias("n"), F.sha2(F.col("span").cast("binary"), 256).alias("digest"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no::INTEGER AS line_no, trim(line, ' ') AS line FROM l WHERE length(line) >= 4""")
def text_lines(spark, folder):
    return text.lines(t(spark, folder, "documents"), "doc_id", "text", 4)


@query("""
WITH n AS (SELECT event_id, user_id, ts, value, CASE WHEN value >= 10 THEN 1 ELSE 0 END AS ok FROM events),
i AS (SELECT *, sum(1 - ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n)
SELECT user_id, island::BIGINT AS island, count(*) AS n_rows, min(event_id) AS first_event FROM i WHERE ok = 1 GROUP BY 1, 2 HAVING count(*) >= 3""")
def numeric_islands(spark, folder):
    return text.islands(t(spark, folder, "events"), "user_id", ["ts", "event_id"], F.col("value") >= 10, 3, F.min("event_id").alias("first_event"))


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), f AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2)
SELECT doc_id, round(-sum((n / t) * log2(n / t)), 6) AS entropy FROM (SELECT doc_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM f) GROUP BY 1""")
def char_entropy(spark, folder):
    return text.char_entropy(t(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), f AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2),
h AS (SELECT doc_id, -sum((n / t) * log2(n / t)) AS e FROM (SELECT doc_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM f) GROUP BY 1)
SELECT d.doc_id, CASE WHEN coalesce(h.e, 0) < 1 THEN 'padding' WHEN h.e >= 4.45 THEN 'high_entropy' WHEN regexp_matches(d.text, '[ -~]{200,}') THEN 'text' ELSE 'mixed' END AS class FROM documents d LEFT JOIN h USING (doc_id)""")
def region_class(spark, folder):
    docs = t(spark, folder, "documents").select("doc_id", "text")
    e = text.char_entropy(docs, "doc_id", "text")
    joined = docs.select("doc_id", F.col("text").rlike(r"[ -~]{200,}").alias("printable")).join(e, "doc_id", "left")
    entropy = F.coalesce("entropy", F.lit(0.0))
    return joined.select("doc_id", F.when(entropy < 1, "padding").when(entropy >= 4.45, "high_entropy").when(F.col("printable"), "text").otherwise("mixed").alias("class"))


@query(r"""
WITH n AS (SELECT 'conversations' AS origin, text AS x FROM conversations UNION ALL SELECT 'pages', html FROM pages),
k AS (SELECT origin, x, lower(substr(ltrim(x, ' '), 1, 64)) AS h FROM n)
SELECT origin, CASE WHEN x IS NULL OR length(trim(x, ' ')) = 0 THEN 'empty' WHEN starts_with(h, '{\rtf') THEN 'rtf' WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') THEN 'html' WHEN starts_with(h, '<') THEN 'xml' ELSE 'text' END AS note_type, count(*) AS n FROM k GROUP BY 1, 2""")
def note_type(spark, folder):
    a = t(spark, folder, "conversations").select(F.lit("conversations").alias("origin"), F.col("text").alias("x"))
    b = t(spark, folder, "pages").select(F.lit("pages").alias("origin"), F.col("html").alias("x"))
    return a.unionByName(b).select("origin", S.note_type(F.col("x")).alias("note_type")).groupBy("origin", "note_type").agg(F.count("*").alias("n"))


@query(r"""
WITH v AS (SELECT page_id, 'title' AS tag, unnest(regexp_extract_all(html, '<title(?:\s[^<>]*)?>([^<>]*)</title>', 1)) AS value FROM pages
UNION ALL SELECT page_id, 'a', unnest(regexp_extract_all(html, '<a(?:\s[^<>]*)?>([^<>]*)</a>', 1)) FROM pages UNION ALL SELECT page_id, 'h1', unnest(regexp_extract_all(html, '<h1(?:\s[^<>]*)?>([^<>]*)</h1>', 1)) FROM pages)
SELECT page_id, tag, value FROM v""")
def leaf_fields(spark, folder):
    pages = t(spark, folder, "pages")
    out = None
    for tag in ("title", "a", "h1"):
        own = pages.select("page_id", F.lit(tag).alias("tag"), F.explode(S.leaf_values(F.col("html"), tag)).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)/([a-z]+)/([0-9]+)', 2) AS book, regexp_extract(url, '^([a-z]+)://([^/]+)/([a-z]+)/([0-9]+)', 3) AS sheet, TRY_CAST(regexp_extract(url, '^([a-z]+)://([^/]+)/([a-z]+)/([0-9]+)', 4) AS BIGINT) AS cell FROM pages""")
def reference_extract(spark, folder):
    pattern = r"^([a-z]+)://([^/]+)/([a-z]+)/([0-9]+)"
    part = lambda i: F.regexp_extract("url", pattern, i)
    return t(spark, folder, "pages").select("page_id", part(2).alias("book"), part(3).alias("sheet"), part(4).try_cast("bigint").alias("cell"))


@query(r"""
WITH n AS (SELECT 'Book' || (c_custkey % 7) || '_' || chr((65 + c_custkey % 26)::INTEGER) || CASE WHEN c_custkey % 3 = 0 THEN '@' || (c_custkey % 5) ELSE '' END AS name FROM customer)
SELECT name, regexp_extract(name, '^(.*)_([A-Z])', 1) AS book, regexp_extract(name, '_([A-Z])', 1) AS "column", CASE WHEN name NOT LIKE '%@%' THEN 1 WHEN name LIKE '%@0' THEN NULL ELSE TRY_CAST(split_part(name, '@', 2) AS INTEGER) END AS sheet, count(*) AS n FROM n GROUP BY ALL""")
def dataset_name_split(spark, folder):
    name = F.concat(F.lit("Book"), F.col("c_custkey") % 7, F.lit("_"), F.char(65 + F.col("c_custkey") % 26), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("@"), F.col("c_custkey") % 5)).otherwise(""))
    own = t(spark, folder, "customer").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return own.withColumn("x", S.dataset_name(F.col("name"))).select("name", "x.book", "x.column", "x.sheet", "n")


@query("SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g'))[1:3] AS letters, list_sum(list_transform([1,2,3], lambda i: (CASE WHEN i <= length(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g'))[1:3]) THEN (ascii(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g'))[i:i]) - 64) * (26 ** (least(3, length(regexp_replace(p_name, '[^A-Za-z]', '', 'g'))) - i)) ELSE 0 END)))::BIGINT AS ordinal FROM part")
def column_ordinal(spark, folder):
    letters = F.substring(F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")), 1, 3)
    return t(spark, folder, "part").select("p_partkey", letters.alias("letters"), S.column_ordinal(letters).alias("ordinal"))


# ------------------------------------------------------------- comparison and shape


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linenumber = 5 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linenumber = 7))
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, sum(x)::BIGINT AS left_count, sum(y)::BIGINT AS right_count FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY 1, 2, 3, 4 HAVING sum(x) <> sum(y)""")
def manifest_diff(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    left = t(spark, folder, "lineitem").select(*columns)
    right = left.where("not (l_returnflag = 'R' and l_linenumber = 7)").withColumn("l_quantity", F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 5), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return compare.multiset_diff(left, right, columns)


@query("""
WITH a AS (SELECT c_nationkey AS b, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS k FROM customer WHERE c_mktsegment = 'BUILDING'),
c AS (SELECT c_nationkey AS b, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS k FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT coalesce(a.b, c.b) AS c_nationkey, coalesce(a.k, c.k)::INTEGER AS k, a.v AS left_value, c.v AS right_value, CASE WHEN a.v IS NULL THEN 'right_only' WHEN c.v IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN c ON a.b = c.b AND a.k = c.k""")
def bucket_pairing(spark, folder):
    customer = t(spark, folder, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    return compare.pair_kth(customer.where("c_mktsegment = 'BUILDING'"), customer.where("c_mktsegment = 'MACHINERY'"), ["c_nationkey"], ["c_acctbal"], "c_acctbal")


@query("""
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'NaN'::DOUBLE ELSE o_totalprice END AS v FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')),
b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'NaN'::DOUBLE WHEN o_orderstatus = 'F' THEN o_totalprice * (1 + 1e-14) WHEN o_orderpriority = '2-HIGH' THEN o_totalprice + 0.01 ELSE o_totalprice END AS v FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'))
SELECT o_orderkey, a.v AS left_value, b.v AS right_value, CASE WHEN a.o_orderkey IS NULL THEN 'missing_left' WHEN b.o_orderkey IS NULL THEN 'missing_right' ELSE 'value' END AS reason FROM a FULL JOIN b USING (o_orderkey)
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR isnan(a.v) OR isnan(b.v) OR abs(a.v - b.v) > greatest(1e-12 * greatest(abs(a.v), abs(b.v)), 1e-12)""")
def tolerant_cell_diff(spark, folder):
    orders = t(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    nan, price = F.lit(float("nan")), F.col("o_totalprice")
    partial, status = F.col("o_orderstatus") == "P", F.col("o_orderpriority")
    odd = partial & (status == "3-MEDIUM")
    left = orders.where(~(partial & (status == "5-LOW"))).select("o_orderkey", F.when(odd, nan).otherwise(price).alias("v"))
    changed = F.when(odd, nan).when(F.col("o_orderstatus") == "F", price * (1 + 1e-14)).when(status == "2-HIGH", price + F.lit(0.01)).otherwise(price)
    right = orders.where(~(partial & (status == "1-URGENT"))).select("o_orderkey", changed.alias("v"))
    return compare.cell_differences(left, right, ["o_orderkey"], "v")


@query("SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN l_linenumber = {i} THEN q END) AS line_{i}" for i in range(1, 8)) + " FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def transpose_columns(spark, folder):
    cells = t(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    wide = reshape.transpose(cells, "l_orderkey", "l_linenumber", "q", list(range(1, 8)))
    return wide.select("l_orderkey", *[F.col(str(i)).alias(f"line_{i}") for i in range(1, 8)])


@query('SELECT vec_id, ((i - 1) // 8)::INTEGER AS "row", ((i - 1) % 8)::INTEGER AS col, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)')
def matrix_reshape(spark, folder):
    return reshape.matrix(t(spark, folder, "embeddings"), "vec_id", "embedding", 8)


@query("""
WITH k AS (SELECT user_id, CASE WHEN value < 1 THEN NULL WHEN value = floor(value) THEN 'unsigned_integer' WHEN value > 100 THEN 'text' ELSE 'numeric' END AS kind FROM events)
SELECT user_id, count(kind) AS n_cells, CASE WHEN count(kind) = 0 THEN 'empty' WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS value_type FROM k GROUP BY 1""")
def value_type_agg(spark, folder):
    v = F.col("value")
    kind = F.when(v < 1, F.lit(None)).when(v == F.floor(v), "unsigned_integer").when(v > 100, "text").otherwise("numeric")
    return reshape.kinds(t(spark, folder, "events").select("user_id", kind.alias("kind")), "user_id", "kind")


@query("""
WITH n AS (SELECT n_nationkey AS id, r_name || '/' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT 0 AS level, r_regionkey::BIGINT AS id, r_name AS path FROM region UNION ALL SELECT 1, id::BIGINT, path FROM n UNION ALL SELECT 2, c_custkey, path || '/' || c_name FROM customer JOIN n ON n.id = c_nationkey""")
def recursive_tree(spark, folder):
    return reshape.tree([(t(spark, folder, "region"), "r_regionkey", None, "r_name"), (t(spark, folder, "nation"), "n_nationkey", "n_regionkey", "n_name"), (t(spark, folder, "customer"), "c_custkey", "c_nationkey", "c_name")])


# ------------------------------------------------------------- classes


@query("""
SELECT 'documents' AS origin, CASE WHEN text IS NULL OR length(text) = 0 THEN 'unknown_text' WHEN contains(lower(text), '<html') OR contains(lower(text), '</html>') THEN 'html_like'
WHEN contains(text, '# ') OR contains(text, '- ') OR contains(text, '* ') OR contains(text, '```') OR contains(text, '> ') THEN 'markdown_like' ELSE 'plain_text' END AS payload_type, count(*) AS n FROM documents GROUP BY 1, 2
UNION ALL SELECT 'pages', CASE WHEN contains(lower(html), '<html') OR contains(lower(html), '</html>') THEN 'html_like' ELSE 'other' END, count(*) FROM pages GROUP BY 1, 2""")
def note_payload_type(spark, folder):
    a = t(spark, folder, "documents").select(F.lit("documents").alias("origin"), classify.note_payload_type(F.col("text")).alias("payload_type"))
    b = t(spark, folder, "pages").select(F.lit("pages").alias("origin"), classify.note_payload_type(F.col("html")).alias("payload_type"))
    b = b.withColumn("payload_type", F.when(F.col("payload_type") == "html_like", "html_like").otherwise("other"))
    return a.unionByName(b).groupBy("origin", "payload_type").agg(F.count("*").alias("n"))


@query(r"""
SELECT doc_id, (length(text) - length(replace(text, chr(65533), '')))::INTEGER AS replacement_characters, (length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')))::INTEGER AS control_characters FROM documents""")
def text_issue_counts(spark, folder):
    return t(spark, folder, "documents").select("doc_id", classify.text_issues(F.col("text")).alias("x")).select("doc_id", "x.*")


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents), s AS (SELECT doc_id, trim(v, ' ') AS v FROM c),
g AS (SELECT doc_id, count(*) FILTER (length(v) > 0) AS n, count(*) FILTER (v = '??' OR starts_with(v, 'cell://')) AS inner_n, count(*) FILTER (length(v) > 0 AND (length(v) > 160 OR contains(v, '<') OR contains(v, '>') OR contains(v, chr(92)) OR contains(v, '"') OR contains(v, '@') OR v[1] IN ('!', ')', ';'))) AS odd, count(*) FILTER (regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$')) AS numbers FROM s GROUP BY 1)
SELECT doc_id, n AS n_values, CASE WHEN n = 0 THEN 'empty' WHEN inner_n = n THEN 'internal_references' WHEN n >= 8 AND numbers = 0 AND odd * 2 > n THEN 'corrupt_text' ELSE 'data' END AS content_class FROM g""")
def tabular_content_class(spark, folder):
    cells = t(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "v"))
    return classify.content_class(cells, "doc_id", "row", "v")


# ------------------------------------------------------------- bytes and codecs


def contents(spark, folder, table: str = "documents", key: str = "doc_id", text: str = "text"):
    return t(spark, folder, table).select(key, F.col(text).cast("binary").alias("content"))


@query(r"""
WITH s AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '([^ -~]*)([ -~]*)')) AS part, generate_subscripts(regexp_extract_all(text, '([^ -~]*)([ -~]*)'), 1) AS n FROM documents),
p AS (SELECT doc_id, n, regexp_extract(part, '[ -~]*$', 0) AS run, sum(octet_length(encode(part))) OVER (PARTITION BY doc_id ORDER BY n) AS reach FROM s)
SELECT doc_id, (reach - length(run))::BIGINT AS "offset", run AS text FROM p WHERE length(run) >= 4""")
def binary_strings(spark, folder):
    return files.strings(contents(spark, folder), 4, "doc_id")


@query("""
WITH l AS (SELECT event_id // 1000 AS block, string_agg(CASE WHEN event_type = 'error' THEN 'gap' ELSE event_id || ' ' || user_id END, chr(10) ORDER BY event_id) AS body FROM events GROUP BY 1),
p AS (SELECT block, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM l), g AS (SELECT *, line <> 'gap' AS ok FROM p),
i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY n) AS island FROM g), c AS (SELECT block, island, line, n, count(*) OVER (PARTITION BY block, island) AS size, row_number() OVER (PARTITION BY block, island ORDER BY n) AS r FROM i WHERE ok)
SELECT block, dense_rank() OVER (PARTITION BY block ORDER BY island)::INTEGER AS table_no, r::INTEGER AS row_in_table, string_split(line, ' ')[1] AS first, string_split(line, ' ')[2] AS second FROM c WHERE size >= 3""")
def numeric_table_scan(spark, folder):
    line = F.when(F.col("event_type") == "error", "gap").otherwise(F.concat("event_id", F.lit(" "), "user_id"))
    body = t(spark, folder, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("block")).agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    made = body.select("block", F.array_join(F.transform("l", lambda x: x["line"]), "\n").cast("binary").alias("content"))
    found = files.numeric_tables(made, 3, 2, "block")
    kept = found.select("block", "table_id").distinct().withColumn("table_no", F.row_number().over(Window.partitionBy("block").orderBy("table_id")))
    return found.join(kept, ["block", "table_id"]).select("block", "table_no", "row_in_table", F.col("values")[0].alias("first"), F.col("values")[1].alias("second"))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def lz4_roundtrip(spark, folder):
    packed = files.transcoded(contents(spark, folder).withColumn("n_bytes", F.octet_length("content").cast("bigint")), "content", "packed", lambda b: len(b).to_bytes(4, "little") + codecs.lz4_encode(b))
    back = files.transcoded(packed, "packed", "back", lambda b: codecs.lz4_decode(b[4:], int.from_bytes(b[:4], "little"))[0])
    return back.select("doc_id", F.sha2("back", 256).alias("digest"), "n_bytes")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def byterun_decode(spark, folder):
    packed = files.transcoded(contents(spark, folder), "content", "packed", codecs.byte_runs_encode)
    return files.transcoded(packed, "packed", "back", lambda b: codecs.byte_runs_decode(b)[0]).select("doc_id", F.sha2("back", 256).alias("digest"))


@query('SELECT vec_id, (i - 1)::INTEGER AS pos, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)')
def fpc_roundtrip(spark, folder):
    return embeddings_roundtrip(t(spark, folder, "embeddings"))


def embeddings_roundtrip(df):
    files.ship(df.sparkSession)

    def run(batches):
        for b in batches:
            for key, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got, _ = codecs.fpc_decode(codecs.fpc_encode(codecs.patterns(values)), len(values))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array(codecs.doubles(got), pa.float64())], names=["vec_id", "pos", "value"])

    return df.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id bigint, pos int, value double")


@query("""
WITH f AS (SELECT o_orderkey, o_totalprice, o_orderkey // 1000 AS file, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS "row" FROM orders)
SELECT file, 'Book1_A' AS name, "row", 'float' AS kind, o_totalprice AS f64, NULL::BIGINT AS i64 FROM f UNION ALL SELECT file, 'Book1_B', "row", 'integer', NULL, o_orderkey FROM f""")
def legacy_project_cells(spark, folder):
    rows = t(spark, folder, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("file")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("r"))
    files.ship(spark)

    def run(batches):
        for b in batches:
            for key, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = legacy.pack_dataset("Book1_A", b"".join(struct.pack("<d", x["o_totalprice"]) for x in r), len(r), 8)
                c = legacy.pack_dataset("Book1_B", b"".join(struct.pack("<i", x["o_orderkey"]) for x in r), len(r), 4, 0x800)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([legacy.pack_file([a, c])], pa.binary())], names=["file", "content"])

    made = rows.mapInArrow(run, "file bigint, content binary")
    return files.legacy_cells(made, "file").select("file", "name", "row", "kind", "f64", "i64")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTRY.items() if s}
