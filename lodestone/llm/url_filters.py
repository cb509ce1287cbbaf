"""URL filters (operator 9), DataFrame functions only.

A rule is a host, a path and a verdict.  It fits its host and all subdomains
where the url's path starts with the rule's path; the longest fitting rule
wins, and of equally long ones an allowing one.

Urls that redirect to each other or name a canonical link are aliases: the
connected components of those edges, found by hooking to the least label and
shortcutting, with a checkpoint each round.  A url without a rule is blocked
if any alias is blocked by a rule.  A url's own rule always stands, so an
explicit allow is never overridden, and allowing is not passed on.

Urls and pages of any length are taken whole.  Null urls and urls without ``://`` have an empty host and path, no rule and no
aliases, and are allowed.  Null or repeated page ids give a row each.  An empty
table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Up to so many rules are written into the plan; more are joined.
MAX_INLINE_RULES = 2_000

#: Letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def host_suffixes(host: Column) -> Column:
    """a.b.c as [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _best(fits: Column) -> Column:
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["verdict"].eqNullSafe("allow").alias("allows"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]], inline: int = MAX_INLINE_RULES) -> DataFrame:
    """`df`, which has columns host and path, with columns rule and rule_verdict (null: none fits)."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(rules) <= inline:
        entries = []
        for host, own in by_host.items():
            entries += [F.lit(host), F.array(*(F.struct(F.lit(host + path).alias("rule"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")) for path, verdict in own))]
        table = F.create_map(*entries)
        found = F.flatten(F.filter(F.transform(host_suffixes(F.col("host")), lambda s: table[s]), lambda x: x.isNotNull()))
        best = _best(F.filter(found, lambda r: F.startswith(F.col("path"), r["path"])))
        return df.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")
    spark = df.sparkSession
    table = spark.createDataFrame([(h, h + p, p, v) for h, p, v in rules], "suffix string, rule string, rule_path string, verdict string")
    keys = df.select("host", "path").distinct()
    fits = keys.withColumn("suffix", F.explode(host_suffixes(F.col("host")))).join(table, "suffix").where(F.startswith(F.col("path"), F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict").eqNullSafe("allow").alias("allows"), "rule", "verdict")).alias("b"))
    return df.join(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("rule_verdict")), ["host", "path"], "left")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it, so that expressions stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def url_key(url: Column) -> Column:
    """A url without its fragment, scheme and host lower-cased; null without ``://``."""
    lowered = lambda bare, head: F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + F.lit(1)))
    key = lambda bare: F.when(F.instr(bare, "://") > 0, let(F.regexp_extract(bare, r"^[^/?#]*://[^/?#]*", 0), lambda head: lowered(bare, head)))
    return let(F.regexp_extract(url, r"^[^#]*", 0), key)


def without_dots(path: Column) -> Column:
    """A path without its segments `.` and `..`."""
    none = F.array().cast("array<string>")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))

    def joined(own):
        kept = F.aggregate(F.slice(own, 2, F.size(own)), none, step)
        tail = F.when(F.element_at(own, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))

    return let(F.split(path, "/", -1), joined)


def resolved(base: Column, link: Column) -> Column:
    """A link as a url, by the usual rules: absolute, without scheme, from the root, a query alone, or relative to the base's folder.  Null if it is none, like mailto:."""

    def whole(base, link):
        origin = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*", 0)
        path = let(F.regexp_extract(base, r"^[^/?#]*://[^/?#]*([^?#]*)", 1), lambda p: F.when(p == "", F.lit("/")).otherwise(p))
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
            .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^[^/?#]*:", 0), link))
            .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
            .when(F.startswith(link, F.lit("?")), F.concat(origin, path, link))
            .when((link == "") | F.startswith(link, F.lit("#")), F.regexp_extract(base, r"^[^#]*", 0))
            .otherwise(F.concat(origin, F.regexp_extract(path, r"^.*/", 0), link))
        )

    def plain(to):
        own = lambda k: F.regexp_extract(to, r"(?s)^([^/?#]*://[^/?#]*)([^?#]*)(.*)$", k)
        return F.when(own(2) == "", to).otherwise(F.concat(own(1), without_dots(own(2)), own(3)))

    return let(base, lambda b: let(let(F.trim(link), lambda x: whole(b, x)), plain))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, with character references for &, quotes and = replaced."""
    of = lambda k: F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))", k)
    value = F.concat(of(1), of(2), of(3))  # one of them has it
    for pattern, char in ((r"(?i)&(?:quot|#34|#x22);", '"'), (r"(?i)&(?:apos|#39|#x27);", "'"), (r"(?i)&(?:equals|#61|#x3d);", "="), (r"(?i)&(?:amp|#38|#x26);", "&")):
        value = F.regexp_replace(value, pattern, char)
    return value


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) between url keys: canonical links and refresh redirects in the pages, resolved against the page's url or its first <base>."""
    html = F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta|base)\b[^>]*>)"), 1)
    some = html.rlike(r"(?i)\bcanonical\b|\brefresh\b")
    raw = pages.where(some).select(F.col(url_col).alias("url"), tags.alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike(r"(?i)^<base\b")), lambda t: _attribute(t, "href")), lambda x: x != "")
    raw = raw.select("url", F.get(bases, F.lit(0)).alias("base"), F.explode(F.filter("tags", lambda t: ~t.rlike(r"(?i)^<base\b"))).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(tag.rlike(r"(?i)^<link\b") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical"), _attribute(tag, "href"))
    content = F.regexp_extract(_attribute(tag, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1)
    refresh = F.when(tag.rlike(r"(?i)^<meta\b") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), F.regexp_replace(F.trim(content), r"^[\"']|[\"']$", ""))
    raw = raw.select("url", "base", F.coalesce(canonical, refresh).alias("to")).where("length(to) > 0 and url is not null")
    base = F.when(F.col("base").isNull(), F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url")))
    return raw.select(url_key(F.col("url")).alias("a"), url_key(resolved(base, F.col("to"))).alias("b")).where("a is not null and b is not null and a <> b").distinct()


#: Edges for which one file of the labels is made.
TABLE_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Nodes of edges (a, b) with the least node of their connected component: (node, component)."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parts = -(-both.count() // TABLE_ROWS)
    if not parts:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    label = written(label.coalesce(parts), "label")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        hooked = label.join(near, label["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        up = label.select(F.col("node").alias("c"), F.col("component").alias("top"))
        after = hooked.join(up, "c", "left").select("node", "old", F.least("c", F.coalesce("top", "c")).alias("component"))
        after = written(after.coalesce(parts), "label")
        changed = after.where("component <> old").limit(1).count()
        label = after.select("node", "component")
        if not changed:
            return label


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, component (null without aliases)."""
    if edges is None:
        edges = html_edges(pages, url_col, html_col)
    label = components(edges)
    host, path = url_parts(F.col("node"))
    blocked = with_rules(label.withColumns({"host": host, "path": path}), rules).groupBy("component").agg(F.max(F.col("rule_verdict").eqNullSafe("block")).alias("alias_blocked"))
    alias = label.join(blocked, "component").select(F.col("node").alias("_key"), "component", "alias_blocked")
    host, path = url_parts(F.col(url_col))
    own = with_rules(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_key(F.col(url_col)).alias("_key")), rules)
    verdict = F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return own.join(alias, "_key", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
