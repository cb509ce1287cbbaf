"""Operator 9 against a plain version."""

import random

import pytest

from lodestone.llm.url_filters import components, html_edges, url_filter

from .conftest import rows_of

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest[:cut].translate(low), tail[:end]


def rule(url):
    host, path = parts(url)
    fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def key(url):
    if url is None or "://" not in url.split("#")[0]:
        return None
    url = url.split("#")[0]
    host, _ = parts(url)
    scheme, rest = url.split("://", 1)
    return scheme.lower() + "://" + host + rest[len(host) :]


def brute(pages, edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        top[find(a)] = find(b)
    blocked = {find(n) for n in list(top) if rule(n)[1] == "block"}
    out = []
    for i, u in pages:
        r, v = rule(u)
        k = key(u)
        alias = "block" if k in top and find(k) in blocked else "allow"
        out.append((i, *parts(u), r, v or alias))
    return out


@pytest.mark.parametrize("inline", [True, False])
def test_rules_and_aliases(spark, inline, monkeypatch):
    import lodestone.llm.url_filters as U

    if not inline:
        real = U.with_rules
        monkeypatch.setattr(U, "with_rules", lambda df, rules: real(df, rules, inline=0))
    r = random.Random(2)
    hosts = ["a.example.net", "EXAMPLE.net", "x.example.com", "example.com", "b.org", "org", "net", "aexample.com", "t.de", "u.de", "v.de"]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/en/1', '/en', '/de/2?q=/fr/', '/fr/3#x', '?a', '#/en/'])}" for _ in range(150)]
    urls += [None, "", "no scheme", "http://", "://net/", "a#http://b.net/", "HTTP://u.de/p?x://y", "http://t.de/\nnet/"]
    pages, edges = [], []
    for i, u in enumerate(urls):
        html = "<html>"
        if key(u) and r.random() < 0.6:
            to = r.choice(urls[:150])
            html += r.choice([f'<link rel="canonical" href="{to}">', f"<META http-equiv=refresh content='0;url={to}'>", f"<link href='{to}'\n rel=canonical>"])
            edges.append((key(u), key(to)))
        pages.append((i, u, html))
    pages += [(None, urls[3], None), (3, urls[3], "")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, host string").repartition(3)
    got = rows_of(U.url_filter(df, RULES).drop("component"))
    assert sorted(got, key=str) == sorted(brute([p[:2] for p in pages], edges), key=str)


def test_relative_links(spark):
    df = spark.createDataFrame([(1, "http://a.de/x", '<link rel="canonical" href="/y">'), (2, "https://a.de/x", '<link rel=canonical href="//b.net/z">')], "page_id bigint, url string, html string")
    assert sorted(rows_of(html_edges(df))) == [("http://a.de/x", "http://a.de/y"), ("https://a.de/x", "https://b.net/z")]
    assert {r.page_id: r.verdict for r in url_filter(df, RULES).collect()} == {1: "allow", 2: "block"}


def test_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n) if i != 30], "a string, b string")
    got = dict(rows_of(components(edges)))
    assert got == {f"{i:03}": ("000" if i <= 30 else "031") for i in range(n + 1)}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter(none, RULES).count() == 0
    assert url_filter(none, []).count() == 0


def test_links_resolve_as_usual(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    from lodestone.llm.url_filters import resolved

    bases = ["http://a.de/b/c/d?q=1", "http://a.de", "https://a.de/x/", "http://a.de/x?y=/z/"]
    links = ["g", "./g", "g/", "/g", "//h.org/g", "?y", "g?y", "#s", "g#s", "..", "../", "../g", "../..", "../../g", "../../../g", "./../g", "g/./h", "g/../h", "http://z.net/a/b", "page2.html", "a b/../c"]
    rows = [(b, x) for b in bases for x in links]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", resolved(F.col("b"), F.col("x")).alias("y")).collect()
    for b, x, y in got:
        want = urljoin(b, x).split("#")[0].replace("a.de?", "a.de/?")
        assert y.split("#")[0].rstrip("/") == want.rstrip("/"), (b, x)
    assert spark.createDataFrame([("http://a.de/", "mailto:x@y")], "b string, x string").select(resolved(F.col("b"), F.col("x"))).first()[0] is None


def test_blocks_pass_over_links_in_pages(spark):
    pages = [
        (1, "http://www.example.net/p", None),
        (2, "http://a.de/x/1.html", '<LINK href="../y/2.html?a=1&amp;b=2" REL="alternate Canonical">'),
        (3, "http://a.de/y/2.html?a=1&b=2", "<meta content='0; URL=//www.example.net/p' http-equiv=Refresh>"),
        (4, "http://b.de/q", '<base href="http://a.de/x/"><link rel=canonical href=1.html>'),
        (5, "http://b.de/en", '<link rel="next" href="http://www.example.net/p">the canonical way'),
        (6, "http://org/fr/z", '<link rel="canonical" href="http://a.de/x/1.html">'),
        (7, "http://b.de/alone", '<link rel="canonical" href="mailto:a@b">'),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: r["verdict"] for r in url_filter(df, RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
