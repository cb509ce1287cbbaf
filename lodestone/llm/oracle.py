"""SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS win FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM k),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM f WHERE n > 1),
g AS (SELECT doc_id, list(pos) AS gone FROM h GROUP BY 1),
x AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN len(gone) = 0 THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM x"""

BENCH = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{BENCH}') AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{BENCH}') AS words FROM benchmark),
n AS (SELECT item, words, least(10, len(words)) AS n FROM b WHERE len(words) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win FROM (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM n)),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d, s WHERE len(words) >= n)),
m AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP7 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, payload_bytes AS n, max(page_id) AS newest FROM p GROUP BY ALL),
c AS (SELECT *, list_transform(range(0, 8), lambda j: ('0x' || substr(hex, j * 5 + 1, 5))::BIGINT) AS parts FROM p),
d AS (SELECT *, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INTEGER + 1, 1)), '')), '') AS payload_digest FROM c)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM d JOIN g ON g.hex = d.hex AND g.n = d.payload_bytes"""

OP9 = r"""
WITH RECURSIVE r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, p, verdict)),
u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
x AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM u),
y AS (SELECT page_id, host, path, (SELECT max({'n': length(h || p), 'a': verdict = 'allow', 'rule': h || p, 'verdict': verdict}) FROM r WHERE (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p)) AS best FROM x)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM y"""


def oracle_sql() -> dict[str, str]:
    """op9's SQL has the rules only: pages without canonical links or redirects have no aliases."""
    return {"op1_substring_dedup": OP1, "op4_benchmark_decontamination": OP4, "op7_warc_round_trip": OP7, "op9_url_filters": OP9}
