"""The SQL (DuckDB) of the training-data queries that SQL can express, over the same tables."""

from __future__ import annotations

from .url_filter import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Base32 of the SHA-1 of ``b``: every five hex digits are four characters.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((CAST('0x' || substr(sha1(b), 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '')"""


def _host(url: str) -> str:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"coalesce({_LOWER.format(f"regexp_extract({rest}, '(?s)^[^/?#]*')")}, '')"


def _path(url: str) -> str:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"coalesce(regexp_extract({rest}, '(?s)^[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    head = f"regexp_extract({bare}, '(?s)^.*?://[^/?#]*')"
    return f"CASE WHEN instr({bare}, '://') > 0 THEN {_LOWER.format(head)} || substr({bare}, length({head}) + 1) END"


def _rule(host: str, path: str) -> str:
    """The longest rule that fits and its verdict, as "rule|verdict"."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    return "CASE" + "".join(f" WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h}{p}|{v}'" for v, h, p in ordered) + " END"


SQL = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
k AS (SELECT b, max(page_id) AS keep FROM p GROUP BY b),
m AS (SELECT page_id, b, CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to FROM p JOIN k USING (b))
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM m""",
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM i)),
lengths AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS p FROM d, lengths)),
m AS (SELECT dw.doc_id, g.item_id, dw.p, dw.k FROM dw JOIN g USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM m) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id),
gl AS (SELECT DISTINCT item_id, k, w[s + 1 : s + k] AS g FROM (SELECT item_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM i)),
said AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM d) GROUP BY x),
rare AS (SELECT item_id, k, g, arg_min(x, n * 1000 + o) AS x FROM (SELECT item_id, k, g, unnest(g) AS x, unnest(range(k)) AS o FROM gl) JOIN said USING (x) GROUP BY item_id, k, g HAVING count(*) = k),
around AS (SELECT doc_id, k, w[p + 1] AS x, w[greatest(p - k - 4, 0) + 1 : p + k + 5] AS c FROM (SELECT doc_id, w, k, unnest(range(len(w))) AS p FROM d, lengths)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM around JOIN rare USING (k, x) WHERE list_has_all(c, g) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named.s, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated, CAST(coalesce(near.n, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op4_url_filter": rf"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
said AS (SELECT url, trim(regexp_replace(CASE WHEN lower(tag[1:5]) = '<link'
    THEN coalesce(nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*''([^'']*)''', 1), ''),
      regexp_extract(tag, '(?is)\bhref\s*=\s*([^\s"''>]+)', 1))
    ELSE regexp_extract(tag, '(?is)content\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''>\s]+)', 1) END, '&amp;', '&', 'gi')) AS link
  FROM tags WHERE regexp_matches(tag, '(?is)rel\s*=\s*["'']?canonical\b') OR regexp_matches(tag, '(?is)http-equiv\s*=\s*["'']?refresh\b')),
led AS (SELECT url, CASE WHEN instr(link, '://') > 0 THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?):', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || link END AS target FROM said),
one AS (SELECT {_node("url")} AS src, {_node("target")} AS dst FROM led),
pairs AS (SELECT src, dst FROM one WHERE src <> dst UNION SELECT dst, src FROM one WHERE src <> dst),
reach(node, other) AS (SELECT src, src FROM pairs UNION SELECT r.node, b.dst FROM reach r JOIN pairs b ON r.other = b.src),
judged AS (SELECT node, {_rule(_host("other"), _path("other"))} AS rule FROM reach),
decided AS (SELECT node, bool_or(ends_with(rule, '|allow')) AS a, bool_or(ends_with(rule, '|block')) AS b FROM judged GROUP BY node),
own AS (SELECT page_id, host, path, node, {_rule("host", "path")} AS rule FROM (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node FROM pages))
SELECT page_id, host, path, CASE WHEN rule IS NOT NULL THEN split_part(rule, '|', 1) END AS rule,
  CASE WHEN rule IS NOT NULL THEN split_part(rule, '|', 2) WHEN coalesce(a, false) THEN 'allow' WHEN coalesce(b, false) THEN 'block' ELSE 'allow' END AS verdict
FROM own LEFT JOIN decided USING (node)""",
    "op5_ngram_join": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
q AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM t),
r AS (SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS g FROM q WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT DISTINCT doc_id, g FROM r WHERE i < greatest(n - 4, 1)),
s AS (SELECT doc_id, list(g ORDER BY g) AS s FROM u GROUP BY doc_id),
c AS (SELECT s, min(doc_id) AS rep, count(*) AS copies, len(s) AS n FROM s GROUP BY s),
g AS (SELECT rep, n, unnest(s) AS g FROM c),
pairs AS (SELECT a.rep AS x, b.rep AS y FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(node, other) AS (SELECT x, x FROM links UNION SELECT r.node, l.y FROM reach r JOIN links l ON r.other = l.x),
parts AS (SELECT node AS rep, min(other) AS class_id FROM reach GROUP BY node),
linked AS (SELECT x AS rep, sum(copies) AS n FROM links JOIN c ON c.rep = links.y GROUP BY x)
SELECT t.doc_id, coalesce(c.rep, t.doc_id) AS rep_id, coalesce(class_id, c.rep, t.doc_id) AS class_id, CAST(coalesce(linked.n, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS n_links
FROM t LEFT JOIN s USING (doc_id) LEFT JOIN c ON s.s = c.s LEFT JOIN parts ON parts.rep = c.rep LEFT JOIN linked ON linked.rep = c.rep""",
    "op10_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
