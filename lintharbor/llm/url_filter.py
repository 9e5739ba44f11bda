"""URL rules with redirect equivalence.

A url's own rule decides first: of the rules whose host is the url's or a parent domain of it and whose path begins the url's
path, the longest. Other urls take the decision of their aliases: connected components over redirect and canonical-link
edges spread a block to every member, unless a member is allowed by a rule, which takes precedence; without either the
verdict is allow.

Aliases are compared as url strings without fragment, with A-Z of scheme and host lower-cased. Edges come from canonical links and
meta refreshes of the pages, and from an edge table (src, dst) where one is given.

Rules are a short list, laid into the plan, or one of any length, joined.

Cases: a null url, and one without "://", has an empty host and path, fits no rule and has no alias; null html gives no edge;
relative links are resolved against the page's first base href, or its url; absolute ones are compared as they stand; links of schemes
without "//" (mailto:, data:) and empty ones give no edge; repeated rows are judged each; further
columns are ignored."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, bounded_batches, join_unique, materialize, work_dir
from .components import connected_components

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Tags that can give an edge or what links are relative to; ">" in a quoted value doesn't end one.
TAGS = r"""(?is)<(?:link|meta|base)(?=[\s/])[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)")
SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):")
REFRESH = re.compile(r"""(?is)^[\s\d.]*[\s;,]*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""")
#: Up to so many rules are laid into the plan as literals; more are joined.
MOST_LITERALS = 2000


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first "://" and "/", "?", "#" or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. Of equally long ones an allow rule is taken."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    # one literal table, so that the generated code doesn't grow with the rules
    cells = lambda verdict, h, p: {"h": h, "below": "." + h, "p": p, "rule": h + p, "verdict": verdict}
    table = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in cells(*r).items()]) for r in ordered])
    first = F.get(F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, r["below"])) & F.startswith(path, r["p"])), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def with_rule(rows: DataFrame, rules, folder: str) -> DataFrame:
    """``rows`` (host, path, ...) with the longest rule that fits as ``own``, a struct (rule, verdict), or null.

    rules: tuples (verdict, host, path), or a table with these columns. A few are literals; of many, whose table may be of any size, every
    host's parent domains and every path's beginnings, of the lengths that the rules have, are looked up by an equi-join."""
    if isinstance(rules, DataFrame):
        if rules.limit(MOST_LITERALS + 1).count() <= MOST_LITERALS:
            rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    elif len(rules) > MOST_LITERALS:
        rules = rows.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    if not isinstance(rules, DataFrame):
        return rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    listed = rules.groupBy(F.struct(F.col("host").alias("h"), F.col("path").alias("p")).alias("key")).agg(F.max(F.col("verdict") == "allow").alias("allow"))
    listed = materialize(listed, f"{folder}/rules")
    lengths = F.array(*[F.lit(r[0]) for r in listed.select(F.length("key.p")).distinct().orderBy(F.length("key.p")).collect()])  # no more than the longest path has characters
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    urls = rows.groupBy(F.struct("host", "path").alias("url")).agg(F.count("*").alias("k"))
    urls = materialize(urls, f"{folder}/judged")
    spread = urls.select("url", F.col("url.host").alias("host"), F.col("url.path").alias("path")).select("url", "path", F.explode(hosts).alias("h"))
    begun = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    spread = spread.select("url", "h", F.explode(begun).alias("p")).select("url", F.struct("h", "p").alias("key"))
    asked = spread.groupBy("key").agg(F.count("*").alias("n")).join(listed, "key")
    met = join_unique(spread, materialize(asked, f"{folder}/asked"), "key", "n", F.xxhash64("url")).filter("allow is not null")
    longest = F.min(F.struct((-F.length("key.h") - F.length("key.p")).alias("size"), (~F.col("allow")).alias("block"), F.col("key.h").alias("h"), F.col("key.p").alias("p")))
    found = met.groupBy("url").agg(longest.alias("m")).join(urls, "url")
    own = F.struct(F.concat("m.h", "m.p").alias("rule"), F.when(F.col("m.block"), "block").otherwise("allow").alias("verdict"))
    found = materialize(found.select("url", own.alias("own"), "k"), f"{folder}/found")
    names = rows.columns
    return join_unique(rows.withColumn("url", F.struct("host", "path")), found, "url", "k", F.xxhash64(*names)).select(*names, "own")


def node_of(url: Column) -> Column:
    """The form in which aliases are compared; null without "://"."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    at = F.instr(bare, "://")
    head = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*", 0)
    return F.when(at > 0, F.concat(ascii_lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))))


def decoded(value: str) -> str:
    """An attribute's value with its character references decoded; as in browsers, a name without ";" before "=" or a letter or digit is none."""

    def one(m: re.Match) -> str:
        if m[0][1] == "#":
            return entities.unescape(m[0])
        return m[0] if m[0][-1] != ";" and value[m.end() : m.end() + 1] == "=" else html5.get(m[0][1:], m[0])

    return REFERENCE.sub(one, value) if "&" in value else value


def without_dots(path: str) -> str:
    """A path that begins with "/", its dot segments removed."""
    out, parts = [], path.split("/")[1:]
    for i, x in enumerate(parts):
        plain = x.lower().replace("%2e", ".")
        if plain == "..":
            del out[-1:]
        if plain not in (".", ".."):
            out.append(x)
        elif i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def resolved(link: str, base: str) -> str | None:
    """A link as a url; ``base`` is a url with "://". None for what has no host."""
    scheme, _, rest = base.partition("://")
    host, path, query = re.match(r"(?s)([^/?#]*)([^?#]*)(\?[^#]*)?", rest).groups()
    if m := SCHEME.match(link):
        if link.startswith("//", m.end()):
            return link
        if m[1].lower() not in ("http", "https") or m[1].lower() != scheme.lower():
            return None
        link = link[m.end() :]  # as browsers do, relative in spite of its scheme
    if link.startswith("//"):
        return f"{scheme}:{link}"
    to, asked, mark = re.match(r"(?s)([^?#]*)(\?[^#]*)?(#.*)?", link).groups()
    if not to:
        return f"{scheme}://{host}{path}{query or '' if asked is None else asked}{mark or ''}"
    to = to if to[0] == "/" else (path.rpartition("/")[0] if path else "") + "/" + to
    return f"{scheme}://{host}{without_dots(to)}{asked or ''}{mark or ''}"


def targets(url: str, tags: list[str]) -> list[str]:
    """The urls that the canonical links and meta refreshes among a page's link, meta and base tags lead to."""
    links, base = [], None
    for tag in tags:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(tag, 5):
            found.setdefault(m[1].lower(), decoded(m[2] or m[3] or m[4] or ""))
        kind, link = tag[1:5].lower(), ""
        if kind == "base":
            base = found["href"].strip() if base is None and "href" in found else base
        elif kind == "link" and "canonical" in found.get("rel", "").lower().split():
            link = found.get("href", "")
        elif kind == "meta" and found.get("http-equiv", "").strip().lower() == "refresh":
            link = next((x for x in REFRESH.match(found.get("content", "")).groups() if x), "")
        links += [link.strip()] if link.strip() else []
    return [to for x in links if (to := resolved(x, (base and resolved(base, url)) or url))]


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) from the canonical links and meta refreshes of ``pages`` (url, html)."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [(u, to) for u, tags in zip(batch.column("url").to_pylist(), batch.column("tags").to_pylist(), strict=True) for to in targets(u, tags)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.string()) for i in range(2)], names=["url", "target"])

    # only pages with such a tag go to Python; explode of one-element arrays keeps the optimizer from copying each step into the next one's many uses of it
    told = pages.filter("instr(url, '://') > 0").select("url", F.explode(F.array(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TAGS), F.lit(0)))).alias("tags"))
    led = told.filter(r"exists(tags, t -> t rlike '(?is)^<(?:link.*(?:canonical|&)|meta.*http-equiv)')").mapInArrow(run, "url string, target string")
    ends = led.select(F.explode(F.array(F.struct(node_of(F.col("url")).alias("src"), node_of(F.col("target")).alias("dst")))).alias("e"))
    return ends.select("e.src", "e.dst").filter("src is not null and dst is not null and src <> dst")


def alias_decisions(edges: DataFrame, rules=RULES) -> DataFrame:
    """(node, decision) for every url of the edges: allow where its component holds an allowed url, else block where it holds a blocked one, else null."""
    folder = work_dir(edges.sparkSession, "aliases")
    members = connected_components(edges).select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    members = with_rule(members, rules, folder).select("node", "component", F.col("own.verdict").alias("own"))
    allowed, blocked = F.max(F.col("own") == "allow"), F.max(F.col("own") == "block")
    per = members.groupBy("component").agg(allowed.alias("a"), blocked.alias("b"), F.count("*").alias("n"))
    per = per.select("component", F.when(F.col("a"), "allow").when(F.col("b"), "block").alias("decision"), "n")
    return join_unique(materialize(members, f"{folder}/members"), materialize(per, f"{folder}/per"), "component", "n", F.xxhash64("node")).select("node", "decision")


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """Each row of ``pages`` (page_id, url, html) as page_id, host, path, rule, verdict."""
    folder = work_dir(pages.sparkSession, "urls")
    found = page_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).filter("src is not null and dst is not null"))
    found = materialize(found.distinct(), f"{folder}/edges")
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = with_rule(rows, rules, folder)
    if found.isEmpty():
        rows = rows.withColumn("decision", F.lit(None).cast("string"))
    else:
        decided = materialize(alias_decisions(found, rules).filter("decision is not null"), f"{folder}/decided")
        weights = rows.groupBy("node").agg(F.count("*").alias("n")).join(decided, "node")
        rows = join_unique(rows, materialize(weights, f"{folder}/weighed"), "node", "n", F.xxhash64("page_id"))
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "decision", F.lit("allow")).alias("verdict"))


def rules_sql(rules=RULES) -> str:
    """The verdict of the rules alone, over a table with host and path: a CASE expression for tests."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    return reduce(lambda a, r: f"{a} WHEN (host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}') THEN '{r[1]}{r[2]}|{r[0]}'", ordered, "CASE") + " END"
