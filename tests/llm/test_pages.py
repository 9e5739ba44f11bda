"""The operators over pages and vectors against brute force."""

import base64
import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from lintharbor.llm import html_text, top_k, url_filter, warc
from lintharbor.llm._common import work_dir

from .conftest import prose

PAGES = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><header><h1>Head&amp;line</h1></header><p><b>First   para&#33;<br>more<p>Second <a href=x>link</a> 5 &lt; 6</p><aside>beside</aside><div class="ad">Buy</div>
<blockquote>Quoted</blockquote><form><input value=x>Sign up</form><ul><li>one<li>two</ul><p>A.</p></article>
<section id="comments"><article><p>A reader says a great many words here, far more than the article itself has to say about it.</p></article></section>
<footer>&copy; foot</footer></body></html>"""


@pytest.fixture(scope="module")
def pages():
    rows = [(1, "https://a.example.net/en/x?q#f", PAGE), (2, "http://B.example.NET/x", None), (3, None, ""), (4, "no scheme", PAGE), (5, "https://a.net", "plain text"), (5, "https://a.net", "plain text")]
    return rows + [(6, "https://www.example.com/de/1", "<p>" + "word " * 200_000), (7, "http://example.org/fr/", None), (None, "ftp://x.org/fr/a\nb", "x"), (8, "https://a.net#z", "<div>" * 3000 + "deep")]


@pytest.fixture(scope="module")
def table(spark, pages, clashing):
    return clashing(spark.createDataFrame(pages, PAGES)).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 WARC


@pytest.mark.parametrize("least", [0, 8])
def test_archives(table, pages, least):
    groups = defaultdict(list)
    for p, _, h in pages:
        groups[h or ""].append(p)
    keep = {h: max((p for p in ps if p is not None), default=None) for h, ps in groups.items() if len(ps) > 1 and len(h.encode()) >= least}

    def expected(p, h):
        raw = (h or "").encode()
        to = keep.get(h or "")
        revisit = to is not None and to != p
        return p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None

    assert rows_of(warc.archive_round_trip(table, least)) == sorted([expected(p, h) for p, _, h in pages], key=repr)


def test_selected_records_and_small_files(spark, table, pages):
    folder = work_dir(spark, "warc-test")
    index = warc.write_archives(table, folder, file_bytes=500)
    got = warc.read_records(index, folder, index.page_id.isin(4, 6, 8), gap=0, most=100).collect()
    assert {r.page_id: r.payload for r in got} == {p: h for p, _, h in pages if p in (4, 6, 8)}
    assert {r.url for r in warc.read_records(index, folder, index.page_id.isNull()).collect()} == {"ftp://x.org/fr/a%0Ab"}
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_highly_compressible_payloads_are_read_in_slices(spark):
    rows = [(i, None, chr(97 + i) * 3_000_000) for i in range(12)]
    folder = work_dir(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), folder).coalesce(1)
    parts = index.select("warc_file", "warc_offset", "warc_length").toArrow().to_batches()
    sizes = [b.nbytes for b in warc._reader(f"{folder}/warc", warc.GAP_BYTES, warc.READ_BYTES, True)(iter(parts))]
    assert len(sizes) >= 6 and max(sizes) < 8_000_000
    assert {r.page_id: len(r.payload) for r in warc.read_records(index, folder).collect()} == dict.fromkeys(range(12), 3_000_000)


def test_stores_under_hadoops_names(tmp_path):
    assert warc.store_of(f"file://{tmp_path}")[1] == str(tmp_path) and warc.store_of("s3a://bucket/a?region=us-east-1")[1] == "bucket/a"


# 3 HTML


def test_main_text():
    expected = ["Head&line", "First para! more", "Second link 5 < 6", "Quoted", "one", "two", "A."]
    assert html_text.main_text(PAGE) == "\n\n".join(expected)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain   text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<p>cut <a href='x", "cut"),
        ("<body><div class='nav'><a href=a>one</a><a href=b>two</a></div><div id=main><p>Long enough to be the text of this page.</p><p>And a second one of these.</p></div><div class=sidebar><p>side</p></div></body>", "Long enough to be the text of this page.\n\nAnd a second one of these."),
        ("<p data=don't>it's <b>bold</b></p>", "it's bold"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


PROSE = "A paragraph of the article that goes on for so many words that nobody would take it for a button."


def test_marks_within_an_article_are_hints():
    links = "".join(f"<li><a href=/{i}>Another story {i}</a>" for i in range(5))
    page = f"""<body><article><h1>T</h1><p>{PROSE}</p><section id="side-effects"><h2>Side effects</h2><p>{PROSE}</p></section><h2 id="related-work">Related work</h2>
<p class="legal">{PROSE}</p><h2 id="search-algorithms" class="search">Search</h2><p>See <em class="notice">this</em> <a id="social" href="x">one</a>.</p><section id="legal"><h3>Legal</h3><p>None.</p></section>
<div class="share">Share</div><div id="social">Follow us</div><div id="related"><h3>Related</h3><ul>{links}</ul></div><ul class="related">{links}</ul></article></body>"""
    assert html_text.main_text(page).split("\n\n") == ["T", PROSE, "Side effects", PROSE, "Related work", PROSE, "Search", "See this one.", "Legal", "None."]
    bare = f"<body><div id=content><p>{PROSE}</p><div id=side-effects><p>{PROSE}</p></div><div id=site-footer><p>{PROSE}</p></div></div></body>"
    assert html_text.main_text(bare) == f"{PROSE}\n\n{PROSE}"


def test_all_articles_and_main_text_stay():
    parts = [f"{PROSE} Part {i}." for i in range(4)]
    several = "".join(f"<article><h2>Part {i}</h2><p>{x}</p><p>Brief.</p></article>" for i, x in enumerate(parts))
    text = [y for i, x in enumerate(parts) for y in (f"Part {i}", x, "Brief.")]
    for page in (f"<body><nav><a href=/>Home</a></nav>{several}<footer>foot</footer></body>", f"<body><div><div>{several}</div></div></body>"):
        assert html_text.main_text(page).split("\n\n") == text
    links = "<ul>" + "".join(f"<li><a href=/{i}>Another story {i}</a>" for i in range(5)) + "</ul>"
    page = f"<body><header>Site</header><main><header><h1>Headline</h1></header><p>A lead.</p><div>{links}<div>{several}</div></div>{links}<p>See <a href=/>this and that</a>.</p><p>{PROSE}</p></main></body>"
    assert html_text.main_text(page).split("\n\n") == ["Headline", "A lead.", *text, "See this and that.", PROSE]
    assert html_text.main_text(f"<body><article><p>{PROSE}</p></article><div><p>{PROSE}</p></div></body>") == f"{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize(
    ("markup", "rest"),
    [
        ('<svg class="icon" viewBox="0 0 1 1"/>', ""), ("<math/>", ""), ("<svg><g><svg><path/></svg><text>in</text></g></svg>", ""), ("<svg><svg/><text>in</text></svg>", ""),
        ("<object data=a><object data=b>in</object>in</object>", ""), ("<svg>", ""), ("<canvas>", ""), ("<video src=x>", ""), ("<audio>", ""), ("<object data=x>", ""), ("<iframe src=x>", ""), ("<noscript>", ""), ("<template>", ""),
        ("<select><option>in<option value=1>in too</option>", ""), ("<svg><!-- </svg> --><text>in</text></svg>", ""), ("<svg-icon>own </svg-icon>", "own"),
    ],
)
def test_embedded_elements_drop_only_themselves(markup, rest):
    page = f"<body><article><p>{PROSE} {markup} More.</p><p>{PROSE}</p><p>An <svg>x</svg> end.</p></article></body>"
    for got in (html_text.main_text(page), html_text.main_text(page.replace("<svg>x</svg>", "<b>x</b>"))):
        assert got.split() == f"{PROSE} {rest} More. {PROSE} An {'x ' if ' x ' in got else ''}end.".split()


def test_unclosed_elements_take_linear_time():
    page = "<article>" + "<svg><p>word" * 20_000
    assert html_text.main_text(page).count("word") == 20_000


def test_density_rejects_an_unmarked_menu():
    links = "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(6))
    for menu in (f"<ul>{links}</ul>", f"<div>{links}</div>", f"<div><p><a href=/1>Terms</a> <a href=/2>Privacy</a> <a href=/3>Imprint</a></p></div>"):
        for page in (f"<div>{menu}<div><p>{PROSE}</p><p>{PROSE}</p></div></div>", f"<div><div><p>{PROSE}</p><p>{PROSE}</p></div>{menu}</div>", f"<div>{menu}<p>{PROSE}</p><p>{PROSE}</p></div>"):
            assert html_text.main_text(f"<body>{page}</body>") == f"{PROSE}\n\n{PROSE}"


def test_marks_yield_to_what_the_page_holds():
    page = f'<body><div class="widget"><h1>T</h1><p>{PROSE}</p></div><div class="widget"><p>{PROSE} No.</p></div></body>'
    assert html_text.main_text(page) == f"T\n\n{PROSE}"
    assert html_text.main_text(f'<body><div class="notice"><p>{PROSE}</p></div></body>') == PROSE
    assert html_text.main_text(f"<body>{PROSE}<br>{PROSE}<div><a href=x>a</a> <a href=y>b</a> <a href=z>c</a></div></body>") == f"{PROSE} {PROSE}"


def test_threads_of_comments_go():
    for thread in (f'<div class="comments"><div class="comment"><p>{PROSE} No.</p></div></div>', f'<section id="comments"><h2>2 comments</h2><article><p>{PROSE} No.</p></article></section>', f'<ol class="commentlist"><li class="comment even">{PROSE} No.</li></ol>'):
        assert html_text.main_text(f"<body><article><h1>T</h1><p>{PROSE}</p>{thread}</article></body>") == f"T\n\n{PROSE}"
    assert html_text.main_text(f'<body><article><h1>T</h1><section id="comments"><h2>Comments in code</h2><p>{PROSE}</p></section></article></body>') == f"T\n\nComments in code\n\n{PROSE}"


def test_what_surrounds_an_article_goes_at_any_depth():
    for tag in ("nav", "aside", "footer", "form"):
        assert html_text.main_text("<div>" * 3000 + f"<{tag}>no</{tag}><p>{PROSE}</p>") == PROSE


def test_selection_against_brute_force():
    """Random pages of nested blocks and links, their densities and choices computed from the definitions on a tree of the standard library's parser."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.top = self.at = {"tag": "root", "up": None, "in": []}

        def handle_starttag(self, tag, attrs):
            self.at["in"].append(new := {"tag": tag, "up": self.at, "in": []})
            self.at = new

        def handle_endtag(self, tag):
            self.at = self.at["up"]

        def handle_data(self, data):
            self.at["in"].append(data)

    below = lambda n: [x for x in n["in"] if isinstance(x, dict)]
    every = lambda n: [y for x in below(n) for y in every(x)] + [n]
    chars = lambda n: sum(len(x.strip()) if isinstance(x, str) else chars(x) for x in n["in"])
    linked = lambda n: sum(0 if isinstance(x, str) else chars(x) if x["tag"] == "a" else linked(x) for x in n["in"])
    links = lambda n: sum(x["tag"] == "a" for x in every(n)[:-1])

    def density(n, body):
        c, lc, t, lt = chars(n), chars(n) if n["tag"] == "a" else linked(n), max(len(every(n)) - 1, 1), max(links(n), 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + linked(body) / chars(body) * c + math.e)
        return c / t * (max(math.log(c / max(lc, 1) * t / lt) / math.log(base), 0.0) if base > 1 else 1.0)  # a page without links: characters per tag

    def expected(page):
        parser = Tree()
        parser.feed(page)
        body = below(parser.top)[0]
        d = {id(n): density(n, body) for n in every(body)}
        total = {id(n): max(sum(d[id(x)] for x in below(n)), 0.0 if n is body else d[id(n)]) for n in every(body)}
        blocks = lambda n: [x for x in every(n) if x["tag"] != "a"]
        best = lambda n: max(blocks(n), key=lambda x: total[id(x)])
        up = core = best(body)
        least = d[id(core)]
        while up is not body:
            up = up["up"]
            least = min(least, d[id(up)])
        chosen = {id(best(n)) for n in blocks(body) if d[id(n)] >= least and chars(n)}
        out = []

        def walk(n, inside):
            inside = inside or id(n) in chosen
            plain = chars(n) - linked(n)
            if inside and id(n) not in chosen and n["tag"] != "a" and d[id(n)] < least and links(n) >= 3 and plain < 80 and 2 * plain < chars(n):
                return
            if all(isinstance(x, str) or x["tag"] == "a" for x in n["in"]):
                line = " ".join("".join(x if isinstance(x, str) else "".join(x["in"]) for x in n["in"]).split())
                out.extend([line] if inside and line else [])
            else:
                for x in below(n):
                    walk(x, inside)

        walk(body, False)
        return "\n\n".join(out)

    r = random.Random(12)

    def block(depth):
        if depth and r.random() < 0.6:
            return f"<div>{''.join(block(depth - 1) for _ in range(r.randrange(1, 5)))}</div>"
        if r.random() < 0.35:
            return f"<ul>{''.join(f'<li><a>{prose(r.randrange(99), r.randrange(1, 4))}</a></li>' for _ in range(r.randrange(1, 7)))}</ul>"
        return f"<div>{prose(r.randrange(99), r.choice((2, 8, 25, 60)))}{r.choice(('', ' <a>more</a>'))}</div>"

    cut = 0
    for _ in range(200):
        page = f"<body>{''.join(block(3) for _ in range(r.randrange(1, 4)))}</body>"
        assert html_text.main_text(page) == expected(page), page
        cut += expected(page).count(" ") < re.sub("<[^>]*>", " ", page).count("w") - 1
    assert cut > 50


def test_extract(spark, table, pages):
    out = html_text.extract(table)
    assert rows_of(out) == sorted([(p, u, html_text.main_text(h), len(html_text.main_text(h))) for p, u, h in pages], key=repr)
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


# 4 URLs


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_rules(spark, table, pages):
    out = url_filter.judge(table)
    assert rows_of(out) == sorted([(p, *judged(u)[:3], judged(u)[3] or "allow") for p, u, _ in pages], key=repr)
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_many_rules_are_joined(spark, monkeypatch, table, pages):
    r = random.Random(6)
    hosts, paths = ["a.net", "net", "b.a.net", "org", "x.org", ""], ["/", "/a", "/a/b", "/é", ""]
    rules = [(r.choice(("allow", "block")), r.choice(hosts), r.choice(paths)) for _ in range(60)] + list(url_filter.RULES)
    urls = [(i, r.choice([None, "no", "http://" + r.choice(["", "z."]) + r.choice(hosts) + r.choice(paths) + r.choice(["", "c", "?q"])]), f'<link rel=canonical href="http://{r.choice(hosts)}/a">') for i in range(150)]
    for rows, more in ((table, pages), (spark.createDataFrame(urls, PAGES), urls)):
        few = rows_of(url_filter.judge(rows, rules))
        monkeypatch.setattr(url_filter, "MOST_LITERALS", 3)
        assert rows_of(url_filter.judge(rows, rules)) == few and len(few) == len(more)
        assert rows_of(url_filter.judge(rows, spark.createDataFrame(rules, "verdict string, host string, path string"))) == few
        monkeypatch.undo()


def test_aliases_carry_decisions(spark):
    link = lambda u: f'<head><LINK rel="canonical" href="{u}"></head>'
    rows = [
        (1, "https://free.org/a", link("https://bad.net/x")), (2, "https://other.org/b", "<meta http-equiv=refresh content='0; url=https://free.org/a'>"), (3, "https://bad.net/x", None),
        (4, "https://good.org/c", link("https://bad.net/y")), (5, "https://good.org/fr/d", link("/c")), (6, "https://bad.net/y", ""), (7, "https://alone.org/q", link("https://alone.org/q#top")), (8, "https://free.org/a#frag", ""),
    ]
    out = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "block"}
    extra = spark.createDataFrame([("https://alone.org/q", "https://bad.net/z"), (None, "x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, PAGES), edges=extra).collect()}[7] == "block"


def test_relative_links_against_brute_force(spark):
    """Random relative links, resolved by urllib and joined by a plain search."""
    from urllib.parse import urljoin

    r = random.Random(4)
    hosts = ["https://a.org", "https://b.org", "https://bad.net", "https://c.info"]
    urls = [h + p + q for h in hosts for p in ("/", "/x", "/x/", "/x/y", "/x/y/z", "/fr/d") for q in ("", "?id=3")]
    links = ["y", "../x", "../../x/y", "./", "..", "?id=3", "y?id=3", "/x/./y", "/x/../fr/d", "z#top", "//bad.net/x", "https://c.info/x"]
    rows, near = [], defaultdict(set)
    for i, u in enumerate(urls):
        link, base = r.choice(links) if r.random() < 0.3 else None, r.choice(["", "", "/x/", "../", "https://b.org/x/"])
        head = f'<base target=_top><base href="{base}"><base href="/no/">' if base else ""
        tag = r.choice(['<link rel="alternate CANONICAL nofollow" href="{}">', "<link href='{}' rel='shortlink&#32;canonical'/>", '<meta http-equiv="Refresh" content="0; url={}">', "<meta content='3;{}' http-equiv=refresh>"])
        if link:
            to = urljoin(urljoin(u, base), link).split("#")[0]
            near[u].add(to)
            near[to].add(u)
            link = link.replace("/", r.choice(["/", "&#47;", "&sol;", "&#x2f;"])).replace("?", "&quest;")
        rows.append((i, u, head + (tag.format(link) if link else '<link rel="canonicals" href="//bad.net/no">')))
    out = {x.page_id: x.verdict for x in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    for i, u in enumerate(urls):
        seen, todo = {u}, [u]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        said = {judged(x)[3] for x in seen}
        assert out[i] == (judged(u)[3] or ("allow" if "allow" in said else "block" if "block" in said else "allow")), u
    assert "block" in {out[i] for i, u in enumerate(urls) if not judged(u)[3]}


@pytest.mark.parametrize(
    ("link", "to"),
    [
        ("page.html", "https://a.org/d/page.html"), ("../x", "https://a.org/x"), ("?id=3", "https://a.org/d/p?id=3"), ("../../../x/./y/", "https://a.org/x/y/"), ("login?to=https://b.org/", "https://a.org/d/login?to=https://b.org/"),
        ("/r?to=https://b.org/", "https://a.org/r?to=https://b.org/"), ("?a=1&copy=2&amp;b&#61;3", "https://a.org/d/p?a=1&copy=2&b=3"), ("https&colon;//b.org/x", "https://b.org/x"), ("mailto:x@b.org", None), ("", None), (" //b.org ", "https://b.org"), ("https:x", "https://a.org/d/x"),
    ],
)
def test_links(link, to):
    assert url_filter.targets("https://a.org/d/p?q#f", [f'<link title="a>b" href="{link}" rel="x canonical">']) == [to] * (to is not None)


# 10 top-k


VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in fine:
        if i % 50 or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q)))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, clashing):
    import struct

    r = random.Random(2)
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [f32(r.choice((r.uniform(-1, 1), 0.5))) for _ in range(6)]) for i in range(400)]
    rows += [(400, None), (450, [0.5, None] * 3), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, [0.25] * 3), (650, [0.5] * 3), (None, [0.1] * 6), (700, []), (750, []), (50, rows[50][1]), (7, rows[7][1])]
    table = top_k.quantised(clashing(spark.createDataFrame(rows, VECTORS)).repartition(3))
    queries = table.filter("vec_id % 50 = 0")
    assert sorted(rows_of(top_k.top_k(queries, table, block_rows=16))) == brute(rows)
    assert sorted(rows_of(top_k.top_k(queries, table, block_rows=16, batch=6))) == brute(rows)
    empty = top_k.quantised(spark.createDataFrame([], VECTORS))
    assert top_k.top_k(empty, empty).count() == 0


def test_query_rows_that_share_an_id_have_a_list_each(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0])] + [(i, [i / 100, 1 - i / 100]) for i in range(1, 40)]
    table = top_k.quantised(spark.createDataFrame(rows, VECTORS))
    assert sorted(rows_of(top_k.top_k(table.filter("vec_id = 50"), table))) == brute(rows)
    assert len(brute(rows)) == 10


def test_clustered_vectors_are_pruned_across_tasks(spark):
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(8)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 8]]) for i in range(1200)]
    table = top_k.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    queries = table.filter("vec_id % 50 = 0")
    assert sorted(rows_of(top_k.top_k(queries, table, block_rows=32))) == brute(rows)
    told = top_k.work(queries, table, block_rows=32).first()
    assert told.scored < 0.6 * told.met


def test_scores_beyond_64_bits_are_refused():
    import numpy as np

    with pytest.raises(OverflowError):
        top_k._exact(np.full((1, 4), 2**62), np.full((1, 4), 2**62))


def test_blocks_below_the_bound_are_skipped():
    import numpy as np

    def block(ids, m):
        m = np.array(m, np.int64)
        return {"dim": m.shape[1], "n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "matrix": m.astype(np.int32).tobytes(), "hi": m.max(0).tobytes(), "lo": m.min(0).tobytes()}

    blocks = [block(range(b * 10, b * 10 + 10), [[b, 1]] * 10) for b in range(8)]
    best, who = np.full((1, 5), top_k.NOTHING), np.full((1, 5), 2**63 - 1)
    assert top_k.search_group(blocks, np.array([999]), np.array([[3, 1]]), 5, best, who) == 1
    assert who[0].tolist() == [70, 71, 72, 73, 74] and best[0].tolist() == [22] * 5
