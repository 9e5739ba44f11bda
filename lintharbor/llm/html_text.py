"""Main text of HTML pages by composite text density (Sun, Song and Liao, 2011).

A page is parsed into a tree. For every node of it the link-adjusted number of characters per tag is computed, what surrounds an
article included; a node's density sum is that of its children. The node with the largest sum is the core, the least density on
its path to the body the threshold. Every element that reaches the threshold, from the body downwards, gives its descendant of the
largest sum to the text. Runs of text beside block elements count as blocks of their own.

Names only guide this. An element that its tag or role calls navigation, aside, footer, form and the like, or that a class or id
marks, isn't summed and gives no text, except that a mark in class or id must be borne out by link ratio or low density (or, of readers' comments, by holding a thread) within
an article or main, and where an id has words besides; that it counts for nothing on an element that holds the page's headline; and that
marks are ignored where a page has no text without them. As density can't judge a short line, an article of which a subtree was chosen and that reaches the
threshold itself is taken whole, and so are the headings and paragraphs beside a chosen element. Outside of
articles, lists of links below the threshold are left out of what was chosen.

Cases: null and empty pages, and pages without text, give an empty text; a page without any markup is its own text; unclosed,
misnested and truncated tags are tolerated, at any depth; of an unclosed svg, object, video or the like only the opening tag is dropped, while
the code of an unclosed script or style reaches to the end of the page; no page is cut; rows are never merged; further columns are ignored."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements whose content is no text of the page, and those that are parts around an article.
UNSEEN = frozenset("script style noscript template iframe svg math canvas object audio video select button input textarea head title".split())
AROUND = frozenset("nav footer aside form dialog menu".split())
#: Roles and words of class and id that mark what surrounds an article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"sidebar|side|aside|nav|navbar|navigation|menu|breadcrumbs?|footer|foot|copyright|legal|comments?|commentlist|replies|respond|disqus|share|sharing|social|"
    r"related|recommend(?:ed|ations?)?|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|widget|skip|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Those of the marks that mean readers' comments; a thread is told by what it holds: further such marks, an article or a form.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|respond|disqus)(?:$|[\s_-])", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that ids of a page's own parts have beside a mark; an id with others may be an anchor made of a heading.
PARTS = frozenset("site page main global top bottom left right header primary secondary wrapper wrap container content box bar area block section list links inner outer widget panel form".split())
#: Characters of unlinked text from which a block is long; a long block is never cut off for its id alone.
LONG = 80
#: A block of so many links is a list of links if most of its text is theirs and the rest isn't long.
LINKS = 3
#: Class tokens of a layout that merely has such a part, and of a page's head.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|show|hide)[_-]\S*", re.IGNORECASE)
PAGE_HEAD = re.compile(r"(?:^|\s)(?:header|site[_-]header|page[_-]header|masthead|top-?bar)(?:$|\s)", re.IGNORECASE)
#: A header is dropped unless it opens the article itself.
SCOPES = frozenset(("article", "main"))
#: Quotes bound an attribute's value only after "="; the possessive loops keep the scan linear on damaged markup.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.DOTALL)
#: Elements of RAW that may be nested, and those of them that "/>" closes.
NESTED = frozenset("template svg math canvas object audio video select".split())
FOREIGN = frozenset(("svg", "math"))
#: Of an unclosed select, its options.
OPTIONS = re.compile(r"(?:\s*<(?:option|optgroup)\b[^>]*>[^<]*|\s*</(?:option|optgroup)\b[^>]*>)+", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Opening one of these closes an open one of those, up to the nearest of the stoppers.
CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",),
} | {t: ("p",) for t in "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
STOPPERS = frozenset("table ul ol dl div section article main body html aside nav blockquote header footer form figure".split())


#: A run of text and inline elements beside blocks.
RUN = "#run"


class Node:
    __slots__ = ("tag", "parts", "parent", "scope", "article", "unseen", "refused", "hint", "chars", "tags", "link_chars", "link_tags", "headings", "titles", "talks", "talk", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.unseen, self.refused, self.hint, self.talks = False, False, None, tag in ("article", "form")
        #: The innermost article or main, and the outermost article, that the node lies in or is.
        self.scope = self if tag in SCOPES else parent.scope if parent else None
        self.article = (parent.article if parent else None) or (self if tag == "article" else None)
        self.chars = self.tags = self.link_chars = self.link_tags = self.headings = self.titles = self.talk = 0
        self.density = self.total = 0.0
        self.best: Node = self


def _mark(node: Node, attributes: str) -> None:
    """Sets what tag and attributes say: ``unseen``, ``refused``, or a ``hint`` from "class" or "id"; "part" where no count needs to bear it out."""
    tag, above = node.tag, node.parent
    if tag in UNSEEN:
        node.unseen = True
    elif tag in AROUND or tag == "header" and not above.scope:
        node.refused = True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        node.unseen = True
    elif found.get("role", "").lower() in ROLES:
        node.refused = True
    if tag in ("html", "body", "main") or tag in INLINE or tag in HEADINGS:
        return
    names = [LAYOUT.sub("", found.get(k, "")) for k in ("class", "id")]
    node.talks = node.talks or any(COMMENTS.search(n) for n in names)
    if MARKS.search(names[0]):
        node.hint = "class" if above.scope else "part"
    elif MARKS.search(names[1]):
        anchor = any(not (w in PARTS or w.isdigit() or MARKS.search(w)) for w in re.split(r"[\s_-]+", names[1].lower()) if w)
        node.hint = "id" if above.scope or anchor else "part"
    elif not above.scope and any(PAGE_HEAD.search(n) for n in names):
        node.hint = "part"


def _ends(page: str, tag: str) -> dict[int, int]:
    """For each closed element ``tag`` of a page, where its opening tag begins: where its closing tag ends."""
    found, opened = {}, []
    words = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\b|\Z)|<(/?){tag}(?=[\s/>])((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.DOTALL | re.IGNORECASE)
    for m in words.finditer(page):
        if m[2] is None:
            continue
        if not m[2]:
            if not (tag in FOREIGN and m[3].endswith("/")):
                opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def parse(page: str) -> Node:
    """The tree of a page; its root stands for the body where the page names none."""
    root = node = Node("root", None)
    at, end, last = 0, len(page), page.rfind(">")
    opened: Counter[str] = Counter()  # so that no search upwards begins in vain, however deep the page
    ends: dict[str, dict[int, int]] = {}
    unclosed: set[str] = set()

    def leave(inner: Node) -> Node:
        """The parent of ``inner``, closing it and all within."""
        low = node
        while low is not inner:
            opened[low.tag] -= 1
            low = low.parent
        opened[inner.tag] -= 1
        return inner.parent

    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:  # no tag is left, but the end of the page may cut one off
            cut = re.compile(r"<(?:!--|/?[a-zA-Z])").search(page, at)
            node.parts.append(page[at : cut.start() if cut else end])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # a closing tag
            up = node if opened[tag] else None
            while up is not None and up.tag != tag and not (tag in INLINE and up.tag not in INLINE):
                up = up.parent
            if up is not None and up.parent is not None and up.tag == tag:
                node = leave(up)
            continue
        closed = CLOSES.get(tag)
        if closed and any(opened[c] for c in closed):
            up, found = node, None
            while up.parent is not None and (up.tag in closed or up.tag not in STOPPERS):
                if up.tag in closed:
                    found = up
                up = up.parent
            if found is not None:
                node = leave(found)
        attributes = m[3]
        new = Node(tag, node)
        _mark(new, attributes)
        node.parts.append(new)
        if tag in VOID or attributes.endswith("/") and (tag in FOREIGN or tag not in INLINE | RAW):
            continue
        if tag in NESTED:  # without a closing tag, only the opening one is dropped, and a select's options
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            if m.start() in ends[tag]:
                at = ends[tag][m.start()]
            elif tag == "select" and (options := OPTIONS.match(page, at)):
                at = options.end()
            continue
        if tag in RAW:  # its content is no markup
            shut = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at) if tag not in unclosed else None
            if shut:
                at = shut.end()
            elif tag in ("script", "style"):
                at = end
            else:
                unclosed.add(tag)  # no later one is closed either
            continue
        node = new
        opened[tag] += 1
    return root


def _box(node: Node) -> None:
    """Runs of text and inline elements beside blocks become blocks of their own."""
    if not any(isinstance(x, Node) and x.tag not in INLINE and not x.unseen for x in node.parts):
        return
    out, run = [], []

    def close() -> None:
        if any(not isinstance(x, str) or x.strip() for x in run):
            box = Node(RUN, node)
            box.parts = run[:]
            for x in run:
                if isinstance(x, Node):
                    x.parent = box
            out.append(box)
        run.clear()

    for x in node.parts:
        if isinstance(x, str) or x.tag in INLINE:
            run.append(x)
        else:
            close()
            out.append(x)
    close()
    node.parts = out


def _count(root: Node) -> list[tuple[Node, bool]]:
    """All nodes that can be seen, with their counts, in page order, and whether they lie in a link."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        order.append((node, in_link))
        if node.tag not in INLINE:
            _box(node)
        for x in node.parts:
            if isinstance(x, str):
                n = len(entities.unescape(x).strip())
                node.chars += n
                node.link_chars += n * in_link
        stack += [(x, in_link or x.tag == "a") for x in reversed(node.parts) if isinstance(x, Node) and not x.unseen]
    for node, _ in reversed(order):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + (node.tag != RUN)
            up.link_tags += node.link_tags + (node.tag == "a")
            up.headings += node.headings + (node.tag in HEADINGS)
            up.titles += node.titles + (node.tag == "h1")
            up.talk += node.talk + node.talks
    return order


def _borne_out(node: Node, body: Node) -> bool:
    """Whether the counts bear out what a hinted node's class or id says."""
    if node.hint == "part":
        return not node.titles
    if not node.chars or 2 * node.link_chars > node.chars or node.talks and node.talk and node.tag != "article":
        return True
    plain, around = node.chars - node.link_chars, node.parent.scope or body
    sparse = plain * max(around.tags, 1) < (around.chars - around.link_chars) * max(node.tags, 1)
    return sparse and (node.hint == "class" or plain < LONG and not node.headings)


def _measure(root: Node) -> tuple[list[Node], Node]:
    """All nodes that can be seen, in page order, with counts and densities, and the body."""
    order = _count(root)
    body = next((n for n, _ in order if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node, _ in order:
        if not node.chars:
            continue
        plain = max(node.chars - node.link_chars, 0)
        scale = math.log(node.chars / max(plain, 1) * node.link_chars + ratio * node.chars + math.e)
        adjusted = (node.chars / max(node.link_chars, 1)) * (max(node.tags, 1) / max(node.link_tags, 1))
        node.density = node.chars / max(node.tags, 1) * max(math.log(adjusted) / math.log(scale) if scale > 1 and adjusted > 0 else 1.0, 0.0)
    return [n for n, _ in order], body


def _kept(top: Node) -> list[Node]:
    """The nodes below and with ``top`` that aren't refused or within a refused one, in page order."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if node.unseen or node.refused:
            continue
        out.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return out


def _blocks(node: Node) -> list[Node]:
    return [x for x in node.parts if isinstance(x, Node) and x.tag not in INLINE and not x.unseen and not x.refused]


def select(root: Node) -> list[Node]:
    """The subtrees that make up the main text, in page order, none within another."""
    nodes, body = _measure(root)
    hinted = [n for n in nodes if n.hint]
    for n in hinted:
        n.refused = n.refused or _borne_out(n, body)
    kept = _kept(body)
    if hinted and not any(isinstance(x, str) and x.strip() for n in kept for x in n.parts):
        for n in hinted:
            n.refused = n.tag in AROUND
        kept = _kept(body)
    for node in reversed(kept):  # children before parents
        inner = [x for x in node.parts if isinstance(x, Node) and not x.unseen and not x.refused]
        node.total = max(sum(x.density for x in inner), node.density if node is not body else 0.0)
        node.best = max([x.best for x in inner if x.tag not in INLINE] + [node], key=lambda n: n.total)
    core = body.best
    if not core.chars:
        return [body]
    least, up = core.density, core
    while up is not body:
        up = up.parent
        least = min(least, up.density)
    chosen: set[int] = set()
    stack = [body]
    while stack:  # from the body downwards, what reaches the threshold gives its descendant of the largest sum
        node = stack.pop()
        if node.chars and node.density >= least:
            chosen.add(id(node.best))
        if id(node) not in chosen:
            stack += _blocks(node)
    picked = [n for n in kept if id(n) in chosen]
    for n in picked:
        if n.article is not None and not n.article.refused and n.article.density >= least:
            chosen.add(id(n.article))
    _keep_lines(picked, body, chosen)
    out = []
    stack = [body]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            out.append(node)
            if node.article is None:
                _cut_links(node, least)
        else:
            stack += reversed(_blocks(node))
    return out


def _link_list(node: Node) -> bool:
    plain = node.chars - node.link_chars
    return node.link_tags >= LINKS and plain < LONG and 2 * plain < node.chars


def _keep_lines(picked: list[Node], body: Node, chosen: set[int]) -> None:
    """Paragraphs and headings beside a chosen element, and headings before what it lies in, are chosen too, unless they are links."""
    on_path = {id(n) for n in picked}
    beside = {id(n.parent): n.parent for n in picked if n is not body}
    wide, above, todo = set(beside), dict(beside), list(beside.values())
    while todo:
        node = todo.pop()
        on_path.add(id(node))
        if node is not body and node.parent is not None and id(node.parent) not in above:
            above[id(node.parent)] = node.parent
            todo.append(node.parent)
    for parent in above.values():
        inner = _blocks(parent)
        ways = [i for i, x in enumerate(inner) if id(x) in on_path]
        whole = any(inner[i].tag == "p" for i in ways) and id(parent) in wide
        lines = ("p", "header", RUN, *HEADINGS) if id(parent) in wide else ("header", *HEADINGS)
        for x in inner if whole else inner[: max(ways, default=0)]:  # a headline stands before its text
            if x.tag in lines and x.chars and not _link_list(x) and (x.tag != "header" or x.headings):
                chosen.add(id(x))


def _cut_links(top: Node, least: float) -> None:
    """Lists of links within ``top`` that don't reach the threshold are refused; an article's own stay."""
    stack = _blocks(top)
    while stack:
        x = stack.pop()
        if x.tag in HEADINGS or x.tag == "article":
            continue
        if x.density < least and _link_list(x):
            x.refused = True
        else:
            stack += _blocks(x)


def text_of(nodes: list[Node]) -> str:
    """The blocks of the subtrees: character references decoded, white space made one space, joined by two line breaks."""
    blocks, run = [], []

    def close() -> None:
        if line := " ".join(entities.unescape("".join(run)).split()):
            blocks.append(line)
        run.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(x)
            elif x.unseen or x.refused:
                continue
            elif x.tag in INLINE:
                if x.tag == "br":
                    run.append(" ")
                stack += reversed(x.parts)
            else:
                close()
                stack += [None, *reversed(x.parts)]
        close()
    return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(select(parse(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """Each row of ``pages`` (page_id, url, html) as page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
