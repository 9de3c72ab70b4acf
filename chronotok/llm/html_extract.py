"""HTML extraction (operator 6): tree scoring of containers.

A page becomes a tree of its block elements. Every paragraph-like block with text of its own gives points, for
being there, for its commas and for its length, to its parent and, halved and then thirded again, to the ancestors
above; a container's points are discounted by the share of its text inside links. The best container and those
of its siblings that score well or read like prose are kept, without what their names or tags mark as menus,
headers, footers, sidebars, notices, adverts, forms or comments and without blocks that are mostly links.

The unit of work is one page, in one pass over the table: nothing is shuffled.

Defined results: a null or empty page, or one without visible text, gives an empty text; broken and unclosed markup
is read as far as it goes; repeated pages are read one by one; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotok.llm.text import table

MARKUP = re.compile(
    r"<!--|<!\[CDATA\[|<[!?][^>]*>|"
    r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)")
ENDS = {"<!--": "-->", "<![CDATA[": "]]>"}
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")  # a slash that ends an unquoted value closes nothing

BLOCKS = frozenset("""address article aside blockquote body center dd details div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul dialog""".split())
CELLS = frozenset(("td", "th"))
RAW = frozenset("script style noscript template iframe textarea title svg math object select noframes xmp".split())
FOREIGN = frozenset(("svg", "math"))
INLINE_DROPPED = frozenset(("button",))
DROPPED = frozenset("head nav header footer aside form menu button dialog".split()) | RAW
EMPTY = frozenset("hr br img input meta link wbr area base col embed source track".split())
CLOSES_P = BLOCKS - CELLS - {"tbody", "tr", "thead", "tfoot", "body", "html"}
# What a start tag closes: the outermost open element of some names, as far as the nearest element that bounds them.
# ``p`` closes the nearest one.
CLOSING = {"p": ({"p"}, {"td", "th", "li", "div", "section"}), "li": ({"li"}, {"ul", "ol", "menu"}),
           "dt": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"})}
CLOSES_LIKE = {"li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td"}
PARAGRAPHS = frozenset("p pre blockquote td dd li div section article main body figcaption".split())
NEVER_NAMED = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
                  "toolbar".split())
# Class and id words of what surrounds an article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w+|adsense|banner|breadcrumbs?|comments?|commentlist|respond|replies|"
    r"discussion|disqus|consent|cookies?|gdpr|footer|header|masthead|nav|navbar|navigation|menu|sidebar|related|"
    r"recommend\w*|share|sharing|social|sponsor\w*|promo\w*|popup|modal|overlay|notices?|alert|newsletter|subscri\w+|"
    r"signup|login|pagination|pager|toolbar|widget|skip|tags|toc)(?=$|[\s_-])", re.I)
CONTAINS_NAMED = re.compile(r"(?:^|\s)(?:has|with|no|without)[_-]\S+", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("tag", "parent", "children", "gone", "points", "chars", "linked", "texts", "depth", "closable")

    def __init__(self, tag: str, parent: _Node | None, gone: bool) -> None:
        self.tag, self.parent, self.gone = tag, parent, gone
        self.children: list[_Node] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.texts: list[tuple[int, str, int]] = []  # order on the page, text, characters inside links
        self.depth = 0 if parent is None else parent.depth + 1
        # For each key of CLOSING the open element that such a start tag would close from here.
        above = None if parent is None else parent.closable
        self.closable = {k: self._closable(k, above[k] if above else None) for k in CLOSING}
        if parent is not None:
            parent.children.append(self)

    def _closable(self, key: str, above: _Node | None) -> _Node | None:
        names, bounds = CLOSING[key]
        if self.parent is None or self.tag in bounds and self.tag not in names:
            return None
        if self.tag in names:
            return self if key == "p" or above is None else above
        return above


def _marked(tag: str, attrs: str, by_name: bool) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return True
    if HIDDEN.search(found.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(ATTRIBUTE, "", attrs)):
        return True
    if not by_name:
        return False
    if tag in NEVER_NAMED:
        return bool(re.search(r"(?:^|[\s_-])comments?(?=$|[\s_-])", found.get("class", "") + " " + found.get("id", "")))
    names = CONTAINS_NAMED.sub(" ", found.get("class", "") + " " + found.get("id", ""))
    return bool(NAMED.search(names))


def _tree(html: str, by_name: bool) -> _Node:
    """The page's tree of blocks with their own texts; everything inside a dropped element is left out. A dropped
    inline element (a marked span, a button) leaves its block whole.

    Every element is opened and closed once, and what a tag closes is known without a walk over the open elements, so
    the time grows with the page's length however its tags are nested.
    """
    root = here = _Node("html", None, False)
    buffer: list[str] = []
    linked, owner, order = 0, None, 0
    opened: dict[str, int] = {}  # open elements by name
    muted: list[list] = []  # dropped inline elements: name, block, elements of that name open inside
    endless: set[str] = set()  # sections whose end the rest of the page lacks

    def flush() -> None:
        nonlocal linked, order
        if buffer:
            text = " ".join("".join(buffer).split())
            if text and not here.gone:
                here.texts.append((order, text, min(linked, len(text))))
                order += 1
            buffer.clear()
        linked = 0

    def up_to(node: _Node) -> None:
        nonlocal here, owner
        flush()
        while here is not node:
            if owner is here:
                owner = None
            opened[here.tag] -= 1
            here = here.parent
        while muted and muted[-1][1].depth > here.depth:
            muted.pop()

    def read(text: str) -> None:
        nonlocal linked
        if not here.gone and not muted:
            buffer.append(text)
            if owner is not None:
                linked += len(text.strip())

    at, m = 0, MARKUP.search(html)
    while m is not None:
        name = m["name"].lower() if m["name"] else ""
        if m.start() > at:
            read(unescape(html[at:m.start()]))
        at = m.end()
        if not name:
            if m[0] in ENDS:
                end = -1 if m[0] in endless else html.find(ENDS[m[0]], at)
                if m[0] == "<!--":
                    at = len(html) if end < 0 else end + 3
                elif end >= 0:
                    read(html[at:end])
                    at = end + 3
                else:  # without its end it is markup up to the next angle bracket
                    endless.add(m[0])
                    end = html.find(">", at)
                    at = len(html) if end < 0 else end + 1
        elif m["close"]:
            if name == "a":
                owner = None
            if muted and muted[-1][0] == name:
                muted[-1][2] -= 1
                if not muted[-1][2]:
                    muted.pop()
            elif opened.get(name):
                node = here
                while node.tag != name:
                    node = node.parent
                up_to(node.parent)
            elif name in BLOCKS:
                flush()
        else:
            attrs = m["attrs"] or ""
            if name in RAW:
                if not (name in FOREIGN and SELF_CLOSED.search(attrs)):
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
            elif name == "a":
                owner = here
            elif name == "br":
                read(" ")
            elif name == "hr":
                flush()
            elif name in ("html", "body"):
                up_to(root)
            elif name in INLINE_DROPPED or name not in BLOCKS and name not in DROPPED:
                if muted and muted[-1][0] == name:
                    muted[-1][2] += 1
                elif name not in EMPTY and _marked(name, attrs, by_name) and not SELF_CLOSED.search(attrs):
                    muted.append([name, here, 1])
            else:
                if name in CELLS:
                    read(" ")
                else:
                    flush()
                if name in CLOSES_P and here.closable["p"] is not None:
                    up_to(here.closable["p"].parent)
                if name in CLOSES_LIKE and here.closable[CLOSES_LIKE[name]] is not None:
                    up_to(here.closable[CLOSES_LIKE[name]].parent)
                flush()
                opened[name] = opened.get(name, 0) + 1
                here = _Node(name, here, here.gone or bool(muted) or _marked(name, attrs, by_name))
        m = MARKUP.search(html, at)
    if at < len(html):
        read(unescape(html[at:]))
    flush()
    return root


def _measure(root: _Node) -> list[_Node]:
    """All kept nodes, parents first, with characters, linked characters and points."""
    nodes, stack = [], [root]
    while stack:
        n = stack.pop()
        if not n.gone:
            nodes.append(n)
            stack.extend(n.children)
    for n in reversed(nodes):
        own = sum(len(t) for _, t, _ in n.texts)
        n.chars += own
        n.linked += sum(k for _, _, k in n.texts)
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
        if own and n.tag in PARAGRAPHS and sum(k for _, _, k in n.texts) <= own / 2:
            joined = "".join(t for _, t, _ in n.texts)
            points = 1 + joined.count(",") + min(len(joined) / 100, 3)
            up = n.parent if n.tag in ("p", "pre", "td", "dd", "li", "blockquote", "figcaption") else n
            for level in range(6):
                if up is None:
                    break
                up.points += points if level == 0 else points / (2 if level == 1 else 3 * level)
                up = up.parent
    return nodes


def _density(n: _Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _main(nodes: list[_Node]) -> list[_Node]:
    """The best container, or it and the siblings worth keeping."""
    score = {id(n): n.points * (1 - _density(n)) for n in nodes}
    scored = [n for n in nodes if n.points > 0]
    if not scored:
        return nodes[:1]
    best = max(scored, key=lambda n: score[id(n)])
    semantic = next((a for a in _ancestors(best) if a.tag in ("article", "main")), None)
    if semantic is not None:
        best = semantic
    else:
        while best.parent is not None and best.parent.tag != "html" and score[id(best.parent)] > 0.75 * score[id(best)]:
            best = best.parent
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * score[id(best)])
    kept = []
    for n in best.parent.children:
        if n.gone:
            continue
        prose = n.tag == "p" and (_density(n) < 0.25 if n.chars > 80 else n.linked == 0 and n.chars > 0)
        if n is best or score[id(n)] >= least and n.tag not in ("ul", "ol", "table") or prose:
            kept.append(n)
    return kept


def _ancestors(n: _Node | None) -> Iterator[_Node]:
    while n is not None:
        yield n
        n = n.parent


def _lines(n: _Node, out: list[tuple[int, str]]) -> None:
    stack = [n]
    while stack:
        x = stack.pop()
        if x.gone:
            continue
        links = x.linked > 0 and x.tag in ("ul", "ol", "dl", "table", "div", "section") and _density(x) > 0.5
        if links and x is not n:
            continue
        out.extend((order, t) for order, t, _ in x.texts)
        stack.extend(x.children)


def main_text(html: str | None) -> str:
    """Blocks of the page's main text, joined by newlines."""
    if not html:
        return ""
    for by_name in (True, False):  # a page whose whole text sits under such names is read without regard to them
        nodes = _measure(_tree(html, by_name))
        lines: list[tuple[int, str]] = []
        for n in _main(nodes):
            _lines(n, lines)
        if lines:
            return "\n".join(t for _, t in sorted(lines))
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h.as_py()) for h in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
