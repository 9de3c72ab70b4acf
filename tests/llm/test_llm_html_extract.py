import random
from xml.etree import ElementTree

import pytest
from llm_cases import empty

from chronotok.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu a</a><li><a href="/b">Menu b</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, to be fair, all the time.</p></div>
<div id="wrap">%s
<div class="sidebar"><p>Side, text, with, many, commas, in, it.</p></div></div>
<section id="comments"><p>A reader, comments, at, great, length, here.</p></section>
<form><p>Subscribe, now</p><input type="text"><button>Go</button></form><script>var a = "<p>script</p>";</script>
<footer>Foot &copy; 2024</footer></body></html>"""
ARTICLES = {
    "div": '<div id="content"><h2>Title &amp; more</h2><p>First para, with <a href=x>a link</a>,\n  and  space.</p>'
           '<div class="ad-box">Buy now</div><p>Second para, &lt;escaped&gt; &eacute;.</p></div>',
    "article": '<article><h2>Title &amp; more</h2><p>First para, with <b>a link,\n and  space.<p>Second para, '
               '&lt;escaped&gt; &eacute;.<ul><li><a href=1>other one</a><li><a href=2>other two</a></ul></article>',
    "main": '<main><h2>Title &#38; more</h2>\n<p>First para, with a link, and space.</p><aside>An aside, so, what</aside>'
            '<p>Second para, &#60;escaped&#62; &#xe9;.</p></main>',
}
WANT = "Title & more\nFirst para, with a link, and space.\nSecond para, <escaped> é."


@pytest.mark.parametrize("kind", list(ARTICLES))
def test_article_without_its_surroundings(kind):
    assert H.main_text(PAGE % ARTICLES[kind]) == WANT


def test_best_container_and_siblings():
    long = "A long paragraph, with commas, and many words, which goes on, and on, until it has said, what it wants. " * 3
    html = f"<body><div><p>{long}</p><p>{long}</p></div><div><p>{long}</p></div><div><a href=1>x</a><a href=2>y</a></div>"
    assert H.main_text(html).count("\n") == 2


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<<p>a</p", "<\na"), ("<p>a < b</p>", "a < b"),
    ("<!-- <p>x</p> --><p>y</p>", "y"), ("<p>a<br>b</p>", "a b"), ("<script>x", ""), ("<p title='>'>q</p>", "q"),
    ("<p>&amp;amp;&nbsp;&unknown;</p>", "&amp; &unknown;"), ("<head><title>t</title><body><p>open head</p>", "open head"),
    ("<p hidden>no</p><p>yes</p>", "yes"), ("<div class=comments><p>only text</p></div>", "only text"),
])
def test_small_and_broken_pages(html, want):
    assert H.main_text(html) == want


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert H.main_text("<p>" + "word " * 200000).count("word") == 200000
    assert H.main_text("<" * 20000 + "a") == "<" * 19999


@pytest.mark.parametrize("html, want", [
    ('<p>Hello <span class="notice">x</span> world goes on here, and on.</p>', "Hello world goes on here, and on."),
    ('<p>Hello <em class="share">x <em>y</em> z</em> world</p><p>next</p>', "Hello world\nnext"),
    ("<p>Hello <button>b</button> tail</p>", "Hello tail"), ("<p>Hello <button>b tail</p><p>next</p>", "Hello\nnext"),
    ('<div>a <span class="ad"><div>b</div></span> c</div>', "a\nc"), ('<p>a <span class="ad"><div>b</div></span> c</p>', "a\nb\nc"),
    ('<p>a <span class="ad"/> b</p>', "a b"), ('<p>a <a href=1><span class="ad">b</span> c</a> d, and on it goes, and on</p>', "a c d, and on it goes, and on"),
    ("<script src=//x.com/>var x = 1;</script><p>y</p>", "y"), ("<script/>var x = 1;</script><p>y</p>", "y"),
    ("<style media=a/>p{}</style><p>y</p>", "y"), ("<p>a<svg/>b</p>", "ab"), ("<p>a<svg x='1'/>b</p>", "ab"), ("<script>x</script foo>y", "y"),
    ("<p>a<![CDATA[ <b> ]]>c</p>", "a <b> c"), ("<p>a<![CDATA[ b > c</p>", "a c"), ("<p>a<!-- b</p>", "a"),
])
def test_inline_elements_and_raw_text(html, want):
    assert H.main_text(html) == want


HOSTILE = {
    "nested blockquotes": "<blockquote>" * 60_000 + "deep", "unmatched p": "<ul>" * 30_000 + "</p>" * 100_000 + "deep",
    "cdata": "<![CDATA[" * 100_000 + "deep", "comments": "<!--" * 200_000, "p in td": "<p><td>" + "<blockquote>" * 60_000 + "deep",
    "li in li": "<div>" * 30_000 + "<li>" * 100_000 + "deep", "rows": "<table>" + "<tr><td>x" * 60_000, "marked spans": "<span class=ad>" * 60_000 + "x",
    "attributes": "<p " + "a" * 900_000 + ">x", "quotes": "<p a='\">" * 100_000, "angles": "<" * 900_000, "dl": "<dl><dt>" * 60_000 + "<dd>" * 60_000,
    "end tags": "<div>" * 60_000 + "</section>" * 60_000,
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    """A page of a megabyte takes about twice the time of its half."""
    import time

    def seconds(html):
        start = time.process_time()
        H.main_text(html)
        return time.process_time() - start

    html = HOSTILE[name]
    assert len(html) <= 1_300_000 and seconds(html) < 20


def plain_tree(html):
    """The same rules by walks over the open elements: (tag, gone, texts) of every node, parents first."""
    import re
    from html import unescape

    stack, nodes, buffer, muted = [], [], [], []
    nodes.append(["html", False, [], None])
    stack = [nodes[0]]

    def flush():
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text and not stack[-1][1]:
            stack[-1][2].append(text)

    def close(node):
        flush()
        while stack[-1] is not node:
            stack.pop()
        stack.pop()
        while muted and not any(muted[-1][1] is x for x in stack):
            muted.pop()

    for part in re.split(r"(<[^>]*>)", html):
        tag = re.fullmatch(r"<(/?)([a-z0-9]+)((?: [^>]*)?)>", part)
        if not tag:
            if not muted and not stack[-1][1]:
                buffer.append(unescape(part))
        elif tag[1]:
            if muted and muted[-1][0] == tag[2]:
                muted[-1][2] -= 1
                if not muted[-1][2]:
                    muted.pop()
            else:
                own = [x for x in stack[1:] if x[0] == tag[2]]
                if own:
                    close(own[-1])
                elif tag[2] in H.BLOCKS:
                    flush()
        elif tag[2] in ("b", "span", "button"):
            if muted and muted[-1][0] == tag[2]:
                muted[-1][2] += 1
            elif tag[2] == "button" or "class" in tag[3]:
                muted.append([tag[2], stack[-1], 1])
        else:
            if tag[2] in H.CELLS:
                if not muted and not stack[-1][1]:
                    buffer.append(" ")
            else:
                flush()
            for key, nearest in ((("p", True),) if tag[2] in H.CLOSES_P else ()) + ((("x", False),) if tag[2] in H.CLOSES_LIKE else ()):
                names, bounds = H.CLOSING["p" if key == "p" else H.CLOSES_LIKE[tag[2]]]
                found = None
                for x in reversed(stack[1:]):
                    if x[0] in names:
                        found = x
                        if nearest:
                            break
                    elif x[0] in bounds:
                        break
                if found is not None:
                    close(found)
            flush()
            node = [tag[2], stack[-1][1] or bool(muted) or "class" in tag[3] or tag[2] in H.DROPPED, [], stack[-1]]
            nodes.append(node)
            stack.append(node)
    flush()
    return [(n[0], n[1], n[2], n[3][0] if n[3] else None) for n in nodes]


def test_tree_against_walks_over_the_open_elements():
    import random

    rng = random.Random(4)
    names = "p div ul li table tr td th dl dt dd section blockquote nav b span button h1".split()
    for _ in range(3000):
        soup = "".join(rng.choice([f"<{n}>", f"</{n}>", f"<{n} class=ad>" if rng.random() < 0.3 else f"<{n}>", "word ", "x&amp;y ", "\n"])
                       for n in rng.choices(names, k=rng.randrange(1, 30)))
        root, got = H._tree(soup, True), []
        order = [root]
        while order:
            n = order.pop()
            got.append((n.tag, n.gone, [t for _, t, _ in n.texts], n.parent.tag if n.parent else None))
            order.extend(reversed(n.children))
        key = lambda x: (x[0], x[1], x[2], str(x[3]))
        assert sorted(got, key=key) == sorted(plain_tree(soup), key=key), soup


def test_table(spark):
    rows = [(1, "u", PAGE % ARTICLES["div"], 1), (1, "u", PAGE % ARTICLES["div"], 1), (None, None, None, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract(pages).collect()
    assert [r.text for r in got] == [WANT, WANT, ""] and got[2].page_id is None
    assert H.extract(empty(spark, "page_id long, url string, html string")).count() == 0


def test_all_pages_of_the_table_equal_their_articles(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert texts[r.page_id] == "\n".join(b for b in blocks if b)


# A second reading of well-formed pages: an XML parser's tree, and sums taken anew for every element.
GONE = {"nav", "aside", "footer", "header"}
GOES_UP = {"p", "li", "blockquote"}
BLOCK_TAGS = {"div", "section", "article", "ul", "li", "p", "blockquote", "h2"} | GONE


def pieces(el):
    """(characters, characters in links, text) of each stretch of the element's own text, and its blocks, in order."""
    out, words, linked = [], [], 0

    def say(text, in_link):
        nonlocal linked
        words.append(text or "")
        linked += len((text or "").strip()) if in_link else 0

    def close():
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            out.append((len(text), min(linked, len(text)), text))
        words.clear()
        linked = 0

    def walk(x, in_link):
        say(x.text, in_link)
        for child in x:
            if child.tag in BLOCK_TAGS:
                close()
                out.append(child)
            elif child.get("class") != "notice":
                walk(child, in_link or child.tag == "a")
            say(child.tail, in_link)

    walk(el, False)
    close()
    return out


def plain_main_text(html):
    root = ElementTree.fromstring(html)
    above = {}

    def kept(el):
        return el.tag not in GONE and el.get("class") != "sidebar"

    def under(el):
        """The element and all kept blocks below it."""
        found = [el]
        for x in pieces(el):
            if not isinstance(x, tuple) and kept(x):
                above[x] = el
                found += under(x)
        return found

    blocks = under(root)
    own = {e: [x for x in pieces(e) if isinstance(x, tuple)] for e in blocks}
    chars = {e: sum(n for x in under(e) for n, _, _ in own[x]) for e in blocks}
    linked = {e: sum(k for x in under(e) for _, k, _ in own[x]) for e in blocks}
    share = {e: linked[e] / chars[e] if chars[e] else 0 for e in blocks}
    points = dict.fromkeys(blocks, 0.0)
    for e in blocks:
        n, k = sum(x[0] for x in own[e]), sum(x[1] for x in own[e])
        if not n or e.tag in ("ul", "h2", "body") or k > n / 2:
            continue
        given = 1 + sum(x[2].count(",") for x in own[e]) + min(n / 100, 3)
        line = [e]
        while line[-1] in above:
            line.append(above[line[-1]])
        for level, up in enumerate(line[e.tag in GOES_UP:][:6]):
            points[up] += given / (1, 2, 6, 9, 12, 15)[level]
    score = {e: points[e] * (1 - share[e]) for e in blocks}
    best = max(blocks, key=lambda e: score[e])
    line = [best]
    while line[-1] in above:
        line.append(above[line[-1]])
    articles = [e for e in line if e.tag == "article"]
    if articles:
        best = articles[0]
    else:
        for up in line[1:]:
            if up is root or score[up] <= 0.75 * score[best]:
                break
            best = up
    chosen = [best]
    if best is not root:
        beside = [x for x in pieces(above[best]) if not isinstance(x, tuple) and kept(x)]
        chosen = [e for e in beside if e is best or score[e] >= max(10, 0.2 * score[best]) and e.tag != "ul" or e.tag == "p" and (
            share[e] < 0.25 if chars[e] > 80 else chars[e] > 0 and not linked[e])]

    def lines(e):
        for x in pieces(e):
            if isinstance(x, tuple):
                yield x[2]
            elif kept(x) and not (linked[x] and x.tag in ("ul", "div", "section") and share[x] > 0.5):
                yield from lines(x)

    return "\n".join(t for e in chosen for t in lines(e))


def random_page(rng):
    words = lambda n: " ".join(rng.choice(("alpha", "beta,", "gamma", "delta,", "x")) for _ in range(n))

    def inline(n):
        out = words(rng.randrange(1, n))
        for _ in range(rng.randrange(3)):
            tag = rng.choice(("a", "b", "a", 'span class="notice"'))
            out += f" <{tag}>{words(rng.randrange(1, n))}</{tag.split()[0]}> {words(rng.randrange(1, 9))}"
        return out

    def block(depth):
        tag = rng.choice(("p", "p", "p", "h2", "ul") if depth > 4 else
                         ("p", "p", "div", "div", "section", "article", "ul", "blockquote", "nav", "aside", 'div class="sidebar"'))
        if tag in ("p", "h2"):
            inner = inline(40)
        elif tag == "ul":
            item = lambda: f"<a>{words(rng.randrange(1, 9))}</a>" if rng.random() < 0.5 else inline(20)
            inner = "".join(f"<li>{item()}</li>" for _ in range(rng.randrange(1, 5)))
        else:
            inner = "".join(block(depth + 1) + (inline(9) if rng.random() < 0.2 else "") for _ in range(rng.randrange(1, 5)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    prose = f"<p>{inline(40)}</p>"  # at least one paragraph with points
    return f"<body>{''.join(block(0) for _ in range(rng.randrange(0, 5)))}{prose}</body>"


def test_random_pages_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        html = random_page(rng)
        assert H.main_text(html) == plain_main_text(html), html
