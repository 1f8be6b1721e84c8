import os
import re
from html.parser import HTMLParser

import pytest

from lumenbase.llm import html
from lumenbase.llm.html import content_cluster, extract_pages, main_text, read_lines

SF = "/root/testdata/sf0.01/pages.parquet"

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href=/>Home</a> The site</header><nav><ul><li><a href=/a>A</a></li></ul></nav><div id="cookie-notice">We use cookies and tell you so at length.</div>
<main><article class="post"><header><h1>Title &amp; more</h1><p>By someone</p></header><p>First <b>para</b>graph &eacute;&#233;&unknown; text\n  here.</p>
<ul><li>One</li><li>Two</li></ul><aside>Aside</aside><blockquote>Quoted<br>line</blockquote><form>Subscribe <input></form><div class="share-buttons">Share</div><p hidden>x</p><p>Of.</p></article>
<section class="comments"><article class="comment"><p>A reader's comment that is much longer than the article, so that by weight alone it would win, and by far too, for it goes on and on.</p></article></section></main>
<div class="sidebar">Other</div><footer>&copy; The site</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Title & more\nFirst paragraph éé&unknown; text here.\nOne\nTwo\nQuoted line\nOf."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain &lt;text&gt;", "plain <text>"), ("<div><p>aa<p>bb", "aa\nbb"), ("<article><p><b>a<br><p>b</p></article></p></div>", "a\nb"),
        ("<p>a</p><!-- c --><p>b</p><script>x", "a\nb"), ("<nav>only menu</nav>", ""), ("<article>a&nbsp;&nbsp;b</article>", "a b"), ("<div class=ad>x</div>y", "y"), ("<", "<"), ("<div class=ad>x</div>", ""),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_without_an_article_the_region_that_holds_the_cluster():
    body = "".join(f"<p>{'A sentence of the article that has some length to it. ' * 3}</p>" for _ in range(4))
    links = "".join(f"<p><a href=/{i}>Link number {i}</a></p>" for i in range(12))
    assert main_text(f"<div>{links}</div><div><h2>Head</h2>{body}</div>").split("\n")[0] == "Head"
    lines, _ = read_lines(f"<div>{links}</div><div>{body}</div>")
    assert [x.text.startswith("A sentence") for x in lines][-4:] == content_cluster(lines, [1.0] * len(lines))[-4:] == [True] * 4


def test_long_page_and_table(spark):
    rows = [(1, "u1", PAGE, 0), (2, None, None, 0), (3, "u3", "<article>" + "<p>word</p>" * 20_000 + "</article>", 0), (None, "u", "<p>x", 0), (1, "u1", PAGE, 0), (4, "u4", "<p>same"[:7], 1), (5, "u5", "<p>same"[:7], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[2]["text"] == "" and got[2]["url"] is None and got[2]["n_chars"] == 0
    assert got[3]["text"] == "\n".join(["word"] * 20_000)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LONG = "A sentence of the article that has some length to it, and goes on for a while. "
BODY = f"<h1>Head</h1><p>{LONG * 3}</p><p>Short.</p><p><a href=/x>A linked line</a></p><ul><li><a href=/y>Linked item</a></li></ul><p>{LONG * 4}</p>"
WANTED = ["Head", (LONG * 3).strip(), "Short.", "A linked line", "Linked item", (LONG * 4).strip()]


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{BODY}</article>", f'<div class="layout has-sidebar">{BODY}</div>', f'<div class="post no-comments">{BODY}</div>', f'<div id="main-share-wrap"><article>{BODY}</article></div>',
        f'<div class="widget"><div class="inner">{BODY}</div></div>', f'<main class="content"><article class="ad-free">{BODY}</article></main>',
        f'<div class=page><div class=text>{BODY}</div><div class="sidebar"><p>Some teaser</p><p>Another one</p></div></div>',
        f'<div class=page><div class=text>{BODY}<div class="share-buttons"><p>Share this</p></div></div><div class="related"><article><p>Teaser</p></article><article><p>Teaser two</p></article></div></div>',
        f'<div class=page><div class=text>{BODY}</div><section class="comments"><p>{LONG * 9}</p><p>{LONG * 12}</p><p>{LONG * 7}</p></section></div>',
        f'<div class=page><article>{BODY}<div class="ad-box"><p>{LONG * 8}</p></div></article><div class="cookie-notice">{LONG * 3}</div></div>',
    ],
)
def test_markup_is_evidence_beside_the_ratios(page):
    menu = "".join(f"<li><a href=/{k}>Menu {k}</a></li>" for k in range(9))
    assert main_text(f"<html><body><ul>{menu}</ul>{page}<footer>Foot</footer></body></html>").split("\n") == WANTED


def test_the_cluster_decides(monkeypatch):
    teasers = "".join(f"<li>Teaser {k}</li><li><a href=/{k}>more</a></li>" for k in range(12))
    page = f"<body><div><ul>{teasers}</ul></div><div>{BODY}</div><div><ul>{teasers}</ul></div></body>"
    assert main_text(page).split("\n") == WANTED
    monkeypatch.setattr(html, "content_cluster", lambda lines, factors: [True] * len(lines))
    assert "Teaser 3" in main_text(page)


def test_several_articles_of_one_page_stay():
    page = f"<body><main><article><h2>One</h2><p>{LONG * 3}</p></article><article><h2>Two</h2><p>{LONG * 3}</p></article></main></body>"
    assert main_text(page).split("\n") == ["One", (LONG * 3).strip(), "Two", (LONG * 3).strip()]


class Tree(HTMLParser):
    """A plain document tree: [tag, children], children being trees or texts."""

    def __init__(self, page):
        super().__init__()
        self.root = ["", []]
        self.path = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.path[-1][0] == "p":
            self.path.pop()
        node = [tag, []]
        self.path[-1][1].append(node)
        if tag not in ("br", "meta"):
            self.path.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.path):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][1].append(data)


def article_blocks(node, inside=False):
    """Texts of the article's blocks, by the tree alone."""
    if isinstance(node, str):
        return [node] if inside else []
    out = []
    for child in node[1]:
        part = article_blocks(child, inside or node[0] == "article")
        if not isinstance(child, str) and child[0] in ("b", "br"):
            part = [" "] if child[0] == "br" else part
            out[-1:] = ["".join(out[-1:] + part[:1])]
            out += part[1:]
        elif isinstance(child, str) and out and isinstance(node[1][0], str) is False and node[0] in ("p", "b"):
            out[-1] += child
        else:
            out += part
    return out


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_agrees_with_the_tree_of_every_page(spark):
    pages = spark.read.parquet(SF)
    got = {r["page_id"]: r["text"] for r in extract_pages(pages).collect()}
    want = {r["page_id"]: "\n".join(t for t in (" ".join(x.split()) for x in article_blocks(Tree(r["html"] or "").root)) if t) for r in pages.collect()}
    assert got == want


MENU = "<ul>" + "".join(f"<li><a href=/{k}>Menu {k}</a></li>" for k in range(9)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm" action="/"><div>{MENU}</div><div class="content">{BODY}</div></form>', f'<div class="ad-wrapper"><article>{BODY}</article></div>', f'<div class="page consent-given"><article>{BODY}</article></div>',
        f'<article class="post sponsored">{BODY}</article>', f'<div class="page consent-given"><div class="text">{BODY}</div><div class="cookie-notice">{LONG}</div></div>',
        f'<form><div class="ad-wrapper"><div class="sponsored">{BODY}<div class="ad">{LONG}</div></div><section class="comments"><p>{LONG * 9}</p></section></div></form>',
        f'<article>{BODY}<form><h3>Leave a reply</h3><p>{LONG * 2}</p><input></form></article>', f'<div role="form"><article>{BODY}</article></div>',
    ],
)
def test_what_wraps_the_article_is_no_boilerplate(page):
    assert main_text(f"<html><body>{MENU}{page}<footer>Foot</footer></body></html>").split("\n") == WANTED


def test_the_title_before_a_sponsored_article():
    assert main_text(f'<h1>Title</h1><article class="post sponsored"><p>{LONG * 3}</p><p>Short.</p></article><footer>Foot</footer>').split("\n")[-2:] == [(LONG * 3).strip(), "Short."]


def test_paragraphs_named_reply_and_controls_within_a_line():
    assert main_text(f'<article><p>{LONG * 2}</p><p class="reply">He replied.</p><p class="ad">Buy now</p></article>').split("\n") == [(LONG * 2).strip(), "He replied."]
    assert main_text("<p>Press <button>OK</button> now, <svg><text>x</text></svg>or <map><area></map>later<script>x</script>.</p>") == "Press now, or later."


def test_no_article_no_text():
    assert main_text(f"<nav>{MENU}</nav><aside><p>Teaser</p></aside><form><h3>Subscribe</h3><input></form><footer><p>Foot</p></footer>") == ""


TABLES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no test tables")
def test_pages_stripped_of_markup_depend_on_the_cluster(spark, monkeypatch):
    """Without the article's tag, classes, ids and roles, the ratios find the text that the tag marks; without them, fewer."""
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(TABLES.replace("sf0.01", "sf0.1") if os.path.exists(TABLES.replace("sf0.01", "sf0.1")) else TABLES).collect() if r["html"]}
    want = {i: "\n".join(t for t in (" ".join(x.split()) for x in article_blocks(Tree(h).root)) if t) for i, h in rows.items()}
    bare = {i: re.sub(r"\s(class|id|role)=\"[^\"]*\"", "", re.sub(r"(</?)(article|nav|header|footer|aside|form)\b", r"\1div", h)) for i, h in rows.items()}
    right = sum(main_text(h) == want[i] for i, h in bare.items())
    monkeypatch.setattr(html, "content_cluster", lambda lines, factors: [True] * len(lines))
    assert right >= 0.985 * len(rows) and right > sum(main_text(h) == want[i] for i, h in bare.items())
