"""Main text of pages."""

import html as entities
import re
import time

import pytest

from energylake.llm import html

PARAGRAPH = "A paragraph of the article, with commas, full stops. And some more words, so that it is long enough."


def page(body, head="<title>Title</title><style>p{x:y}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def article(*blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


CASES = {
    "plain article": (page(f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head</h1>{article(PARAGRAPH, 'Short.')}</article><footer>Foot</footer>"), ["Head", PARAGRAPH, "Short."]),
    "no article element": (page(f"<div class='menu'><a>Home</a> <a>News</a></div><div id='content'><h2>Head</h2>{article(PARAGRAPH, PARAGRAPH, 'End.')}</div><div class='sidebar'>Side, side.</div>"), ["Head", PARAGRAPH, PARAGRAPH, "End."]),
    "unclosed tags": ("<html><body><article><h1>Head</h1><p><b>One, two.<br><p>Three, four.", ["Head", "One, two.", "Three, four."]),
    "cut inside a tag": ("<article><p>One, two.</p><p>Three</p", ["One, two.", "Three"]),
    "character references": (page(f"<article><p>Fish &amp; chips &lt;b&gt; &eacute;&#233;&#xe9; &nbsp; x &copy 5 &unknown; &am</p>{article(PARAGRAPH)}</article>"), ["Fish & chips <b> ééé x © 5 &unknown; &am", PARAGRAPH]),
    "inline tags and white space": (page(f"<article><p>One\n\t<em>two</em>thr<b>ee</b> <a href=x>four</a>\r\n</p>{article(PARAGRAPH)}</article>"), ["One twothree four", PARAGRAPH]),
    "scripts and styles": (page(f"<article><script>if (a < b) {{ x = '</p>'; }}</script>{article(PARAGRAPH)}<style>b{{}}</style><noscript>No</noscript></article>"), [PARAGRAPH]),
    "script without end": (page(f"<article>{article(PARAGRAPH)}<script>var x = 1;"), [PARAGRAPH]),
    "comments in the markup": (page(f"<article><!-- <p>not</p> -->{article(PARAGRAPH)}<!-- open"), [PARAGRAPH]),
    "reader comments": (page(f"<article>{article(PARAGRAPH)}<section class='comments'><article class='comment'>{article('Nice one, thanks.')}</article></section></article><div id='disqus_thread'>Say, say.</div>"), [PARAGRAPH]),
    "parts inside the article": (page(f"<article><aside>Aside</aside><p>{PARAGRAPH}</p><div class='ad'>Buy, buy.</div><form>Name <input></form><p>{PARAGRAPH}</p><div class='cookie-notice'>We use, cookies.</div><footer>By me</footer></article>"), [PARAGRAPH, PARAGRAPH]),
    "page header": (page(f"<header><h1>Site</h1></header><main><h1>Head</h1>{article(PARAGRAPH)}</main>"), ["Head", PARAGRAPH]),
    "lists, quotes and tables": (page(f"<article><p>{PARAGRAPH}</p><ul><li>One<li>Two</ul><blockquote>Said</blockquote><table><tr><td>A<td>B<tr><td>C</table><pre>x  y</pre></article>"), [PARAGRAPH, "One", "Two", "Said", "A", "B", "C", "x y"]),
    "hidden": (page(f"<article>{article(PARAGRAPH)}<p hidden>Not</p><div style='display: none'>Not</div></article>"), [PARAGRAPH]),
    "attributes with brackets": (page(f"<article><p title='a > b' data-x=\"<p>\">{PARAGRAPH}</p></article>"), [PARAGRAPH]),
    "stray quote in a tag": (page(f"<article><p title=it's>{PARAGRAPH}</p></article>"), [PARAGRAPH]),
    "upper case": (f"<HTML><BODY><ARTICLE><P>{PARAGRAPH}</P></ARTICLE><NAV>Home</NAV></BODY></HTML>", [PARAGRAPH]),
    "text alone": ("just text, no tags", ["just text, no tags"]),
    "largest article": (page(f"<article>{article('Teaser, one.')}</article><article>{article(PARAGRAPH, PARAGRAPH)}</article>"), [PARAGRAPH, PARAGRAPH]),
    "nothing": ("<nav>Home</nav><script>1</script>", []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    source, blocks = CASES[name]
    assert html.extract(source) == "\n".join(blocks)


SECOND = PARAGRAPH.replace("article", "second part")
SPLIT = {
    "articles of equal length": (page(f"<div><article>{article(PARAGRAPH, PARAGRAPH)}</article><article>{article(SECOND, SECOND)}</article></div>"), [PARAGRAPH, PARAGRAPH, SECOND, SECOND]),
    "a shorter second article": (page(f"<article>{article(*[PARAGRAPH] * 9)}</article><article>{article(SECOND)}</article>"), [PARAGRAPH] * 9 + [SECOND]),
    "heading beside the body": (page(f"<h1>Head</h1><div>{article(*[PARAGRAPH] * 9)}</div>"), ["Head"] + [PARAGRAPH] * 9),
    "heading before the article": (page(f"<div><h1>Head</h1></div><article>{article(*[PARAGRAPH] * 9)}</article>"), ["Head"] + [PARAGRAPH] * 9),
    "closing section": (page(f"<div>{article(*[PARAGRAPH] * 19)}</div><section>{article(SECOND)}</section>"), [PARAGRAPH] * 19 + [SECOND]),
    "links beside the body": (page(f"<div>{article(*[PARAGRAPH] * 9)}</div><div><span><a href='/'>Home</a></span></div>"), [PARAGRAPH] * 9),
}


@pytest.mark.parametrize("name", SPLIT)
def test_content_outside_the_main_element(name):
    source, blocks = SPLIT[name]
    assert html.extract(source) == "\n".join(blocks)


WHOLE = article(*[PARAGRAPH] * 4)
NAMES = {
    "ids made from headings": (page(f"<article>{WHOLE}<h2 id='related-work'>Related work</h2><p id='side'>{SECOND}</p><h2 id='notice-period'>Notice</h2><section id='discussion'><h2>Discussion</h2><p>{SECOND}</p></section><section id='social-impact'><p>{SECOND}</p></section></article>"), [PARAGRAPH] * 4 + ["Related work", SECOND, "Notice", "Discussion", SECOND, SECOND]),
    "an article called discussion": (page(f"<article class='post discussion'>{WHOLE}</article>"), [PARAGRAPH] * 4),
    "a form around the page": (page(f"<form id='aspnetForm'><nav>Home</nav><div id='content'>{WHOLE}</div><label>Name</label><input><select><option>A</select></form>"), [PARAGRAPH] * 4),
    "unwanted parts with a wanted word": (page(f"<div id='content'>{WHOLE}<div class='article-sidebar'><p>{SECOND}</p></div><div class='page-footer'><p>{SECOND}</p></div><div class='content-ad'><p>{SECOND}</p></div><div class='post-share'>{SECOND}</div></div>"), [PARAGRAPH] * 4),
    "a page with a sidebar": (page(f"<div class='content has-sidebar'>{WHOLE}<div class='sidebar-left'><a>One</a></div><div class='related-posts'><a>Two</a></div></div>"), [PARAGRAPH] * 4),
    "comments": (page(f"<article>{WHOLE}<div id='comments'><p>{SECOND}</p></div><div class='post-comments'><p>{SECOND}</p></div></article>"), [PARAGRAPH] * 4),
}


@pytest.mark.parametrize("name", NAMES)
def test_names_of_parts(name):
    source, blocks = NAMES[name]
    assert html.extract(source) == "\n".join(blocks)


def test_link_lists_score_low():
    body = "".join(f"<td><a href='/{i}'>Some link, to a page.</a></td>" for i in range(20))
    read = html.read_page(page(f"<table><tr>{body}</tr></table><div>{article(PARAGRAPH, PARAGRAPH)}</div>"))
    scores = {read.paths.text(p): x for p, x in html.path_scores(read.blocks).items()}
    assert scores["/html/body/div/p"] > 3 * scores["/html/body/table/tr/td"]


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x, y.</p>"), (4, "u", "<p>same.</p>"), (4, "u", "<p>same.</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS k0", "3 AS n_chars")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html.extract_pages(df).collect())
    assert got == [("1", "u", "", 0), ("2", "None", "", 0), ("4", "u", "same.", 5), ("4", "u", "same.", 5), ("None", "u", "x, y.", 5)]
    assert html.extract_pages(df.limit(0)).collect() == []


def test_hostile_pages_take_no_long_time():
    begun = time.time()
    for source in ["<" * 50_000, "<p " * 20_000, "<a '" * 20_000, "<div>" * 5_000 + "x", "&" * 50_000, "<!--" * 20_000, "</p>" * 50_000, '<p a="' * 10_000]:
        html.extract(source)
    assert time.time() - begun < 30


@pytest.mark.parametrize(
    "source",
    [
        "<div>x, y." * 100_000,
        "<div class='promo content'>x, y." * 20_000,
        "<article>x, y." * 40_000,
        "<td><p><div>x, y." * 30_000 + "</span>" * 50_000,
        "<span>x, y." * 100_000 + "</b></i>" * 50_000,
        "<form><label>x</label>" * 20_000,
        "<ul><li>x, y." * 30_000,
    ],
)
def test_deep_pages_take_time_by_their_length(source):
    """About a megabyte of elements that are all open at once."""
    begun = time.time()
    html.extract(source)
    assert time.time() - begun < 20


def plain_scores(blocks):
    """Ratios of every path, from (path, text, linked characters) in page order, by loops."""
    paths = {p for p, _, _ in blocks}
    fused = {}
    for p in paths:
        own = [(t, l) for q, t, l in blocks if q == p]
        chars = sum(len(t) for t, _ in own)
        marks = sum(c in ",.;:!?。，；：！？、" for t, _ in own for c in t)
        linked = sum(min(l, len(t)) for t, l in own)
        fused[p] = (chars / len(own) * (1 + marks) / len(own)) ** 0.5 * (1 - linked / chars)
    line = [fused[p] for p, _, _ in blocks]
    at = lambda i: line[min(max(i, 0), len(line) - 1)]
    smooth = [(0.2 * at(i - 2) + 0.6 * at(i - 1) + at(i) + 0.6 * at(i + 1) + 0.2 * at(i + 2)) / 2.6 for i in range(len(line))]
    return {p: sum(x for x, (q, _, _) in zip(smooth, blocks) if q == p) / sum(q == p for q, _, _ in blocks) for p in paths}


@pytest.mark.parametrize("name", [*CASES, *SPLIT, *NAMES])
def test_path_scores(name):
    read = html.read_page((CASES | SPLIT | NAMES)[name][0])
    if read.blocks:
        rows = [(b.element.path, b.text, b.linked) for b in read.blocks]
        assert html.path_scores(read.blocks) == pytest.approx(plain_scores(rows))


def by_template(source):
    """Blocks between the tags of the test tables' template."""
    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    parts = re.split(r"<h1>|</h1>|<p>|</p>", inner.replace("<br>", " "))
    texts = (" ".join(entities.unescape(re.sub(r"<[^>]*(>|$)", "", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: by_template(r.html) for r in df.collect()}
    got = html.extract_pages(df).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
