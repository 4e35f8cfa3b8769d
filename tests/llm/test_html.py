"""Extraction of main text on small pages."""

import random
import tracemalloc

import pytest

from papersheaf.llm import html

SCHEMA = "page_id long, url string, html string"
SIDE = (
    "<header>top</header><nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class='sidebar-left'><p>side text</p></div>"
    "<div id='cookieNotice'>we use cookies</div><form><p>name</p><input></form>"
)
END = "<section class='comments'><p>first!</p><p>a long reader comment, with more words than all else</p></section><footer>&copy; x</footer>"


def page(body, before=SIDE, after=END):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>"


@pytest.mark.parametrize(
    "source, text",
    [
        (page("<article><h1>A &amp; B</h1><p>one\n two<br>three <b>fo</b>ur<p>five</article>"), "A & B one two three four five"),
        (page("<div class='post-17'><p>x &lt; y &#233;&eacute;</p><ul><li>i<li>j</ul></div>"), "x < y éé i j"),
        (page("<main><p>a<script>var t='</p>';</script>b<!-- c --></p><blockquote>q</blockquote></main>"), "ab q"),
        (page("<article><p>cut &amp off he"), "cut & off he" + " first! a long reader comment, with more words than all else"[:0]),
        (page("<article><p>kept</p><aside>no</aside><div class='ad'>buy</div><p>end</article>"), "kept end"),
        ("just text <with", "just text"),
        ("a < b > c <1", "a < b > c <1"),
        ("<p class=\"x>y\" data='a\"b'>quoted</p>", "quoted"),
        ("<script>never closed <p>x", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_one_page(source, text):
    assert html.read(source).extract([]) == text


def test_whole_long_page():
    body = "".join(f"<p>word{k} &amp; more</p>" for k in range(20000))
    assert html.read(page(f"<article>{body}</article>")).extract([]) == " ".join(f"word{k} & more" for k in range(20000))


def test_hosts_vote_for_their_paths(spark):
    many = [(k, "http://a.org/x", page(f"<div class='box-{k}'><p>main text number {k}, long enough</p></div><div class='extra'><p>e</p></div>")) for k in range(8)]
    # here another container holds more text, but the host's pages agree on the first
    odd = (50, "http://A.org/y", page("<div class='box-9'><p>short</p></div><div class='extra'><p>much longer text in the other box</p></div>"))
    alone = (60, "http://b.org", page("<div class='extra'><p>much longer text in the other box</p></div>"))
    rows = [*many, odd, alone, (70, None, page("<main><p>no url</p></main>")), (None, "bad", None), (80, "http://c", "")]
    pages = spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA + ", host string, paths string")
    got = {r.page_id: (r.url, r.text) for r in html.extract(pages).collect()}
    assert got[3] == ("http://a.org/x", "main text number 3, long enough")
    assert got[50][1] == "short"
    assert got[60][1] == "much longer text in the other box"
    assert (got[70][1], got[None][1], got[80][1]) == ("no url", "", "")


def test_no_rows(spark):
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("<article><h1>{h}</h1><div class='entry-content'><p>{long}</p></div></article>", "{h} {long}"),
        ("<article><div class='lead'><p>{lead}</p></div><div class='body'><p>{long}</p></div></article>", "{lead} {long}"),
        ("<div class='post'><div class='lead'><p>{lead}</p></div><div class='body'><p>{long}</p></div></div>", "{lead} {long}"),
        ("<h1>{h}</h1><div class='x'><p>{long}</p></div><p><a href='/'>{lead}</a></p>", "{h} {long}"),
        ("<article><p>{lead}</p><ul><li>{long}<li>{long}</ul><p>{h}</p></article>", "{lead} {long} {long} {h}"),
        ("<article><p>{lead}</p><table><tr><td>{long}<td>{h}<tr><td>{long}</table></article>", "{lead} {long} {h} {long}"),
        ("<div class='a'><p>{lead}</p></div><div class='b'><p>{long}</p></div><ul class='c'><li><a>{h}</a></ul>", "{lead} {long}"),
    ],
)
def test_text_around_the_best_container(spark, body, wanted):
    parts = {"h": "the heading", "lead": "a lead of some words " * 5, "long": "long text of the body " * 40}
    wanted = " ".join(wanted.format(**parts).split())
    source = page(body.format(**parts))
    assert html.read(source).extract([]) == wanted
    assert html.read(source).extract([html.read(source).best()]) == wanted


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("<div class='content has-sidebar'><article><p>{long}</p></article></div>", "{long}"),
        ("<article class='post comments-open'><p>{long}</p><section class='related-work'><p>{lead}</p></section></article>", "{long} {lead}"),
        ("<div id='sidebar-layout'><article><p>{long}</p></article></div>", "{long}"),
        ("<div class='page-header-below'><main><p>{lead}</p></main></div>", "{lead}"),
        ("<div class='newsletter'><p>{long}</p></div>", "{long}"),
        ("<app-root class='ad-layout'><article><p>{long}</p></article></app-root>", "{long}"),
        ("<article><p>{lead}</p></article><div class='sidebar'><article><p>{long}</p></article></div>", "{lead}"),
        ("<article><p>{lead}<span class='share'>now</span></p><p class='ad'>buy</p></article>", "{lead}"),
    ],
)
def test_names_of_side_matter_around_the_main_text(spark, body, wanted):
    parts = {"lead": "a lead of some words " * 5, "long": "long text of the body " * 40}
    assert html.read(page(body.format(**parts))).extract([]) == " ".join(wanted.format(**parts).split())


def test_no_page_is_empty_for_its_names():
    assert html.read("<div class='comments'><p>all there is</p></div><nav>x</nav>").extract([]) == "all there is"
    assert html.read("<p><span class='notice'>all there is</span></p>").extract([]) == "all there is"


@pytest.mark.parametrize("body", ["<div class=body>", "<section class='body'>"])
@pytest.mark.parametrize(
    "box, kept",
    [
        ("<div class=lead><p>a lead</p></div>", "a lead"),
        ("<section>the <i>closing</i> words</section>", "the closing words"),
        ("<blockquote><p>a quote</p></blockquote>", "a quote"),
        ("<div><div><table><tr><td>cell</table></div></div>", "cell"),
        ("<div class='links'><a href=x>one</a> <a href=y>two</a></div>", ""),
        ("<div class=lead>a lead of words, <ul><li><a>link list</a></ul></div>", "a lead of words,"),
        ("<div class='sidebar'>no</div>", ""),
    ],
)
def test_boxes_beside_the_best_container(body, box, kept):
    long = "long text of the body " * 90
    for order in (f"{body}<p>{long}</p></{body[1:].split()[0]}>{box}", f"{box}{body}<p>{long}</p></{body[1:].split()[0]}>"):
        wanted = [long.strip(), kept] if order.startswith(body) else [kept, long.strip()]
        assert html.read(page(order)).extract([]) == " ".join(filter(None, wanted))
        assert html.read(page(f"<div class=w>{order}</div>")).extract([]) == " ".join(filter(None, wanted))


def test_names_with_few_words_of_side_matter_inside_an_article():
    long = "long text of the body " * 40
    source = (
        f"<article><p>{long}</p><section class='notice-board-history'><p>kept</p></section>"
        "<div class='page-share-tools'><a>drop this</a></div><div class='related-posts'>drop</div><div class='long-user-comments'>drop</div></article>"
    )
    assert html.read(page(source)).extract([]) == f"{long.strip()} kept"


def test_deep_pages_take_memory_by_their_length():
    def peak(depth):
        source = "<div>" * depth + "<p>text</p>" + "<div><p>x</p></div></div>" * depth
        tracemalloc.start()
        found = html.read(source)
        assert found.extract([found.best()]).startswith("text")
        found.votes()
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size

    small, large = peak(3000), peak(12000)
    assert large < 5 * small
    assert large < 60 * 1024 * 1024


def test_tags_without_end_take_time_by_their_length():
    source = "<b>" * 20000 + "<p>a</i></p>" * 20000
    assert html.read(source).extract([]) == " ".join(["a"] * 20000)


TEMPLATES = {
    "wrapped.org": "<div class='w'><div class='promo-x'>{same}</div><div class='intro'>{a}</div><div class='post-{n}'><h1>{b}</h1><p>{c}</p></div><div class='end'>{d}</div></div>",
    "flat.org": "<div class='tpl'>{same}</div><h1>{b}</h1><div id='x{n}' class='txt'><p>{a}</p><p>{c}</p></div><blockquote>{d}</blockquote>",
    "article.org": "<div class='tpl'>{same}</div><article class='n{n}'><p>{a}</p><div class='in'><p>{b}</p><ul><li>{c}</ul></div><section>{d}</section></article>",
    "table.org": "<table><tr><td><div class='head'>{a}</div><div class='main-col{n}'>{b}<br>{c}</div><center>{d}</center></table><div class='about-us'>{same}</div>",
}
ORDER = {"wrapped.org": "abcd", "flat.org": "bacd", "article.org": "abcd", "table.org": "abcd"}


def test_templates_of_hosts_against_what_was_put_in(spark):
    """Each page is made from parts, so its article is known without reading any markup."""
    draw, rows, wanted = random.Random(5), [], {}
    for number in range(160):
        host = list(TEMPLATES)[number % 4]
        parts = {p: " ".join(draw.choice("one two three four five six".split()) for _ in range(n)) for p, n in zip("abcd", (12, 8, 200, 15))}
        parts |= {"same": f"this box is on all pages of {host}", "n": number}
        rows.append((number, f"http://{host}/{number}", page(TEMPLATES[host].format(**parts))))
        wanted[number] = " ".join(parts[p] for p in ORDER[host])
    rows += [(1000 + k, url, source) for k, (_, url, source) in enumerate(rows[:8])]  # copies vote, too
    wanted |= {1000 + k: wanted[k] for k in range(8)}
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == wanted


def test_copies_of_one_page_do_not_repeat_its_boxes(spark):
    source = page("<div class='lead'>a lead</div><div class='body'><p>" + "long text " * 90 + "</p></div>")
    got = html.extract(spark.createDataFrame([(k, "http://a.org/", source) for k in range(20)], SCHEMA + ""))
    assert {r.text for r in got.collect()} == {"a lead " + ("long text " * 90).strip()}


def test_other_columns_with_names_of_its_own(spark):
    rows = [(1, "http://a.org/", page("<article><p>x</p></article>"), *["z"] * 8)]
    names = "host string, path string, paths string, votes string, beside string, main string, agreed string, text string"
    assert html.extract(spark.createDataFrame(rows, f"{SCHEMA}, {names}")).collect() == [(1, "http://a.org/", "x")]
