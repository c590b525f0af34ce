"""Main text: minimum cuts against enumeration, and pages with known articles."""

import itertools
import random

import numpy as np
import pytest

from grainspan.llm import html
from grainspan.llm.mincut import cut_value, min_cut


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_least(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    source = [rng.choice([0, rng.random() * 3]) for _ in range(n)]
    sink = [rng.choice([0, rng.random() * 3]) for _ in range(n)]
    edges = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5]
    best = min(cut_value(source, sink, edges, side) for side in itertools.product([False, True], repeat=n))
    assert cut_value(source, sink, edges, min_cut(source, sink, edges)) == pytest.approx(best)


ARTICLE = "<p>First paragraph, it has some words &amp; a <a href=x>link</a>.</p><p>Second one,\n  it&#39;s longer; yes&nbsp;indeed it is.</p>"
TEXT = "First paragraph, it has some words & a link. Second one, it's longer; yes indeed it is."


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=1>Home</a></nav><article>{ARTICLE}</article><footer>&copy; us</footer>",
        f"<head><title>no</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><div id=content>{ARTICLE}</div><aside>More <a>a</a></aside></body>",
        f"<script>var a='<p>no</p>';</script><main>{ARTICLE}</main><section class='comments'><p>Great article, thank you very much, I liked it.</p></section>",
        f"<div class='cookie-notice'><p>We use cookies, accept them all, please.</p></div><div role=main class=post>{ARTICLE}</div><form><p>Sign up now.</p></form>",
        f"<ul class=menu><li><a href=1>A</a></li><li><a href=2>B</a></li></ul><article><!-- <p>no</p> -->{ARTICLE}<div class=ad>Buy this, now.</div></article>",
        f"<NAV><A HREF=1>Home</A></NAV><ARTICLE>{ARTICLE}",
        f"<div><a href=1>A</a> <a href=2>B</a></div><div>{ARTICLE}</div><div><a href=1>About</a> <a href=2>Contact</a></div>",
    ],
)
def test_known_articles(page):
    assert html.main_text(page, html.PLAIN) == TEXT


@pytest.mark.parametrize("page", [None, "", "   ", "<script>x</scr", "<a <b", "<!-- open", "<nav><p>Menu, of things.</p></nav>"])
def test_no_content(page):
    assert html.main_text(page, html.PLAIN) == ""


def test_broken_markup():
    assert html.main_text("<article><p><b>One two.<br><p>Three &am", html.PLAIN) == "One two. Three &am"
    assert html.main_text("<article><p>a</div></b></p><p>1 < 2 and so on.</article>", html.PLAIN) == "a 1 < 2 and so on."
    assert html.main_text("<article><p>foo<b>bar</b> <i>x</i></p></article>", html.PLAIN) == "foobar x"


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "annotation", "canvas", "audio", "video", "template"])
def test_elements_without_an_end_tag(tag):
    for page in (f"<article><div><{tag}>No <b>such</b> text</div>{ARTICLE}</article>", f"<body><{tag}>No text<article>{ARTICLE}</article>", f"<article><p><{tag}>No</p>{ARTICLE}<div><{tag}>no</{tag}></div></article>"):
        assert html.main_text(page, html.PLAIN) == TEXT, page
    # with an end tag, nothing within shows and nothing around is parted
    assert html.main_text(f"<article><p>One <{tag}><div>no <p>no</div> <{tag}/> </b>no</{tag}>two.</p></article>", html.PLAIN) == "One two."


def test_head_without_an_end_tag():
    for head in ("<head><title>no</title>", "<html><head><meta charset=a><script>no</script>", "<head><style>no</style></head><body>", "<head><title>no</title><body class=a>"):
        assert html.main_text(f"{head}<div>{ARTICLE}</div>", html.PLAIN) == TEXT
    assert html.main_text("<article><p>One.</p><script>no<p>no</p></article>", html.PLAIN) == "One."


def test_many_unclosed_elements_are_linear():
    page = "<article>" + "<p>Words, and more. <svg><button>" * 20000 + "</article>"
    assert html.main_text(page[:4000], html.PLAIN).startswith("Words, and more. Words,")
    assert len(html.read(page)[0]) == 20000
    assert len(html.read("<svg>" * 3000 + "x" * 10**6)[0]) == 0


def test_long_page():
    page = "<nav><a>m</a></nav><article>" + "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(3000)) + "</article>"
    assert html.main_text(page, html.PLAIN) == " ".join(f"Paragraph {i}, with words." for i in range(3000))


def test_learnt_weights_separate():
    pages = [f"<nav><a href=1>Home {i}</a><a href=2>News</a></nav><article>{ARTICLE}</article><footer>&copy; site {i}</footer>" for i in range(20)]
    w = html.learn(pages)
    assert not np.array_equal(w, html.PLAIN)
    assert html.main_text(f"<div><a href=1>Home</a></div><div>{ARTICLE}</div>", w) == TEXT
    assert np.array_equal(html.learn(["<p>a</p>", None]), html.PLAIN)


def test_table(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "other"), (1, "u", f"<article>{ARTICLE}</article>", "other"), (None, None, None, None), (3, "v", "", "x")]
    out = html.extracted(spark.createDataFrame(rows, schema))
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in out.collect()), key=repr) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=repr)
    assert html.extracted(spark.createDataFrame([], schema)).count() == 0


PROSE = " ".join(f"<p>Paragraph {i} has a number of words, commas, and a full stop at its end.</p>" for i in range(6))
PLAIN_PROSE = " ".join(f"Paragraph {i} has a number of words, commas, and a full stop at its end." for i in range(6))


@pytest.mark.parametrize(
    "name",
    ["main has-sidebar", "post comments-open", "entry form-style", "container legal-news", "content share-enabled", "no-sidebar", "is-modal-page", "sidebar", "form", "search", "widget post", "pageWithSidebar", "layout-ad-free"],
)
def test_names_of_wrappers_keep_the_article(name):
    for tag in ("div", "section", "form"):
        assert html.main_text(f"<nav><a href=1>Home</a></nav><{tag} class='{name}'>{PROSE}</{tag}><footer>&copy; us</footer>", html.PLAIN) == PLAIN_PROSE


@pytest.mark.parametrize("name", ["sidebar", "page-footer", "ad-slot", "cookie-notice", "comment-list", "siteFooter", "ad", "newsletter signup", "comment-content"])
def test_names_of_parts_drop_them(name):
    part = f"<div class='{name}'><p>Some words that are not the article, and more.</p></div>"
    for page in (f"<div>{PROSE}</div>{part}", f"{part}<div>{PROSE}</div>", f"<article>{PROSE}</article>{part * 12}"):
        assert html.main_text(page, html.PLAIN) == PLAIN_PROSE
    assert html.main_text(f"<article>{PROSE}{part}{PROSE}</article>", html.PLAIN) == f"{PLAIN_PROSE} {PLAIN_PROSE}"


def test_neighbours_outweigh_a_name():
    """The same named block is content between paragraphs of its container and boilerplate on its own."""
    long = "This is a long block of prose, of many words, with commas, and with all that the classifier takes for content; " * 8 + "so it goes."
    article = "".join(f"<div>{long}</div>" for _ in range(3))
    weights = html.PLAIN + np.array([1.0] + [0.0] * 8)
    blocks, homes = html.read(f"<div>{article}<div class=ad>{long}</div>{article}</div>")
    assert blocks[3].says == -html.NAMED and html.content(blocks, homes, weights) == [True] * 7
    blocks, homes = html.read(f"<div>{article}</div><div class=ad>{long}</div><ul><li><a href=1>x</a></li></ul>")
    assert html.content(blocks, homes, weights) == [True] * 3 + [False] * 2
    for name in ("related", "notice"):  # a name that may be something else
        assert "Short one." in html.main_text(f"<article>{PROSE}<p class={name}>Short one.</p>{PROSE}</article>", html.PLAIN)


def test_math_and_noscript_are_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> be given.</p><noscript><p>Here, as well, is text of the article.</p></noscript></article>"
    assert html.main_text(page, html.PLAIN) == "Let x=2 be given. Here, as well, is text of the article."


@pytest.mark.parametrize("seed", range(40))
def test_whole_pages_against_all_labellings(seed):
    """A page's labelling costs as little as the best of all its labellings."""
    rng = random.Random(seed)
    part = lambda: rng.choice(["<p>{}</p>", "<li>{}</li>", "<div class=ad>{}</div>", "<a href=1>{}</a><hr>", "<section class=related>{}</section>"]).format(" ".join("word" for _ in range(rng.choice([1, 5, 40]))) + rng.choice([".", ""]))
    page = "".join(rng.choice(["<nav>{}</nav>", "<article>{}</article>", "<div>{}</div>", "<div class=post>{}</div>"]).format("".join(part() for _ in range(rng.randint(1, 3)))) for _ in range(4))
    blocks, homes = html.read(page)
    source, sink, edges = html.graph(blocks, homes, html.PLAIN)
    best = min(cut_value(source, sink, edges, side) for side in itertools.product([False, True], repeat=len(blocks)))
    assert cut_value(source, sink, edges, html.content(blocks, homes, html.PLAIN)) == pytest.approx(best)


def test_a_hundred_thousand_blocks_take_seconds():
    import time

    rng = random.Random(1)
    page = "".join(rng.choice([f"<p>{'word, ' * rng.randint(1, 30)}end.</p>", f"<div><a href=1>link {i}</a></div>", f"<ul><li>item {i}</li></ul>"]) for i in range(100_000))
    begun = time.thread_time()
    assert len(html.main_text(page, html.PLAIN)) > 10**6
    deep = "<div><b><i>" * 20_000 + PROSE + "</x></b>" * 20_000
    html.main_text(deep, html.PLAIN)
    assert time.thread_time() - begun < 60
