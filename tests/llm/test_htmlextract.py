import html
import random
import re

import pytest

from phaseframe.llm import htmlextract as H
from phaseframe.llm import queries


@pytest.fixture(scope="module")
def model():
    return H.trained()


def article(source):
    """The text of the generator's articles: headline and paragraphs, tags stripped."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", source, re.S)[1]
    blocks = re.split(r"</?p>|</?h1>", re.sub(r"</?b>", "", body))
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark, tiny):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    out = queries.op6_html(spark, tiny).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r["text"] == article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_layouts_that_were_not_trained_on(model):
    rng, score = random.Random(4242), []
    for _ in range(200):
        source = H._layout(rng)
        want = {t.replace(H.MARK, "") for t in H.Page(source).text if H.MARK in t}
        got = {t for t in H.extract_texts([source.replace(H.MARK, "")], model)[0].split("\n\n") if t}
        score.append(2 * len(got & want) / (len(got) + len(want)) if got or want else 1.0)
    assert sum(score) / len(score) > 0.95


PAGE = """<html><body><div class="cookie-notice"><p>We use cookies, accept them please.</p></div><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><div class="sidebar"><h3>Related</h3><ul><li><a href=/b>One</a></li></ul></div>
<article><h1>Head &amp; line</h1><p>First   paragraph<br>with <b>bold</b> and a <a href=/c>link</a>.<p>Second &lt;paragraph&gt; &#233;&nbsp;here, which is a little longer than the first one.
<div class="advert"><p>Buy this now</p></div><p>Third paragraph of the article, which also has some words.</p></article>
<section id="comments"><h2>Comments</h2><p>Great article, thanks for sharing it with us.</p></section><form><label>Mail</label><input><p>Sign up here</p></form>
<script>var x = "<p>not text</p>";</script><style>p { color: red }</style><footer><p>Copyright 2020</p></footer></body></html>"""


def test_a_page_with_everything(model):
    assert H.extract_texts([PAGE], model)[0].split("\n\n") == [
        "Head & line", "First paragraph with bold and a link.", "Second <paragraph> é here, which is a little longer than the first one.",
        "Third paragraph of the article, which also has some words.",
    ]


def test_no_contradictions(model):
    page = H.Page(PAGE)
    keep = H.decode(page, model.margin(H.features(page)).tolist())
    assert all(keep[p] for p, k in zip(page.parent[1:], keep[1:]) if k)


def test_hard_sources_do_not_break(model):
    hard = ["", " ", "plain text", "<", "<p", "<p class='x", "</p></div>", "<!-- open", "<script>never closed", "<div>" * 3000 + "deep", "&am", "&#x110000;", "<a " + "x=\"" * 2000]
    out = H.extract_texts(hard, model)
    assert len(out) == len(hard) and out[0] == "" and out[2] in ("plain text", "")


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "u", None, 5), (1, "u", None, 5), (None, None, PAGE, 6)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"] or 0, len(r["text"]) > 0) for r in out) == [(0, True), (1, False), (1, False)]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("tag", ["select", "svg", "math", "object", "canvas"])
def test_unclosed_element_does_not_end_the_page(tag):
    page = H.Page(f"<body><p>before</p><{tag} class='x'><p>the whole article</p></body>")
    assert "the whole article" in vars(page)["text"]


@pytest.mark.parametrize("tag", ["script", "style", "title", "textarea", "iframe", "noscript"])
def test_unclosed_raw_text_reaches_the_end(tag):
    page = H.Page(f"<body><p>before</p><{tag}><p>no article</p></body>")
    assert "before" in vars(page)["text"] and "no article" not in vars(page)["text"]


INSERTS = {
    '<div style="display:none"><p>Hidden words of the page that nobody sees at all.</p></div>': [],
    '<p hidden>Hidden words of the page that nobody sees at all.</p>': [],
    '<p hidden>Hidden words without an end<p>Seen again, with some words after it.</p>': ["Seen again, with some words after it."],
    '<div style="visibility: hidden"><ul><li>One of them<li>Two of them</ul></div>': [],
    '<section hidden=""><div><p>Deep down</p></div><p>Still hidden, all of this text here.</p></section><p>Seen again, with some words after it.</p>': ["Seen again, with some words after it."],
    '<p>Before the button <button class="x"><b>Press</b> me</button> and after it, in one block.</p>': ["Before the button and after it, in one block."],
    '<p>A film <video src="a.mp4"><p>Your browser has no video.</p></video> that is shown here.</p>': ["A film that is shown here."],
    '<p>A sound <audio>No sound in your browser.</audio> that is heard in this place.</p>': ["A sound that is heard in this place."],
    '<p>Words with <x-y data-k="1">something of its own</x-y> stay in one block of text.</p>': ["Words with something of its own stay in one block of text."],
    '<p class="overflow-hidden">A class that only sounds like hiding, on a plain paragraph.</p>': ["A class that only sounds like hiding, on a plain paragraph."],
    '<p data-hidden="1" title="hidden">Attributes that only sound like hiding, on a plain paragraph.</p>': ["Attributes that only sound like hiding, on a plain paragraph."],
    '<p>Some <span style="display:none">never seen</span>words and <span hidden>not these</span>more of them here.</p>': ["Some words and more of them here."],
    '<blockquote>Quoted words of somebody, which belong to the article.</blockquote>': ["Quoted words of somebody, which belong to the article."],
    '<ul><li>A first point of the list in the article.</li><li>A second point of the list, too.</li></ul>': ["A first point of the list in the article.", "A second point of the list, too."],
    '<form class="signup"><label>Mail</label><input name=a><button>Send</button></form>': [],
    '<aside class="related"><h3>Related</h3><ul><li><a href=/x>Another one</a></li><li><a href=/y>And another</a></li></ul></aside>': [],
    '<p>Entities &amp; spaces&nbsp;here:   &#x41;&eacute;&lt;b&gt; are read as they should be.</p>': ["Entities & spaces here: Aé<b> are read as they should be."],
    '<!-- <p>Not even this one is shown to anybody.</p> --><p>After a comment of the page the text goes on.</p>': ["After a comment of the page the text goes on."],
    '<p>An unclosed paragraph with several words in it<p>And one more after it, also without an end': ["An unclosed paragraph with several words in it", "And one more after it, also without an end"],
    '<script>document.write("<p>made up</p>")</script><noscript>No script here</noscript><style>p{}</style><p>What is left is a paragraph of text.</p>': ["What is left is a paragraph of text."],
}


@pytest.mark.parametrize("insert", INSERTS)
def test_pages_by_hand(model, insert):
    around = ["A headline", "The first paragraph of the article has a number of words, and a second clause.", "The last paragraph of the article has some words as well, and ends here."]
    source = f"<html><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>{around[0]}</h1><p>{around[1]}</p>{insert}<p>{around[2]}</p></article><footer>Copyright</footer></body></html>"
    assert H.extract_texts([source], model)[0].split("\n\n") == [*around[:2], *INSERTS[insert], around[2]]


def test_a_page_that_hides_its_body_at_first(model):
    source = '<html><body style="visibility:hidden"><article><h1>A headline</h1><p>The paragraph of the article has a number of words.</p></article></body></html>'
    assert "The paragraph of the article has a number of words." in H.extract_texts([source], model)[0]
