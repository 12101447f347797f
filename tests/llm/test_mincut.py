import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import mincut
from rollcall.llm.queries import op8_mincut_html


def cost(label, gain, edges):
    return sum(g for g, y in zip(gain, label, strict=True) if g > 0 and not y) - sum(g for g, y in zip(gain, label, strict=True) if g < 0 and y) + sum(c for (a, b), c in edges.items() if label[a] != label[b])


@pytest.mark.parametrize("seed", range(40))
def test_cut_is_cheapest(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    gain = [rng.randint(-9, 9) for _ in range(n)]
    edges = {(a, b): rng.randint(0, 7) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5}
    best = min(cost(y, gain, edges) for y in itertools.product([False, True], repeat=n))
    assert cost(mincut.cut(gain, edges), gain, edges) == best


def test_long_chain():
    gain = [5 if i % 50 else -5 for i in range(5000)]
    edges = {(i, i + 1): 6 for i in range(4999)}
    label = mincut.cut(gain, edges)
    assert all(label[1:])  # single blocks follow their neighbours; the first has one neighbour only
    assert cost(label, gain, edges) <= cost([True] * 5000, gain, edges)


def texts(page):
    return [b.text for b in mincut.blocks_of(page)]


def test_blocks():
    assert texts("") == [] and texts("plain &lt;b&gt; text") == ["plain <b> text"]
    assert texts("<p>a<b>b</b>\n c&nbsp;&nbsp;d<p>e<br>f") == ["ab c d", "e f"]
    assert texts("<script>var a='</p>x';</script>y<style>z</style><!-- q -->w<noscript>n</noscript>") == ["yw"]
    assert texts("<SCRIPT>x</Script >y<script>never ends") == ["y"]
    assert texts("<ul><li>a<li>b</ul>c<table><tr><td>d<td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("a < b and <p title='>'>c</p><p title=\"x>d") == ["a < b and", "c", "d"]
    assert texts("</div></p>x</html>") == ["x"]
    assert texts("<p>" * 3000 + "x") == ["x"]


def test_what_markup_says():
    page = """<header>s</header><nav>n</nav><div class="sidebar">b</div><article class="post"><header><h1>h</h1></header><p>p<aside>a</aside><form>f<input></form></article>
    <section id="comments"><article><p>c</article></section><div class="ad-slot">d</div><footer>e</footer><div class="has-sidebar">x</div><div style="display: none">y</div><article>g<p class="Notice">i</p><section id="relatedPosts">j</section></article><div id="AD-box">k</div>"""
    assert {b.text: b.seed for b in mincut.blocks_of(page)} == {"s": -1, "n": -1, "b": -1, "h": 1, "p": 1, "a": -1, "f": -1, "c": -1, "d": -1, "e": -1, "x": 0, "y": -1, "g": 1, "i": -1, "j": -1, "k": -1}


STORY = "<h1>The title</h1>" + "<p>This is a long paragraph of the story, with sentences and some words. It goes on and on, so that it is content.</p>" * 3
AROUND = "<nav><a href=1>Home</a></nav>%s<footer>Imprint</footer>"


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post comments-open">%s</article>', '<article class="hentry category-cookies">%s</article>', '<div class="post no-comments"><article>%s</article></div>', '<div class="ad-free"><article>%s</article></div>',
        '<form id="aspnetForm"><article>%s</article></form>', '<form>%s</form>', '<div class="promo"><article>%s</article></div>', '<div id="modal"><main>%s</main></div>', '<div class="sponsor">%s</div>',
        '<article class="post ad-free">%s</article>', '<div class="post hentry comments-open">%s</div>', '<div class="share-price-news">%s</div>', '<article><section class="reply-letter">%s</section></article>',
    ],
)
def test_names_do_not_hide_the_main_text(page):
    got = mincut.main_text(AROUND % (page % STORY), mincut.START)
    assert got.count("It goes on") == 3 and "The title" in got and "Imprint" not in got and "Home" not in got
    # Comments, adverts and forms beside it are still told apart.
    for part in ('<div id="comments">%s</div>', '<div class="post-comments">%s</div>', '<div class="ad-slot">%s</div>', "<form>%s</form>"):
        beside = AROUND % ("<article>" + STORY + "</article>" + part % "<p>Beside</p>")
        assert {b.text: b.seed for b in mincut.blocks_of(beside)}["Beside"] == -1


def test_head_and_body_left_out():
    page = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8><style>p{}</style><nav><a href=1>Home</a></nav><article>" + STORY + "</article><footer>Imprint</footer>"
    got = mincut.main_text(page, mincut.START)
    assert got.count("It goes on") == 3 and "Imprint" not in got and got.startswith("The title")
    assert mincut.main_text("<head><title>T</title>" + STORY.replace("<h1>The title</h1>", "Words first, and quite a lot of them, so that they are content, too."), mincut.START).startswith("Words first")


def stripped(page):
    """The page without the tags, classes and ids that tell its parts."""
    page = re.sub(r"<(/?)(?:nav|article|footer|aside|header|main|section|ul|li)\b[^>]*>", r"<\1div>", page)
    return re.sub(r' (?:class|id|role)=("[^"]*"|\S+)', "", page)


def test_classifier_and_flow_without_helpful_markup(spark):
    """Learned on whole pages, applied to stripped ones: every block's label comes from the flow, and some of them against the block's own score."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = mincut.learn(df)
    scores, flipped, seen, flowed = [], 0, 0, []
    for r in df.collect():
        page = stripped(r.html)
        blocks, elements = mincut.read_page(page)
        assert not any(b.seed for b in blocks)
        n, edges = mincut.edges_of(blocks, elements, 0.6, 0.8, 0.3, 1000)
        gain = mincut.gains(blocks, weights)
        label = mincut.cut([round(1000 * g) for g in gain] + [0] * (n - len(blocks)), edges)[: len(blocks)]
        flowed.append(n <= 500)
        flipped += sum((g > 0) != y for g, y in zip(gain, label, strict=True))
        seen += len(blocks)
        got, want = set(mincut.main_text(page, weights).split("\n")), set(expected(r.html).split("\n"))
        scores.append(2 * len(got & want) / (len(got) + len(want)))
    print("F1", np.mean(scores), "labels against the own score", flipped, "of", seen, "pages wholly in the flow", np.mean(flowed))
    assert np.mean(scores) >= 0.97 and flipped > 0 and np.mean(flowed) > 0.99


def test_names_are_one_capacity_among_others():
    """What names and an article say is smaller than the classifier's largest score; an explicit sign is larger."""
    page = '<div class="menu">' + STORY + "</div>" + "<article><a href=1>x</a></article><footer>" + STORY.replace("This", "That") + "</footer>"
    gain = dict(zip((b.text[:9] for b in mincut.blocks_of(page)), mincut.gains(mincut.blocks_of(page), mincut.START), strict=True))
    assert gain["This is a"] > 0 > gain["x"] and gain["That is a"] < -3


def test_quotes_within_bare_values_and_stray_signs():
    """Tags end at their first '>' outside a quoted value; quotes elsewhere in a tag mean nothing."""
    assert texts("<p title=it's>First paragraph.</p><p>Second one.</p><p title=that's>Third one.</p>") == ["First paragraph.", "Second one.", "Third one."]
    assert texts("<img alt=Bob's><p>It's Bob's.</p><p>And so on.") == ["It's Bob's.", "And so on."]
    assert texts("<p a=\"x>y\" b='>' c = d>1</p><p \"odd'>2</p><p a=>3<p =b>4<p/>5") == ["1", "2", "3", "4", "5"]
    assert texts("<p>a<!-->b<!--->c<!-- > -- >d-->e<!x>f<?y>g</ z>h<!-- never") == ["abcefgh"]
    assert texts("1 < 2 <3 <é> </ \x00>4") == ["1 < 2 <3 <é> 4"] and texts("a <b") == ["a <b"] and texts("a <b c='d>e") == ["a e"]
    assert texts("<p title='x>one</p><p title=\"y>two</p>") == ["one", "two"]
    assert texts('<a href="x"title="y">1</a><P CLASS=Ad>2') == ["1", "2"] and [b.seed for b in mincut.blocks_of('<p>some more text</p><P CLASS="Ad">2')] == [0, -1]


@pytest.mark.parametrize("bad", ["a <b and ", "<a ", "<a '", "<a b='", "</a \"", "<!-- ", "<!-", "<script>", "<p a=\"x>'", "&lt;<", "<a/b/"])
def test_odd_pages_take_linear_time(bad):
    began = time.time()
    mincut.main_text(bad * (1_000_000 // len(bad)) + ("" if bad != "<a b='" else ">"), mincut.START)
    assert time.time() - began < 5


SENTENCE = "This is a whole sentence, as long as those of the story itself, with commas, and it ends in a full stop."
BESIDE = [
    "<footer><p>%s</p></footer>", '<section id="comments"><p>%s</p><p>%s</p></section>', '<aside class="sidebar"><p>%s</p></aside>', '<div class="cookie-banner"><p>%s</p></div>', "<form><p>%s</p></form>", "<div hidden><p>%s</p></div>",
    '<nav><p>%s</p></nav>', '<div role="contentinfo"><p>%s</p></div>', '<div style="display:none"><p>%s</p></div>', '<div class="newsletter"><p>%s</p></div>', '<div class="ad"><p>%s</p></div>',
]


def test_sentences_of_other_parts_go(spark):
    """Beside and within the article, before and after it, with weights learned as the query learns them, and with none."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for weights in (mincut.learn(df, keys=F.col("page_id")), mincut.START):
        for part in BESIDE:
            other = part.replace("%s", SENTENCE)
            for page in (f"<article>{STORY}</article>{other}", f"{other}<article>{STORY}</article>", f"<article>{STORY.replace('</h1>', '</h1>' + other)}</article>", f'<div class="content">{STORY}</div>{other}'):
                got = mincut.main_text(f"<html><body>{page}</body></html>", weights)
                assert "whole sentence" not in got and got.count("It goes on") == 3, (part, page)


def test_deep_nesting_is_linear():
    began = time.time()
    assert mincut.main_text("<span>" * 20_000 + "<p>x" * 20_000, mincut.START) is not None
    assert len(mincut.blocks_of("<div><p>word" * 20_000)) == 20_000 and len(mincut.blocks_of("</i>x<b>" * 20_000)) == 1
    assert time.time() - began < 8


@pytest.mark.parametrize("seed", range(10))
def test_settling_first_changes_nothing(seed):
    rng = random.Random(seed)
    n = 60
    gain = [rng.randint(-9, 9) for _ in range(n)]
    edges = {(i, j): rng.randint(0, 5) for i in range(n) for j in (i + 1, i + 7) if j < n}
    assert mincut.cut(gain, edges) == mincut.cut(gain, edges, settle_above=0)


def test_comments_as_the_only_articles():
    page = AROUND % (f'<div class="story">{STORY}</div><section id="comments"><article><p>Beside</article></section>')
    assert {b.text: b.seed for b in mincut.blocks_of(page)}["Beside"] == -1 and "Beside" not in mincut.main_text(page, mincut.START)


def test_cut_can_overrule_markup():
    """A paragraph like those around it, of the same article, but with a name of boilerplate."""
    page = "<article>" + "<p>Sentences of the story, which are quite long and have all the punctuation that one may want, too, in such a text.</p>" * 2
    page += '<p class="promotion">A sentence of the story, which is just as long, and has all the punctuation that one may want, too, in such a text; it goes on.</p>'
    page += "<p>Sentences of the story, which are quite long and have all the punctuation that one may want, too, in such a text.</p>" * 2 + "</article>"
    assert [b.seed for b in mincut.blocks_of(page)] == [1, 1, -1, 1, 1]
    assert "A sentence" in mincut.main_text(page, mincut.START)


def expected(page):
    """The text of a test page: what its one article holds."""
    a = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", a))
    return "\n".join(x for x in parts if x)


def test_rows(spark):
    page = "<html><nav><a href=x>menu</a></nav><article><h1>T &amp; t</h1><p>Some words here.</article><footer>f</footer></html>"
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", None), (None, "u", "<nav>x</nav>", "t"), (4, "u", "<article>" + "<p>long text, " * 20000 + "</article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = mincut.extract(df, mincut.learn(df), carry=["page_id", "url"]).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == "T & t\nSome words here." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == by[None].text == "" and by[2].n_chars == 0
    assert by[4].text.count("\n") == 19999
    assert mincut.extract(df.limit(0), mincut.learn(df.limit(0)), carry=["page_id"]).count() == 0
    named = mincut.extract(df.withColumn("n_chars", F.lit("x")), mincut.START, carry=["text", "url", "n_chars", "page_id"])
    assert named.columns == ["url", "page_id", "text", "n_chars"] and {r.text for r in named.filter("page_id = 1").collect()} == {by[1].text}


def test_page_without_helpful_markup():
    page = """<div id="x"><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Sport</a></div><div class=x><h1>The title of the story</h1><p>This is a long paragraph, with sentences and some words. It goes on
    and on, so that it is long enough to be content.<p>Short one.<p>Another paragraph of the story which is quite long, too, and has punctuation &amp; entities.</div><div>Copyright 2020 | <a href=5>Terms</a></div>"""
    got = mincut.main_text(page, mincut.START)
    assert "Short one.\nAnother paragraph" in got and "Home" not in got and "Terms" not in got


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op8_mincut_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_training():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, mincut.FEATURES))
    y = x[:, 3] > 0.2
    w = mincut.train(x, y)
    assert ((x @ w > 0) == y).mean() > 0.8
    assert (mincut.train(x, np.ones(500, bool)) == mincut.START).all()
