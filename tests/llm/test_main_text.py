import html
import itertools
import random
import re

import numpy as np
import pytest

from placetime.llm import chain_crf, main_text
from placetime.llm.page_blocks import blocks_of

PAGES = "/root/testdata/sf0.01/pages.parquet"


def texts(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize("page, want", [
    ("<p>a<p>b<b>c</b> d<br>e</p>f", ["a", "bc d e", "f"]),
    ("a &amp; b&nbsp;&lt;x&gt; &#233;&amp &am", ["a & b <x> é& &am"]),
    ("<p>one<script>if (a < b) document.write('</p>')</script>two<style>p{}</style></p>", ["onetwo"]),
    ("<p>x<!-- <p>no</p> -->y</p><!-- open <p>z</p>", ["xy"]),
    ("<p title='a > b' class=\"c\">t</p>", ["t"]),
    ("<p title=\"open>t</p>", ["t"]),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<select><option>a<option>b</select><button>c</button><textarea>d</textarea><p>e", ["e"]),
    ("1 < 2 and 3 > 2 <", ["1 < 2 and 3 > 2 <"]),
    ("<p>cut</p><p cla", ["cut"]), ("<p>cut</p", ["cut"]), ("", []), (None, []), (" \n\t", []), ("<><p></p>", ["<>"]),
    ("<title>t</title><head><meta></head><body>b", ["b"]), ("<svg><text>no</text></svg>x<svg/>y", ["xy"]), ("<p>\U0001f600  日本\n語</p>", ["\U0001f600 日本 語"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_ancestors_names_and_links():
    (nav, text) = blocks_of("<div id=mainMenu class='site-nav x'><a href=a>go</a> to</div><article><div><p>t</article>")
    assert [(e.tag, e.names) for e in nav.path] == [("div", ("main", "menu", "nav", "site", "x"))] and nav.links == 2
    assert [e.tag for e in text.path] == ["article", "div", "p"]


def test_a_closing_tag_ends_what_is_open_inside():
    assert [[e.tag for e in b.path] for b in blocks_of("<article><div><p>a</article><p>b</div>c")] == [["article", "div", "p"], ["p"], ["p"]]


def test_a_very_long_page_is_read_in_linear_time():
    n = 100_000
    assert len(blocks_of("<div>" * 2000 + "<p>x" * n)) == n
    assert texts("<" * n) == ["<" * n] and texts("<!--" * n) == [] and len(texts("<a '" * n + "<p>z")) <= 1


def test_viterbi_finds_the_best_sequence():
    rnd = random.Random(1)
    for n in (1, 2, 5):
        field = chain_crf.Field({}, tuple(tuple(rnd.gauss(0, 2) for _ in range(3)) for _ in range(3)), tuple(rnd.gauss(0, 1) for _ in range(3)))
        scores = [[rnd.gauss(0, 2) for _ in range(3)] for _ in range(n)]

        def total(tags):
            return field.start[tags[0]] + sum(s[t] for s, t in zip(scores, tags)) + sum(field.moves[a][b] for a, b in itertools.pairwise(tags))
        assert tuple(field.tags(scores)) == max(itertools.product(range(3), repeat=n), key=total)


def test_fitting_reaches_the_likelihood_of_enumeration():
    """At the end of fitting, expected counts under the model (by enumeration) equal those of the data."""
    data = [([{"a"}, {"b"}, {"a"}], [0, 1, 0]), ([{"b"}, {"a"}], [1, 1]), ([{"a"}], [0]), ([{"b"}, {"b"}], [0, 1]), ([{"a"}, {"b"}], [1, 0])]
    field = chain_crf.fit(data, 2, 400)
    gap = np.zeros((2, 2))
    for features, gold in data:
        scores = [field.scores(f) for f in features]
        every = list(itertools.product(range(2), repeat=len(gold)))
        weight = np.exp([field.start[t[0]] + sum(s[y] for s, y in zip(scores, t)) + sum(field.moves[a][b] for a, b in itertools.pairwise(t)) for t in every])
        for tags, p in [*zip(every, weight / weight.sum()), (tuple(gold), -1.0)]:
            for f, y in zip(features, tags):
                gap["b" in f, y] += p
    assert np.abs(gap).max() < 0.05


def plain(page):
    """The article of a page in the layout of the test tables."""
    start = page.find("<article>")
    if start < 0:
        return ""
    end = page.find("</article>", start)
    inner = page[start + 9 : end] if end >= 0 else re.sub(r"<[^>]*$", "", page[start + 9 :])
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def field(spark):
    return main_text.trained(spark.read.parquet(PAGES))


def test_every_page_of_the_table(spark, field):
    pages = spark.read.parquet(PAGES)
    got = {r.page_id: (r.text, r.n_chars, r.url) for r in main_text.main_texts(pages, field).collect()}
    assert got == {r.page_id: (plain(r.html), len(plain(r.html)), r.url) for r in pages.collect()}


def test_held_out_layouts(spark, field):
    """Composed pages of texts that were not trained on: at least 99 % of the blocks."""
    pages = [r.html for r in spark.read.parquet(PAGES.replace("sf0.01", "sf0.1")).limit(150).collect()]
    rnd, right, n = random.Random(3), 0, 0
    for page in pages:
        made = blocks_of(main_text.Composer(rnd, [b.text[:2000] for b in blocks_of(page)]).page())
        gold = [int(main_text.MARK in b.text) for b in made]
        bare = [b._replace(text=b.text.replace(main_text.MARK, "") or "x") for b in made]
        got = field.tags([field.scores([*p, *t]) for p, t in main_text.features_of(bare)])
        right, n = right + sum(map(int.__eq__, got, gold)), n + len(gold)
    assert right >= 0.99 * n


A, B = "This is the first paragraph of a story, and it goes on for a while.", "A second one says more about it."


@pytest.mark.parametrize("page", [
    f"<body><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><main><article><p>{A}</p><p>{B}</p></article></main><footer><p>&copy; Site</p></footer>",
    f"<div class='cookie-notice'><p>We use cookies to make this site better. Do you agree?</p><button>Yes</button></div><div id=content><p>{A}</p><p>{B}</p></div><div class=sidebar><h3>More</h3><p>Another story that you may like.</p></div>",
    f"<article><p>{A}</p><div class='ad'>Buy this thing now, it is cheap.</div><p>{B}</p><section class='comments'><h3>Comments</h3><div class=comment><p>I do not agree with this story at all.</p></div></section></article><aside><p>Read this next.</p></aside>",
    f"<div class=post><p>{A}</p><p>{B}</p></div><form><label>Name</label><input><p>Sign up for our letter.</p></form><div id=comments><ol><li class=comment><p>What a nice read this was, thank you.</p></ol></div><div class=footer>All rights reserved.</div>",
])
def test_other_layouts(field, page):
    assert main_text.extract(page, field, {}) == f"{A}\n{B}"


def test_odd_rows(spark, field):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>x y z.</p></article>"), (2, "v", ""), (3, "w", "<nav>only</nav>"), (4, "x", "<article>" + "<p>long text here.</p>" * 20_000), (5, "y", "no markup \U0001f600 at all & more <")]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in main_text.main_texts(pages, field).collect()), key=str)
    by_id = {r[0]: r for r in got}
    assert len(got) == len(rows) and got.count((1, "u", "", 0)) == 2 and by_id[None][2] == "x y z." and by_id[2][2:] == ("", 0) and by_id[3][2] == ""
    assert by_id[4][2] == "\n".join(["long text here."] * 20_000) and all(r[3] == len(r[2]) for r in got)
    assert main_text.main_texts(pages.limit(0)).collect() == []
    assert main_text.main_texts(pages.where("html is null")).first().text == ""
