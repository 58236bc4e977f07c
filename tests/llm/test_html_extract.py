"""HTML extraction: blocks, the random field against exhaustive sums, and held-out pages."""

import html
import random
import re
from itertools import product

import numpy as np
import pytest

from threadloom.llm import html_extract as he
from threadloom.llm import layouts
from threadloom.llm.dom import blocks

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain &amp; simple\n\t text", ["plain & simple text"]),
        ("<p>one<p>two<br>three</p>four", ["one", "two three", "four"]),
        ("<p>a<b>b</b>c <i>d</i></p>", ["abc d"]),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", ["x", "y", "1", "2", "3"]),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>seen<!-- <p>no</p> --> too</p>", ["seen too"]),
        ("<head><title>t</title><meta charset=x><body><p>b", ["b"]),
        ("<head><title>t</title><p>b", ["b"]),
        ("<div>cut <p>off <span", ["cut", "off"]),
        ("<p>a < b &lt;c&gt; &#233; &eacute; &nbsp; &unknown; 1<2</p></div></section>", ["a < b <c> é é &unknown; 1<2"]),
        ('<p title="a > b" data-x=\'<p>\'>t</p>', ["t"]),
        ("<select><option>o</select><button>go</button><textarea><p>x</textarea><p>z", ["z"]),
        ("<script>never closed <p>text", []),
        ("<p>\x00\x1c é😀</p>", ["\x00 é😀"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_blocks_of_hostile_pages_take_linear_time():
    for page in ("<a " * 100_000, "<div>" * 20_000 + "x" + "</p>" * 20_000, '<p x="' * 50_000, "<" * 200_000, "<!--" * 50_000, "</b " * 100_000, "a<p class=c>" * 30_000):
        blocks(page)


def test_block_facts():
    b = blocks('<div id=siteFooter class="x-1 ad"><section role=note><p hidden>see <a href=#>this link</a></p></section></div>')[0]
    assert {"t:div", "c:site", "c:footer", "c:ad", "c:note", "t:section", "t:p", "hidden", "p:foote"} <= b.path and b.linked == len("this link") and b.tag == "p"


def toy(rng, n):
    chain = he.Chain({"f": rng.normal(), "g": rng.normal()}, rng.normal(size=(2, 2, 2)))
    feats = [[f for f in "fgh" if rng.random() < 0.5] for _ in range(n)]
    return chain, feats, [0, *rng.integers(0, 2, n - 1).tolist()]


def path_score(chain, feats, same, labels):
    return sum(chain.weights.get(f, 0) * y for names, y in zip(feats, labels, strict=True) for f in names) + sum(chain.bonds[same[t], labels[t - 1], labels[t]] for t in range(1, len(labels)))


def test_viterbi_and_likelihood_equal_exhaustive_search():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        chain, feats, same = toy(rng, n)
        every = {y: path_score(chain, feats, same, y) for y in product((0, 1), repeat=n)}
        assert tuple(chain.viterbi(feats, same)) == max(every, key=every.get)
        labels = rng.integers(0, 2, n)
        score = np.array([[sum(chain.weights.get(f, 0) for f in names) for names in feats] + [9.0, 9.0]])
        pad = lambda x: np.array([[*x, 1, 0]])
        given = (score, pad(same), pad(labels), np.array([n]))
        value, by_score, by_bond = chain.likelihood(*given)
        assert value == pytest.approx(every[tuple(labels)] - np.log(np.exp(list(every.values())).sum()))
        for t in range(n):
            moved = score.copy()
            moved[0, t] += 1e-6
            assert by_score[0, t] == pytest.approx((chain.likelihood(moved, *given[1:])[0] - value) / 1e-6, abs=1e-4)
        for place in np.ndindex(2, 2, 2):
            chain.bonds[place] += 1e-6
            assert by_bond[place] == pytest.approx((chain.likelihood(*given)[0] - value) / 1e-6, abs=1e-4)
            chain.bonds[place] -= 1e-6
    assert he.Chain().viterbi([], []) == []


@pytest.fixture(scope="module")
def chain(spark):
    return he.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet").where("page_id % 2 = 0"))


def test_held_out_pages(spark, chain):
    pages = spark.read.parquet(f"{SF}/pages.parquet").where("page_id % 2 = 1")
    said = {r["page_id"]: r["html"] for r in pages.collect()}
    got = he.extract(pages, chain).collect()
    assert len(got) == len(said)
    for r in got:
        inner = re.search("<article>(.*)</article>", said[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?p>|<br>|</h1>", " ", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_held_out_layouts(spark, chain):
    rng = random.Random(77)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(trim(text)) > 20").limit(400).collect()]
    right = wrong = 0
    for _ in range(200):
        lines, others = ([x for x in rng.choice(texts).split("\n") if x.strip()][:20] for _ in range(2))
        row = blocks(layouts.page(lines, others, rng))
        for b, y in zip(row, chain.viterbi(he.features(row), he.siblings(row)), strict=True):
            right, wrong = right + (y == (layouts.MARK in b.marks)), wrong + (y != (layouts.MARK in b.marks))
    assert right / (right + wrong) > 0.98


STORY = ["The council met on Tuesday to talk about the new bridge, and it took until midnight.", "Most members were in favour of the plan, though the cost of it worried some of them.", "A vote is planned for the spring."]
PAGE = """<!DOCTYPE html><html><head><title>Bridge</title><script>var x = "<p>no</p>";</script></head><body>
<div id="cookie-notice"><p>We use cookies. By staying on this site you accept them, and all that comes with it.</p><button>OK</button></div>
<header><div class="logo">The Daily</div><nav><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul></nav></header>
<aside class="sidebar"><h3>Most read</h3><p>A long line about another thing that many people have read, as it seems.</p></aside>
{body}
<div class="advertisement"><p>Buy two of these, get one of those for nothing, but only today.</p></div>
<form class="newsletter"><label>Subscribe to our newsletter</label><p>We send one mail a week, never more than that.</p></form>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I was there and it was a long evening, believe me, with much talk.</p></div><div class="comment"><p>The old bridge is good enough.</p></div></section>
<footer>&copy; 2024 The Daily. All rights reserved.</footer></body></html>"""


@pytest.mark.parametrize("body", ["<article><h1>A new bridge</h1>{}</article>", "<main><h1>A new bridge</h1>{}</main>", '<div class="post-content"><h1>A new bridge</h1>{}</div>', '<div id="main"><h1>A new bridge</h1><div class="share">Share Tweet</div>{}</div>'])
def test_pages_of_other_make(chain, body):
    page = PAGE.format(body=body.format("".join(f"<p>{s}</p>" for s in STORY)))
    assert he.main_text(page, chain) == " ".join(["A new bridge", *STORY])


def test_odd_rows(spark, chain):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>No furniture here, only this line of text."), (None, "u", "<article><p>" + "word " * 300_000 + "end.</p></article>"), (5, None, "<p><p><p>")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["page_id"] or 0, r["url"], len(r["text"]), r["n_chars"]) for r in he.extract(table, chain).collect())
    assert len(got) == 6 and got[0] == (0, "u", 1_500_004, 1_500_004) and got[1][2:] == (0, 0) == got[2][2:]
    assert he.extract(table.limit(0), chain).count() == 0


def test_nothing_to_learn_from(spark, make):
    pages = spark.createDataFrame([(1, "https://a.example/none", "<nav>a</nav><p>b</p>")], "page_id long, url string, html string")
    for docs, some in ((make(["a b"]), pages), (make([]), pages.limit(0))):
        empty = he.fit(docs, some)
        assert he.main_text("<nav>a</nav><p>b</p>", empty) == "a b"
