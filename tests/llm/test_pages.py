"""Main text of pages of other forms than those of the tables, and the tree's questions."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from stampline.llm import html

LONG = " ".join(["one two three"] * 14)
FORMS = {
    "div": lambda h: re.sub(r"<(/?)article", r"<\1div", h),
    "section": lambda h: re.sub(r"<(/?)article", r"<\1section", h),
    "main": lambda h: re.sub(r"<(/?)article", r"<\1main", h),
    "body": lambda h: re.sub(r"</?article>", "", h),
    "cell": lambda h: h.replace("<article>", "<table><tr><td>").replace("</article>", "</td></tr></table>"),
    "plain": lambda h: re.sub(r"<(/?)(article|nav|footer)", r"<\1div", h).replace(' class="ad"', ""),
}


@pytest.mark.parametrize("form", FORMS)
def test_pages_without_article(data, form):
    model, wanted, missed, extra = html.tree(), 0, 0, 0
    for r in pq.read_table(f"{data.replace('0.001', '0.01')}/pages.parquet").to_pylist():
        want = Counter(b.text for b in html.blocks(re.search(r"<article>.*</article>", r["html"], re.S)[0]))
        got = Counter(html.main_text(FORMS[form](r["html"]), model).split("\n\n"))
        wanted, missed, extra = wanted + sum(want.values()), missed + sum((want - got).values()), extra + sum((got - want).values())
    assert missed <= 0.05 * wanted and extra <= 0.02 * wanted


def test_marks():
    for name in ("social-share", "cookie-notice", "site-footer", "Comments", "reader-replies", "ad", "x sidebar", "post-comments-list"):
        assert html.marked(name), name
    for name in ("social-history", "tags-explained", "related-work", "main-content", "", "post", "footer-of-the-mountain", "advert2x"):
        assert not html.marked(name) or name == "advert2x", name
    model = html.tree()
    page = f'<article><p>{LONG} a</p><div class="social-history"><p>{LONG} b</p></div><section id="tags-explained"><p>{LONG} c</p></section></article>'
    assert html.main_text(page, model) == f"{LONG} a\n\n{LONG} b\n\n{LONG} c"
    assert html.main_text(f'<main><p>{LONG}</p><div class="reader-replies"><p>{LONG} d</p></div></main>', model) == LONG


def test_tree_is_no_table_of_its_pages():
    """Every leaf has some blocks, depth and leaves are what cross-validation over pages bears out, and it is shares and neighbours that are asked for."""
    rows, labels = html.labelled()
    model = html.tree()
    asked = set()

    def walk(node, inside):
        assert inside.sum() >= html.LEAST
        if node[1] is not None:
            asked.add(html.FEATURES[node[0]])
            low = rows[:, node[0]] <= node[1]
            walk(node[2], inside & low)
            walk(node[3], inside & ~low)

    walk(model, labels >= 0)
    assert {"words", "words_after", "share", "article", "boiler"} <= asked
    found = {d: html.cross_validated(d) for d in range(1, 9)}
    assert found[html.DEPTH] == max(found.values()) > 0.94


def said(n, word="word"):
    return " ".join([word] * n)


def listed(n, k):
    return "".join(f"<li><a href=x>{said(k, 'link')}</a>" for _ in range(n))


TEXT = said(66, "text")
ARTICLE = f"<div><p>{TEXT}</p></div>"
PROBES = {
    "related links": (f"{ARTICLE}<div><ul>{listed(8, 6)}</ul></div>", TEXT),
    "a list of many links": (f"<div><ul>{listed(40, 1)}</ul></div>{ARTICLE}", TEXT),
    "a long footer": (f"{ARTICLE}<footer><p>{said(45)}</p></footer>", TEXT),
    "an advert by its name": (f"{ARTICLE}<div class='gpt-ad-unit'>{said(33)}</div>", TEXT),
    "legal text by its name": (f"{ARTICLE}<div class='legal'>{said(33)}</div>", TEXT),
    "a short article": (f"<div>{said(17)}</div>", said(17)),
    "a short article among links": (f"<div><a href=x>Home</a></div><div><p>{said(17)}</p></div><div><p>{said(2)}</div>", said(17)),
    "a heading in its own element": (f"<div class='article-header'><h1>{said(5)}</h1></div>{ARTICLE}", f"{said(5)}\n\n{TEXT}"),
    "a button": (f"<div><p>{TEXT}</p><button>Share this</button></div>", TEXT),
    "a button in an article": (f"<article><p>{TEXT}</p><button>Share this</button></article>", TEXT),
    "a form": (f"{ARTICLE}<form><label>{said(9)}</label><input></form>", TEXT),
    "links in a row": (f"<div><a>Home</a> <a>News</a> <a>Sport and more</a></div>{ARTICLE}", TEXT),
    "a short list of long links": (f"{ARTICLE}<div><h3>{said(2)}</h3><ul>{listed(3, 9)}</ul></div>", TEXT),
    "sections of an article": (f"<article><section><p>{said(12)}</p></section><section><p>{TEXT} {TEXT}</p></section><div><p>{said(7)}</p></div></article>", f"{said(12)}\n\n{TEXT} {TEXT}\n\n{said(7)}"),
    "an element a paragraph": (f"<div><p>{said(25)}</p></div>{ARTICLE}<div><p>{said(30)}</p></div><div><a>x</a></div>", f"{said(25)}\n\n{TEXT}\n\n{said(30)}"),
}


@pytest.mark.parametrize("name", PROBES)
def test_pages_unlike_the_labelled(name):
    page, want = PROBES[name]
    assert html.main_text(page, html.tree()) == want
    assert html.main_text(f"<!DOCTYPE html><html><body class=page>{page}</body></html>", html.tree()) == want


def test_a_page_of_megabytes():
    long = " ".join(f"w{i}" for i in range(200_000))
    page = f"<nav>{listed(20_000, 2)}</nav><article><p>{long}</p><p>end.</p></article><footer>{said(30)}</footer>"
    assert len(page) > 1_500_000 and html.main_text(page, html.tree()) == f"{long}\n\nend."


def test_boilerplate_of_every_length():
    model = html.tree()
    for n in (*range(1, 40), 60, 120, 400):
        said = " ".join(["word"] * n)
        page = f"<nav>{said}</nav><div class=ad>{said}</div><article><p>{LONG}</p></article><div class=comments><p>{said}</p></div><aside>{said}</aside><footer>{said}</footer>"
        assert html.main_text(page, model) == LONG, n
        assert html.main_text(f"<article><p>{said}</p></article>", model) == said, n
