"""HTML extraction: flat text blocks with their own and their neighbours' word count and link density, and the kinds of the elements they are in,
classified by a decision tree that is trained here on a small labelled table."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role.
RAW = frozenset("script style noscript template textarea title svg math iframe object select option canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form header main menu nav ol search section table td ul".split())
BOILER = frozenset("nav footer aside form menu dialog button search".split())
SECTION = frozenset("article aside body details dialog div footer form header main nav search section td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 legend summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark what is around the article, and words that say nothing beside them. A name marks an element if all its parts are of
#: these and one of the first: "social-share-list" does, "social-history" doesn't.
MARKS = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies copyright disclaimer discussion disqus footer header imprint legal login masthead menu modal nav "
    "navbar navigation newsletter notice outbrain pagination popup privacy promo promoted promotion related replies reply responses share sharing sidebar social sponsor sponsored subscribe taboola tags toolbar trending widget".split()
)
BESIDE = frozenset(
    "area bar block body bottom box button buttons consent container content form fixed global gpt group icons inner item items left links list main media outer page panel post posts "
    "primary reader readers right row secondary section site sticky stories story thread top unit user users wrap wrapper".split()
)


def marked(names: str) -> bool:
    """Whether one of the names of a class, id or role marks an element."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not MARKS.isdisjoint(parts) and all(x in MARKS or x in BESIDE for x in parts):
            return True
    return False


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]+|<(?![A-Za-z/!?]))", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: bool
    article: bool
    heading: bool
    #: Number of the section that the block is in.
    section: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Open:
    tag: str
    boiler: bool
    article: bool
    section: int


@dataclass
class _State:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    #: Whether the article has begun; later ones inside boilerplate are comments or teasers.
    main: bool = False
    heading: bool = False
    sections: int = 0


def blocks(html: str | None) -> list[Block]:
    """The flat blocks of text of a page, in its order. Comments, scripts, styles and other raw elements have no text; an element that
    is not closed ends with the one around it."""
    html = html or ""
    out = _State()
    stack = [_Open("", False, False, 0)]
    link = 0
    pos, size = 0, len(html)

    def flush() -> None:
        if out.parts:
            text = " ".join("".join(out.parts).split())
            if text:
                linked = len("".join(out.linked).split()) if out.linked else 0
                out.blocks.append(Block(text, len(text.split()), linked, stack[-1].boiler, stack[-1].article, out.heading, stack[-1].section))
            out.parts.clear()
            out.linked.clear()

    while pos < size:
        m = _TOKEN.match(html, pos)
        if m is None:  # a tag whose quotes are never closed
            end = html.find(">", pos)
            pos = size if end < 0 else end + 1
            continue
        pos = m.end()
        text, tag = m[5], m[3]
        if text is not None or m[1] is not None:
            out.parts.append(unescape(text if text is not None else m[1]))
            if link:
                out.linked.append(out.parts[-1])
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                link = max(0, link - 1)
                if out.linked:
                    out.linked.append(" ")
            elif tag in BLOCK:
                flush()
                link, out.heading = 0, False
                if tag in CONTAINER:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == tag:
                            del stack[i:]
                            break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            if tag not in VOID and not m[4].rstrip().endswith("/"):
                pos = close.end() if close else size
            continue
        if tag == "br":
            out.parts.append(" ")
            if link:
                out.linked.append(" ")
        elif tag == "a":
            link += 1
        elif tag in BLOCK:
            flush()
            link, out.heading = 0, tag in HEADING
            if tag in CONTAINER and not m[4].rstrip().endswith("/"):
                # the body's classes ("has-sidebar") tell of what is in it
                named = m[4] if tag != "body" else ""
                marks = bool(named) and any(marked(v.strip("\"'")) for _, v in _ATTR.findall(named))
                top = stack[-1]
                main = tag in ("article", "main") and not marks and not (top.boiler and out.main)
                out.main |= main
                boiler = not main and (top.boiler or tag in BOILER or marks or (tag == "header" and not top.article))
                out.sections += tag in SECTION
                stack.append(_Open(tag, boiler, main or (top.article and not boiler), out.sections if tag in SECTION else top.section))
    flush()
    return out.blocks


#: Of a block: words, link density, both of the blocks before and after it, link density of its section, the section's share (its words outside links by the
#: most that a section outside boilerplate has), both neighbours' shares, and the kinds of its elements: a heading, inside an article, inside
#: boilerplate. No number of a section's words is asked for by itself, so a page's size says nothing.
FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "section_density", "share", "share_before", "share_after", "heading", "article", "boiler",
)
#: Depth of the tree and least blocks of a leaf; cross_validated() bears them out.
DEPTH, LEAST = 5, 5
#: Each labelled page is learned from at these sizes, so that no threshold on words is that of one page.
SIZES = (1.0, 2.0)

# Pages whose blocks are labelled by hand. {n+} stands for a block's n words, [n+] for n words in a link; + is main text, - is not.
LABELLED = (
    "<nav><ul><li>[1-]<li>[1-]<li>[2-]</ul></nav><div class=ad>{6-}</div><article><h1>{7+}</h1><p>{40+}<p>{3+}<p>{25+}</article><footer>{14-}</footer>",
    "<header>{3-}[1-]</header><main><h1>{4+}</h1><p>{1+}<p>{80+}<ul><li>[3+]<li>{5+}<li>[2+]</ul><p>{9+}</main><aside><h2>{2-}</h2><p>{30-}</aside>",
    "<nav>[1-]<p>[1-]<p>[1-]</nav><article><p>{2+}<p>{6+}<p>{1+}</article><form>{8-}</form><div class=comments><p>{60-}<p>{45-}<p>{3-}</div>",
    "<div><a>[1-]</a></div><div>[2-]</div><div>[1-]</div><div><h1>{6+}</h1><p>{50+}<p>{4+}<p>{35+}<p>{8+}</div><div>[3-]</div><div>[2-]</div>",
    "<div><ul><li>[1-]<li>[2-]<li>[1-]<li>[1-]</ul></div><div><h1>{5+}</h1><p>{2+}<p>{28+}<p>{9+}<p>{44+}<p>{1+}</div><div><p>{3-}</div>",
    "<div>{2-}[1-]</div><section><h2>{3+}</h2><p>{33+}<p>{7+}</section><section><h2>{2+}</h2><p>{60+}<ul><li>{4+}<li>{6+}<li>{3+}</ul></section><div>[1-]<p>[2-]<p>[1-]</div>",
    "<table><tr><td>[1-]<p>[1-]<p>[2-]</td><td><h1>{8+}</h1><p>{70+}<p>{5+}<p>{90+}</td><td>[4-]<p>[5-]<p>[3-]</td></tr></table><div>{4-}</div>",
    "<div><p>{1-}</div><div><p>{3-}</div><div><h1>{9+}</h1></div><div><p>{24+}<p>{31+}<p>{2+}</div><div><p>{2-}</div><footer><p>{40-}<p>{25-}</footer>",
    "<div><h3>{2-}</h3><ul><li>[6-]<li>[7-]<li>[5-]<li>[8-]</ul></div><div><h1>{5+}</h1><p>{120+}</div><div><h3>{2-}</h3><ul><li>[9-]<li>[6-]<li>[7-]</ul></div>",
    "<p>{30+}<p>{20+}<p>{2+}<p>{55+}",
    "<div><p>{5-}</div><div><p>[1-]</div><div><p>{22+}</div><div><p>{40+}</div><div><p>{18+}</div><div><p>{75+}</div><div><p>[2-]</div><div><p>{3-}</div>",
    "<div class=menu>[1-]<p>[1-]</div><div><h1>{4+}</h1><p>{65+}<h2>{3+}</h2><p>{1+}<p>{48+}</div><div class=comments><p>{70-}<p>{55-}</div><div id=footer>{60-}</div>",
    "<article><h1>{3+}</h1><p>{12+}<p>[1+]<p>[4+]<div class=share>{2-}[1-]</div><p>{110+}<div class=related><h2>{2-}</h2><p>{35-}<p>[6-]</div></article>",
    "<div><h2>{2-}</h2><p>[1-]<p>[1-]<p>[1-]<p>{4-}</div><div><h1>{6+}</h1><p>{9+}<p>{14+}<p>{11+}<p>{8+}<p>{13+}</div><div><p>{6-}<p>[2-]</div>",
    "<div><p>{4-}<p>{2-}</div><div><p>{3-}</div>",
    "<div class=cookie-notice>{45-}<p>{12-}</div><div><p>{30+}<p>{200+}<p>{6+}</div><div class=sidebar><p>{80-}<p>{33-}<p>{2-}</div>",
    "<header><h1>{3-}</h1><p>{9-}</header><article><header><h1>{8+}</h1><p>{6+}</header><p>{2+}<p>{30+}</article><section id=comments><h2>{1-}</h2><article><p>{90-}</article></section>",
    "<div class=ad>{12-}</div><article><p>{50+}<p>{4+}</article><footer>{22-}</footer><div class=cookie-notice>{28-}</div>",
    "<aside>{19-}</aside><div><p>{45+}<p>{12+}</div><div class=newsletter>{17-}<p>{10-}</div><footer>{9-}</footer>",
    "<nav>{20-}</nav><div><p>{18+}</div><div class=promo>{24-}</div><div><p>{29+}</div><div class=related>{26-}</div>",
    "<form>{11-}</form><main><p>{60+}<p>{10+}</main><div class=comments><p>{14-}<p>{9-}</div><div class=comments><p>{21-}</div><footer>{30-}</footer>",
    "<p>{22+}", "<div><p>{25+}</div><div>[2-]</div>", "<div>[1-]</div><div><p>{20+}<p>{6+}</div><footer>{21-}</footer>", "<div>{19+}</div><div class=ad>{23-}</div>",
    "<article><p>{15+}<p>{20+}</article><div class=ad>{16-}</div><article><p>{25+}<p>{2+}</article><footer>{18-}</footer>",
    "<div><p>{26+}[4+]<p>{17+}[2+]<p>{60+}<p>{3+}</div><div>[5-]<p>[4-]<p>[6-]</div>",
    "<div><h1>{5+}</h1><p>{60+}</div><div><ul><li>[6-]<li>[7-]<li>[5-]<li>[6-]<li>[8-]<li>[6-]<li>[6-]<li>[4-]</ul></div>",
    "<div><ul><li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]<li>[1-]</ul></div><div><p>{64+}<p>{18+}</div>",
    "<div>[2-]</div><div><h1>{4+}</h1></div><div><p>{70+}<p>{22+}</div><div><h3>{2-}</h3><ul><li>[9-]<li>[11-]<li>[8-]</ul></div>",
    "<div><h1>{6+}</h1></div><div><p>{58+}</div><div><p>{6-}[4-]<p>[3-]</div>",
    "<div><h1>{3+}</h1></div><div><p>{14+}<p>{31+}<p>{9+}</div>", "<div>{17+}</div>", "<div>[1-]</div><div><p>{16+}</div><div><p>{1-}</div>", "<div>[1-] [1-] [2-]</div><div><p>{12+}<p>{9+}</div><div>[2-]</div>",
    "<div><p>{8+}</div>", "<div><h2>{2+}</h2><p>{11+}</div><div>{1-}[2-]</div>", "<section><p>{15+}</section><section><p>{13+}</section><div>[3-]</div>",
    "<div><h1>{7+}</h1><p>{90+}<p>{5+}[3+]{30+}<ul><li>[4+]<li>{6+}<li>[3+]</ul><p>{44+}</div><div>[2-]<p>[2-]<p>[2-]<p>[2-]</div>",
    "<article><h1>{5+}</h1><section><p>{12+}<p>{5+}</section><section><h2>{3+}</h2><p>{70+}<p>{44+}</section><div><p>{9+}</div></article><div>[2-]</div>",
    "<article><div><p>{8+}</div><div><p>{60+}<p>{33+}</div><div><ul><li>{4+}<li>{3+}<li>[5+]</ul></div><div>{16+}</div></article><nav>[1-]</nav>",
    "<main><div><h1>{4+}</h1></div><div><p>{15+}</div><div><p>{80+}<p>{26+}</div><div><p>{11+}</div></main><footer>{20-}</footer>",
    "<div>[2-]<p>[1-]</div><div><p>{21+}</div><div><p>{64+}</div><div><p>{33+}</div><div><p>{14+}</div><div><p>{27+}</div><div>[3-]<p>[4-]</div>",
    "<section><h2>{4+}</h2><p>{20+}</section><section><h2>{3+}</h2><p>{75+}<p>{40+}</section><section><h2>{2+}</h2><p>{28+}</section><div><ul><li>[5-]<li>[6-]<li>[7-]</ul></div>",
    "<section><p>{18+}<p>{24+}</section><section><p>{90+}<p>{61+}</section><section><p>{15+}</section><div><p>[7-]<p>[9-]<p>{3-}</div><div>[1-]</div>",
    "<div><p>{3-}[9-]{2-}[8-]</div><div><h1>{5+}</h1><p>{40+}<p>{52+}</div><div><p>{4-}[6-]<p>[3-]{2-}</div>",
    "<div>{5-}</div><div><h1>{4+}</h1><p>{40+}<p>{22+}</div><div>{4-}</div>", "<div>{7-}</div><div><p>{30+}<p>{9+}</div><div>{3-}</div>", "<div><p>{33+}</div><div><p>{18+}</div><div>{6-}</div>",
    "<div>{4-}</div><div><p>{20+}<p>{6+}</div><div>{8-}</div>", "<div><h2>{3+}</h2><p>{24+}</div><div>{5-}</div>", "<div>{6-}</div><div><p>{26+}</div><div><p>{60+}<p>{12+}</div><div>{2-}</div>",
)


def labelled(pages: tuple[str, ...] = LABELLED, sizes: tuple[float, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and label of each block of labelled pages, each at every size."""
    rows, labels = [], []
    for page in pages:
        for size in sizes:
            # a block is labelled by its last word
            words = lambda m: "x " * (max(1, round(int(m[1]) * size)) - 1) + m[2]
            filled = re.sub(r"\{(\d+)([+-])\}", lambda m: words(m) + " ", page)
            filled = re.sub(r"\[(\d+)([+-])\]", lambda m: f"<a href=y>{words(m)}</a> ", filled)
            found = blocks(filled)
            rows += features(found)
            labels += [b.text[-1] == "+" for b in found]
    return np.array(rows, float), np.array(labels, float)


def cross_validated(depth: int, least: int = LEAST, folds: int = 5) -> float:
    """The share of blocks of LABELLED that trees get right which have not seen the blocks' page at any size."""
    right = total = 0
    for k in range(folds):
        model = train_tree(*labelled(tuple(p for i, p in enumerate(LABELLED) if i % folds != k)), depth, least)
        rows, labels = labelled(LABELLED[k::folds])
        right += sum(classify(model, r) == bool(y) for r, y in zip(rows, labels, strict=True))
        total += len(labels)
    return right / total


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH, least: int = LEAST) -> tuple:
    """A binary tree of (feature, threshold, low, high) and class numbers, grown by the fall of Gini impurity; ties go to the
    earlier feature and the smaller threshold."""
    ones = labels.mean()
    if depth == 0 or ones in (0.0, 1.0):
        return int(ones >= 0.5), None, None, None
    best = (0.0, None, None)
    n, now = len(labels), ones * (1 - ones)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            k = int(low.sum())
            if k < least or n - k < least:
                continue
            p, q = labels[low].mean(), labels[~low].mean()
            gain = now - (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
            if gain > best[0] + 1e-12:
                best = (gain, f, t)
    if best[1] is None:
        return int(ones >= 0.5), None, None, None
    low = rows[:, best[1]] <= best[2]
    below, above = train_tree(rows[low], labels[low], depth - 1, least), train_tree(rows[~low], labels[~low], depth - 1, least)
    if below[1] is None and below == above:  # nothing is decided here
        return below
    return best[1], float(best[2]), below, above


def tree(pages: tuple[str, ...] = LABELLED) -> tuple:
    return train_tree(*labelled(pages))


def features(found: list[Block]) -> list[tuple]:
    none = Block("", 0, 0, False, False, False, -1)
    around = [none, *found, none]
    words, linked = Counter(), Counter()
    for b in found:
        words[b.section] += b.words
        linked[b.section] += b.linked
    most = max((words[b.section] - linked[b.section] for b in found if not b.boiler), default=0)
    share = lambda b: (words[b.section] - linked[b.section]) / most if most else 0.0
    return [
        (b.words, b.density, a.words, a.density, c.words, c.density, linked[b.section] / max(words[b.section], 1), share(b), share(a), share(c), b.heading, b.article, b.boiler)
        for a, b, c in zip(around, found, around[2:], strict=False)
    ]


def classify(model: tuple, row: tuple) -> bool:
    while model[1] is not None:
        model = model[2] if row[model[0]] <= model[1] else model[3]
    return bool(model[0])


def main_text(html: str | None, model: tuple) -> str:
    found = blocks(html)
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if classify(model, row))


def extract(pages: DataFrame, labelled_pages: tuple[str, ...] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row of ``pages`` (page_id, url, html).

    Null or empty html and pages without main text: text empty, n_chars 0. Null page_id and url are passed on; repeated rows give
    repeated results. Broken markup: an unclosed element ends with the one around it. Other columns are not read; an
    empty table gives no rows. Pages are handled one at a time, so memory is bounded by the longest page.
    """
    model = tree(labelled_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                text = [main_text(h.as_py(), model) for h in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
