"""Operator 10: the main text of a page from flat text blocks, by a decision tree over words and link density.

A page is cut into a flat row of text blocks at block-level tags; the blocks of one list or table are judged as one. A block
is described by its number of words and its link density (the share of its characters inside links) and those of the rows of
like blocks before and after it; further by whether a container marks it as a menu, notice, advert and so on, by element or by class,
whether it is in an article, and whether the page has one. A decision tree, trained here on the small table LABELLED,
decides: rows of links go in and outside of articles, a lone link among prose stays; on pages without an article prose stays,
and so do short blocks beside prose; beside an article only long prose does.

Defined results: null and empty pages, and pages without such a block, give an empty text; character references are
decoded once, after the markup is gone; runs of white space (and line breaks by <br>) in a block become one space; unclosed
elements end with their container, an unclosed comment or script with the page; pages of any length are read whole;
repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import short_batches, table

#: Elements that part blocks; those that are never shown or never prose; those that hold boilerplate, or the article.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = set("script style noscript template svg math iframe object canvas audio video select button textarea title".split())
BOILERPLATE = set("nav footer aside form menu dialog".split())
#: Parts of a class or id (between hyphens and underscores) that mark boilerplate on any element; whole names that do so on
#: an element that holds others; parts that mark it outside of articles only, where they stand alone or with a page's word.
MARKED = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter pager pagination popup promo promotion sidebar signup sponsor sponsored subscribe subscription toolbar widget widgets".split())
NAMES = set("copyright legal login notice notices related search share sharing skip social tags toc".split())
HEADS, OF_PAGE = "header", set("header site page main top global".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption".split())
GROUPS = set("ul ol dl table".split())
FAR = 400
ARTICLE = set("article main".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>""", re.S)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: words, link density, words before, density before, words after, density after, marked as boilerplate, in an article, page
#: has an article, and the class: text of the article or not
LABELLED = [
    # marked as boilerplate
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0), (12, 1.0, 0, 0.0, 10, 0.0, 1, 0, 0, 0), (9, 0.0, 12, 1.0, 10, 0.0, 1, 0, 1, 0),
    (60, 0.0, 8, 0.0, 12, 0.1, 1, 1, 1, 0), (45, 0.0, 50, 0.0, 40, 0.0, 1, 0, 0, 0), (12, 0.1, 80, 0.0, 0, 0.0, 1, 0, 1, 0),
    (150, 0.05, 30, 0.0, 9, 0.0, 1, 1, 1, 0), (30, 0.0, 8, 0.0, 50, 0.0, 1, 0, 0, 0), (80, 0.1, 60, 0.0, 70, 0.0, 1, 1, 1, 0),
    (16, 0.0, 50, 0.0, 30, 0.1, 1, 0, 0, 0), (8, 0.0, 0, 0.0, 60, 0.0, 1, 1, 1, 0), (25, 0.2, 3, 1.0, 40, 0.0, 1, 0, 1, 0),
    (400, 0.0, 20, 0.0, 300, 0.0, 1, 0, 0, 0), (6, 0.0, 3, 0.0, 60, 0.0, 1, 0, 0, 0), (5, 0.0, 90, 0.0, 90, 0.0, 1, 1, 1, 0),
    # in an article: text, but for rows of links
    (8, 0.0, 9, 0.0, 60, 0.0, 0, 1, 1, 1), (2, 0.0, 70, 0.0, 55, 0.0, 0, 1, 1, 1), (1, 0.0, 8, 0.0, 5, 0.0, 0, 1, 1, 1),
    (120, 0.02, 8, 0.0, 60, 0.0, 0, 1, 1, 1), (40, 0.3, 60, 0.0, 2, 1.0, 0, 1, 1, 1), (300, 0.0, 2, 1.0, 10, 0.2, 0, 1, 1, 1),
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (12, 0.0, 12, 1.0, 9, 1.0, 0, 1, 1, 1), (20, 0.5, 30, 0.1, 40, 0.0, 0, 1, 1, 1),
    (3, 1.0, 60, 0.0, 44, 0.0, 0, 1, 1, 1), (6, 1.0, 30, 0.1, 25, 0.0, 0, 1, 1, 1), (9, 0.9, 12, 0.0, 8, 0.0, 0, 1, 1, 1),
    (7, 0.0, 6, 0.0, 7, 0.0, 0, 1, 1, 1), (60, 0.0, 7, 0.0, 6, 0.0, 0, 1, 1, 1), (6, 0.0, 9, 0.0, 7, 0.0, 0, 1, 1, 1),
    (12, 0.0, 10, 0.0, 8, 0.0, 0, 1, 1, 1), (30, 0.0, 30, 0.0, 7, 0.0, 0, 1, 1, 1), (4, 0.0, 5, 0.0, 6, 0.0, 0, 1, 1, 1),
    (9, 0.1, 60, 0.0, 4, 0.0, 0, 1, 1, 1), (80, 0.0, 40, 0.0, 6, 0.0, 0, 1, 1, 1), (3, 0.0, 4, 0.0, 3, 0.0, 0, 1, 1, 1),
    (2, 0.0, 3, 1.0, 3, 1.0, 0, 1, 1, 1), (15, 0.0, 4, 1.0, 7, 0.2, 0, 1, 1, 1), (45, 0.0, 5, 0.0, 120, 0.0, 0, 1, 1, 1),
    (5, 0.0, 70, 0.0, 130, 0.0, 0, 1, 1, 1), (10, 0.0, 9, 0.0, 150, 0.0, 0, 1, 1, 1), (25, 0.0, 90, 0.0, 0, 0.0, 0, 1, 1, 1),
    (3, 1.0, 2, 0.0, 60, 0.0, 0, 1, 1, 1), (4, 1.0, 5, 0.0, 8, 0.0, 0, 1, 1, 1), (6, 0.8, 8, 0.0, 4, 0.0, 0, 1, 1, 1),
    (4, 1.0, 14, 1.0, 30, 0.0, 0, 1, 1, 0), (6, 1.0, 25, 0.9, 60, 0.0, 0, 1, 1, 0), (3, 1.0, 40, 1.0, 3, 1.0, 0, 1, 1, 0),
    (2, 1.0, 3, 1.0, 4, 1.0, 0, 1, 1, 0), (14, 1.0, 5, 1.0, 40, 0.0, 0, 1, 1, 0), (4, 1.0, 2, 1.0, 3, 1.0, 0, 1, 1, 0),
    (3, 1.0, 4, 0.9, 20, 0.0, 0, 1, 1, 0), (5, 0.9, 3, 1.0, 2, 1.0, 0, 1, 1, 0), (8, 0.95, 4, 1.0, 0, 0.0, 0, 1, 1, 0),
    # beside an article: only long prose
    (25, 0.0, 1, 1.0, 8, 0.0, 0, 0, 1, 0), (4, 0.0, 90, 0.0, 3, 1.0, 0, 0, 1, 0), (16, 0.0, 50, 0.0, 30, 0.1, 0, 0, 1, 0),
    (6, 0.0, 3, 0.0, 60, 0.0, 0, 0, 1, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 1, 0), (30, 0.0, 12, 0.0, 60, 0.0, 0, 0, 1, 0),
    (90, 0.7, 6, 0.0, 80, 0.0, 0, 0, 1, 0), (20, 0.9, 60, 0.0, 70, 0.0, 0, 0, 1, 0), (12, 0.0, 100, 0.0, 120, 0.0, 0, 0, 1, 0),
    (110, 0.0, 9, 0.0, 80, 0.0, 0, 0, 1, 1), (150, 0.1, 60, 0.0, 70, 0.0, 0, 0, 1, 1), (400, 0.05, 3, 1.0, 9, 0.0, 0, 0, 1, 1),
    # pages without an article: prose, and what stands beside prose
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (6, 0.0, 3, 0.9, 4, 0.5, 0, 0, 0, 0),
    (14, 0.9, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (30, 0.8, 5, 1.0, 40, 0.0, 0, 0, 0, 0), (4, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0),
    (8, 0.0, 4, 0.0, 6, 0.0, 0, 0, 0, 0), (60, 0.7, 50, 0.0, 40, 0.0, 0, 0, 0, 0), (3, 0.9, 70, 0.0, 50, 0.0, 0, 0, 0, 0),
    (8, 0.0, 9, 1.0, 12, 0.0, 0, 0, 1, 0), (9, 0.0, 6, 1.0, 8, 0.0, 0, 0, 1, 0), (14, 0.0, 40, 0.0, 0, 0.0, 0, 0, 1, 0),
    (2, 0.0, 0, 0.0, 7, 1.0, 0, 0, 0, 0), (3, 0.0, 4, 1.0, 6, 0.0, 0, 0, 0, 0), (5, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 0),
    (30, 0.0, 8, 0.0, 50, 0.0, 0, 0, 0, 1), (80, 0.1, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (25, 0.2, 3, 1.0, 40, 0.0, 0, 0, 0, 1),
    (16, 0.0, 50, 0.0, 30, 0.1, 0, 0, 0, 1), (6, 0.0, 3, 0.0, 60, 0.0, 0, 0, 0, 1), (5, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 1),
    (40, 0.0, 70, 0.0, 3, 1.0, 0, 0, 0, 1), (9, 0.0, 44, 0.0, 35, 0.0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 30, 0.0, 0, 0, 0, 1),
    (20, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (200, 0.3, 5, 0.0, 4, 0.0, 0, 0, 0, 1), (16, 0.0, 4, 0.0, 3, 1.0, 0, 0, 0, 1),
    (1, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 1), (1, 0.0, 20, 0.0, 18, 0.0, 0, 0, 0, 1), (2, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 1),
    (4, 0.0, 30, 0.1, 2, 1.0, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 24, 0.0, 0, 0, 0, 1), (7, 0.3, 28, 0.0, 22, 0.0, 0, 0, 0, 1),
]


def grow(rows: list[tuple], depth: int = 9):
    """A decision tree by Gini impurity: (feature, cut, tree up to the cut, tree above it), or a class."""
    ones = sum(r[-1] for r in rows)
    if ones in (0, len(rows)) or depth == 0:
        return int(2 * ones >= len(rows))

    def impurity(part):
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    options = []
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            low, high = [r for r in rows if r[f] <= (a + b) / 2], [r for r in rows if r[f] > (a + b) / 2]
            options.append((impurity(low) + impurity(high), -f, (a + b) / 2, low, high))
    if not options:
        return int(2 * ones >= len(rows))
    _, f, cut, low, high = min(options, key=lambda o: o[:3])
    return (-f, cut, grow(low, depth - 1), grow(high, depth - 1))


@lru_cache(maxsize=1)
def tree():
    return grow(LABELLED)


def decide(features: tuple, node) -> int:
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


def container(name: str, attributes: str, in_article: bool) -> int:
    """What an element says of the blocks in it: 1 article, -1 boilerplate, 0 nothing."""
    if name in ARTICLE:
        return 1
    if name in BOILERPLATE or name == "header" and not in_article:
        return -1
    if name in ("body", "html", "header"):
        return 0
    for m in NAMED.finditer(attributes):
        for value in (m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[^a-z0-9]+", value)
            if not MARKED.isdisjoint(parts) or value in NAMES and name not in LEAVES:
                return -1
            if HEADS in parts and not in_article and OF_PAGE.issuperset(parts):
                return -1
    return 0


def blocks(html: str) -> tuple[list[tuple[str, int, int, int, int]], bool]:
    """The page's blocks in order, each (text, linked characters, marked, in article, group), and whether there is an article.

    Blocks of one list or table have its number as group, others one of their own.
    """
    out: list[tuple[str, int, int, int, int]] = []
    # open block elements, whether they or one around them are marked, and are an article; the outermost list or table
    stack: list[tuple[str, int, int, int]] = []
    opened = 0
    held: list[str] = []
    linked: list[str] = []
    links, has_article, at, size = 0, False, 0, len(html)

    def flush() -> None:
        nonlocal opened
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                opened += 1
                _, marked, article, group = stack[-1] if stack else ("", 0, 0, 0)
                out.append((text, min(len(text), len(" ".join(unescape("".join(linked)).split()))), marked, article, group or -opened))
            held.clear()
            linked.clear()

    def take(text: str) -> None:
        if text:
            held.append(text)
            if links:
                linked.append(text)

    while at < size:
        m = TAG.search(html, at)
        if m is None:
            take(html[at:])
            break
        take(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in SKIPPED:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
            held.append(" ")
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name == "br":
            take(" ")
        elif name in BLOCKS:
            flush()
            links = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in ("p", "hr", "li", "dt", "dd", "td", "th", "tr") or NAMED.search(attributes):
                while stack and stack[-1][0] in ("p", "li", "dt", "dd", "td", "th", "tr"):
                    stack.pop()  # their end tags may be left out
                _, marked, article, group = stack[-1] if stack else ("", 0, 0, 0)
                said = container(name, attributes, bool(article))
                has_article |= said == 1
                if name in GROUPS and not group:
                    opened += 1
                    group = opened
                if name != "hr":
                    # an article inside a marked element is the page's text all the same; what is marked in an article is not
                    stack.append((name, int(said < 0 or marked and said != 1), int(said == 1 or article), group))
    flush()
    return out, has_article


def _row_of(units: list[tuple], kind: list[tuple], places: range) -> tuple[int, float]:
    """Words and link density of the units at places up to the first of another kind than the nearest; none counts as 0.

    Beyond FAR words more make no difference, so long pages are read in linear time.
    """
    words = linked = 0
    for j in places:
        if kind[j] != kind[places[0]] or words > FAR:
            break
        words, linked = words + units[j][1], linked + units[j][1] * units[j][2]
    return words, linked / words if words else 0.0


def main_text(html: str | None) -> str:
    row, has_article = blocks(html or "")
    units: list[tuple] = []
    for _, unit in groupby(row, key=lambda x: x[2:]):
        texts = list(unit)
        units.append((texts, sum(len(t[0].split()) for t in texts), sum(t[1] for t in texts) / sum(len(t[0]) for t in texts)))
    # neighbours are rows of units of one kind: what is before a unit in its own row, or all of the row before it
    kind = [(density > 0.5, texts[0][2], texts[0][3]) for texts, _, density in units]
    kept = []
    for i, (texts, words, density) in enumerate(units):
        before, after = _row_of(units, kind, range(i - 1, -1, -1)), _row_of(units, kind, range(i + 1, len(units)))
        if len(texts) > 1 and density > 0.5:  # in a list of links the neighbours of a block are other links
            before = after = words // len(texts), density
        if decide((words, density, *before, *after, texts[0][2], texts[0][3], int(has_article)), tree()):
            kept += [t[0] for t in texts]
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    short_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    shaped = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return shaped.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))
