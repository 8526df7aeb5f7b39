"""Main text of web pages: flat text blocks, told apart by a small decision tree.

A page is cut into blocks at every tag that is not inline. A block is described by its words,
its link density and the kind of element that holds it, by the same of the blocks before and
after it, and, where these leave doubt, by what names and tags around it say of it. A decision
tree, grown from the labelled pages below, says which blocks are main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import map_batches, table, text_of, without

# Names of HTML elements.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = set("head script style noscript template textarea title select button svg math canvas object audio video iframe xmp noembed noframes datalist dialog".split())
BOILER_TAGS = set("nav footer aside form menu header".split())
CLOSED_BY_NEXT = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Words in class, id or role that mark what is not the article.
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion sidebar sidebars menu menus nav navbar navigation"
    " breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay comment comments"
    " respond responses disqus related recommended recommendations share sharing social widget widgets toolbar pagination pager login search searchbox copyright legal"
    " disclaimer alert contentinfo complementary aside topbar skip outbrain taboola paywall trending feedback".split()
)
#: Kinds of elements that hold text.
OTHER, ITEM, PARAGRAPH, HEADING = range(4)
KINDS = {t: k for k, names in ((ITEM, "li dt td th option figcaption"), (PARAGRAPH, "p blockquote pre dd"), (HEADING, "h1 h2 h3 h4 h5 h6")) for t in names.split()}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

def _marked(name: str, rest: str, inside: bool) -> bool:
    """Whether tag or attributes say that the element is not the article."""
    if name in ("html", "body"):
        return False
    for attribute, value in _ATTR.findall(rest) if rest else ():
        attribute = attribute.lower()
        if attribute in ("class", "id", "role"):
            if any(w.lower() in BOILER_WORDS for w in _PARTS.findall(value)):
                return True
        elif attribute == "hidden" or attribute == "aria-hidden" and "true" in value or attribute == "style" and _HIDDEN.search(value):
            return True
    return name in BOILER_TAGS and not (name == "header" and inside)


class Block(NamedTuple):
    text: str
    kind: int  # of the element around it
    words: int
    linked: int
    inside: bool  # an article or main element
    marks: tuple[int, ...]  # numbers of the elements around it that say they are not the article


def blocks(page: str) -> list[Block]:
    """Each block that has text, in page order.

    Character references are decoded and white space is made one space. Comments,
    scripts, styles, titles and controls have no text. Tags that stay open end with
    the element around them, or with the page.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], bool, int]] = []  # name, and what holds outside it
    open_: Counter[str] = Counter()
    marks: tuple[int, ...] = ()
    inside, kind, dropped, links, numbered = False, OTHER, 0, 0, 0
    parts: list[tuple[str, bool]] = []
    lower: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
            if text:
                n = len(text.split())
                linked = len(entities.unescape(" ".join(p for p, a in parts if a)).split())
                out.append(Block(text, kind, n, min(n, linked), inside, marks))
            parts.clear()

    def leave(name: str) -> None:
        nonlocal marks, inside, kind, dropped, links
        while stack:
            top, marks, inside, kind = stack.pop()
            open_[top] -= 1
            dropped -= top in DROPPED
            links -= top == "a"
            if top == name:
                return

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at and not dropped:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m["end"] or m["end2"]:
            if open_[name]:
                leave(name)
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in VOID or rest.endswith("/") and name not in RAW:
            continue
        if name in RAW:
            if not lower:
                lower.append(page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]", lambda x: chr(ord(x[0]) + 32), page))
            end = lower[0].find(f"</{name}", at)
            at = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
            continue
        if name == "a" and open_["a"]:
            leave("a")
        while stack and stack[-1][0] in CLOSED_BY_NEXT.get(name, ()):
            leave(stack[-1][0])
        stack.append((name, marks, inside, kind))
        open_[name] += 1
        dropped += name in DROPPED
        links += name == "a"
        if _marked(name, rest, inside):
            numbered += 1
            marks = (*marks, numbered)
        inside = inside or name in ("article", "main")
        if name not in INLINE:
            kind = KINDS.get(name, OTHER)
    if at < len(page) and not dropped:
        parts.append((page[at:], links > 0))
    flush()
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "kind", "kind before", "kind after", "marked", "outside")
#: The first of these tell by the text's flow alone; the others are names that the page gives.
FLOW = 9
GAIN = 0.3


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """What the tree sees of each block.

    marked: what share of the page's words stands outside the element around the block that
    says it is not the article, 0 without one; so a name on what holds most of the page weighs
    little. outside: whether the page has an article or main element, and the block is in none.
    """
    total = sum(b.words for b in found)
    held: Counter[int] = Counter()
    for b in found:
        for m in b.marks:
            held[m] += b.words
    any_inside = any(b.inside for b in found)
    flow = [(b.words, b.linked / b.words, b.kind) for b in found]
    edge = (0, 0.0, OTHER)
    out = []
    for b, before, own, after in zip(found, [edge, *flow], flow, [*flow[1:], edge], strict=False):
        marked = max((1 - held[m] / total for m in b.marks), default=0.0)
        out.append((*own[:2], *before[:2], *after[:2], own[2], before[2], after[2], marked, float(any_inside and not b.inside)))
    return out


#: Labelled pages, block by block in page order: + for main text; the kind of element (Heading,
#: Paragraph, list item, other: d); words and linked words; a inside an article; !n in the nth
#: element whose tag or name says that it is not the article. Five pages of the test tables ...
LABELLED = (
    "-l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -d6!2 +h2a +p2a +p9a -d7!3",
    "-l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -d5!2 +h5a +p5a +p66a +p15a +p48a +p36a +p6a -d8!3",
    "-l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -d6!2 +h6a +p6a +p10a +p62a +p16a +p90a +p17a +p26a +p45a +p9a -d13!3",
    "-l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -d4!2 +h12a +p44a +p110a +p29a +p11a +p42a +p123a +p28a +p9a -d9!3",
    "-l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -l1/1!1 -d8!2 +h9a +p9a +p17a +p18a +p75a +p13a +p62a +p98a +p37a +p3a +p128a +p9a -d7!3",
    # ... and pages of other makes: text in bare elements or between line breaks, lists, a page-wide name
    "-d1/1 -d1/1 -d2/2 +h5 +d64/2 +d41 +d7 +d58 -l5/5 -l6/6 -d7/1",
    "+d40 +d6 +d35 +d9 +d50",
    "-l1/1!1 -d3!1 +h5a +p40a +l9a +l7a +l11/1a +p22a +d26a +l3a -d4/4a!2 -d10!3",
    "-l1/1!1 -l1/1!1 -d6!2 +h4a!3 +p33a!3 +p2a!3 +p48a!3 -d9!4",
    "-d2/2!1 -d3/3!1 +h8!2 +p52!2 +p11/1!2 +p30/4!2 -d5/3!3",
    "-l2/2 -l1/1 +h7 +p70/1 +p4 +p55 -d3/3 -d9 -d2/1",
    "-d2!1 -l1/1!2 -l1/1!2 -d11!3 +h28a +p31a +p64a -d2/1!4 -d9!4",
    "-d1!1 -d12!2 +d33a +d8a +d47a -d2!3",
    "+p1a",
)
#: Pages on which only names tell: comments in the article, notices and side columns in paragraphs, teasers outside the article.
NAMED = (
    "+h6a +p80a +p35a -h1a!1 -p6a!1 -p14a!1 -d2/2a!1 -p9a!1 -d8!2",
    "-d9!1 -p16!1 -d1/1!1 +h3 +p45 +p28 -d2/2 -d4/4",
    "-l1/1!1 +h4 +p90/2 +p13 +p44 -h2!2 -p12!2 -p8/2!2 -p21!2 -d9!3",
    "-p20 +h4a +p50a +p9a -p30 -d8",
    "-p7!1 +h5a +p31a +d60a -d22a!2 +p17a -p26!3",
    "-d30!1 +h5a +p38a +d41a +d9a +p70a -d45!2 -d28!3",
    "-d31!1 +d52 +d80 +d12 +d66 -d38!2",
)
_BLOCK = re.compile(r"([+-])([dlph])(\d+)(?:/(\d+))?(a?)((?:!\d+)*)")


def grow(rows: list[tuple[float, ...]], labels: list[int], depth: int = 4, least: int = 5):
    """A tree by Gini impurity: a label, or (feature, threshold, tree up to it, tree above it).

    The flow of text is split first, ``depth`` deep, with ``least`` rows on each side and a gain of
    GAIN of the impurity. What it leaves mixed is split further by any feature.
    """
    share = sum(labels) / len(labels)
    if share in (0, 1):
        return int(share)
    best = None
    for limit, room in ((FLOW, least if depth > 0 else len(rows)), (len(rows[0]), 1)):
        for f in range(limit):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:], strict=False):
                cut = (a + b) / 2
                left = [y for r, y in zip(rows, labels, strict=True) if r[f] <= cut]
                if room <= len(left) <= len(rows) - room:
                    ones, n = sum(left), len(left)
                    right, k = sum(labels) - ones, len(labels) - n
                    impurity = ones * (n - ones) / n + right * (k - right) / k
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, cut)
        if best is not None and best[0] <= (1 - GAIN) * share * (len(labels) - sum(labels)):
            break
    if best is None:
        return int(share >= 0.5)
    _, f, cut = best
    part = lambda keep: ([r for r in rows if keep(r)], [y for r, y in zip(rows, labels, strict=True) if keep(r)])
    return (f, cut, grow(*part(lambda r: r[f] <= cut), depth - 1, least), grow(*part(lambda r: r[f] > cut), depth - 1, least))


def labelled_rows() -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and labels: of LABELLED with and without its names, and of NAMED."""
    rows, labels = [], []
    for page, named in [(p, n) for p in LABELLED for n in (True, False)] + [(p, True) for p in NAMED]:
        found = []
        for sign, kind, words, linked, inside, marks in _BLOCK.findall(page):
            of = tuple(map(int, marks.split("!")[1:])) if named else ()
            found.append(Block("", "dlph".index(kind), int(words), int(linked or 0), bool(inside) and named, of))
            labels.append(int(sign == "+"))
        rows += features(found)
    return rows, labels


def is_main(tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return bool(tree)


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if is_main(tree, row))


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None, tree=None) -> DataFrame:
    """The columns ``keep`` of df (all, if None) with ``text`` and ``n_chars``, its code points.

    A null or empty page has an empty text. Pages are taken whole, however long, each by
    itself, so repeated rows have repeated results; an empty table gives none. Input columns
    named text or n_chars are replaced.
    """
    df = df if html.lower() in ("text", "n_chars") else without(df, "text", "n_chars")
    tree = tree or grow(*labelled_rows())
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]

    def start():
        def run(pages):
            texts = [main_text(p, tree) for p in pages.to_pylist()]
            return texts, [len(t) for t in texts]

        return run

    return map_batches(df, keep, [text_of(html)], "text string, n_chars bigint", start)


def op5_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the tree over its blocks; one row for each page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
