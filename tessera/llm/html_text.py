"""Main text of web pages by tree scoring.

A page is read into a tree of block elements.  Paragraphs earn points for their length and their commas, discounted by
the share of their text inside links, and pass them on: all of them to their parent, half to the grandparent, a third
to the one above; an ``article`` or ``main`` collects those of all its paragraphs.  A word of a class or id that is
common among menus, adverts, comments and the like never removes anything by itself: it makes the points that pass
through its element weigh less.  A container's worth is its points, discounted by its link density.  The container
of the greatest worth is kept (an article, then a main, before others that come near), with those siblings that score
well or are plain long paragraphs.  Inside it a marked element stays if it holds most of the container's points; a
doubtful mark (a word of texts too, or one word of several) gives way to evidence already: few links, and a paragraph,
a heading or much text; a mark of what others have put there (adverts, reader comments) gives way to nothing.  What HTML itself says is no main text (``nav``, ``aside``, ``form``, scripts, hidden elements,
landmark roles ...) never scores.  A page without any points gives all its other text.

All passes are linear in the page: elements know their nearest open paragraph, cell and row, and sums run once up the
tree.

Defined results: null and empty pages have an empty text; markup that is cut off or never closed ends at the end of
the page, and a quote that is never closed ends with its tag; character references are decoded once; of containers of
equal worth the outer one is kept; a null id stays null; rows are independent, so repeated rows and empty tables need
nothing special; columns other than those of ``keep`` are ignored, and none of theirs can clash.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no main text, with all that is inside.
APART = frozenset("head nav footer aside form menu dialog button select template iframe object svg canvas audio video noscript".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words of a class or id that mark what is seldom main text.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert "
    "disclaimer sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist reply replies respond disqus discussion share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pager pagination paging toolbar widget widgets skip copyright".split()
)
#: Marks that are words of texts too.
DOUBTFUL = frozenset("side notice notices alert disclaimer promotion discussion replies respond share sharing social related recommended recommendations subscription copyright skip header".split())
#: Marks of what is written or put there by others, however much of it there is.
FOREIGN = frozenset("ad ads advert advertisement adverts advertising adsense sponsor sponsored sponsors promo promoted cookie cookies consent gdpr comment comments commentlist disqus newsletter subscribe signup login popup modal".split())
#: Words that say nothing beside a mark: ``ad-box`` is as sure as ``ad``.
PLAIN = frozenset("area bar block body bottom box btn button buttons container content global group holder inner item items js left link links list main module outer page panel post right section site slot text the top unit wrap wrapper".split())
FIRM, SURE, UNSURE = 3, 2, 1
#: What points are worth behind an element with a mark.
WEIGHT = {0: 1.0, UNSURE: 0.6, SURE: 0.1, FIRM: 0.1}
#: Points of an article or main count so many times.
TRUSTED = 3
#: A container that comes so near to the best one may be chosen for its element.
NEAR = 0.75
#: What a sibling must be worth, and the share of the best container's worth.
LEAST, SHARE = 10.0, 0.2
UNMARKED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table".split())
CELLS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that are parts of a list or table rather than containers.
PARTS = frozenset("tr td th tbody thead tfoot li dt dd ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body h1 h2 h3".split())
PASSING = frozenset("p pre blockquote li dd td h1 h2 h3".split())

#: A quoted value counts as one only if what follows can follow a value; else the quote is a character like others.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "parent", "apart", "mark", "points", "all", "chars", "linked", "plain", "p", "cell", "row", "foreign")

    def __init__(self, tag: str, parent: Node | None, apart: bool, mark: int = 0):
        self.tag, self.parent, self.apart, self.mark, self.plain = tag, parent, apart, mark, False
        self.foreign = mark == FIRM or bool(parent and parent.foreign)
        self.points, self.all, self.chars, self.linked = 0.0, 0.0, 0, 0
        new = parent is None or tag in SCOPE or apart != parent.apart
        self.p = self if tag == "p" else None if new or tag in ("td", "th") else parent.p
        self.cell = self if tag in CELLS else None if new else parent.cell
        self.row = self if tag == "tr" else None if new else parent.row


def classify(tag: str, attributes: str) -> tuple[bool, int]:
    """(no main text by HTML itself, mark of its class and id)."""
    apart, mark = tag in APART, 0
    for name, *value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(value)
        if tag in ("html", "body"):
            break
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDES.search(value)) or (name == "role" and value.lower() in ROLES):
            apart = True
        elif name in ("class", "id") and tag not in UNMARKED:
            for one in value.split():
                words = [w.lower() for w in _WORDS.findall(one)]
                if not MARKS.isdisjoint(words):
                    sure = all(w in MARKS or w in PLAIN for w in words) and any(w in MARKS and w not in DOUBTFUL for w in words)
                    mark = max(mark, (UNSURE if not sure else SURE if FOREIGN.isdisjoint(words) else FIRM))
    return apart, UNSURE if tag == "header" and not mark else mark


class Page:
    """``nodes`` in page order, parents first; ``blocks``: (element, text, characters inside links)."""

    def __init__(self, page: str):
        self.nodes = [Node("#page", None, False)]
        self.blocks: list[tuple[Node, str, int]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        node, opened = self.nodes[0], Counter()
        parts: list[str] = []
        linked = at = links = 0
        muted, deep = "", 0  # a marked inline element whose text is left out; it ends with its block at the latest

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                if text := _SPACE.sub(" ", html.unescape("".join(parts))).strip():
                    self.blocks.append((node, text, min(linked, len(text))))
                parts, linked = [], 0

        def up_to(x: Node) -> Node:
            """Closes all open elements up to and with x."""
            y = node
            while y is not x.parent:
                opened[y.tag] -= 1
                y = y.parent
            return y

        while at < len(page):
            m = _TAG.search(page, at)
            end = m.start() if m else len(page)
            if end > at and not node.apart and not muted:
                parts.append(page[at:end])
                if links:
                    linked += end - at
            if not m:
                break
            at = m.end()
            if not m.group(2):
                continue
            closing, tag = m.group(1), m.group(2).lower()
            if tag in RAW:
                if not closing:
                    stop = _END[tag].search(page, at)
                    at = stop.end() if stop else len(page)
            elif tag in VOID:
                if tag == "br":
                    parts.append(" ")
                elif tag == "hr":
                    flush()
            elif tag not in BLOCK and tag not in APART:
                if muted:
                    deep += (tag == muted) * (-1 if closing else 1)
                    muted = muted if deep else ""
                elif not closing and not m.group(3).endswith("/"):
                    apart, mark = classify(tag, m.group(3))
                    if apart or mark >= SURE:
                        muted, deep = tag, 1
                if tag == "a" and not muted:
                    links = 0 if closing else 1
            elif closing:
                muted = ""
                if opened[tag] > 0:
                    x = node
                    while x.tag != tag:
                        x = x.parent
                    flush()
                    node, links = up_to(x), 0
            else:
                muted = ""
                flush()
                if tag in BLOCK:
                    if node.p:
                        node = up_to(node.p)
                    if tag in CELLS and node.cell and node.cell.tag in CELLS[tag]:
                        node = up_to(node.cell)
                    elif tag == "tr" and node.row:
                        node = up_to(node.row)
                apart, mark = classify(tag, m.group(3))
                node, links = Node(tag, node, node.apart or apart, mark), 0
                self.nodes.append(node)
                opened[tag] += 1
        flush()

    def score(self) -> list[Node]:
        """Points, characters and link characters of all elements; those that may be chosen, in page order."""
        number = {id(x): k for k, x in enumerate(self.nodes)}
        below = [0.0] * len(self.nodes)  # weighted points of all paragraphs in an element
        for node, text, linked in self.blocks:
            node.chars += len(text)
            node.linked += linked
            node.plain = node.plain or node.tag == "p" or node.tag in HEADINGS
            if node.tag not in PARAGRAPHS:
                continue
            points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
            node.all += points
            below[number[id(node)]] += points
            x, share = node, 1
            if node.tag in PASSING:
                points *= WEIGHT[node.mark]
                x = node.parent
            while x and share <= 3:
                points *= WEIGHT[x.mark]
                if x.tag not in ("article", "main"):
                    x.points += points / share
                x, share = x.parent, share + 1
        for k in range(len(self.nodes) - 1, 0, -1):
            x = self.nodes[k]
            below[k] *= WEIGHT[x.mark]
            if x.tag in ("article", "main"):
                x.points = below[k] * TRUSTED
            below[number[id(x.parent)]] += below[k]
            x.parent.all += x.all
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.plain = x.parent.plain or (x.plain and (x.tag not in HEADINGS or x.parent.mark == UNSURE))
        return [x for x in self.nodes if x.points > 0 and not x.foreign]

    def best(self, scored: list[Node]) -> Node:
        most = max(map(_worth, scored))
        near = [x for x in scored if _worth(x) >= NEAR * most]
        for tag in ("article", "main"):
            if own := [x for x in near if x.tag == tag]:
                return max(own, key=_worth)
        best = max(scored, key=_worth)
        while best.tag in PARTS and best.parent:
            best = best.parent
        return best


def _worth(x: Node) -> float:
    return x.points * (1 - x.linked / x.chars) if x.chars else 0.0


def _stays(x: Node, holder: float) -> bool:
    """Whether a marked element inside the chosen container is text: it holds most of its points (a layout named after its
    parts), or its mark is unsure and it reads like text."""
    if x.mark < FIRM and x.all > 0.5 * holder:
        return True
    return x.mark == UNSURE and x.linked <= 0.3 * x.chars and (x.plain or x.chars >= 200)


def main_text(page: str, scoring: bool = True) -> str:
    """``scoring`` off: all text that HTML itself doesn't set apart (to see what the points decide)."""
    tree = Page(page)
    scored = tree.score()
    if not scoring or not scored:
        return "\n".join(t for _, t, _ in tree.blocks)
    best = tree.best(scored)
    least = max(LEAST, SHARE * _worth(best))
    inside, beside = {id(best)}, set()
    for x in tree.nodes[1:]:  # parents come first
        if x is best:
            continue
        up = id(x.parent)
        if up in inside:
            if not x.mark or _stays(x, best.all):
                inside.add(id(x))
        elif x.parent is best.parent and x.tag not in ("html", "body") and x.mark < SURE:
            plain = x.tag == "p" and x.chars > 80 and x.linked < 0.25 * x.chars
            if not (x.tag in SCOPE and x.linked > 0.7 * x.chars) and (plain or (_worth(x) >= least and x.linked < 0.5 * x.chars)):
                beside.add(id(x))
        elif up in beside and not (x.mark and not _stays(x, best.all)) and not (x.tag in SCOPE and x.linked > 0.7 * x.chars):
            beside.add(id(x))
    return "\n".join(t for node, t, _ in tree.blocks if id(node) in inside or id(node) in beside)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: id, the columns of ``keep``, ``text`` and ``n_chars``."""
    names = ["id_", *keep]
    rows = pages.select(F.col(id_col).cast("long").alias("id_"), *keep, F.col(html_col).cast("string").alias("html_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p or "") for p in b.column("html_").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lean(run), f"{kinds}, text string, n_chars long").withColumnRenamed("id_", id_col)
