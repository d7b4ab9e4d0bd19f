"""Main text of web pages: the maximum-scoring subsequence of words and tags.

Every word and tag of a page gets a weight: words score positive where pages mark such places as
their article, tags score negative. One linear scan finds the contiguous stretch with the largest
sum; its blocks are the text. Class names and elements that hint at page furniture are weights too: a
block whose hints outweigh its words is cut out of the stretch. Hints on what wraps the article don't
count. The weights are log ratios of counts on labelled pages, which are the pages that mark their
article themselves. A page takes time in proportion to its length, however malformed it is.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A quote opens a value only behind "="; one that is never closed is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HINT = re.compile(
    r"(?:^|[\s_-])(?<!\bno[_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?:"
    r"(ads?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|menus?|breadcrumbs?|pagination|pager|sidebars?|aside|widgets?|headers?|masthead|copyright"
    r"|replies|respond|disqus|social|shar(?:e|es|ing)|follow|related|newsletter|signup|login|forms?|tags?|tracking|complementary|contentinfo|toolbar)"
    r"|(advert|sponsor|promo|nav|foot|comment|recommend|subscribe|search|skip)\w*)(?=$|[\s_-])",
    re.I,
)
#: Fixed values of HTML: elements that never hold text to read, those of them that hold no markup, elements of
#: page furniture, and elements that have no end tag, don't break a line of text, or do.
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video head select option button datalist".split())
_PLAIN = frozenset("script style noscript template textarea title iframe".split())
_IN_HEAD = frozenset("title meta link script style base noscript template head".split())
_FURNITURE = frozenset("nav aside footer form dialog menu fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = (_RAW - {"head"}) | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meta q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
_BLOCK = frozenset("html body div section article main header p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary center".split())
_HOLDS = frozenset("html body div section article main".split())
#: An open element that a new one closes, unless one of the others was opened since.
_CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_NAMED = _RAW | _FURNITURE | _VOID | _INLINE | _BLOCK
#: Hints of blocks that may well be longer than the article, and so are never taken for its wrapper.
_FIRM = frozenset("<nav> <aside> <footer> <dialog> <menu> comment replies respond disqus".split())
_COMMENTS = frozenset("comment replies respond disqus".split())
_HEADERS = frozenset("header headers masthead".split())
_NONE: frozenset[str] = frozenset()


def _attributes(more: str) -> tuple[frozenset[str], bool, bool]:
    """(hints of furniture, invisible, role of main content) of a start tag's attributes."""
    names, hidden, main, hints = [], False, False, set()
    for name, a, b, c in _ATTRIBUTE.findall(more):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            names.append(value)
            main = main or value.strip().lower() == "main"
        elif name == "hidden" or name == "style" and _INVISIBLE.search(value):
            hidden = True
        elif name == "aria-hidden" and value.lower() == "true":
            hints.add("aria-hidden")
    for word, stem in _HINT.findall(" ".join(names)):
        hints.add((word or stem).lower())
    return frozenset(hints), hidden, main


_known_attributes = lru_cache(4_096)(_attributes)


class _Element:
    __slots__ = ("parent", "tag", "hints", "hidden", "marks", "words", "active", "root", "link", "holder", "weight")

    def __init__(self, parent: _Element | None, tag: str, hints: frozenset[str], hidden: bool, marks: str):
        self.parent, self.tag, self.hints, self.hidden, self.marks, self.words = parent, tag, hints, hidden, marks, 0
        self.active, self.root, self.link, self.holder, self.weight = _NONE, False, False, "", 0.0


def _parse(page: str) -> tuple[list[_Element], list[tuple]]:
    """The page's elements, parents first, and its tokens: (element, tag's name) and
    (element, "", text, number of words, whether a block begins here).

    An end tag closes the nearest open element of its name (one within a line none beyond its block), a
    block closes an open paragraph, an item the item before it, the page's end everything.
    """
    top = _Element(None, "", _NONE, False, "")
    elements, found, stack, depths, blocks = [top], [], [top], defaultdict(list), [0]
    breaks, at = True, 0

    def close(to: int) -> None:
        while len(stack) > to:
            depths[stack.pop().tag].pop()
            blocks.pop()

    while at < len(page):
        for m in _TOKEN.finditer(page, at):
            end, name, more = m.group(1), m.group(2), m.group(3)
            at = m.end()
            if name is None:
                text = m.group(0)
                if not text.startswith("<") or len(text) == 1:
                    n = len(text.split())
                    found.append((stack[-1], "", text, n, breaks))
                    stack[-1].words += n
                    breaks = False
                continue
            name = name.lower()
            inline = name in _INLINE
            if not inline:
                breaks = True
            known = name if name in _NAMED else "other"
            if end:
                if name not in _PLAIN:
                    found.append((stack[-1], "/" + known))
                if depths[name] and (not inline or blocks[-1] == blocks[depths[name][-1]]):
                    close(depths[name][-1])
                continue
            if stack[-1].tag == "head" and name not in _IN_HEAD:
                close(len(stack) - 1)
            if not inline and depths["p"] and blocks[-1] == blocks[depths["p"][-1]]:
                close(depths["p"][-1])
            if name in _CLOSES:
                mine, over = (max((depths[x][-1] for x in names if depths[x]), default=0) for names in _CLOSES[name])
                if mine > over:
                    close(mine)
            if name not in _PLAIN:
                found.append((stack[-1], known))
            if name == "br":
                found.append((stack[-1], "", " ", 0, False))
            if name in _VOID or name not in _HOLDS and _SELF_CLOSED.search(more):
                continue
            if name in _PLAIN:
                last = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                at = last.start() if last else len(page)
                break
            hints, hidden, main = (_NONE, False, False) if not more else _known_attributes(more) if len(more) < 500 else _attributes(more)
            marks = name if name in ("article", "main") else "main" if main else ""
            if marks:
                hints = hints & _COMMENTS
            elif inline or name in ("html", "body"):
                hints = _NONE
            if name in _FURNITURE:
                hints = hints | {f"<{name}>"}
            elif name == "header":
                hints = hints | {"header"}
            e = _Element(stack[-1], name, hints, hidden or name in _RAW, marks)
            depths[name].append(len(stack))
            blocks.append(blocks[-1] + (not inline))
            elements.append(e)
            stack.append(e)
    return elements, found


def _settle(elements: list[_Element]) -> bool:
    """Which hints count where, and what the marked article is; whether there is one.

    The roots are the articles that stand in no other and in no comments, or else such main elements. A hint doesn't
    count on what holds the only roots, nor, unless it is firm, on what holds over half of the page's
    words; in a root a header's doesn't.
    """
    for e in elements:
        e.hidden = e.hidden or e.parent is not None and e.parent.hidden
        e.link = e.tag == "a" or e.parent is not None and e.parent.link
        e.holder = (e.tag if e.tag in _NAMED or not e.tag else "other") if e.tag not in _INLINE else e.parent.holder
    for e in reversed(elements):
        if e.parent is not None and not e.hidden:
            e.parent.words += e.words
    roots: list[_Element] = []
    for kind in ("article", "main"):
        inside: dict[int, tuple[bool, bool]] = {}
        clear: list[_Element] = []
        wrapped: list[_Element] = []
        for e in elements:
            within, hinted = inside[id(e.parent)] if e.parent is not None else (False, False)
            hinted = hinted or bool(e.hints)
            if e.marks == kind and not within and not e.hidden and not e.hints & _COMMENTS:
                (wrapped if hinted else clear).append(e)
                within = True
            inside[id(e)] = within, hinted
        roots = clear or [max(wrapped, key=lambda e: e.words)] if clear or wrapped else []
        if roots:
            break
    holders: set[int] = set()
    for e in roots:
        e.root = True
        up = e.parent
        while up is not None and id(up) not in holders:
            holders.add(id(up))
            up = up.parent
    half = elements[0].words / 2
    for e in elements[1:]:
        up = e.parent
        own = e.hints
        if e.root or id(e) in holders:
            own = _NONE
        elif own and e.words > half:
            own = own & _FIRM
        if own and up.root:
            own = own - _HEADERS
        e.active = up.active if own <= up.active else up.active | own
        e.root = e.root or up.root
    return bool(roots)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each feature stands at a word, and each tag, in and out of the marked article. Words with
    hints count as out, and for their hints alone: a list in a menu says nothing about lists."""
    for batch in batches:
        found: Counter = Counter()
        for page in batch["html"]:
            if not page:
                continue
            elements, seen = _parse(page)
            if not _settle(elements):
                continue
            for t in seen:
                e = t[0]
                if e.hidden:
                    continue
                if t[1]:
                    if not e.active:
                        found["tag:" + t[1], e.root] += 1
                elif e.active:
                    for h in e.active:
                        found["hint:" + h, False] += t[3]
                else:
                    for f in _features(e):
                        found[f, e.root] += t[3]
        keys = list(found)
        yield pd.DataFrame({"feature": [k[0] for k in keys], "inside": [bool(k[1]) for k in keys], "n": [found[k] for k in keys]})


def _features(e: _Element) -> list[str]:
    return ["in:" + e.holder] + ["link"] * e.link + ["article"] * e.root


def learn_weights(pages: DataFrame, html_col: str = "html", prior: float = 2.0) -> dict[str, float]:
    """Log ratios of the features' counts in and out of marked articles, over all labelled pages.

    A page is labelled if it marks an article or main element. Features are HTML's elements and the
    stems of hints, so they are a few hundred whatever the pages hold; other elements are one feature."""
    rows = pages.select(F.col(f"`{html_col}`").alias("html")).mapInPandas(_count, "feature string, inside boolean, n long")
    counts = rows.groupBy("feature").agg(F.sum(F.expr("IF(inside, n, 0)")).alias("a"), F.sum(F.expr("IF(inside, 0, n)")).alias("b"))
    return {r["feature"]: math.log((r["a"] + prior) / (r["b"] + prior)) for r in counts.collect()}


def main_text(page: str | None, weights: dict[str, float], word: float = 1.0, tag: float = -0.5, hint: float = -2.0, link: float = -1.2, cut: float = -0.5) -> str:
    """Blocks of the best stretch, each on one line. ``word``, ``tag``, ``hint`` and ``link`` are the
    weights of a word, a tag, a hint of furniture and a link before anything was learned. A word whose hints
    outweigh it is cut, and costs ``cut``, or nothing in a marked article."""
    if not page:
        return ""
    elements, seen = _parse(page)
    _settle(elements)
    for e in elements:
        if e.active:
            unit = word + sum(weights.get("hint:" + h, hint) for h in e.active)
        else:
            unit = word + sum(weights.get(f, link if f == "link" else 0.0) for f in _features(e))
        e.weight = max(-6.0, min(6.0, unit))
    tags = {t: min(-0.05, max(-4.0, tag + min(0.0, weights.get("tag:" + t, 0.0)) / 4)) for t in {t[1] for t in seen}}
    best = total = 0.0
    begin, chosen = 0, (0, 0)
    for at, t in enumerate(seen):
        e = t[0]
        if e.hidden:
            score = 0.0
        elif t[1]:
            score = 0.0 if e.active else tags[t[1]]
        elif e.active and e.weight < 0:
            score = 0.0 if e.root else cut * t[3]
        else:
            score = e.weight * t[3]
        if total <= 0:
            total, begin = 0.0, at
        total += score
        if total > best:
            best, chosen = total, (begin, at + 1)
    blocks: list[list[str]] = []
    for at, t in enumerate(seen[: chosen[1]]):
        e = t[0]
        if t[1] or e.hidden or e.active and e.weight < 0:
            continue
        if t[4] or not blocks or at == chosen[0]:
            blocks.append([])
        if at >= chosen[0]:
            blocks[-1].append(t[2])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None) -> Column:
    """The main text as a column. Null and empty pages, and pages without a stretch that scores above
    zero, give an empty string; equal pages give equal texts; whole pages are read however long.
    Without ``weights`` a job over ``pages`` learns them first."""
    learned = learn_weights(pages, html_col) if weights is None else weights

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, learned) for p in batch], dtype=object)

    return run(F.col(f"`{html_col}`"))
