"""Main text of web pages: flat text blocks, classified by a decision tree from word counts and link densities.

A page is cut into flat blocks at block-level tags. A block's features are its word count and link density, those of
the block before and after it, whether it is a heading, its place (PLACES) and whether it stands in a region whose tag,
class or id speaks of menus, adverts, notices, reader comments and the like. A decision tree (Gini) is trained on the
small labelled table in PAGES and graded(): a page there is a row of blocks with word count, linked words and label.
The tree asks for link density and word counts first: of splits that are equally good the one on the earlier feature
is taken. Menus and link lists go by link density (theirs and their neighbours'), prose outside articles stays by its
and its neighbours' word counts; what only a region tells (a long comment, a long footer) goes by the region.

Blocks of scripts, styles, heads, forms and hidden elements are never text. An article inside a form is read: the form
then wraps the page. A region that was never closed ends where an article begins, but for those in LASTING: articles
in them are comments or teasers.

Defined results: null or empty html has empty text; unclosed tags, quotes, comments and cut-off pages are read as far
as they go; every block is judged, however many, in time linear in the page however deep its elements are nested;
repeated rows give equal results.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomcrawl.llm.common import map_batches, table

BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements without text of their own that is read, and of those the ones whose content is no markup.
DROPPED = frozenset("head script style noscript template svg select option button textarea iframe object form canvas audio video datalist".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that may stand in a head; any other one ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: A tag of these ends one of its kind that is open, if only _LOOSE ones stand between.
_ENDING = frozenset("p li td th tr dt dd option".split())
_LOOSE = frozenset("b i em strong a span u p small font".split())

BOILER_TAGS = frozenset(("nav", "footer", "aside", "menu", "dialog", "search"))
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share sharing social related recommended comment comments reply replies disqus login signup widget copyright legal pagination pager toolbar".split()
)
LASTING = frozenset("comment comments reply replies disqus related recommended sidebar aside footer".split())
#: Class words of elements that hold the text where a page has no article.
MAIN_WORDS = frozenset("main article post entry story".split())
#: Class words before a boiler word that say something of the page and not of the element ("has-sidebar").
_ABOUT = frozenset("has have with no not without show hide is".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: A whole tag behind its name, where all is as it should be; else _attributes() reads one attribute after another.
_PLAIN = re.compile(r"""(?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`/][^\s"'=<>`]*+))?+)*+\s*+/?>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE, _WORD, _VALUE = re.compile(r"[\s/]*+"), re.compile(r"[^\s=>/][^\s=>/]*+"), re.compile(r"[^\s>]*+")
_ASKED = re.compile(r"(?i)class|id|role|hidden|style")
_NONE = re.compile(r"(?i)display\s*:\s*none")
_TOKENS = re.compile(r"[\s,;]+")
_PARTS = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_density: float
    heading: int
    within: int  # 2: an article, 1: an element that speaks of the main text, 0: neither
    hint: int


def region_words(value: str) -> set[str]:
    """The words of a class, id or role, in lower case; a token like "has-sidebar" gives none."""
    found: set[str] = set()
    for token in _TOKENS.split(value):
        parts = [p for p in _PARTS.split(token if token.islower() else re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if p]
        if parts and parts[0] not in _ABOUT:
            found.update(parts)
    return found


class _Element:
    """What holds in an open element: dropped (0, 1, or 2: only by a form), boiler region, lasting region, and so on."""

    __slots__ = ("tag", "dropped", "hint", "lasting", "within", "link", "tight", "blocks")

    def __init__(self, tag, dropped, hint, lasting, within, link, tight, blocks):
        self.tag, self.dropped, self.hint, self.lasting, self.within, self.link = tag, dropped, hint, lasting, within, link
        self.tight, self.blocks = tight, blocks  # how many of the open elements up to it aren't loose, and are blocks


_ROOT = _Element("", 0, 0, 0, 0, 0, 0, 0)


class _Reader:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[_Element] = [_ROOT]
        self.places: dict[str, list[int]] = {}  # of every tag where it is open
        self.parts: list[str] = []
        self.linked = self.heading = 0

    def text(self, s: str) -> None:
        top = self.stack[-1]
        if top.dropped:
            return
        self.parts.append(s)
        if top.link:
            self.linked += len(s.split())

    def cut(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            words = (entities.unescape(text) if "&" in text else text).split()
            if words:
                top = self.stack[-1]
                self.blocks.append(Block(" ".join(words), len(words), min(1.0, self.linked / len(words)), self.heading, top.within, int(top.hint > 0)))
            self.parts, self.linked = [], 0

    def pop(self, to: int) -> None:
        """Closes the open elements from place `to` on."""
        for e in self.stack[to:]:
            self.places[e.tag].pop()
            if e.tag in HEADINGS:
                self.heading = 0
        del self.stack[to:]

    def open(self, tag: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        stack, places = self.stack, self.places
        if tag not in _IN_HEAD and tag != "head" and places.get("head"):
            self.pop(places["head"][-1])
        if tag in BLOCK:
            self.cut()
            if tag in _ENDING and places.get(tag):
                k = places[tag][-1]
                if stack[-1].tight == stack[k].tight:
                    self.pop(k)
        if tag in VOID or closed and tag not in BLOCK:
            return
        top = stack[-1]
        dropped, hint, lasting, within, words, hidden = top.dropped, top.hint, top.lasting, top.within, set(), False
        for name, value in attributes:
            name = name.lower()
            if name in ("class", "id", "role"):
                words |= region_words(value.strip("\"'"))
            elif name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true" or name == "style" and _NONE.search(value):
                hidden = True
        if tag in ("html", "body"):
            words = set()
        bad = tag in BOILER_TAGS or bool(words & BOILER_WORDS) or not within and (tag == "header" or "header" in words and tag not in HEADINGS)
        if tag == "article" and not bad:
            if not lasting:
                within, hint = 2, 0
            if dropped == 2:
                dropped = 0
        elif not bad and (tag == "main" or words & MAIN_WORDS and tag in ("div", "section", "td", "main")):
            within, hint = max(within, 1), hint if lasting or within else 0
            if dropped == 2 and tag == "main":
                dropped = 0
        elif bad:
            hint, lasting = hint + 1, lasting or int(tag in LASTING or bool(words & LASTING))
        if tag in DROPPED or hidden:
            dropped = 2 if tag == "form" and not hidden and dropped in (0, 2) else 1
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Element(tag, dropped, hint, lasting, within, int(top.link or tag == "a"), top.tight + (tag not in _LOOSE), top.blocks + (tag in BLOCK)))
        if tag in HEADINGS:
            self.heading = 1

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        if not self.places.get(tag):
            return
        k = self.places[tag][-1]
        if tag not in BLOCK and tag not in DROPPED and self.stack[-1].blocks > self.stack[k].blocks:
            return  # an inline end doesn't close blocks
        self.pop(k)


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[list[tuple[str, str]], int]:
    """Attributes of a tag that isn't well written, and where it ends. A quote that is never closed is a letter."""
    found, n = [], len(page)
    while True:
        at = _SPACE.match(page, at).end()
        if at >= n:
            return found, n
        if page[at] == ">":
            return found, at + 1
        if page[at] == "=":
            at += 1
            continue
        m = _WORD.match(page, at)
        at, value = _SPACE.match(page, m.end()).end(), ""
        if at < n and page[at] == "=":
            at += 1
            while at < n and page[at].isspace():
                at += 1
            if at < n and page[at] in "\"'" and last[page[at]] > at:
                end = page.index(page[at], at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                v = _VALUE.match(page, at)
                value, at = v[0], v.end()
        found.append((m[0], value))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in its order."""
    r, at, n = _Reader(), 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while at < n:
        lt = page.find("<", at)
        if lt == -1:
            r.text(page[at:])
            break
        if lt > at:
            r.text(page[at:lt])
        following = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end == -1 else end + 3
        elif following in ("!", "?"):
            end = page.find(">", lt)
            at = n if end == -1 else end + 1
        elif following == "/" or following.isascii() and following.isalpha():
            m = _NAME.match(page, lt + 1 + (following == "/"))
            if m is None:
                r.text("<")
                at = lt + 1
                continue
            tag, past = m[0].lower(), m.end()
            whole = _PLAIN.match(page, past)
            if whole is None:
                found, at = _attributes(page, past, last)
            else:
                at = whole.end()
                found = _ATTRIBUTE.findall(whole[0]) if at - past > 4 and _ASKED.search(whole[0]) else []
            if following == "/":
                r.close(tag)
                continue
            r.open(tag, found, page[at - 2] == "/")
            if tag in RAW:
                stop = _RAW_END[tag].search(page, at)
                if tag not in DROPPED and tag != "title":
                    r.text(page[at : stop.start() if stop else n])
                at = stop.start() if stop else n
        else:
            r.text("<")
            at = lt + 1
    r.cut()
    return r.blocks


FEATURES = ("link_density", "words", "link_density_before", "link_density_after", "words_before", "words_after", "heading", "place", "hint")
#: Outside the article of a page that has one; on a page without; in an element that speaks of the main text, on a page
#: without; in the article.
PLACES = {"outside": 0, "none": 1, "main": 2, "article": 3}


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; missing neighbours count as empty."""
    within = np.array([b.within * (not b.hint) for b in found], np.int64)
    most = within.max(initial=0)
    place = np.where(within == 2, 3, 0) if most == 2 else np.where(within == 1, 2, 0) if most == 1 else np.ones(len(found), np.int64)
    density, words = np.array([b.link_density for b in found], float), np.array([b.words for b in found], float)
    before, after = (lambda x: np.append(0.0, x[:-1])[: len(x)]), (lambda x: np.append(x[1:], 0.0)[: len(x)])
    rest = [np.array([b.heading for b in found], float), place, np.array([b.hint for b in found], float)]
    return np.stack([density, words, before(density), after(density), before(words), after(words), *rest], axis=1) if found else np.zeros((0, len(FEATURES)))


#: Labelled pages, their blocks in order: word count, behind a slash how many of the words are linked (* all of them),
#: h before a heading, + behind main text; a name and brackets around a region, of class words or article or main.
PAGES = (
    "nav[1* 1* 2* 1* 2*] ad[12] article[h8+ 20+ 1+ 35+ 14/2+ 60+ 3+] footer[9]",
    "nav[1* 2* 1*] ad[3] article[h5+ 7+] footer[27]",
    "header[2* 8] sidebar[14 3* 3*] main[h4+ 2+ 30+ 2+ 2+ aside[11] 45+ 2+ comments[10 2]] footer[1]",
    "1* 1* 1* h5+ 40+ 32/2+ 12+ 50+ 2* 2* 1* notice[14] 3",
    "1* 2 28+ 3/2 4",
    "2* 2* article[header[h4+] 1+ advert[10] 6+ 6*+ 25+ share[1*] comments[10 32]] newsletter[14]",
    "10* 9* 20+ 3+ 24/2+ 10* 10* 12 10*",
    "1 1 h3+ 24+ 20+ 22+ 1* 1* 1*",
    "nav[1* 1*] article[h7+ 22+ 5+ 18+ 6* 7* 5* 30+ 4*+ 26+ h2 8* 9* 6*] footer[40]",
    "article[h6+ 30+ 25+ comments[h2 25 40 3 60 12]] footer[60]",
    "article[h6+ 30+] comments[h2 25 40 3 60 12 90] notice[33] footer[5 30 80]",
    "30 45/3 article[h9+ 3+ 50+ 1+] 25 40 2 60",
    "nav[2* 2*] h6+ 40+ 5+ 38+ sidebar[20 44 3* 50] 42+ footer[35 60] notice[28 50]",
    "main[h6+ 30+ 4+ 36+ 2+ 41+ 5* 6* 4*] 21 33 footer[20]",
    "main[h3+ 1+ 17+ 9+ 25/5+ 8+] comments[15 30 45]",
    "3* 3* 4* 2 h4+ 18+ 33+ 7+ 41/3+ 29+ h2 7* 8* 6* 5* 2 1* 1*",
    "4 2* 3* 55+ 70+ 6+ 48+ 2+ 90+ 3 2* 2* 5",
    "2* 1* 3* 3* h7+ 35+ h3+ 28+ 44+ h2+ 61+ 3* 4* 2*",
    "cookie[40 12 2*] 2* 2* h5+ 25+ 31+ 9+ 27+ legal[50] 2*",
    "main[h5+ 22+ 16+ 3* 4*+ 20+] related[h2 7* 12 6* 15]",
    "main[h5+ 26+ 5*+ 19+ 12*+ 33+ 6* 4* 8* 5*]",
    "14* 12* 11* 13* 16* 2 15* 12*",
    "1* 1* 30+ 45+ 1* 1* 30* 45* 20*",
    "article[h4+ 12+ 9*+ 3+ h3+ 2+ 2+ 2+ 15/6+ 18/9+ 1*+ 16+] 9 4*",
    "article[2/1+ 5/2+ 7+ 3/1+ 4/2+] 3/1 4/2",
    "32+",
    "h5+ 19+",
    "h4+ 27+ 40+ 3+ 65+",
    "h2+ 24+ 31/4+ 18+ 2* 3* 2*",
    "1* 2* 1* 90+ 12+ 28+",
    "2* 2* h6+ 16+ 22+ 4+ 37+ 5 2* 1* 2*",
    "3 2 4 1* 2*",
)


def graded() -> list[str]:
    """Pages by rule: every size of block in every place, with the label that only the place tells."""
    out, sizes = [], (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233)
    menu = "nav[1* 2* 1* 1* 3* 2* 1* 2* 1* 2* 4* 1*]"
    for n, m in zip(sizes, (*sizes[5:], *sizes[:5]), strict=True):
        for region in ("footer", "cookie", "comments", "ad"):
            out.append(f"{menu} {region}[{n}] article[h{min(n, 13)}+ {n}+ {region}[{m} {n}] {m}+] {region}[{n} {m}]")
            out.append(f"{region}[{n}] {menu} main[h{min(m, 13)}+ {m + 15}+ {n}+ 40+ {region}[{n} {m}]] {region}[{m}]")
        out.append(f"{menu} {n} {m} article[{n}+ {m}+ {n}+] {m} {n}")
        out.append(f"{menu} h4+ 30+ {n}+ 30+ ad[{m}] 25+ footer[{n} {m}]")
        out.append(f"2* {n}* 1* h4+ 30+ 26+ {n}* {m}* {n}*")
        out.append(f"article[h5+ {n}+ {m}* {n}* {m}* {n}+ {n}*+ {m}+] {n}* {m}*")
    return out


_TOKEN = re.compile(r"(\w+)\[|(h?)(\d+)(?:/(\d+)|(\*))?(\+)?|(\])|\s+")


def labelled_page(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels (1: main text) of a page in the notation of PAGES."""
    found, labels, around = [], [], [(0, 0)]
    for m in _TOKEN.finditer(page):
        region, h, words, linked, whole, main, end = m.groups()
        within, hint = around[-1]
        if region:
            own = {"article": 2, "main": 1}.get(region, 0)
            boiler = region in BOILER_TAGS or region in BOILER_WORDS or region == "header" and not within
            around.append((max(within, own), hint + boiler))
        elif words:
            n = int(words)
            found.append(Block("", n, 1.0 if whole else int(linked or 0) / n, int(bool(h)), within, int(hint > 0)))
            labels.append(int(bool(main)))
        elif end:
            around.pop()
    return found, labels


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and label (1: main text) of every block of these pages."""
    pages = [labelled_page(p) for p in (*PAGES, *graded())]
    return np.vstack([features(found) for found, _ in pages]), np.array([x for _, labels in pages for x in labels])


def grow(x: np.ndarray, y: np.ndarray):
    """A decision tree: a label, or (feature, threshold, tree at or below it, tree above it).

    The split of least Gini impurity; of equals the one on the earlier feature, then the lower.
    """
    if y.min() == y.max():
        return int(y[0])
    best = None
    for f in range(x.shape[1]):
        values, place = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        size, ones = np.bincount(place), np.bincount(place, y)
        n, k = np.cumsum(size)[:-1], np.cumsum(ones)[:-1]
        rest, others = len(y) - n, y.sum() - k
        cost = 2 * (k * (n - k) / n + others * (rest - others) / rest)
        at = int(np.argmin(cost.round(9)))
        if best is None or cost[at] < best[0] - 1e-9:
            best = (float(cost[at]), f, float(values[at] + values[at + 1]) / 2)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low]), grow(x[~low], y[~low])


def judge(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, bool)
    f, t, low, high = tree
    out, side = np.zeros(len(x), bool), x[:, f] <= t
    out[side], out[~side] = judge(low, x[side]), judge(high, x[~side])
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, judge(tree, features(found)), strict=True) if keep)


def extract_main(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The id columns, text and n_chars (code points) of every page."""
    at = len(id_cols)

    def make():
        tree = grow(*labelled_blocks())

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(p, tree) if p else "" for p in b.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*id_cols, "text", "n_chars"])

        return step

    return map_batches(df.select(*id_cols, html_col), df.select(*id_cols).schema.add("text", "string").add("n_chars", "long"), make)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main(table(spark, sf_dir, "pages"))


QUERIES = {"op5_main_text": op5_main_text}
SQL: dict[str, str] = {}
