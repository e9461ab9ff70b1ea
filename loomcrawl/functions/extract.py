"""Main text of a page by three published kinds of rules over flat text blocks.

A page is cut at block-level tags; a block has its text, its words and those of them inside a link. The cutting and
two of the rules are column expressions; the third looks for the nearest settled block on both sides, which is a
linear pass in an Arrow-batched function. Null pages have no blocks; texts of kept blocks are joined by line feeds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcrawl.functions.fixed import LANGUAGE_WORDS, STOP_WORDS
from loomcrawl.functions.html import strip_spaces
from loomcrawl.functions.text import words

BLOCK_TAGS = ("address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "select", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul")
CUT = f"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:[ \\t\\n\\r/][^>]*)?>"
ENTITIES = (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))
HIDDEN = ("script", "style", "head", "noscript")
OPEN, CLOSE = "\x01", "\x02"

# Thresholds of the stop-word rule (link density, characters, stop-word share).
LINKED, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.2, 70, 200, 0.30, 0.32


def blocks(html: Column) -> Column:
    """array<struct<text, words, linked>> of a page's blocks with words, in page order.

    A link that goes over a block's end counts as linked in the block it begins in.
    """
    x = F.regexp_replace(F.coalesce(html, F.lit("")), f"[{OPEN}{CLOSE}]", " ")
    for tag in HIDDEN:
        x = F.regexp_replace(x, f"(?is)<{tag}[ >].*?</{tag}>", " ")
    x = F.regexp_replace(x, "(?s)<!--.*?-->", " ")
    x = F.regexp_replace(F.regexp_replace(x, "(?i)<a[ \\t\\n\\r][^>]*>", OPEN), "(?i)</a>", CLOSE)

    def block(raw: Column) -> Column:
        s = F.regexp_replace(raw, "<[^>]*>", "")
        for entity, char in ENTITIES:
            s = F.replace(s, F.lit(entity), F.lit(char))
        linked = F.array_join(F.regexp_extract_all(s, F.lit(f"{OPEN}([^{CLOSE}]*)"), F.lit(1)), " ")
        text = strip_spaces(F.regexp_replace(s, f"[{OPEN}{CLOSE}]", ""))
        return F.struct(text.alias("text"), F.size(words(text)).alias("words"), F.size(words(F.regexp_replace(linked, OPEN, ""))).alias("linked"))

    return F.filter(F.transform(F.split(x, CUT), block), lambda b: b["words"] > 0)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda b: b["text"]), "\n")


def dense_text(blocks: Column) -> Column:
    """Blocks of ten words or more, at most half of them linked, and shorter such ones (three words) beside them."""
    apart = lambda b: b["linked"] * 2 <= b["words"]
    long = lambda b: F.coalesce((b["words"] >= 10) & apart(b), F.lit(False))
    return _joined(F.filter(blocks, lambda b, i: long(b) | ((b["words"] >= 3) & apart(b) & (long(F.get(blocks, i - 1)) | long(F.get(blocks, i + 1))))))


def article_text(blocks: Column) -> Column:
    """The published decision tree over the words and link densities of a block and its neighbours."""

    def keep(b: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        n, was, then = b["words"], F.coalesce(before["words"], F.lit(0)), F.coalesce(after["words"], F.lit(0))
        calm = F.coalesce(before["linked"] * 9 <= before["words"] * 5, F.lit(True))
        return (b["linked"] * 3 <= n) & F.when(calm, (n > 16) | (then > 15) | (was > 4)).otherwise((n > 40) | (then > 17))

    return _joined(F.filter(blocks, keep))


def kinds(texts: list[str], n_words: list[int], n_linked: list[int], stops: frozenset[str]) -> list[bool]:
    """Which blocks the stop-word rule keeps: first each by itself, then unsettled ones by the nearest settled ones."""
    first = []
    for t, n, k in zip(texts, n_words, n_linked, strict=True):
        if k > LINKED * n:
            first.append("bad")
        elif len(t) < SHORT:
            first.append("bad" if k else "short")
        else:
            share = sum(w in stops for w in t.lower().split()) / n
            first.append(("good" if len(t) > LONG else "near") if share >= MANY_STOPS else "near" if share >= FEW_STOPS else "bad")

    def sides(order: range) -> list[tuple[str, bool]]:
        """Of each block the settled kind on one side, and whether a near block comes before it on the way."""
        out, settled, near = [("bad", False)] * len(first), "bad", False
        for i in order:
            out[i] = settled, near
            if first[i] in ("good", "bad"):
                settled, near = first[i], False
            elif first[i] == "near":
                near = True
        return out

    backward = range(len(first) - 1, -1, -1)
    left, right = sides(range(len(first))), sides(backward)
    for i, kind in enumerate(list(first)):
        if kind == "short":
            (a, near_a), (b, near_b) = left[i], right[i]
            first[i] = "good" if a == b == "good" or (a != b and (near_a if a == "bad" else near_b)) else "bad"
    after, before = sides(backward), "bad"
    for i, kind in enumerate(first):
        if kind == "near":
            first[i] = "good" if "good" in (before, after[i][0]) else "bad"
        before = first[i]
    return [k == "good" for k in first]


def stopword_text(blocks: Column) -> Column:
    """Blocks with few links and many English stop words, and what stands between them."""
    stops = frozenset(STOP_WORDS) | frozenset(LANGUAGE_WORDS["en"])

    @F.pandas_udf("string")
    def chosen(texts: pd.Series, n_words: pd.Series, n_linked: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(t for t, k in zip(ts, kinds(ts, ns, ks, stops), strict=True) if k) for ts, ns, ks in zip(texts, n_words, n_linked, strict=True)], dtype=object)

    return chosen(blocks["text"], blocks["words"], blocks["linked"])
