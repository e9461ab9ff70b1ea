"""Page metadata, links and text by regular expressions: stays in the JVM, for pages of ordinary markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))


def title(html: Column) -> Column:
    return F.left(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(200))


def meta(html: Column, name: str, most: int) -> Column:
    return F.left(F.trim(F.regexp_extract(html, f"(?is)<meta[^>]*name=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)", 1)), F.lit(most))


def lang(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<html[^>]*lang=[\"']([^\"']*)", 1)


def canonical(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)", 1)


def count_links(html: Column) -> Column:
    return F.regexp_count(html, F.lit("(?i)<a [^>]*href="))


def count_images(html: Column) -> Column:
    return F.regexp_count(html, F.lit("(?i)<img [^>]*src="))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("<a href=\"([^\"]*)\""), F.lit(1))


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("<a href=\"[^\"]*\"[^>]*>([^<]*)"), F.lit(1))


def plain_text(html: Column) -> Column:
    """Text without scripts, styles, navigation, header, footer and comments, on one line."""
    x = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "nav", "footer", "header"):
        x = F.regexp_replace(x, f"(?is)<{tag}[ >].*?</{tag}>", " ")
    x = F.regexp_replace(F.regexp_replace(x, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return strip_spaces(x)


def best_content(*candidates: Column) -> Column:
    """The first candidate with more than 200 characters, else the longest with more than 100, else empty."""
    trimmed = [F.trim(F.coalesce(c, F.lit(""))) for c in candidates]
    first = F.coalesce(*[F.when(F.length(t) > 200, c) for t, c in zip(trimmed, candidates, strict=True)])
    ranked = F.array_max(F.array(*[F.struct(F.when(F.length(t) > 100, F.length(c)).otherwise(0).alias("n"), F.lit(-k).alias("k"), c.alias("c")) for k, (t, c) in enumerate(zip(trimmed, candidates, strict=True))]))
    return F.coalesce(first, F.when(ranked["n"] > 0, ranked["c"]).otherwise(""))
