"""URL functions as column expressions (Catalyst sees through them; no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcrawl.functions.fixed import IGNORED_EXTENSIONS, LINK_EXTENSIONS, LINK_HOSTS, MEDIA_TYPES, MOST_BYTES, TRACKING_KEYS

_HOST, _PATH, _QUERY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", "^[^?#]*\\?([^#]*)"


def with_scheme(url: Column) -> Column:
    u = F.trim(url)
    return F.when(u.rlike("^(?i)https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def netloc(url: Column) -> Column:
    """What stands between the scheme and the path, as written; empty without a scheme."""
    return F.regexp_extract(url, _HOST, 1)


def host(url: Column) -> Column:
    """Lower-case network location without www. and the default ports."""
    h = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.regexp_replace(F.regexp_replace(h, "^www\\.", ""), ":(80|443)$", "")


def path(url: Column) -> Column:
    """Path with single slashes and none at its end; the root is one slash."""
    p = F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+", "/")
    p = F.regexp_replace(p, ";[^/]*$", "")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    """Parameters with a value, without tracking keys, by key; empty if none is left."""
    pairs = F.split(F.regexp_extract(url, _QUERY, 1), "&")
    kept = F.filter(pairs, lambda p: p.rlike("^[^=]+=.") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING_KEYS))
    return F.array_join(F.sort_array(kept), "&")


def normalize(url: Column) -> Column:
    """The canonical https form of a URL; null for too short ones, those without a host, and ignored file types."""
    u = with_scheme(url)
    q = query(u)
    whole = F.concat(F.lit("https://"), host(u), path(u), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    bad = (F.length(F.trim(url)) < 10) | (host(u) == "") | F.lower(F.regexp_extract(u, _PATH, 1)).rlike(f"\\.({'|'.join(IGNORED_EXTENSIONS)})$")
    return F.when(url.isNotNull() & ~bad, whole)


def domain(url: Column) -> Column:
    """Lower-case network location without www., port kept."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), "^www\\.", "")


def priority(url: Column, depth: Column | int = 0, source: Column | int = 0) -> Column:
    """100 and the source's priority, more for short paths and news, less for archives and depth; 1 at least."""
    u = F.lower(url)
    bonus = F.when(u.endswith("/") | (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) <= 3), 20).otherwise(0)
    bonus += F.when(u.rlike("news|blog|article|post"), 10).otherwise(0)
    bonus -= F.when(u.rlike("archive|tag|category|page="), 15).otherwise(0)
    return F.greatest(F.lit(1), F.lit(100) + source + bonus - F.lit(10) * depth).cast("int")


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def fuzzy_hash(url: Column) -> Column:
    return F.md5(F.lower(F.concat(F.regexp_extract(url, _HOST, 1), F.regexp_extract(url, _PATH, 1))))


def link_target(href: Column, base: Column) -> Column:
    """The absolute form of an http(s) or relative link without its fragment; null for what is never followed.

    Relative forms: //host/..., /path, ?query and path (resolved against the base's directory; dot segments stay).
    """
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme, site = F.lower(F.regexp_extract(base, "^([A-Za-z]+):", 1)), F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    directory = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    directory = F.when(directory.endswith("/"), directory).otherwise(F.concat(directory, F.lit("/")))
    whole = (
        F.when(h.rlike("^(?i)https?://"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(h.startswith("/"), F.concat(site, h))
        .when(h.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), h))
        .when(h == "", F.regexp_extract(base, "^([^#]*)", 1))
        .otherwise(F.concat(directory, h))
    )
    at, p = F.lower(F.regexp_extract(whole, _HOST, 1)), F.regexp_extract(whole, _PATH, 1)
    bad = (at == "") | F.lower(p).rlike(f"\\.({'|'.join(LINK_EXTENSIONS)})$") | at.rlike("|".join(h.replace(".", "\\.") for h in LINK_HOSTS))
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    rest = F.regexp_extract(whole, "^[^?#]*(\\?[^#]*)", 1)
    return F.when(~bad, F.concat(F.lower(F.regexp_extract(whole, "^([A-Za-z]+)", 1)), F.lit("://"), at, p, rest))


def registered_domain(url: Column) -> Column:
    """The last two labels of the host; three behind a two-letter country and a short second label."""
    h = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), ":[0-9]+$", "")
    three = F.regexp_extract(h, "([^.]+\\.(?:co|com|ac|gov|org|net|edu)\\.[a-z]{2})$", 1)
    return F.when(three != "", three).otherwise(F.regexp_extract(h, "([^.]+\\.[^.]+)$", 1))


def valid_content(media_type: Column, length: Column) -> Column:
    """struct(ok, reason) of a response's media type and length."""
    main = F.lower(F.trim(F.regexp_extract(F.coalesce(media_type, F.lit("")), "^([^;]*)", 1)))
    reason = F.when((main != "") & ~main.isin(*MEDIA_TYPES), "unsupported content type").when(length > MOST_BYTES, "content too large")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def charset(media_type: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(media_type, F.lit("")), "charset=[\"']?([A-Za-z0-9_.:-]+)", 1))
    return F.when(found == "", "utf-8").otherwise(found)


def crawl_id(dom: Column, url: Column, ts: Column) -> Column:
    """domain:8 hex digits:epoch; the same row always gets the same id."""
    return F.concat_ws(":", dom, F.left(F.md5(F.concat(F.sha2(url, 256), ts.cast("string"))), F.lit(8)), F.unix_timestamp(ts.cast("timestamp")).cast("string"))


def hash_shard(dom: Column, shards: int = 4) -> Column:
    """md5 of the domain modulo a power of two up to 16."""
    return (F.conv(F.right(F.md5(dom), F.lit(1)), 16, 10).cast("int") % shards).cast("int")
