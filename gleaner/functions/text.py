"""Column functions on text and URLs (all native expressions)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dictionaries import FILE_NAME_REPLACEMENTS, TRACKING

ALNUM_RUN = r"[^\p{IsAlphabetic}\p{N}]+"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it inside higher-order functions."""
    return F.get(F.transform(F.array(value), f), 0)


def squeeze(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def canonical_url(c: Column) -> Column:
    """A URL without fragment, tracking parameters and final slash, scheme and host in lower case.

    The slash goes only if there is a path; parameters keep their order.
    """
    bare = F.split_part(F.trim(c), F.lit("#"), F.lit(1))
    base, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    head = F.regexp_extract(base, r"^([^:/]*://[^/]*)", 1)
    lowered = F.when(head != "", F.concat(F.lower(head), F.substr(base, F.length(head) + 1))).otherwise(base)
    path_slashes = F.regexp_count(F.regexp_replace(lowered, r"^.*?://", ""), F.lit("/"))
    cut = F.when((path_slashes > 1) & lowered.endswith("/"), F.substr(lowered, F.lit(1), F.length(lowered) - 1)).otherwise(lowered)
    key = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(TRACKING))
    return F.when(F.size(kept) > 0, F.concat(cut, F.lit("?"), F.array_join(kept, "&"))).otherwise(cut)


def host_of(c: Column) -> Column:
    """The host in lower case, without scheme, path and query."""
    return F.lower(F.regexp_extract(F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^([^/?#]*)", 1))


def path_of(c: Column) -> Column:
    """Path and query, "/" if there is none."""
    rest = F.regexp_extract(F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def resolve_href(href: Column, page: Column) -> Column:
    """An absolute URL for a link on a page; null for links that are no pages."""
    origin = F.regexp_extract(page, r"^([a-zA-Z]+://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"^([a-zA-Z]+:)", 1)
    return F.when(href.startswith("http"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))


def norm_name(c: Column) -> Column:
    """Letters and digits in lower case, everything between as one space."""
    return F.trim(F.regexp_replace(F.lower(c), ALNUM_RUN, " "))


def tokens(c: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(F.lower(c), ALNUM_RUN), lambda w: w != "")


def word_count(c: Column) -> Column:
    """White-space tokens that have a letter A-Z."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike("[A-Za-z]"))).cast("long")


def last_words(c: Column, n: int) -> Column:
    """The last n words, with the line ends among them."""
    parts = F.split(F.trim(c), r"(?<=\S)(?=\s)")
    return F.regexp_replace(F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ""), r"^\s+", "")


def file_safe(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), FILE_NAME_REPLACEMENTS, c)


def xml_escape(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")], c)


def url_encode(c: Column) -> Column:
    """Form encoding with %20 for a space."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def valid_article_url(url: Column, valid: list[str], skip: list[str], least_segment: int = 0, least_depth: int = 0, hyphen: bool = False, suffix: str | None = None) -> Column:
    """Whether a URL looks like an article of a site.

    Depth counts the non-empty parts between slashes, scheme and host among
    them; a URL that ends like an article id may be less deep.
    """
    parts = F.filter(F.split(url, "/"), lambda p: p != "")
    last = F.element_at(parts, -1)
    any_of = lambda patterns, empty: reduce(lambda a, b: a | b, [F.contains(url, F.lit(p)) for p in patterns], F.lit(empty))
    deep = (F.size(parts) >= least_depth) | (url.rlike(suffix) if suffix else F.lit(False))
    return F.coalesce(any_of(valid, False) & ~any_of(skip, False) & (F.length(last) >= least_segment) & (last.contains("-") if hyphen else F.lit(True)) & deep, F.lit(False))


def page_links(html: Column) -> Column:
    """Targets of the links of a page."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?href=["']([^"']*)["']"""), F.lit(1))


def feed_links(xml: Column) -> Column:
    """Distinct links of a site map, RSS or Atom feed, sorted."""
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^(<!\[CDATA\[)+", ""), r"(\]\]>)+$", ""))
    found = [F.regexp_extract_all(xml, F.lit(p), F.lit(1)) for p in (r"(?is)<loc>\s*(.*?)\s*</loc>", r"(?is)<link>\s*(https?://.*?)\s*</link>", r"""(?is)<link[^>]+href=["'](https?://[^"']+)["']""")]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), clean)))


def word_windows(c: Column, most: int) -> Column:
    """Windows of at most ``most`` words that overlap by a tenth (20 words at least)."""
    step = most - max(most // 10, 20)

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) > most, F.filter(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: (i == 0) | (i + most - step < F.size(w)))).otherwise(F.array(F.lit(0)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, most), " "))).otherwise(F.array().cast("array<string>"))

    return bind(F.filter(F.split(c, r"\s+"), lambda x: x != ""), windows)


def tone_panel(c: Column, positive: list[str], negative: list[str], active: list[str]) -> Column:
    """Shares in percent of positive, negative and active words, and what follows from them."""
    some = lambda words: F.array(*[F.lit(x) for x in words])

    def panel(w: Column) -> Column:
        n = F.size(w).cast("double")
        share = lambda f: F.when(n > 0, F.size(F.filter(w, f)) * 100.0 / n).otherwise(0.0)
        return F.struct(share(lambda x: F.array_contains(some(positive), x)).alias("p"), share(lambda x: ~F.array_contains(some(positive), x) & F.array_contains(some(negative), x)).alias("m"), share(lambda x: F.array_contains(some(active), x)).alias("a"), F.size(w).cast("long").alias("n"))

    def fields(x: Column) -> Column:
        return F.struct((x["p"] - x["m"]).alias("tone"), x["p"].alias("positive"), x["m"].alias("negative"), (x["p"] + x["m"]).alias("polarity"), x["a"].alias("activity"), F.lit(0.0).alias("self_group"), x["n"].alias("word_count"))

    return bind(bind(tokens(c), panel), fields)


def quick_tone(c: Column, positive: list[str], negative: list[str]) -> Column:
    """10 (p - n) / (p + n), 0 without such words."""
    w = tokens(c)
    p = F.size(F.filter(w, lambda x: x.isin(positive))).cast("double")
    m = F.size(F.filter(w, lambda x: ~x.isin(positive) & x.isin(negative))).cast("double")
    return F.when(p + m > 0, 10.0 * (p - m) / (p + m)).otherwise(0.0)


def first_offset(lower: Column, phrases: list[str]) -> Column:
    """Byte offset of the first whole-word occurrence of any phrase in a lower-cased text, or null."""
    pattern = r"(?<![A-Za-z0-9_])(?:" + "|".join(sorted((re.escape(p) for p in phrases), key=len, reverse=True)) + r")(?![A-Za-z0-9_])"
    at = F.regexp_instr(lower, F.lit(pattern))
    # Plain containment is much cheaper than the expression and rules most texts out.
    maybe = reduce(lambda a, b: a | b, [lower.contains(p) for p in phrases])
    return F.when(maybe & (at > 0), F.octet_length(F.substr(lower, F.lit(1), at - 1)).cast("long"))


def themes(c: Column, book: dict[str, list[str]]) -> Column:
    """Themes with the offset of their first phrase, by offset; texts under 40 bytes have none."""
    found = lambda lower: F.array(*[F.struct(first_offset(lower, [p.lower() for p in phrases]).alias("char_offset"), F.lit(code).alias("theme")) for code, phrases in book.items()])
    return F.when(F.octet_length(c) >= 40, F.array_sort(F.filter(bind(F.lower(c), found), lambda x: x["char_offset"].isNotNull()))).otherwise(F.array().cast("array<struct<char_offset:bigint,theme:string>>"))


def places(c: Column, gazetteer: list[tuple]) -> Column:
    """Places with their first offset, by offset; overlapping names are all kept."""
    found = lambda lower: F.array(*[F.struct(first_offset(lower, [n.lower()]).alias("char_offset"), F.lit(n).alias("name"), F.lit(f"{cc}/{n.replace(' ', '_')}").alias("feature_id"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.lit(cc).alias("country"), F.lit(adm).alias("adm1"), F.lit("").alias("adm2")) for n, lat, lon, adm, cc in gazetteer])
    return F.when(F.octet_length(c) >= 40, F.array_sort(F.filter(bind(F.lower(c), found), lambda x: x["char_offset"].isNotNull())))


def first_match(c: Column, patterns: list[str], otherwise: Column) -> Column:
    """The first group of the first pattern that matches, else another value."""
    found = [F.regexp_extract(c, p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found], otherwise)


def before(c: Column, pattern: str) -> Column:
    """What stands before the first match, trimmed."""
    return F.regexp_replace(F.get(F.split(c, pattern, 2), 0), r"^\s+|\s+$", "")


def split_keeping(c: Column, pattern: str) -> Column:
    """Parts of a text cut at matches; each match begins the next part."""
    return F.split(c, f"(?={pattern})")


def table_name(c: Column) -> Column:
    return F.translate(c, "- .", "___")


def fixed_url(c: Column, base: Column) -> Column:
    """An absolute URL from what a page gives, or null if it is none."""
    whole = F.when(c.rlike(r"^https?://"), c).when(c.startswith("//"), F.concat(F.lit("https:"), c)).when(c != "", F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(c, "^/+", "")))
    return F.when(whole.rlike(r"^https?://[^/\s]+\S*$"), whole)
