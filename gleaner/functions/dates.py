"""Date and number parsing; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where pages state their date, in order of trust.
PUBLISHED = [
    r'"datePublished"\s*:\s*"([^"]+)"',
    r"""<meta[^>]+property=["']article:published_time["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+content=["']([^"']+)["'][^>]+property=["']article:published_time["']""",
    r"""<meta[^>]+itemprop=["']datePublished["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+name=["']pubdate["'][^>]+content=["']([^"']+)["']""",
    r"""<time[^>]+datetime=["']([0-9]{4}-[0-9]{2}-[0-9]{2}[^"']*)["']""",
]


def iso_date(c: Column) -> Column:
    """The day of an ISO date or time in its own offset, with the epoch second: struct(day, ts)."""
    day = F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1)
    moment = F.coalesce(F.try_to_timestamp(F.trim(c)), F.try_to_timestamp(day))
    return F.when((day != "") & moment.isNotNull(), F.struct(day.alias("day"), F.unix_timestamp(moment).alias("ts")))


def published(html: Column) -> Column:
    """The first readable date that a page states, as :func:`iso_date` gives it."""
    return F.coalesce(*[iso_date(F.regexp_extract(html, p, 1)) for p in PUBLISHED])


def _first_format(c: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def central_bank_date(c: Column) -> Column:
    """Dates such as "Jun 05, 2024", "June 5 2024" and "5 June 2024", with stray commas and points around."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[.,\s]+|[.,\s]+$", ""), r"\s+", " ")
    return _first_format(clean, ["MMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "d MMM yyyy"])


def market_regulator_date(c: Column) -> Column:
    return _first_format(F.trim(c), ["MMM d, yyyy"])


def insurance_regulator_date(c: Column) -> Column:
    """Null for placeholders without a digit."""
    return F.when(c.rlike("[0-9]"), _first_format(F.trim(c), ["d-M-yyyy"]))


def exchange_date(c: Column) -> Column:
    return _first_format(F.initcap(F.trim(c)), ["d-MMM-yyyy"])


def number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def whole(c: Column) -> Column:
    return number(c).try_cast("bigint")


def token_estimate(words: Column, factor: float = 1.333) -> Column:
    return F.floor(words * factor).cast("long")


def json_ld_body(html: Column, least: int = 200) -> Column:
    """The first articleBody of at least so many bytes in a page's JSON-LD, in an object, a list or a graph."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    found = F.flatten(F.transform(scripts, lambda s: F.array(*[F.get_json_object(s, p) for p in ("$.articleBody", "$[0].articleBody", "$[1].articleBody", "$['@graph'][0].articleBody", "$['@graph'][1].articleBody")])))
    return F.try_element_at(F.filter(found, lambda b: F.octet_length(b) >= least), F.lit(1))


def fenced_json(c: Column) -> Column:
    """The JSON inside a code fence of a reply; the reply itself where there is none that parses."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner).otherwise(c)
