"""Crawl-side operators over tables of URLs, pages and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import host_of, page_links, path_of, resolve_href


def discover_links(pages: DataFrame) -> DataFrame:
    """Distinct absolute URLs that pages link to."""
    each = pages.select("url", F.explode(page_links(F.col("html"))).alias("href"))
    return each.select(resolve_href(F.col("href"), F.col("url")).alias("url")).where(F.col("url").isNotNull()).distinct()


def not_retrieved(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates whose URL is not in the history."""
    return candidates.join(history.select("url").distinct(), "url", "left_anti")


def first_section(urls: DataFrame) -> DataFrame:
    """One row for each URL with the first of its sections (url, section, position)."""
    return urls.groupBy("url").agg(F.min_by("section", "position").alias("section"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, kind, prefix) of the rules that hold for every agent, from (host, body).

    A line "user-agent" sets whether the following rules count; comments and
    empty values don't.
    """
    line = F.trim(F.split_part(F.col("line"), F.lit("#"), F.lit(1)))
    rows = robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")).select("host", "at", F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))
    before = Window.partitionBy("host").orderBy("at")
    agent = F.last(F.when(F.col("name") == "user-agent", F.col("value")), ignorenulls=True).over(before)
    return rows.withColumn("agent", agent).where((F.col("agent") == "*") & F.col("name").isin("allow", "disallow") & (F.col("value") != "")).select("host", F.col("name").alias("kind"), F.col("value").alias("prefix"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and allowed: the longest matching prefix decides, allow wins a tie, no rule allows."""
    u = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    longest = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.length("prefix"))), F.lit(-1))
    matched = u.join(rules, (u.host == rules.host) & F.startswith(u.path, rules.prefix), "left")
    return matched.groupBy("url").agg((longest("allow") >= longest("disallow")).alias("allowed"))


def retryable(status: Column) -> Column:
    return (status >= 500) | status.isin(408, 429)


def backoff_seconds(wait: Column, attempt: Column) -> Column:
    """Exponential backoff of at most a minute, without jitter."""
    return F.least(wait * F.pow(F.lit(2), F.least(attempt, F.lit(5))), F.lit(60)).cast("double")


def status_class(code: Column) -> Column:
    return F.when(code.between(200, 299), "2xx").when(code == 403, "403").when(code == 404, "404").when(code == 408, "timeout").when(code.between(400, 499), "4xx").when(code >= 500, "5xx").otherwise("other")
