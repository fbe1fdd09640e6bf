"""Listing pages of regulators: table rows with dates carried forward, and the link to prefer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dictionaries import NOTIFICATION_SUMMARY
from ..functions.dates import central_bank_date, exchange_date
from ..functions.select import table_rows
from ..functions.text import resolve_href, squeeze


def preferred_link(links: Column) -> Column:
    """The first link to a page, else to a spreadsheet, else to a PDF."""
    kind = lambda pattern: F.try_element_at(F.filter(links, lambda u: F.lower(u).rlike(pattern)), F.lit(1))
    return F.coalesce(F.try_element_at(F.filter(links, lambda u: ~F.lower(u).rlike(r"\.(pdf|xlsx?)(\?|$)")), F.lit(1)), kind(r"\.xlsx?(\?|$)"), kind(r"\.pdf(\?|$)"))


def listing_rows(pages: DataFrame, selector: str = "table.tablebg tr") -> DataFrame:
    """url, row, title, link, pdf, published: rows with a link, each with the last date row above it."""
    rows = pages.select("url", F.explode(table_rows(selector)(F.col("html"))).alias("r")).select("url", "r.*")
    day = F.when(F.size("links") == 0, central_bank_date(F.get("cells", 0)))
    before = Window.partitionBy("url").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    dated = rows.withColumn("published", F.last(day, ignorenulls=True).over(before)).where(F.size("links") > 0)
    pdf = F.try_element_at(F.filter("links", lambda u: F.lower(u).rlike(r"\.pdf(\?|$)")), F.lit(1))
    return dated.select("url", "row", F.get("cells", 0).alias("title"), resolve_href(preferred_link(F.col("links")), F.col("url")).alias("link"), resolve_href(pdf, F.col("url")).alias("pdf"), "published")


def page_requests(sections: DataFrame, pages: int) -> DataFrame:
    """A row for each section and page number to ask for."""
    return sections.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))


def notification_summary(summary: Column) -> Column:
    """Serial (unique_id), long date and recipients in the summary of a notification; empty where it has another form."""
    part = lambda k: F.regexp_extract(F.regexp_replace(summary, r"\r?\n", " "), NOTIFICATION_SUMMARY, k)
    return F.struct(squeeze(part(2)).alias("unique_id"), part(3).alias("date"), part(5).alias("recipients"))


def circulars(replies: DataFrame, base: str) -> DataFrame:
    """url, title, unique_id and published of each circular in the JSON replies (body) of an exchange's interface; those without a file are left out."""
    kind = "array<struct<filePath:string,subject:string,notif_dt:string,nseCircularNumber:string>>"
    rows = replies.select(F.explode(F.from_json("body", kind)).alias("c")).where("c.filePath is not null")
    text = lambda name: F.coalesce(F.col(f"c.{name}"), F.lit(""))
    return rows.select(F.concat(F.lit(base.rstrip("/")), "c.filePath").alias("url"), text("subject").alias("title"), text("nseCircularNumber").alias("unique_id"), exchange_date(F.col("c.notif_dt")).alias("published"))
