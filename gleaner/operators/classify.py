"""Document types by title, section and URL, and the filter on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as d


def _cascade(rules: list[tuple[Column, str]]) -> Column:
    out = F
    for condition, kind in rules:
        out = out.when(condition, kind)
    return out.otherwise(d.DEFAULT_TYPE)


def central_bank_type(title: Column, section: Column) -> Column:
    return _cascade([(section.isin("Speeches", "speeches"), "speech"), *((title.rlike(p), kind) for p, kind in d.CENTRAL_BANK_TYPES)])


def market_regulator_type(title: Column, section: Column, url: Column) -> Column:
    return _cascade(
        [
            (section.isin("Speeches", "speeches"), "speech"),
            (title.rlike(d.MARKET_REGULATOR_NOTICE), "individual_notice"),
            (title.rlike(d.MARKET_REGULATOR_ORDER), "individual_order"),
            (title.contains("Appeal No") & title.contains("filed by"), "individual_appeal"),
            (title.rlike(d.MARKET_REGULATOR_PROSPECTUS), "prospectus"),
            (url.rlike(d.MARKET_REGULATOR_FILINGS), "filings"),
        ]
    )


def with_doc_type(df: DataFrame, central_bank: str, market_regulator: str, insurance_regulator: str) -> DataFrame:
    """Set classification['doc_type'] for documents of the three modules; others stay as they are."""
    module = F.lower("module")
    kind = F.when(module == central_bank, central_bank_type(F.col("title"), F.col("section_name"))).when(module == market_regulator, market_regulator_type(F.col("title"), F.col("section_name"), F.col("url"))).when(module == insurance_regulator, F.lit(d.DEFAULT_TYPE))
    old = F.coalesce("classification", F.create_map().cast("map<string,string>"))
    return df.withColumn("classification", F.when(kind.isNull(), F.col("classification")).otherwise(F.map_concat(F.map_filter(old, lambda k, _: k != "doc_type"), F.create_map(F.lit("doc_type"), kind))))


def keep_wanted(df: DataFrame, wanted: tuple[str, ...] = ("speech", "regulatory-notification")) -> DataFrame:
    """Documents whose type contains one of the wanted words; without a type they stay."""
    kind = F.coalesce(F.try_element_at("classification", F.lit("doc_type")), F.lit("speech"))
    test = F.lit(False)
    for w in wanted:
        test = test | kind.contains(w)
    return df.where(test)


def for_insights(df: DataFrame, modules: tuple[str, ...]) -> DataFrame:
    """Wanted documents of some modules, whose names are compared without regard to case; documents without a module go."""
    return keep_wanted(df.where(F.lower("module").isin([m.lower() for m in modules])))


def default_classification(kind: Column | str = d.DEFAULT_TYPE) -> Column:
    """The map that a document starts with: every key is "other", but for its type."""
    others = [F.lit(x) for k in d.CLASSIFICATION_KEYS for x in (k, "other")]
    return F.create_map(*others, F.lit("doc_type"), F.lit(kind) if isinstance(kind, str) else kind)


def recent(df: DataFrame, published: str, days: int, now: Column | None = None) -> DataFrame:
    """Documents published at most so many days before now (seconds since 1970)."""
    now = F.unix_timestamp() if now is None else now
    return df.where(F.coalesce(F.col(published) >= now - days * 86400, F.lit(False)))


#: Bits of a document's processing flags that a regulator's document has from the start.
REGULATOR_FLAGS = 2 | 4 | 8 | 16 | 128 | 256


def with_flags(flags: Column, bits: int = REGULATOR_FLAGS) -> Column:
    """Processing flags with some bits set; none is ever cleared."""
    return F.coalesce(flags, F.lit(0)).bitwiseOR(F.lit(bits))


def long_enough(df: DataFrame, sites: DataFrame, text: str = "text", default: int = 400) -> DataFrame:
    """Documents whose text has at least the bytes that their site (module, min_length) asks for; sites without a number ask for the default."""
    wanted = df.join(sites.select("module", "min_length"), "module", "left")
    return wanted.where(F.octet_length(text) >= F.coalesce("min_length", F.lit(default))).drop("min_length")
