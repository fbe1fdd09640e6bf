"""The registered queries, each with its SQL where SQL can express it.

The synthetic prose holds none of the finance vocabulary, so texts for the
extractors are composed from relational columns by an expression that both
engines read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import dictionaries as d
from ..functions import dates, extract, hashing, html, text
from ..operators import assist, chain, chunk, classify, crawl, dedupe, graph, harvest, history, listing, store, vector
from ..sources import archives, documents, market
from ..streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: list[str]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: A sentence about each part, the same in both engines.
STORY = (
    "concat('The bank in ', " + _case("p_partkey", ["Mumbai", "New Delhi", "London", "Londonderry", "Tokyo"]) + ", ' paid Rs ', p_size, "
    + _case("p_partkey", [" crore", " lakh", " million", ""]) + ", ' on 2024-0', 1 + p_partkey % 9, '-1', p_partkey % 10, ' after ', "
    + _case("p_partkey", ["profit growth", "heavy losses and fraud", "a strong rally, then a crash", "nothing much"])
    + ", '; ', p_size + 10, ' branches and ', p_size, ' percent of 2,', 100 + p_size, ' employees; ', "
    + _case("p_partkey", ["SEBI issued a circular on insider trading", "the embankment held", "RBI announced a repo rate cut", "inflation and GDP data were filed"]) + ", ' ', 1 + p_partkey % 28, ' June 2023.')"
)
PARTS = f"(SELECT p_partkey, {STORY} AS text FROM part)"


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(STORY).alias("text"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(f"""
    WITH t AS (SELECT p_partkey, {_WORDS} AS w FROM {PARTS}),
    n AS (SELECT p_partkey, len(w) AS n, len(list_filter(w, lambda x: list_contains({_sql_list(d.POSITIVE)}, x))) AS p,
             len(list_filter(w, lambda x: NOT list_contains({_sql_list(d.POSITIVE)}, x) AND list_contains({_sql_list(d.NEGATIVE)}, x))) AS m,
             len(list_filter(w, lambda x: list_contains({_sql_list(d.ACTIVE)}, x))) AS a FROM t)
    SELECT p_partkey, round(p * 100.0 / n - m * 100.0 / n, 9) AS tone, round(p * 100.0 / n, 9) AS positive, round(m * 100.0 / n, 9) AS negative,
           round(p * 100.0 / n + m * 100.0 / n, 9) AS polarity, round(a * 100.0 / n, 9) AS activity, CAST(n AS BIGINT) AS word_count FROM n""")
def a07_tone_panel(spark, sf_dir):
    panel = stories(spark, sf_dir).select("p_partkey", text.tone_panel(F.col("text"), d.POSITIVE, d.NEGATIVE, d.ACTIVE).alias("t"))
    return panel.select("p_partkey", *[F.round(f"t.{c}", 9).alias(c) for c in ("tone", "positive", "negative", "polarity", "activity")], "t.word_count")


@query(f"""
    WITH t AS (SELECT p_partkey, {_WORDS} AS w FROM {PARTS}),
    n AS (SELECT p_partkey, len(list_filter(w, lambda x: list_contains({_sql_list(d.QUICK_POSITIVE)}, x))) AS p,
            len(list_filter(w, lambda x: NOT list_contains({_sql_list(d.QUICK_POSITIVE)}, x) AND list_contains({_sql_list(d.QUICK_NEGATIVE)}, x))) AS m FROM t)
    SELECT p_partkey, CASE WHEN p + m > 0 THEN 10.0 * (p - m) / (p + m) ELSE 0.0 END::DOUBLE AS tone FROM n""")
def a08_cheap_tone(spark, sf_dir):
    return stories(spark, sf_dir).select("p_partkey", text.quick_tone(F.col("text"), d.QUICK_POSITIVE, d.QUICK_NEGATIVE).alias("tone"))


@query(f"""
    WITH t AS (SELECT p_partkey, {_WORDS} AS w FROM {PARTS}),
    n AS (SELECT p_partkey, len(w)::DOUBLE AS wc, len(list_filter(w, lambda x: list_contains({_sql_list(d.POSITIVE)}, x))) * 100.0 / len(w) AS pos,
            len(list_filter(w, lambda x: NOT list_contains({_sql_list(d.POSITIVE)}, x) AND list_contains({_sql_list(d.NEGATIVE)}, x))) * 100.0 / len(w) AS neg,
            len(list_filter(w, lambda x: list_contains({_sql_list(d.ACTIVE)}, x))) * 100.0 / len(w) AS act FROM t)
    SELECT p_partkey, 'finlex' AS dict_id, dim_id, CASE WHEN dim_id = 'wc' THEN 'c' ELSE 'v' END AS "key",
           round(CASE dim_id WHEN 'wc' THEN wc WHEN 'tone' THEN pos - neg WHEN 'pos' THEN pos WHEN 'neg' THEN neg ELSE act END, 9) AS score
    FROM n, unnest(['wc', 'tone', 'pos', 'neg', 'act']) AS u(dim_id)""")
def m04_gcam(spark, sf_dir):
    panel = stories(spark, sf_dir).select("p_partkey", text.tone_panel(F.col("text"), d.POSITIVE, d.NEGATIVE, d.ACTIVE).alias("t"))
    rows = panel.select("p_partkey", F.inline(store.gcam(F.col("t"))))
    return rows.withColumn("score", F.round("score", 9))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[A-Za-z]'))) AS BIGINT) AS n_words FROM documents")
def a16_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


_CANON = f"""
    WITH b AS (SELECT page_id, split_part(trim(url), '#', 1) AS u FROM pages),
    s AS (SELECT page_id, split_part(u, '?', 1) AS base, CASE WHEN strpos(u, '?') > 0 THEN substr(u, strpos(u, '?') + 1) ELSE '' END AS q FROM b),
    h AS (SELECT page_id, q, lower(regexp_extract(base, '^[^:/]*://[^/]*')) || substr(base, length(regexp_extract(base, '^[^:/]*://[^/]*')) + 1) AS base FROM s),
    c AS (SELECT page_id, q, CASE WHEN length(regexp_replace(base, '^.*?://', '')) - length(replace(regexp_replace(base, '^.*?://', ''), '/', '')) > 1 AND ends_with(base, '/') THEN left(base, length(base) - 1) ELSE base END AS base FROM h),
    p AS (SELECT page_id, base, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND NOT list_contains({_sql_list(d.TRACKING)}, lower(split_part(x, '=', 1)))) AS kept FROM c),
    canon AS (SELECT page_id, CASE WHEN len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END AS url FROM p)"""


@query(_CANON + " SELECT page_id, url FROM canon")
def t02_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
           CASE WHEN starts_with(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1), '/') THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) ELSE '/' || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) END AS path FROM pages""")
def t11_url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"), text.path_of(F.col("url")).alias("path"))


@query(_CANON + " SELECT url, min_by(section, rank) AS section FROM (SELECT url, 'feed' AS section, 0 AS rank FROM canon WHERE page_id % 2 = 0 UNION ALL SELECT url, 'listing', 1 FROM canon) GROUP BY url")
def u02_url_union(spark, sf_dir):
    urls = t02_canonical_url(spark, sf_dir)
    feed = urls.where("page_id % 2 = 0").select("url", F.lit("feed").alias("section"), F.lit(0).alias("position"))
    return crawl.first_section(dedupe.union_all([feed, urls.select("url", F.lit("listing").alias("section"), F.lit(1).alias("position"))]))


@query(_CANON + " SELECT page_id, url FROM canon WHERE url NOT IN (SELECT url FROM canon WHERE page_id % 3 = 0)")
def j01_anti_history(spark, sf_dir):
    urls = t02_canonical_url(spark, sf_dir)
    return crawl.not_retrieved(urls, urls.where("page_id % 3 = 0")).select("page_id", "url")


@query("""
    WITH p AS (SELECT page_id, url, list_filter(string_split(url, '/'), lambda x: x <> '') AS parts FROM pages)
    SELECT page_id, (contains(url, 'example.com/') OR contains(url, 'example.net/')) AND NOT (contains(url, '#') OR contains(url, 'page=')) AND length(parts[-1]) >= 2
           AND (len(parts) >= 5 OR regexp_matches(url, '/[0-9]{3}(\\?.*)?$')) AS valid FROM p""".replace("\\\\", "\\"))
def p06_valid_urls(spark, sf_dir):
    ok = text.valid_article_url(F.col("url"), ["example.com/", "example.net/"], ["#", "page="], 2, 5, False, r"/[0-9]{3}(\?.*)?$")
    return table(spark, sf_dir, "pages").select("page_id", ok.alias("valid"))


_FNV = "list_reduce(list_transform(range(0, CAST(octet_length(encode({0})) AS BIGINT)), lambda i: CAST(concat('0x', substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER)::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


@query("SELECT page_id, 'u' || lower(lpad(hex(CAST(" + _FNV.format("url") + " AS UBIGINT)), 16, '0')) AS doc_id FROM pages")
def t07_fnv_doc_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashing.document_id(F.lit(""), F.col("url")).alias("doc_id"))


_SIMHASH = r"""
    WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}]+', '', 'g')), lambda w: w <> '') AS w FROM documents WHERE octet_length(encode(text)) >= 200),
    u AS (SELECT DISTINCT unnest(w) AS x FROM t),
    f AS (SELECT x, CAST(""" + _FNV.format("x") + r""" AS UBIGINT) AS h FROM u),
    e AS (SELECT doc_id, unnest(w) AS x FROM t),
    j AS (SELECT doc_id, h FROM e JOIN f USING (x)),
    bits AS (SELECT doc_id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM j, range(0, 64) r(i) GROUP BY doc_id, i),
    sim AS (SELECT doc_id, bit_or(CASE WHEN s > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END) AS h FROM bits GROUP BY doc_id)"""


@query(_SIMHASH + " SELECT doc_id, lower(lpad(hex(h), 16, '0')) AS simhash FROM sim")
def a06_simhash(spark, sf_dir):
    return dedupe.fingerprints(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


@query(_SIMHASH + ", d AS (SELECT h, min(doc_id) AS first FROM sim GROUP BY h) SELECT a.first AS first_a, b.first AS first_b FROM d a JOIN d b ON a.first < b.first AND bit_count(xor(a.h, b.h)) <= 3")
def j02_near_dup_pairs(spark, sf_dir):
    return dedupe.near_pairs(dedupe.fingerprints(table(spark, sf_dir, "documents"))).select("first_a", "first_b")


@query(_SIMHASH + """,
    nodes AS (SELECT doc_id, h, row_number() OVER (ORDER BY doc_id) AS r FROM sim),
    near AS (SELECT b.r AS j, list(a.r ORDER BY a.r) AS before FROM nodes a JOIN nodes b ON a.r < b.r AND bit_count(xor(a.h, b.h)) <= 3 GROUP BY b.r),
    seq AS (SELECT list(struct_pack(j := nodes.r, b := coalesce(near.before, [])) ORDER BY nodes.r) AS l FROM nodes LEFT JOIN near ON near.j = nodes.r),
    reps AS (SELECT list_reduce(l, lambda acc, x: CASE WHEN len(list_intersect(acc, x.b)) = 0 THEN list_append(acc, x.j) ELSE acc END, [0::BIGINT]) AS reps FROM seq),
    dup AS (SELECT n.doc_id, min(k.doc_id) AS leader FROM nodes n JOIN near ON near.j = n.r, reps, nodes k WHERE NOT list_contains(reps, n.r) AND list_contains(reps, k.r) AND list_contains(near.before, k.r) GROUP BY n.doc_id)
    SELECT documents.doc_id, leader AS duplicate_of FROM documents LEFT JOIN dup USING (doc_id)""")
def c01_dedupe_greedy(spark, sf_dir):
    return dedupe.tag_duplicates(table(spark, sf_dir, "documents"))


@query("SELECT coalesce(source, 'none') AS cluster_id, count(*) AS n FROM documents GROUP BY 1")
def a02_cluster_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("cluster_id")).agg(F.count("*").alias("n"))


_TITLE = _case("o_orderkey", ["Auction Result of bonds", "Variable Rate Repo today", "Launches of the 45th round of Household Survey", "Foreign Exchange Turnover Data: week", "Adjudication Order in the matter", "Appeal No 5 filed by A", "Draft Prospectus", "Master Direction"])
_SECTION = "CASE WHEN o_orderkey % 11 = 0 THEN 'Speeches' ELSE 'Press' END"
_TITLED = f"(SELECT o_orderkey, {_TITLE} AS title, {_SECTION} AS section_name, CASE WHEN o_orderkey % 5 = 0 THEN '/filings/takeovers/x' ELSE '/x' END AS url FROM orders)"


def _titled(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TITLE).alias("title"), F.expr(_SECTION).alias("section_name"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN '/filings/takeovers/x' ELSE '/x' END").alias("url"))


def _sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TYPES = f"""SELECT o_orderkey, CASE WHEN section_name IN ('Speeches', 'speeches') THEN 'speech' {' '.join(f"WHEN regexp_matches(title, {_sql_quote(p)}) THEN '{k}'" for p, k in d.CENTRAL_BANK_TYPES)} ELSE 'regulatory-notification' END AS central,
    CASE WHEN section_name IN ('Speeches', 'speeches') THEN 'speech' WHEN regexp_matches(title, {_sql_quote(d.MARKET_REGULATOR_NOTICE)}) THEN 'individual_notice' WHEN regexp_matches(title, {_sql_quote(d.MARKET_REGULATOR_ORDER)}) THEN 'individual_order'
         WHEN contains(title, 'Appeal No') AND contains(title, 'filed by') THEN 'individual_appeal' WHEN regexp_matches(title, {_sql_quote(d.MARKET_REGULATOR_PROSPECTUS)}) THEN 'prospectus' WHEN regexp_matches(url, {_sql_quote(d.MARKET_REGULATOR_FILINGS)}) THEN 'filings' ELSE 'regulatory-notification' END AS market FROM {_TITLED}"""


@query(_TYPES)
def p02_doc_type(spark, sf_dir):
    return _titled(spark, sf_dir).select("o_orderkey", classify.central_bank_type(F.col("title"), F.col("section_name")).alias("central"), classify.market_regulator_type(F.col("title"), F.col("section_name"), F.col("url")).alias("market"))


@query(f"SELECT o_orderkey FROM ({_TYPES}) WHERE o_orderkey % 7 = 0 OR contains(central, 'speech') OR contains(central, 'regulatory-notification')")
def p01_filter(spark, sf_dir):
    typed = p02_doc_type(spark, sf_dir).withColumn("classification", F.when(F.col("o_orderkey") % 7 != 0, F.create_map(F.lit("doc_type"), F.col("central"))))
    return classify.keep_wanted(typed).select("o_orderkey")


@query("SELECT event_id FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 5 * 86400")
def p03_recency(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    last = ev.agg(F.max("at").alias("now"))
    return classify.recent(ev.join(F.broadcast(last)), "at", 5, F.col("now")).select("event_id")


@query("SELECT doc_id, octet_length(encode(text)) >= 200 AS dedupe, octet_length(encode(text)) >= 80 AS mentions, octet_length(encode(text)) >= 40 AS extract FROM documents")
def p04_length_gates(spark, sf_dir):
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", (n >= 200).alias("dedupe"), (n >= 80).alias("mentions"), (n >= 40).alias("extract"))


def _prefix(phrases: list[str]) -> str:
    """RE2 pattern whose first group is what stands before the first whole-word phrase."""
    return "^(?s)(|.*?[^A-Za-z0-9_])(?:" + "|".join(sorted((re.escape(p.lower()).replace(chr(92) + " ", " ") for p in phrases), key=len, reverse=True)) + ")(?:$|[^A-Za-z0-9_])"


@query(" UNION ALL ".join(f"SELECT p_partkey, '{code}' AS theme, CAST(strlen(regexp_extract(lower(text), '{_prefix(ph)}', 1)) AS BIGINT) AS char_offset FROM {PARTS} WHERE regexp_matches(lower(text), '{_prefix(ph)}')" for code, ph in d.THEMES.items()))
def t25_themes(spark, sf_dir):
    tagged = stories(spark, sf_dir).select("p_partkey", text.themes(F.col("text"), d.THEMES).alias("themes"))
    return store.facts(tagged, "themes", "p_partkey")


@query(" UNION ALL ".join(f"SELECT p_partkey, '{n}' AS name, '{cc}/{n.replace(' ', '_')}' AS feature_id, CAST({lat} AS DOUBLE) AS lat, CAST({lon} AS DOUBLE) AS lon, CAST(strlen(regexp_extract(lower(text), '{_prefix([n])}', 1)) AS BIGINT) AS char_offset FROM {PARTS} WHERE regexp_matches(lower(text), '{_prefix([n])}')" for n, lat, lon, adm, cc in d.PLACES))
def t26_geocode(spark, sf_dir):
    found = stories(spark, sf_dir).select("p_partkey", text.places(F.col("text"), d.PLACES).alias("locations"))
    return store.facts(found, "locations", "p_partkey").select("p_partkey", "name", "feature_id", "lat", "lon", "char_offset")


@query()
def t27_organisations(spark, sf_dir):
    """Overlapping gazetteer and suffix matches with counts: tested on literal texts."""
    return store.facts(extract.with_extracts(stories(spark, sf_dir), ["organizations"]), "organizations", "p_partkey")


_AMOUNT_SQL = "(?i)" + d.AMOUNT.replace("'", "''")


@query(f"""
    WITH m AS (SELECT p_partkey, unnest(regexp_extract_all(text, '{_AMOUNT_SQL}', 1)) AS c, unnest(regexp_extract_all(text, '{_AMOUNT_SQL}', 2)) AS v, unnest(regexp_extract_all(text, '{_AMOUNT_SQL}', 3)) AS s FROM {PARTS})
    SELECT p_partkey, CAST(replace(v, ',', '') AS DOUBLE) * CASE lower(s) WHEN 'crore' THEN 1e7 WHEN 'lakh' THEN 1e5 WHEN 'million' THEN 1e6 ELSE 1.0 END AS value,
           CASE WHEN coalesce(c, '') = '' THEN '' ELSE 'INR' END AS currency, coalesce(lower(s), '') AS unit FROM m WHERE coalesce(c, '') <> '' OR coalesce(s, '') <> ''""")
def t28_amounts(spark, sf_dir):
    return store.facts(extract.with_extracts(stories(spark, sf_dir), ["amounts"]), "amounts", "p_partkey").select("p_partkey", "value", "currency", "unit")


@query(rf"""
    WITH m AS (SELECT p_partkey, unnest(regexp_extract_all(text, '\b([0-9][0-9,]*)\s+([A-Za-z]{{3,}})\b', 1)) AS n, unnest(regexp_extract_all(text, '\b([0-9][0-9,]*)\s+([A-Za-z]{{3,}})\b', 2)) AS o FROM {PARTS})
    SELECT p_partkey, CAST(replace(n, ',', '') AS DOUBLE) AS number, lower(o) AS object FROM m WHERE ends_with(lower(o), 's') AND NOT list_contains({_sql_list(d.NO_COUNT)}, lower(o))""")
def t29_counts(spark, sf_dir):
    return store.facts(extract.with_extracts(stories(spark, sf_dir), ["counts"]), "counts", "p_partkey").select("p_partkey", "number", "object")


@query(rf"""
    SELECT p_partkey, 'day' AS resolution, CAST(regexp_extract(x, '^(\d+)-', 1) AS INTEGER) AS year, CAST(regexp_extract(x, '-(\d+)-', 1) AS INTEGER) AS month, CAST(regexp_extract(x, '-(\d+)$', 1) AS INTEGER) AS day
    FROM (SELECT p_partkey, unnest(regexp_extract_all(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b')) AS x FROM {PARTS})
    UNION ALL SELECT p_partkey, 'day', 2023, 6, CAST(x AS INTEGER) FROM (SELECT p_partkey, unnest(regexp_extract_all(text, '\b(\d{{1,2}}) June 2023\b', 1)) AS x FROM {PARTS})""")
def d06_dates(spark, sf_dir):
    return store.facts(extract.with_extracts(stories(spark, sf_dir), ["dates_referenced"]), "dates_referenced", "p_partkey").select("p_partkey", "resolution", "year", "month", "day")


@query(rf"""
    SELECT 'amounts' AS kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_AMOUNT_SQL}', 1)) AS c, unnest(regexp_extract_all(text, '{_AMOUNT_SQL}', 3)) AS s FROM {PARTS}) WHERE coalesce(c, '') <> '' OR coalesce(s, '') <> ''
    UNION ALL SELECT 'dates_ref', count(*) FROM (SELECT unnest(regexp_extract_all(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b')) FROM {PARTS} UNION ALL SELECT unnest(regexp_extract_all(text, '\b\d{{1,2}} June 2023\b')) FROM {PARTS})""")
def k06_fact_counts(spark, sf_dir):
    tables = store.emit_tables(extract.with_extracts(stories(spark, sf_dir), ["amounts", "dates_referenced"]), "p_partkey")
    return dedupe.union_all([t.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, t in tables.items()])


@query("""SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 1 OR user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1)
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def k04_upsert_last_wins(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old = store.upsert(ev.limit(0), ev.where("event_id % 2 = 0"), ["user_id"], ["event_id"])
    return store.upsert(old, ev.where("event_id % 2 = 1"), ["user_id"], ["event_id"])


@query("SELECT l_partkey AS instrument, strftime(min(l_shipdate), '%Y-%m-%d') AS trade_date, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_shipdate FROM lineitem) GROUP BY 1")
def k11_price_load(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("trade_date"), F.col("l_partkey").alias("fin_instrm_id"), F.col("l_extendedprice").alias("close_price"), "l_orderkey", "l_linenumber")
    kept = store.insert_ignore(rows.limit(0), rows, ["trade_date", "fin_instrm_id"], ["l_orderkey", "l_linenumber"])
    return kept.groupBy(F.col("fin_instrm_id").alias("instrument")).agg(F.min("trade_date").alias("trade_date"), F.count("*").alias("n"))


_LEDGER = "(SELECT event_type AS source, CAST(user_id % 5 AS INTEGER) AS dataset, max(CASE WHEN value > 50 THEN CAST(floor(epoch(ts)) AS BIGINT) END) AS last_success_ts FROM events GROUP BY 1, 2)"


@query(f"SELECT source, dataset, dataset > 0 AND coalesce((SELECT CAST(floor(max(epoch(ts))) AS BIGINT) FROM events) - last_success_ts < dataset * 86400, false) AS skip FROM {_LEDGER}")
def p11_should_skip(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    ledger = ev.groupBy(F.col("event_type").alias("source"), (F.col("user_id") % 5).cast("int").alias("dataset")).agg(F.max(F.when(F.col("value") > 50, at)).alias("last_success_ts"))
    now = ev.agg(F.max(at)).first()[0] or 0
    feeds = ledger.select("source", "dataset", F.col("dataset").alias("frequency_days"))
    return store.should_skip(feeds, ledger, F.lit(now))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, concat('name:', CAST(l_suppkey AS VARCHAR)) AS s FROM lineitem)
          SELECT a.s AS src_entity_id, b.s AS dst_entity_id, CAST(count(*) AS DOUBLE) AS weight FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY 1, 2""")
def a01_edge_weights(spark, sf_dir):
    return graph.edge_weights(_edges(spark, sf_dir))


def _edges(spark, sf_dir):
    mentions = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("name:"), F.col("l_suppkey").cast("string")).alias("entity_id"))
    return graph.document_pairs(mentions, "l_orderkey").select("l_orderkey", F.col("src").alias("src_entity_id"), F.col("dst").alias("dst_entity_id"), F.lit(1.0).alias("weight"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, concat('name:', CAST(l_suppkey AS VARCHAR)) AS s FROM lineitem)
          SELECT a.l_orderkey, a.s AS src, b.s AS dst FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.s < b.s""")
def j03_entity_pairs(spark, sf_dir):
    return _edges(spark, sf_dir).select("l_orderkey", F.col("src_entity_id").alias("src"), F.col("dst_entity_id").alias("dst"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), k AS (SELECT l_orderkey FROM m GROUP BY 1 HAVING count(*) > 1)
          SELECT DISTINCT concat('name:', CAST(l_suppkey AS VARCHAR)) AS entity_id, CASE WHEN l_suppkey % 2 = 0 THEN s_name ELSE concat('name:', CAST(l_suppkey AS VARCHAR)) END AS label
          FROM m JOIN k USING (l_orderkey) JOIN supplier ON s_suppkey = l_suppkey""")
def j04_node_labels(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("name:"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("canonical_name"))
    return graph.node_labels(_edges(spark, sf_dir), named)


@query()
def k09_gexf(spark, sf_dir):
    """Lines of an XML document: tested against a parser."""
    edges = a01_edge_weights(spark, sf_dir)
    return graph.gexf_lines(j04_node_labels(spark, sf_dir), edges).orderBy("section", "position")


@query("SELECT event_id, last_value(CASE WHEN value > 90 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def w01_carry_forward(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("value") > 90, F.col("event_id")), ignorenulls=True).over(w).alias("header"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents),
          s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) > 100 THEN list_filter(range(0, len(w), 80), lambda i: i = 0 OR i + 20 < len(w)) ELSE [0] END) AS i FROM t WHERE len(w) > 0)
          SELECT doc_id, CAST(i // 80 AS INTEGER) AS k, array_to_string(w[i + 1:i + 100], ' ') AS part FROM s""")
def w03_word_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.word_windows(F.col("text"), 100)).alias("k", "part"))


@query("SELECT CAST(x AS DATE) AS day FROM range(DATE '2026-05-01', DATE '2026-06-15', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6 ORDER BY x DESC LIMIT 10")
def w08_business_days(spark, sf_dir):
    return market.business_days(spark, "2026-06-14", 10)


@query("""WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
    r AS (SELECT DISTINCT host, 'disallow' AS kind, '/en/' AS prefix FROM u UNION ALL SELECT DISTINCT host, 'allow', '/en/2' FROM u UNION ALL SELECT DISTINCT host, 'disallow', '/fr' FROM u WHERE host LIKE 'm.%')
    SELECT url, coalesce(max(CASE WHEN kind = 'allow' THEN length(prefix) END), -1) >= coalesce(max(CASE WHEN kind = 'disallow' THEN length(prefix) END), -1) AS allowed
    FROM u LEFT JOIN r ON u.host = r.host AND starts_with(path, prefix) GROUP BY url""")
def j06_robots(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    mobile = F.when(F.col("host").startswith("m."), "Disallow: /fr # mobile\n").otherwise("")
    robots = pages.select(text.host_of(F.col("url")).alias("host")).distinct().withColumn("body", F.concat(F.lit("User-agent: bot\nDisallow: /\nUser-agent: *\nDisallow: /en/\nAllow: /en/2\nDisallow:\n"), mobile))
    return crawl.robots_allowed(pages, crawl.robots_rules(robots))


@query("""WITH l AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"'']*)["'']', 1)) AS href FROM pages)
    SELECT DISTINCT CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-zA-Z]+:') || href ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || href END AS url
    FROM l WHERE starts_with(href, 'http') OR starts_with(href, '/')""".replace("\\\\", "\\"))
def s07_links(spark, sf_dir):
    return crawl.discover_links(table(spark, sf_dir, "pages"))


@query("""WITH f AS (SELECT page_id, url FROM pages) SELECT page_id, list_sort(list_distinct(['https://a.example/' || page_id, url, 'https://b.example/'])) AS links FROM f""")
def s08_feed_links(spark, sf_dir):
    xml = F.concat(F.lit("<rss><link>https://b.example/</link><item><loc> <![CDATA["), F.col("url"), F.lit(']]> </loc></item><LINK rel="alternate" href="https://a.example/'), F.col("page_id").cast("string"), F.lit('"/></rss>'))
    return table(spark, sf_dir, "pages").select("page_id", text.feed_links(xml).alias("links"))


@query(r"SELECT c_custkey, trim(regexp_replace(lower('  ' || c_name || '!  Bank & Söhne'), '[^\p{L}\p{N}]+', ' ', 'g')) AS name FROM customer")
def t09_norm_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.norm_name(F.concat(F.lit("  "), "c_name", F.lit("!  Bank & Söhne"))).alias("name"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
    SELECT query_id, count(*) AS n, round(sum(score), 4) AS total, max(score) AS best FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10) GROUP BY query_id""")
def g13_vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    best = vector.top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10).withColumn("score", F.round("score", 6))
    return best.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.max("score").alias("best"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def a13_l2_norm(spark, sf_dir):
    v = vector.l2_normalise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(vector.dot(v, v)) * F.sqrt(vector.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("SELECT CASE WHEN c BETWEEN 200 AND 299 THEN '2xx' WHEN c = 403 THEN '403' WHEN c = 404 THEN '404' WHEN c = 408 THEN 'timeout' WHEN c BETWEEN 400 AND 499 THEN '4xx' WHEN c >= 500 THEN '5xx' ELSE 'other' END AS status, count(*) AS n FROM (SELECT [200, 204, 301, 403, 404, 408, 429, 500, 503][CAST(event_id % 9 + 1 AS BIGINT)] AS c FROM events) GROUP BY 1")
def a18_status_histogram(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 204, 301, 403, 404, 408, 429, 500, 503)]), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(crawl.status_class(code).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, c >= 500 OR c IN (408, 429) AS retry, least(2.0 * pow(2, least(event_id % 8, 5)), 60.0)::DOUBLE AS wait FROM (SELECT event_id, [200, 301, 404, 408, 429, 500][CAST(event_id % 6 + 1 AS BIGINT)] AS c FROM events)")
def s10_retry_policy(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 301, 404, 408, 429, 500)]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", crawl.retryable(code).alias("retry"), crawl.backoff_seconds(F.lit(2.0), F.col("event_id") % 8).alias("wait"))


@query("SELECT doc_id, substr(text, 1, 500) AS preview FROM documents")
def g05_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 500).alias("preview"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def d05_legacy_date(spark, sf_dir):
    old = F.concat_ws("-", F.dayofmonth("o_orderdate").cast("string"), F.upper(F.date_format("o_orderdate", "MMM")), F.year("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", market.legacy_date(old).alias("day"))


@query("SELECT s_suppkey, replace(replace(replace(replace('a/' || s_name || '?x=1.html', '.html', ''), '/', ''), '?', '_'), '=', '_') AS name FROM (SELECT s_suppkey, replace(s_name, '#', '_') AS s_name FROM supplier)")
def t04_file_safe(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.file_safe(F.concat(F.lit("a/"), "s_name", F.lit("?x=1.html"))).alias("name"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS parts FROM conversations GROUP BY conv_id")
def j09_positional_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.size("p").cast("long").alias("parts"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r05_stream_windows(spark, sf_dir):
    agg = streams.tumbling(streams.event_stream(spark, sf_dir))
    return streams.run_available(agg, f"windows_{uuid.uuid4().hex}").withColumn("total", F.round("total", 4))


@query()
def t22_chunks(spark, sf_dir):
    """Sequential folds over sentences: tested on literal texts."""
    return chunk.chunk_table(table(spark, sf_dir, "documents"))


@query()
def t30_paragraph_text(spark, sf_dir):
    """A lenient HTML parser: tested on literal pages."""
    return table(spark, sf_dir, "pages").select("page_id", html.paragraphs(F.col("html")).alias("x")).select("page_id", "x.*")


@query()
def t33_markdown(spark, sf_dir):
    """A lenient HTML parser: tested on literal pages."""
    return table(spark, sf_dir, "pages").select("page_id", html.markdown(F.col("html")).alias("markdown"))


@query()
def t06_siphash_id(spark, sf_dir):
    """Keyed hash without a SQL counterpart: tested against a known value."""
    return table(spark, sf_dir, "pages").select("page_id", hashing.siphash_hex(F.col("url")).alias("doc_id"))


def _stories_as_documents(spark, sf_dir):
    s = stories(spark, sf_dir)
    return s.select(F.col("p_partkey").cast("string").alias("unique_id"), F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("url"), "text", F.lit("m").alias("module"), F.array(F.lit("src")).alias("source_name"), (F.col("p_partkey") * 86400).alias("publish_date_ms"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(p_partkey AS VARCHAR) AS cluster_id, p_partkey * 86400 AS mention_ts, 'src' AS source, CAST(100.0 AS DOUBLE) AS confidence FROM {PARTS} WHERE octet_length(encode(text)) >= 80")
def c02_mentions(spark, sf_dir):
    return chain.mention_rows(chain.mentions(_stories_as_documents(spark, sf_dir)))


@query(f"""SELECT kind, count(*) AS n FROM (
    SELECT 'amounts' AS kind FROM (SELECT unnest(regexp_extract_all(text, '{_AMOUNT_SQL}', 1)) AS c, unnest(regexp_extract_all(text, '{_AMOUNT_SQL}', 3)) AS s FROM {PARTS}) WHERE coalesce(c, '') <> '' OR coalesce(s, '') <> ''
    UNION ALL SELECT 'themes' FROM ({ORACLES['t25_themes']}) UNION ALL SELECT 'locations' FROM ({ORACLES['t26_geocode']}) UNION ALL SELECT 'gcam' FROM ({ORACLES['m04_gcam']})) GROUP BY kind""")
def c10_processor_chain(spark, sf_dir):
    steps = [chain.Plugin("extract_quant", priority=1), chain.Plugin("themes", priority=2), chain.Plugin("tone", priority=3), chain.Plugin("geocode", priority=4), chain.Plugin("solr", priority=5), chain.Plugin("ner", enabled=False)]
    enriched = chain.run_chain(chain.mentions(_stories_as_documents(spark, sf_dir)), steps)
    counted = [t.select(F.lit(name).alias("kind")) for name, t in store.emit_tables(enriched).items() if name in ("amounts", "themes", "gcam", "locations")]
    return dedupe.union_all(counted).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'name:' || lower(x) AS entity_id, x AS label FROM (VALUES ('Securities and Exchange Board of India'), ('National Stock Exchange'), ('Reserve Bank of India')) t(x)")
def c08_entity_graph(spark, sf_dir):
    docs = _stories_as_documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" SEBI and NSE agreed.")))
    found = chain.organisations(chain.mentions(docs))
    return graph.node_labels(chain.entity_edges(found), chain.entities(found))


@query(r"SELECT url, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '/(\d+)', 1) ELSE 'none' END AS id FROM pages".strip())
def t14_unique_id(spark, sf_dir):
    pattern = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("")
    return table(spark, sf_dir, "pages").select("url", text.first_match(pattern, [r"/(\d+)", r"/(zz)"], F.lit("none")).alias("id"))


@query("SELECT s_suppkey, 'Dear Sir' AS greeting, s_name AS recipients FROM supplier")
def t16_recipients(spark, sf_dir):
    letter = F.concat(F.lit(" "), "s_name", F.lit(" \nDear Sir / Madam,\nplease note"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("Dear Sir").alias("greeting"), text.before(letter, r"(?i)(dear|madam)").alias("recipients"))


@query("SELECT n_nationkey, 'daily_' || replace(replace(replace(n_name, ' ', '_'), '-', '_'), '.', '_') AS name FROM nation")
def t18_table_name(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.table_name(F.concat(F.lit("daily."), "n_name")).alias("name"))


@query(r"SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '\. [A-Z]')) AS BIGINT) AS parts FROM documents".strip())
def t19_split_keeping(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.split_keeping(F.col("text"), r"\. [A-Z]")).cast("long").alias("parts"))


@query("SELECT source, min_by(doc_id, doc_id) AS entity_doc, count(*) AS n FROM documents GROUP BY source")
def k07_entity_first_wins(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", "doc_id").alias("entity_doc"), F.count("*").alias("n"))


@query("SELECT l_returnflag AS col0, l_linestatus AS col1, strftime(l_shipdate, '%Y') AS trade_date, min_by(CAST(l_orderkey AS VARCHAR), l_orderkey * 10 + l_linenumber) AS col2 FROM lineitem GROUP BY 1, 2, 3")
def k12_generic_load(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("trade_date"), F.col("l_returnflag").alias("col0"), F.col("l_linestatus").alias("col1"), F.col("l_orderkey").cast("string").alias("col2"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return store.insert_ignore(rows.limit(0), rows, ["trade_date", "col0", "col1"], ["at"]).drop("at")


@query(f"""SELECT source, dataset, ts AS last_attempt_ts, CASE WHEN dataset % 2 = 0 THEN ts ELSE last_success_ts END AS last_success_ts, CASE WHEN dataset % 2 = 0 THEN 'success' ELSE 'failed' END AS status
    FROM (SELECT *, CAST(1700000000 AS BIGINT) AS ts FROM {_LEDGER})""")
def k13_run_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ledger = ev.groupBy(F.col("event_type").alias("source"), (F.col("user_id") % 5).cast("int").alias("dataset")).agg(F.max(F.when(F.col("value") > 50, F.unix_seconds(F.col("ts").cast("timestamp")))).alias("last_success_ts"))
    ledger = ledger.select("*", F.lit(0).cast("long").alias("last_attempt_ts"), F.lit("x").alias("status"), F.lit(0).cast("long").alias("rows_ingested"), F.lit("").alias("message"))
    results = ledger.select("source", "dataset", F.lit(1700000000).cast("long").alias("ts"), (F.col("dataset") % 2 == 0).alias("ok"), F.lit(1).cast("long").alias("rows"), F.lit("m").alias("message"))
    return store.record_results(ledger, results).drop("rows_ingested", "message")


@query("SELECT page_id, url AS \"URL\", CAST(page_id AS VARCHAR) AS \"uniqueID\", '1970-01-01' AS pubdate FROM pages")
def p05_output_json(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").cast("string").alias("unique_id"), F.lit("1970-01-01").alias("publish_date"), F.col("html").alias("html_content"))
    return documents.output_columns(docs)


@query("SELECT event_id, length(props) > 0 AND NOT starts_with(props, '<') AND (starts_with(props, 'TradDt') OR contains(left(props, 64), ',')) AS csv FROM events")
def p10_csv_sniff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", market.looks_like_csv(F.col("props")).alias("csv"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(epoch(o_orderdate) AS BIGINT) AS ts, CAST(o_orderdate AS DATE) AS bank, CAST(o_orderdate AS DATE) AS insurer, CAST(o_orderdate AS DATE) AS exchange FROM orders")
def d01_date_formats(spark, sf_dir):
    at = F.col("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_date(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), dates.central_bank_date(F.concat(F.date_format(at, "MMMM d, yyyy"), F.lit(". "))).alias("bank"), dates.insurance_regulator_date(F.date_format(at, "dd-MM-yyyy")).alias("insurer"), dates.exchange_date(F.upper(F.date_format(at, "dd-MMM-yyyy"))).alias("exchange"))
    return o.select("o_orderkey", F.col("iso.day").alias("iso"), F.col("iso.ts").alias("ts"), "bank", "insurer", "exchange")


@query("SELECT page_id, '2024-05-06' AS day FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 2 <> 0")
def d02_publish_date(spark, sf_dir):
    meta = F.when(F.col("page_id") % 2 == 0, F.lit('<meta property="article:published_time" content="2024-05-06T10:00:00+05:30">')).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", dates.published(F.concat(meta, "html"))["day"].alias("day"))


@query("SELECT e.event_id, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS DOUBLE) AS d, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE trunc(value) END AS BIGINT) AS i FROM events e")
def m02_optional_numbers(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", dates.number(raw).alias("d"), dates.whole(raw).alias("i"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN repeat('Body ' || page_id || ' ', 40) END AS body FROM pages")
def m06_json_ld_body(spark, sf_dir):
    body = F.to_json(F.struct(F.repeat(F.concat(F.lit("Body "), F.col("page_id").cast("string"), F.lit(" ")), 40).alias("articleBody")))
    script = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">['), body, F.lit("]</script>"))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", dates.json_ld_body(F.concat("html", script)).alias("body"))


@query("SELECT s_suppkey, replace(replace(replace(replace(replace('<' || s_name || '> & \"x\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM supplier")
def t17_xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.xml_escape(F.concat(F.lit("<"), "s_name", F.lit('> & "x"'))).alias("xml"))


@query("SELECT doc_id, CAST(floor(len(string_split_regex(trim(text), '[ \\t\\n\\x0b\\f\\r]+')) * 1.333) AS BIGINT) AS n FROM documents".replace("\\\\", "\\"))
def m03_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", dates.token_estimate(F.size(F.split(F.trim("text"), r"\s+"))).alias("n"))


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def r03_stream_first_wins(spark, sf_dir):
    firsts = streams.event_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    got = streams.run_available(firsts, f"firsts_{uuid.uuid4().hex}", "append")
    return got.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def r06_tumbling_batch(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    """SELECT CAST(d AS DATE) AS day, CASE WHEN d < DATE '2024-08-01'
         THEN 'https://nsearchives.nseindia.com/content/historical/EQUITIES/' || strftime(d, '%Y/') || upper(strftime(d, '%b')) || '/cm' || strftime(d, '%d') || upper(strftime(d, '%b')) || strftime(d, '%Y') || 'bhav.csv.zip'
         ELSE 'https://nsearchives.nseindia.com/content/cm/BhavCopy_NSE_CM_0_0_0_' || strftime(d, '%Y%m%d') || '_F_0000.csv.zip' END AS url
       FROM (SELECT unnest(generate_series(TIMESTAMP '2006-01-01', TIMESTAMP '2025-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6"""
)
def s23_price_history(spark, sf_dir):
    return market.price_history(spark, "2006-01-01", "2025-12-31")


@query("SELECT page_id, 'm_' || left(regexp_replace(CASE WHEN contains(url, '/') THEN regexp_extract(url, '([^/]*)$', 1) ELSE 'data' END, '\\.[^.]*$', ''), 48) || '_2024_05_06.xlsx' AS file FROM pages")
def k16_dataset_file(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", harvest.dataset_file("m", F.col("url"), F.lit("2024-05-06")).alias("file"))


@query("SELECT 'https://x.example/files/' || p_partkey || '.pdf' AS url, p_name AS title, p_brand AS unique_id FROM part")
def s18_circulars(spark, sf_dir):
    item = F.struct(F.format_string("/files/%d.pdf", "p_partkey").alias("filePath"), F.col("p_name").alias("subject"), F.col("p_brand").alias("nseCircularNumber"))
    replies = table(spark, sf_dir, "part").select(F.to_json(F.array(item)).alias("body"))
    return listing.circulars(replies, "https://x.example/").drop("published")


@query(
    r"""SELECT p_partkey, trim(regexp_extract(t, p, 2)) AS unique_id, regexp_extract(t, p, 3) AS date, regexp_extract(t, p, 5) AS recipients
        FROM (SELECT p_partkey, concat('RBI/', 2000 + p_size, '-', 10 + p_size % 80, '/', p_partkey, ' DOR.No.', p_size, '/2024-25 July ', 1 + p_size % 28, ', 2024 The Chairman of ', p_name, ' Madam / Dear Sir') AS t,
                '(RBI[/A-Z]+\d{4}-\d{2,4}/\d*)(.+\d{4}-\d{2,4}[ ]*)((?:January|February|March|April|May|June|July|August|September|October|November|December)[\d ]+,[\d ]+)()(.+)(Madam|$)' AS p FROM part)"""
)
def t34_notification_summary(spark, sf_dir):
    summary = F.expr("concat('RBI/', 2000 + p_size, '-', 10 + p_size % 80, '/', p_partkey, ' DOR.No.', p_size, '/2024-25 July ', 1 + p_size % 28, ', 2024 The Chairman of ', p_name, ' Madam / Dear Sir')")
    return table(spark, sf_dir, "part").select("p_partkey", listing.notification_summary(summary).alias("s")).select("p_partkey", "s.*")


@query("""SELECT user_id, event_type, event_id FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 <> 0, event_id) = 1""")
def k03_history_first_wins(spark, sf_dir):
    """Every tenth event is the history, the others arrive; both are read whole."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    history_ = store.insert_ignore(ev.limit(0), ev.where("event_id % 10 = 0"), ["user_id"], ["event_id"])
    return store.insert_ignore(history_, ev.where("event_id % 10 <> 0"), ["user_id"], ["event_id"])


@query(r"""WITH f AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: length(w) >= 3)) AS w FROM conversations) GROUP BY 1, 2),
    q AS (SELECT conv_id, sum(n * n) AS q FROM f GROUP BY 1)
    SELECT f.conv_id, round(sum(f.n * g.n) / sqrt(CAST(any_value(a.q) AS DOUBLE) * any_value(b.q)), 6) AS cosine
    FROM f JOIN f g ON g.conv_id = f.conv_id - 1 AND g.w = f.w JOIN q a ON a.conv_id = f.conv_id JOIN q b ON b.conv_id = f.conv_id - 1 GROUP BY f.conv_id""")
def a12_cosine_conversations(spark, sf_dir):
    """Cosine of the term counts of each conversation, all turns, and the one before it."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) >= 3)
    f = table(spark, sf_dir, "conversations").select("conv_id", F.explode(w).alias("w")).groupBy("conv_id", "w").agg(F.count("*").alias("n"))
    norm = f.groupBy("conv_id").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    after = (F.col("conv_id") + 1).alias("conv_id")
    both = f.join(f.select(after, "w", F.col("n").alias("m")), ["conv_id", "w"]).groupBy("conv_id").agg(F.sum(F.col("n") * F.col("m")).alias("s"))
    return both.join(norm, "conv_id").join(norm.select(after, F.col("q").alias("p")), "conv_id").select("conv_id", F.round(F.col("s") / F.sqrt(F.col("q").cast("double") * F.col("p")), 6).alias("cosine"))


@query("SELECT conv_id, turn, '{\"model\":\"m\",\"messages\":[{\"role\":\"user\",\"content\":' || to_json(text) || '}],\"temperature\":0.0}' AS payload FROM conversations")
def c17_request_payloads(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", assist.payload("chatgpt", "m", F.col("text")).alias("payload"))


@query("""SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous,
            coalesce(regexp_replace(text, '\\s+', '', 'g') <> regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '\\s+', '', 'g'), false) AS differs FROM conversations""".replace("\\\\", "\\"))
def j10_previous_versions(spark, sf_dir):
    docs = history.previous_versions(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["turn", "text"])
    differs = history.changed(docs).select("conv_id", "turn", F.lit(True).alias("differs"))
    return docs.join(differs, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("previous.text").alias("previous"), F.coalesce("differs", F.lit(False)).alias("differs"))


@query("""SELECT conv_id, i - 1 AS at, p[i] AS text, CASE WHEN i < len(p) THEN left(p[i], 20) END AS summary
          FROM (SELECT conv_id, list(text ORDER BY turn) AS p FROM conversations GROUP BY conv_id), range(1, 10000) t(i) WHERE i <= len(p)""")
def j09_parts_with_summaries(spark, sf_dir):
    """Parts zipped with one summary fewer."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    parts = F.transform("t", lambda x, i: F.struct(i.cast("string").alias("id"), x["text"].alias("text")))
    summaries = F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda x: F.substring(x["text"], 1, 20))
    zipped = turns.select("conv_id", F.explode(assist.with_summaries(parts, summaries)).alias("x"))
    return zipped.select("conv_id", F.col("x.id").cast("long").alias("at"), "x.text", "x.summary")


@query("SELECT c_custkey, coalesce(max(o_orderkey), 0) AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a03_next_version(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return history.next_version(rows, "c_custkey", "o_orderkey")


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS INTEGER) | 414 AS flags FROM part")
def p15_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", classify.with_flags(F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("int"))).alias("flags"))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, lower('Desk_' || o_orderstatus) AS module, lower(o_orderpriority) AS kind FROM orders)
    WHERE module IN ('desk_f', 'desk_p') AND (o_orderkey % 5 = 0 OR contains(kind, 'urgent') OR contains(kind, 'high'))""")
def p13_for_insights(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Desk_"), "o_orderstatus").alias("module"), F.lower("o_orderpriority").alias("kind"))
    named = F.when(F.col("kind").contains("urgent") | F.col("kind").contains("high"), F.concat(F.lit("speech "), F.col("kind"))).otherwise(F.col("kind"))
    typed = orders.withColumn("classification", F.when(F.col("o_orderkey") % 5 != 0, classify.default_classification(named)))
    return classify.for_insights(typed, ("DESK_F", "desk_p")).select("o_orderkey")


@query("""SELECT p_partkey, key, CASE WHEN key = 'doc_type' THEN lower(p_type) ELSE 'other' END AS value FROM part,
    (SELECT unnest(['channel', 'customer_type', 'function', 'market_type', 'occupation', 'product_type', 'risk_type', 'doc_type']) AS key)""")
def p14_default_classification(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(classify.default_classification(F.lower("p_type"))))


@query("SELECT page_id, strlen(html) AS n FROM pages WHERE strlen(html) >= CASE page_id % 3 WHEN 0 THEN 3000 WHEN 1 THEN 2000 ELSE 400 END")
def p07_long_enough(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.concat(F.lit("site"), (F.col("page_id") % 3).cast("string")).alias("module"))
    sites = spark.createDataFrame([("site0", 3000), ("site1", 2000), ("site2", None)], "module string, min_length int")
    return classify.long_enough(pages, sites, "html").select("page_id", F.octet_length("html").cast("long").alias("n"))


def _file_safe_sql(x: str) -> str:
    for old, new in d.FILE_NAME_REPLACEMENTS:
        x = "replace({}, '{}', '{}')".format(x, old.replace("'", "''"), new)
    return x


@query(f"SELECT page_id, right({_file_safe_sql("regexp_extract(url, '([^/]*)$', 1)")}, 64) AS tail FROM (SELECT page_id, url || '?a=' || repeat('x y/', page_id % 3) || repeat('long-tail;', 9) || '.html' AS url FROM pages)")
def g08_last_characters(spark, sf_dir):
    url = F.expr("concat(url, '?a=', repeat('x y/', cast(page_id % 3 as int)), repeat('long-tail;', 9), '.html')")
    return table(spark, sf_dir, "pages").select("page_id", archives.last_characters(url).alias("tail"))


@query("SELECT p_partkey, bit_count(xor(CAST(p_partkey AS BIGINT) * 2654435761, CAST(p_size AS BIGINT) * 40503)) AS distance FROM part")
def t08_hamming(spark, sf_dir):
    a, b = F.col("p_partkey").cast("long") * 2654435761, F.col("p_size").cast("long") * 40503
    return table(spark, sf_dir, "part").select("p_partkey", hashing.hamming(a, b).alias("distance"))


@query(r"SELECT p_partkey, 'name:' || trim(regexp_replace(lower('  ' || p_name || ' & ' || p_brand || '!'), '[^\p{L}\p{N}]+', ' ', 'g')) AS entity_id FROM part")
def t10_provisional_id(spark, sf_dir):
    name = F.concat(F.lit("  "), "p_name", F.lit(" & "), "p_brand", F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", graph.entity_id(F.struct(F.lit(None).cast("string").alias("entity_id"), name.alias("surface_form"))).alias("entity_id"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || '//cdn.example/' || page_id
             WHEN 2 THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/p/' || page_id END AS target FROM pages""")
def t12_resolved_links(spark, sf_dir):
    href = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('//cdn.example/', page_id) WHEN 2 THEN concat('/p/', page_id) ELSE 'mailto:x' END")
    return table(spark, sf_dir, "pages").select("page_id", text.resolve_href(href, F.col("url")).alias("target"))


@query("SELECT p_partkey, replace(replace(p_name || ' & ' || p_size, ' ', '%20'), '&', '%26') AS body FROM part")
def t15_form_encoding(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.url_encode(F.concat("p_name", F.lit(" & "), F.col("p_size").cast("string"))).alias("body"))


@query("SELECT DISTINCT url FROM pages")
def a04_known_urls(spark, sf_dir):
    """URLs of a crawl's history that a candidate list, the history twice over, doesn't extend."""
    known = table(spark, sf_dir, "pages").select("url")
    again = dedupe.union_all([known, known])
    return again.distinct().join(crawl.not_retrieved(again, known), "url", "left_anti")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY user_id")
def a05_first_seen_order(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    ordered = seen.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return ordered.select("user_id", F.array_join(F.array_distinct(F.transform("x", lambda e: e["event_type"])), ",").alias("types"))


@query("SELECT page_id, strlen(html) AS bytes, left(html, CAST(least(strlen(html) - 1, 62000) AS BIGINT)) AS body FROM pages WHERE strlen(html) > 0")
def g06_prompt_body(spark, sf_dir):
    """The body of a prompt is cut at 62,000 characters, and one short of the text's bytes: that is the feature."""
    pages = table(spark, sf_dir, "pages").where(F.octet_length("html") > 0)
    return pages.select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.substring(assist.capped(F.col("html")), F.lit(1), F.octet_length("html") - 1).alias("body"))


@query("SELECT o_orderkey, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) AS ts, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders")
def d09_midnight_and_back(spark, sf_dir):
    midnight = F.unix_timestamp(F.to_timestamp(F.to_date("o_orderdate")))
    return table(spark, sf_dir, "orders").select("o_orderkey", midnight.alias("ts"), F.date_format(F.timestamp_seconds(midnight), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS bank, CAST(o_orderdate AS DATE) AS market, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS insurance, CAST(o_orderdate AS DATE) AS exchange FROM orders")
def d03_regulator_dates(spark, sf_dir):
    """Each order's date written as the regulators write it, in turn, and read again."""
    day = F.to_date("o_orderdate")
    written = F.element_at(F.array(*[F.date_format(day, f) for f in ("MMM dd, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    bank = dates.central_bank_date(F.concat(F.lit(" ,"), written, F.lit(". ")))
    insurance = dates.insurance_regulator_date(F.when(F.col("o_orderkey") % 5 > 0, F.date_format(day, "dd-MM-yyyy")).otherwise("dd-mm-yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", bank.alias("bank"), dates.market_regulator_date(F.date_format(day, "MMM dd, yyyy")).alias("market"), insurance.alias("insurance"), dates.exchange_date(F.upper(F.date_format(day, "dd-MMM-yyyy"))).alias("exchange"))


@query("SELECT vec_id, len(embedding) AS n, true AS same FROM embeddings")
def m05_vector_blobs(spark, sf_dir):
    """Each vector as a blob of 32-bit floats and back."""
    both = table(spark, sf_dir, "embeddings").withColumn("blob", vector.to_blob("embedding")).withColumn("back", vector.from_blob("blob"))
    same = F.forall(F.arrays_zip("embedding", "back"), lambda x: x["embedding"].cast("float") == x["back"])
    return both.select("vec_id", (F.octet_length("blob") / 4).cast("long").alias("n"), same.alias("same"))


@query("SELECT vec_id, i AS at, round(v / greatest(sqrt(q), 1e-9), 5) AS x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) JOIN (SELECT vec_id, sum(v * v) AS q FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1) USING (vec_id)")
def a13_unit_components(spark, sf_dir):
    unit = vector.l2_normalise(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit).alias("at", "x")).select("vec_id", (F.col("at") + 1).cast("long").alias("at"), F.round("x", 5).alias("x"))


@query("""SELECT strftime(l_shipdate, '%Y-%m-%d') AS trade_date, l_partkey AS instrument, l_extendedprice AS close_price FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_partkey, strftime(l_shipdate, '%Y-%m-%d') ORDER BY l_orderkey, l_linenumber) = 1""")
def k11_price_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("trade_date"), F.col("l_partkey").alias("instrument"), F.col("l_extendedprice").alias("close_price"), "l_orderkey", "l_linenumber")
    return store.insert_ignore(rows.limit(0), rows, ["trade_date", "instrument"], ["l_orderkey", "l_linenumber"]).select("trade_date", "instrument", "close_price")


@query(r"""SELECT p_partkey, strpos(text, m) - 1 AS char_offset, m AS phrase FROM
           (SELECT p_partkey, text, unnest(regexp_extract_all(text, '\d{4}-\d{2}-\d{2}') || regexp_extract_all(text, '\d{1,2} June 2023')) AS m FROM """ + PARTS + ")")
def d06_date_offsets(spark, sf_dir):
    """Dates with the places where they stand."""
    found = extract.with_extracts(stories(spark, sf_dir), ["dates_referenced"]).select("p_partkey", "text", F.explode("dates_referenced").alias("d"))
    iso = F.format_string("%04d-%02d-%02d", "d.year", "d.month", "d.day")
    long_ = F.concat(F.col("d.day").cast("string"), F.lit(" June 2023"))
    at = F.col("d.char_offset").cast("long")
    return found.select("p_partkey", at.alias("char_offset"), F.when(F.substring("text", at.cast("int") + 1, F.lit(10)) == iso, iso).otherwise(long_).alias("phrase"))


@query("SELECT p_partkey, p_name || ', ' || p_brand AS name, p_retailprice AS close_price, p_size AS volume FROM part")
def s24_quoted_prices(spark, sf_dir):
    """Price files of every brand, with commas and quotes inside fields, read by the header."""
    line = F.format_string('%s,"%s, ""%s""",%s,%d', F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_retailprice").cast("string"), F.col("p_size").cast("int"))
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), line.alias("line")).groupBy("file").agg(F.concat(F.lit("key,name,close,volume\n"), F.array_join(F.collect_list("line"), "\n")).alias("content"))
    rows = market.rows_of_contents(files)
    get = lambda k: F.try_element_at("row", F.lit(k))
    return rows.select(get("key").cast("long").alias("p_partkey"), F.replace(get("name"), F.lit('"'), F.lit("")).alias("name"), get("close").cast("double").alias("close_price"), get("volume").cast("long").alias("volume"))


@query("SELECT p_partkey, p_retailprice AS close_price FROM part WHERE p_size % 2 = 0")
def k14_prices_in_texts(spark, sf_dir):
    """Documents of one module hold a price file as their text, those of another don't count."""
    body = F.format_string("TradDt,key,close\n2024-01-02,%d,%s\n", F.col("p_partkey").cast("long"), F.col("p_retailprice").cast("string"))
    docs = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "MOD_Market").otherwise("mod_news").alias("module"), F.col("p_partkey").cast("string").alias("unique_id"), body.alias("text"))
    rows = market.prices_in_texts(docs, ["mod_market"])
    return rows.select(F.try_element_at("row", F.lit("key")).cast("long").alias("p_partkey"), F.try_element_at("row", F.lit("close")).cast("double").alias("close_price"))


@query("SELECT CAST(max(o_orderdate) AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def g09_first_good_day(spark, sf_dir):
    """The walk back over days: the latest one whose file is a price file; the days after it have only an error page."""
    day = F.to_date("o_orderdate")
    files = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.concat(F.lit("TradDt,key\n"), F.array_join(F.collect_list(F.concat_ws(",", F.lit("d"), F.col("o_orderkey").cast("string"))), "\n")).alias("content"))
    later = files.select(F.date_add("day", 4000).alias("day"), F.lit("<html>not found</html>").alias("content"))
    good = market.first_good_day(files.unionByName(later)).withColumn("file", F.col("day").cast("string"))
    return market.rows_of_contents(good).groupBy("file").agg(F.count("*").alias("n")).select(F.to_date("file").alias("day"), "n")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS publish_date, 'Prices ' || strftime(o_orderdate, '%Y-%m-%d') AS title, CAST(epoch(o_orderdate) AS BIGINT) AS ts, count(*) AS n FROM orders GROUP BY o_orderdate")
def s19_price_documents(spark, sf_dir):
    day = F.to_date("o_orderdate")
    files = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.concat(F.lit("TradDt,key"), F.array_join(F.collect_list(F.concat(F.lit("\nd,"), F.col("o_orderkey").cast("string"))), "")).alias("content")).withColumn("url", F.lit("u"))
    docs = market.price_file_documents(files, "mod_prices", "Prices")
    return docs.select("publish_date", "title", F.col("publish_date_ms").alias("ts"), (F.size(F.split("text", "\n")) - 1).cast("long").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r04_keyed_dedupe(spark, sf_dir):
    """Events delivered twice over; state with a watermark lets each in once."""
    twice = streams.event_stream(spark, sf_dir).select("ts", "user_id", "event_type", "event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = streams.once(twice, ["event_id"], "3650 days")
    got = streams.run_available(once.select("user_id", "event_type", "event_id"), f"once_{uuid.uuid4().hex}", "append")
    return got.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, r_name, page, '/list?section=' || n_nationkey || '&page=' || page AS url FROM nation, region, range(1, 4) t(page)")
def j11_page_requests(spark, sf_dir):
    """Requests for the first three pages of every section."""
    sections = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(table(spark, sf_dir, "region").select("r_name"))
    pages = sections.select("n_nationkey", "r_name", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("page"))
    return pages.withColumn("url", F.concat(F.lit("/list?section="), F.col("n_nationkey").cast("string"), F.lit("&page="), F.col("page").cast("string")))
