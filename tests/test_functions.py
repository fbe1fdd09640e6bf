"""Known values and literal texts."""

import random
from datetime import date
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import functions as F

from gleaner import dictionaries as d
from gleaner.functions import dates, extract, hashing, html, select, text
from gleaner.operators import assist, chain, chunk, classify, crawl, dedupe, feeds, graph, listing, store, wordpiece
from gleaner.sources import archives, config, documents, market


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_hashes(spark):
    assert one(spark, hashing.fnv1a(F.col("s")), s="rupee") % (1 << 64) == 10053715977867704958
    assert one(spark, hashing.fnv1a(F.col("s")), s="") % (1 << 64) == hashing.FNV_START
    words = ["", "a", "rupee", "größe", "x" * 50]
    assert [one(spark, hashing.fnv1a(F.col("s")), s=w) % (1 << 64) for w in words] == hashing.fnv1a_many([w.encode() for w in words]).tolist()
    assert hashing.simhash_text("", {}) == 0
    assert one(spark, hashing.document_id(F.col("a"), F.col("b")), a=" 7 ", b="u") == "7"
    assert len(one(spark, hashing.document_id(F.col("a"), F.col("b")), a="", b="u")) == 17


def test_urls(spark):
    canon = lambda u: one(spark, text.canonical_url(F.col("u")), u=u)
    assert canon("HTTPS://Example.COM/News/Story/?utm_source=x&id=5#top") == "https://example.com/News/Story?id=5"
    assert canon("https://example.com/") == "https://example.com/"
    assert canon("https://example.com/a?fbclid=1&gclid=2") == "https://example.com/a"
    assert canon(canon("http://A.b/c/?x=1&utm_a=2")) == canon("http://A.b/c/?x=1&utm_a=2")
    assert one(spark, text.resolve_href(F.col("h"), F.col("p")), h="//x.y/z", p="https://a.b/c") == "https://x.y/z"
    assert one(spark, text.resolve_href(F.col("h"), F.col("p")), h="mailto:a", p="https://a.b/c") is None


def test_names_and_words(spark):
    assert one(spark, text.norm_name(F.col("s")), s="HDFC  Bank!") == extract.norm_name("HDFC  Bank!") == "hdfc bank"
    assert one(spark, text.word_count(F.col("s")), s="one 2 three, --") == 2
    assert one(spark, text.last_words(F.col("s"), 2), s="a b\nc d") == "c d"
    assert one(spark, text.squeeze(F.col("s")), s=" a \n b ") == "a b"
    assert one(spark, text.url_encode(F.col("s")), s="a b&c") == "a%20b%26c"


def test_amounts_counts_dates():
    assert extract.amounts("paid Rs 5 crore today") == [(5e7, "INR", "crore", "", 5)]
    assert [a[:3] for a in extract.amounts("2.5 lakh and $3 million")] == [(250000.0, "", "lakh"), (3e6, "USD", "million")]
    assert extract.amounts("room 12 is free") == []
    assert extract.amounts("members 5 met")[0][1] == "INR"
    assert extract.counts("It has 1,200 employees and 5 crores") == [("", 1200.0, "employees", 7)]
    assert [x[1:4] for x in extract.dates("on 2024-05-06, 10 June 2026 and June 11, 2026")] == [(2024, 5, 6), (2026, 6, 10), (2026, 6, 11)]
    assert extract.amounts("für € 7")[0][4] == len("für ".encode())


def test_organisations():
    found = {o[0]: o for o in extract.organisations("RBI met Acme Industries Ltd, and the Reserve Bank of India said so.")}
    assert found["Reserve Bank of India"][3] == 1.0 and "Acme Industries Ltd" in found
    assert extract.organisations("nothing here") == []


def test_themes_places_tone(spark):
    t = "The bank met in London about inflation while Londonderry and the embankment waited"
    assert [x["theme"] for x in one(spark, text.themes(F.col("s"), d.THEMES), s=t)] == ["FIN_BANKING", "ECON_INFLATION"]
    assert [x["feature_id"] for x in one(spark, text.places(F.col("s"), d.PLACES), s=t)] == ["GB/London"]
    assert one(spark, text.themes(F.col("s"), d.THEMES), s="bank") == []
    panel = one(spark, text.tone_panel(F.col("s"), d.POSITIVE, d.NEGATIVE, d.ACTIVE), s="profit growth announced")
    assert round(panel["positive"], 3) == 66.667 and panel["negative"] == 0 and panel["word_count"] == 3
    assert one(spark, text.quick_tone(F.col("s"), d.QUICK_POSITIVE, d.QUICK_NEGATIVE), s="profit") == 10.0
    assert one(spark, text.quick_tone(F.col("s"), d.QUICK_POSITIVE, d.QUICK_NEGATIVE), s="") == 0.0


def test_types_and_filter(spark):
    rows = [("m1", "Auction Result of x", "", "", None), ("M2", "Appeal No 1 filed by B", "", "", {"doc_type": "x", "k": "v"}), ("zz", "Survey on y", "", "", None), ("m1", "t", "Speeches", "", None)]
    df = spark.createDataFrame(rows, "module string, title string, section_name string, url string, classification map<string,string>")
    typed = classify.with_doc_type(df, "m1", "m2", "m3")
    assert [r["classification"] for r in typed.collect()] == [{"doc_type": "market_action"}, {"k": "v", "doc_type": "individual_appeal"}, None, {"doc_type": "speech"}]
    assert classify.keep_wanted(typed).count() == 2


def test_greedy_rule_in_blocks(spark, tmp_path):
    """A family of near copies, strays and a chain, in blocks of every size, against the rule applied one by one; null keys lead nothing."""
    rng = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    centre, chain = rng.getrandbits(64), [rng.getrandbits(64)]
    for _ in range(40):
        chain.append(flip(chain[-1], 2))
    prints = [flip(centre, rng.randint(0, 3)) for _ in range(450)] + [rng.getrandbits(64) for _ in range(60)] + chain
    rng.shuffle(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    first, want, reps = {}, {}, []
    for i, p in enumerate(prints):
        if first.setdefault(p, i) == i:
            near = [r for r in reps if (prints[r] ^ p).bit_count() <= 3]
            if near:
                want[i] = near[0]
            else:
                reps.append(i)
    assert len(want) > 100 < len(reps)
    marked = spark.createDataFrame([*rows, (None, rows[0][1] ^ 1)], "doc_id long, simhash long")
    for least in (60, 16384):
        assert {r["node"]: r["leader"] for r in dedupe.leaders(marked, least=least).collect()} == want
    ends = dedupe.block_ends(marked.where("doc_id is not null").select("simhash", F.col("doc_id").alias("first")), 50)
    assert ends == sorted(ends) and 2 <= len(ends) <= 4
    assert dedupe.leaders(marked.limit(0)).collect() == []


def test_greedy_rule_is_not_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "first_a long, first_b long")
    assert sorted(map(tuple, dedupe.greedy_representatives(pairs).collect())) == [(2, 1), (4, 3)]


def test_first_and_last_wins(spark):
    empty = spark.createDataFrame([], "k string, v int, at int")
    new = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 3), (None, 3, 3)], "k string, v int, at int")
    assert sorted((r["k"] or "", r["v"]) for r in store.insert_ignore(empty, new, ["k"], ["at"]).collect()) == [("", 3), ("", 3), ("a", 1)]
    assert store.upsert(empty, new.where("k is not null"), ["k"], ["at"]).first()["v"] == 2
    ledger = spark.createDataFrame([("s", "d", 10, 10, "success", 5, "")], "source string, dataset string, last_attempt_ts long, last_success_ts long, status string, rows_ingested long, message string")
    failed = spark.createDataFrame([("s", "d", 20, False, 0, "no")], "source string, dataset string, ts long, ok boolean, rows long, message string")
    assert tuple(store.record_results(ledger, failed).first()) == ("s", "d", 20, 10, "failed", 0, "no")


def test_graph(spark):
    mentions = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a"), ("x", "c"), ("y", "a")], "doc_id string, entity_id string")
    pairs = graph.document_pairs(mentions)
    assert sorted((r["src"], r["dst"]) for r in pairs.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    edges = graph.edge_weights(pairs.select(F.col("src").alias("src_entity_id"), F.col("dst").alias("dst_entity_id"), F.lit(2.0).alias("weight")))
    nodes = graph.node_labels(edges, spark.createDataFrame([("a", "A & <co>")], "entity_id string, canonical_name string"))
    lines = [r["line"] for r in graph.gexf_lines(nodes, edges).orderBy("section", "position").collect()]
    tree = ElementTree.fromstring("\n".join(lines[1:]))
    ns = "{http://gexf.net/1.3}"
    assert len(tree.findall(f".//{ns}node")) == 3 and {e.get("weight") for e in tree.findall(f".//{ns}edge")} == {"2"}


def test_robots_and_retries(spark):
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nAllow: /a/b\nUser-agent: z\nDisallow: /")], "host string, body string")
    urls = spark.createDataFrame([("http://h/a/x",), ("http://h/a/b/c",), ("http://h/",), ("http://other/a",)], "url string")
    assert {r["url"]: r["allowed"] for r in crawl.robots_allowed(urls, crawl.robots_rules(robots)).collect()} == {"http://h/a/x": False, "http://h/a/b/c": True, "http://h/": True, "http://other/a": True}


def test_chunks():
    def by_words(s):
        out, held = [], ""
        for c in " ".join(s.split()):
            held += c
            if c in ".!?" and len(held.split()) >= 3:
                out.append(held.strip())
                held = ""
        return out + [held.strip()] * (len(held.split()) >= 3)

    for s in ("", "A b.c d. E f", "At 3.14 p.m. it ended!Then more came... And so on? no", "a.b.c d e.f g h i", "x . y . z . w", "!!! a b c"):
        assert chunk.sentences_by_words(s) == by_words(s)
    assert chunk.sentences("One two three. Too short. And now this one ends!") == ["One two three.", "And now this one ends!"]
    assert chunk.merge_small(["a b", "c", "d e f", "g"], 3) == ["a b c", "d e f g"]
    assert all(len(c.split()) <= 500 for c in chunk.semantic_chunks(" ".join(f"word{i} goes on here." for i in range(900))))
    assert chunk.semantic_chunks("Too little text to keep here.") == []
    assert chunk.fixed_windows(" ".join("abcdefghij" * 10), 60)[1].split()[0] == (list("abcdefghij") * 10)[40]
    assert chunk.pack_paragraphs("a b\n\nc d\n\ne f", 4, 1) == ["a b\n\nc d d e f"]


def test_pages():
    title, body, quality = html.paragraph_text("<html><title>t</title><h1>Head</h1><script>'</p>'</script><p>short</p><p>This paragraph is long enough &amp; kept<p>So is this one, although it is never closed")
    assert title == "Head" and body.count("\n\n") == 1 and "&" in body and 0 < quality < 1
    assert html.to_markdown("<h2>A</h2><p>b <b>c</b> <a href='/d'>e</a></p><ul><li>f</li></ul><script>x</script>") == "## A\n\nb **c** [e](/d)\n\n- f"


def test_prices(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TradDt,FinInstrmId,ClsPric,SctySrs\n2024-01-02,5,10.5,EQ\n2024-01-02,x,,EQ\nragged,1\n,7,1,EQ\n")
    rows = market.typed_prices(market.rows_by_header(market.read_lines(spark, str(tmp_path)))).orderBy("at").collect()
    assert [(r["fin_instrm_id"], r["close_price"], r["security_series"], r["isin"]) for r in rows] == [(5, 10.5, "EQ", ""), (None, None, "EQ", "")]
    assert one(spark, market.legacy_date(F.col("s")), s="2-JAN-2006") == "2006-01-02"
    assert one(spark, market.legacy_date(F.col("s")), s="x") == "x"
    assert [one(spark, market.looks_like_csv(F.col("s")), s=s) for s in ("a,b", "<html>", "", "TradDt")] == [True, False, False, True]
    assert [r["day"] for r in market.business_days(spark, "2024-06-03", 2).collect()] == [date(2024, 6, 3), date(2024, 5, 31)]


def test_price_layouts(spark, tmp_path):
    (tmp_path / "new.csv").write_text('\nTradDt,FinInstrmId,FinInstrmNm,ClsPric\n2024-09-02,5,"Bolts, ""fine""\nand nuts",10.5\n')
    (tmp_path / "old.csv").write_text("SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,\nABC,EQ,1,2,0.5,1.5,x,1,100,150,2-JAN-2006,\nABD,EQ,1,2,1,1,1,1,1,1,,\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    rows = market.load_prices(spark, str(tmp_path)).orderBy("trade_date").collect()
    assert [(r["layout"], r["trade_date"], r["ticker_symbol"], r["fin_instrm_id"], r["fin_instrm_name"], r["close_price"], r["last_price"]) for r in rows] == [
        ("legacy", "2006-01-02", "ABC", None, None, 1.5, None),
        ("new", "2024-09-02", "", 5, 'Bolts, "fine"\nand nuts', 10.5, None),
    ]


def test_document_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"url": "u", "text": "t", "source_name": ["s"]}')
    (tmp_path / "b.json").write_text('{"uniqueID": "7", "URL": "w", "text": "t", "pubdate": "2024-01-01", "sourceName": ["z"]}')
    rows = documents.read_json(spark, str(tmp_path)).orderBy("filename").collect()
    assert rows[0]["url"] == "u" and rows[1]["unique_id"] == "7" and rows[1]["publish_date"] == "2024-01-01" and rows[1]["url"] == "w" and rows[1]["source_name"] == ["z"]
    assert "html_content" not in documents.output_columns(documents.read_json(spark, str(tmp_path))).columns


def test_wordpieces_and_vectors(spark):
    vocabulary = {w: i for i, w in enumerate(["[CLS]", "[SEP]", "[UNK]", "un", "##aff", "##able", "cafe", ".", "a"])}
    assert wordpiece.wordpiece("unaffable", vocabulary) == ["un", "##aff", "##able"] and wordpiece.wordpiece("unx", vocabulary) == ["[UNK]"]
    assert wordpiece.ids("Café unaffable.", vocabulary) == [0, 6, 3, 4, 5, 7, 1] and wordpiece.ids("a a a unaffable", vocabulary, 6) == [0, 8, 8, 8, 1]
    pooled = wordpiece.pool(np.ones((1, 3, 4)), np.array([[1, 1, 0]]))
    assert np.allclose(np.linalg.norm(pooled), 1)
    chunks = spark.createDataFrame([(1, "one two"), (2, None)], "chunk_index int, chunk_text string")
    rows = wordpiece.embed_chunks(chunks, wordpiece.hash_embedder(16)).collect()
    assert [round(sum(x * x for x in r["vector"]), 4) for r in sorted(rows)] == [1.0, 0.0]


def test_chain_order_and_processors(spark):
    steps = [chain.Plugin("tone", priority=10), chain.Plugin("themes", priority=-20), chain.Plugin("ner", enabled=False), chain.Plugin("solr"), chain.Plugin("geocode", kind="retriever")]
    assert chain.plan(steps) == ["themes", "tone"]
    docs = spark.createDataFrame([("1", "http://A.b/x/?utm_a=1", "RBI and SEBI agreed with HDFC Bank about inflation in Mumbai, London. " * 4, "m", ["s"], 5)] * 1 + [("2", "u", "short", "m", [], 6)], "unique_id string, url string, text string, module string, source_name array<string>, publish_date_ms long")
    out = chain.run_chain(docs, [chain.Plugin(n, priority=i) for i, n in enumerate(["dedupe", "mentions", "extract_quant", "themes", "tone", "geocode", "ner", "split_text"])]).orderBy("doc_id").collect()
    assert out[0]["url"] == "http://a.b/x" and out[0]["themes"][0]["theme"] == "FIN_BANKING" and len(out[0]["organizations"]) == 3 and out[1]["tone"] is None
    assert chain.mention_rows(chain.mentions(docs)).first()["source"] == "s"


def test_model_calls_are_injected(spark):
    docs = spark.createDataFrame([("x" * 80, {"metadata": "y" * 30}), ("z" * 80, None)], "text string, generated_content map<string,string>")
    out = assist.tag(docs, "llama3", "Tag this.", lambda: lambda p: f"{len(p)} characters were sent")
    rows = {r["text"][0]: r["generated_content"] for r in out.collect()}
    assert rows["x"] == {"metadata": "y" * 30} and rows["z"]["metadata"].endswith("characters were sent")
    assert one(spark, assist.reply_text("chatgpt", F.col("s")), s='{"choices":[{"message":{"content":"hi"}}]}') == "hi"
    assert one(spark, assist.prompt("gemma2", F.lit("i"), F.col("s")), s="b").startswith("<start_of_turn>user\ni\nb")


def test_dates(spark):
    for s, f in (("Jun 05, 2024.", dates.central_bank_date), ("5 June 2024", dates.central_bank_date), ("05-06-2024", dates.insurance_regulator_date), ("05-JUN-2024", dates.exchange_date), ("Jun 5, 2024", dates.market_regulator_date)):
        assert one(spark, f(F.col("s")), s=s) == date(2024, 6, 5), s
    assert one(spark, dates.insurance_regulator_date(F.col("s")), s="to be announced") is None
    assert tuple(one(spark, dates.iso_date(F.col("s")), s="2024-06-05T23:30:00-05:00")) == ("2024-06-05", 1717648200)
    assert one(spark, dates.fenced_json(F.col("s")), s='Sure:\n```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, dates.fenced_json(F.col("s")), s="plain") == "plain"
    assert one(spark, text.fixed_url(F.col("s"), F.lit("https://a.b/")), s="/c") == "https://a.b/c" and one(spark, text.fixed_url(F.col("s"), F.lit("x")), s="") is None


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text('data_dir = "a"\n[[plugins]]\nname = "tone"\npriority = 3\n[[sites]]\nplugin_name = "s"\nvalid_url_patterns = ["x/"]\nunknown = 1\n')
    monkeypatch.setenv("GLEANER_DATA_DIR", "b")
    c = config.read(str(tmp_path / "c.toml"))
    assert c["data_dir"] == "b" and config.plugins(c)[0].priority == 3 and config.sites(c)[0].valid_url_patterns == ("x/",)


def test_dated_archives(spark, tmp_path):
    docs = spark.createDataFrame([("m", "u1", "t1", "2024-01-02"), ("m", "u2", "t2", "2024-01-02"), ("m", "u1", "t1", "2024-01-02")], "module string, url string, text string, publish_date string")
    assert archives.write_dated_zips(docs, str(tmp_path)).collect()[0]["n"] == 2
    assert archives.write_dated_zips(docs, str(tmp_path)).count() == 0
    rows = documents.read_archives(spark, str(tmp_path)).collect()
    assert {(r["url"], r["text"], r["publish_date"]) for r in rows} == {("u1", "t1", "2024-01-02"), ("u2", "t2", "2024-01-02")}
    assert archives.merge_zips(str(tmp_path / "2024" / "2024-01-02.zip"), str(tmp_path / "all.zip")) == 2


def test_selectors_and_listings(spark):
    page = "<div class='story lead'><p>One <a href='/x'>two</a></p><p>three</div><div id=z><p>four</p><script>no</script></div>"
    elements = select.parse(page)
    assert [e.text() for e in select.select(elements, "div.story p")] == ["One two", "three"]
    assert [e.text() for e in select.select(elements, "div[class*='lea'] p, #z p")] == ["One two", "three", "four"]
    assert select.first_long_text(page, ["main p", "#z", "div.story p"], 5) == "One two\nthree" and select.first_long_text("", ["p"], 1) == ""
    html_ = "<table class=tablebg><tr><td>Jun 05, 2024<tr><td><a href='/a'>A</a></td><td><a href='/a.pdf'>pdf</a></td></tr><tr><td><a href='/b.pdf'>B</a></table>"
    rows = listing.listing_rows(spark.createDataFrame([("https://r.example/list", html_)], "url string, html string")).orderBy("row").collect()
    assert [(r["title"], r["link"], r["pdf"], r["published"]) for r in rows] == [("A", "https://r.example/a", "https://r.example/a.pdf", date(2024, 6, 5)), ("B", "https://r.example/b.pdf", "https://r.example/b.pdf", date(2024, 6, 5))]
    assert listing.page_requests(spark.range(2), 3).count() == 6


def test_feeds(spark):
    def fail(_):
        raise RuntimeError("no file")

    jobs = [feeds.Feed("a", "x", lambda s: feeds.Outcome(True, 7)), feeds.Feed("b", "x", fail), feeds.Feed("c", "x", fail, 2)]
    ledger = spark.createDataFrame([("c", "x", 1000, 1000, "success", 3, "")], feeds.LEDGER)
    after = {r["source"]: (r["status"], r["rows_ingested"], r["last_success_ts"]) for r in feeds.run_feeds(spark, jobs, ledger, 2000).collect()}
    assert after == {"a": ("success", 7, 2000), "b": ("failed", 0, None), "c": ("success", 3, 1000)}


def test_summaries_of_parts(spark):
    docs = spark.createDataFrame([(1, "word " * 30, []), (2, "word " * 300, [("0", "first " * 20), ("1", "second " * 20)])], "doc_id int, text string, text_parts array<struct<id:string,text:string>>")
    out = assist.summarise(docs, "m", "Summarise.", lambda: lambda p: "S(" + p[-60:].strip() + ")" * 40, "doc_id", 100)
    rows = {r["doc_id"]: r["summary"] for r in out.collect()}
    assert rows[1].startswith("S(") and "word" in rows[1] and rows[2].startswith("S(")
