"""Wu-Manber search against plain search, and benchmarks in several blocks."""

import random
import re

from gleaner.llm import decontaminate, queries


def plain(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    d, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            part = w[k : k + 13]
            for i in range(len(d) - len(part) + 1):
                if d[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(item)
    return len(d), sorted(hit), found


def test_matcher():
    r = random.Random(3)
    vocabulary = ["a", "bb", "ß", "The", "x1", "zé", "Q", "long-word"]
    phrase = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ".", "!"]) for _ in range(n))
    for _ in range(150):
        items = [(str(i), phrase(r.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(r.randint(0, 8))]
        texts = [phrase(r.randint(0, 60)) + (" " + r.choice(items)[1] + " z" if items and r.random() < 0.7 else "") for _ in range(r.randint(1, 6))]
        for t, (n, hit, found) in zip(texts, decontaminate.Matcher(items).scan(texts), strict=True):
            assert (n, hit.tolist(), found) == plain(t, items)


def test_long_texts_and_many_patterns():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(300)]
    items = [(str(i), " ".join(r.choice(words) for _ in range(40))) for i in range(60)]
    text = " ".join(r.choice(words) for _ in range(20_000)) + " " + items[7][1] + " " + " ".join(r.choice(words) for _ in range(20_000))
    assert [(n, hit.tolist(), found) for n, hit, found in decontaminate.Matcher(items).scan([text])] == [plain(text, items)]


def test_blocks_change_nothing(spark, sf_dir):
    documents, benchmark = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "benchmark")
    one = decontaminate.contamination(documents, benchmark).collect()
    many = decontaminate.contamination(documents, benchmark, block_bytes=2000).collect()
    assert sorted(one) == sorted(many) and any(x["contaminated"] for x in one)


def test_many_blocks_are_one_python_node(spark, sf_dir, monkeypatch):
    documents = queries.table(spark, sf_dir, "documents")
    benchmark = queries.table(spark, sf_dir, "benchmark")
    size = sum(len((t or "").encode()) for _, t in set(benchmark.select("item_id", "text").collect()))
    assert len(decontaminate.write_blocks(benchmark, 13, size // 50)) > 20
    many = decontaminate.contamination(documents, benchmark, block_bytes=size // 50)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(many.collect()) == sorted(decontaminate.contamination(documents, benchmark).collect())


def test_normalising():
    r = random.Random(9)
    for _ in range(300):
        t = "".join(r.choice(["a", "B", " ", "  ", ".", "ß", "\n", "\0", "1"]) for _ in range(r.randint(0, 12)))
        assert decontaminate.normalised(t) == b" " + b" ".join(decontaminate.words(t)) + b" "
