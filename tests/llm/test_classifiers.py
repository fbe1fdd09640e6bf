"""Quality, toxicity and HTML extraction: parts against plain versions, models by held-out accuracy."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import block_labeller, boosting, html_blocks, quality, queries, toxicity, train_block_labeller

SF = "/root/testdata/sf0.01"


def test_trees_learn_and_score_like_a_walk():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000], trees=150)
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    for row, s in zip(x[:20], forest.score(x[:20]), strict=True):
        raw = forest.base
        for t in range(len(forest.feature)):
            at = 0
            while forest.left[t, at] != at:
                at = forest.left[t, at] if row[forest.feature[t, at]] <= forest.threshold[t, at] else forest.right[t, at]
            raw += forest.value[t, at]
        assert abs(1 / (1 + np.exp(-raw)) - s) < 1e-9


def test_one_label_or_none():
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (boosting.fit(np.zeros((9, 3)), np.ones(9)).score(np.zeros((2, 3))) > 0.9).all()


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "Hello world", "UP!! UP!! UP!!", "ü" * 40, "a\nb\na\n", "x | y | z", None, "w " * 5000]
    together = quality.statistics(pa.array(texts))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()))[0], row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the larger tables")
@pytest.mark.parametrize(("name", "label", "least"), [("op10_quality", "quality", 0.95), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    scored = queries.QUERIES[name](spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert sum(r["predicted"] == r[label] for r in scored) / len(scored) > least


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_find_what_distances_say():
    r = random.Random(6)
    word = lambda a, b: "".join(r.choice("abcé") for _ in range(r.randint(a, b)))
    for _ in range(100):
        terms, stems = sorted({word(1, 11) for _ in range(8)}), sorted({word(3, 5) for _ in range(2)})
        tokens = sorted({word(1, 13) for _ in range(60)})
        found = toxicity.Lexicon(terms, stems).find(tokens)
        for t in tokens:
            near = [(distance(t[1:], x[1:]), x) for x in terms if t[0] == x[0] and distance(t[1:], x[1:]) <= toxicity.budget(x)] + [(0, s + "*") for s in stems if t.startswith(s)]
            assert found.get(t) == ((min(near)[1], min(near)[0]) if near else None)


def test_misspelled_and_quoted():
    finder = toxicity.Finder(toxicity.Model(["worthless", "idiot"], ["vequ"], frozenset({"idiom"}), 0.8))
    texts = ["you are an idiot", "you worthles fool", 'He said "you idiot" to them', "an idiom is fine", "vequais", "", "IDI0T and 1diot"]
    x = finder.features(texts)
    assert x[0, 0] == 1 and x[1, 0] == 0.8 and x[2, 0] == toxicity.QUOTED_WEIGHT and not x[3].any() and x[4, 1] == 1 and not x[5].any() and x[6, 0] == 0.8


def test_first_letters_and_short_terms():
    model = toxicity.Model(["idiot", "scum", "stupid"], [], frozenset({"spud"}), 0.8, anywhere=True)
    x = toxicity.Finder(model).features(["1diot", "$tupid", "you scvm", "diot", "xidiot", "spud", "plain", "scum"])
    assert x[:, 0].tolist() == [0.8, 0.8, 0.8, 0.8, 0.8, 0, 0, 1]
    r = random.Random(8)
    word = lambda a, b: "".join(r.choice("abcé") for _ in range(r.randint(a, b)))
    for _ in range(100):
        terms, tokens = sorted({word(1, 11) for _ in range(8)}), sorted({word(1, 13) for _ in range(60)})
        found = toxicity.Lexicon(terms, [], anywhere=True).find(tokens)
        for t in tokens:
            near = [(distance(t, x), x) for x in terms if distance(t, x) <= toxicity.budget(x)]
            assert found.get(t) == ((min(near)[1], min(near)[0]) if near else None)


def test_blocks_of_broken_pages():
    page = '<body><nav><ul><li><a href="/x">Home<li>News</ul></nav><p>One <b>two<p>three &amp; four<script>"</p>"</script><div class="ad box">buy</div></body>'
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["Home", "News", "One two", "three & four", "buy"]
    assert found[0].links == 4 and found[-1].path[-1] == "div ad box"
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<p") == html_blocks.blocks("<p>") == []
    assert [b.text for b in html_blocks.blocks("<!-- <p>no --> a <style>p{}</style> b <unclosed 'x")][0].startswith("a b")


def test_labels_do_not_depend_on_the_batch():
    model = block_labeller.load(block_labeller.packaged())
    pages = [x for x, _ in train_block_labeller.examples(40, 123)] + [np.zeros((0, block_labeller.WIDTH), np.float32)]
    together = model.label_pages(pages)
    for page, p in zip(pages, together, strict=True):
        assert len(p) == len(page) and (not len(page) or np.allclose(model.label_pages([page])[0], p, atol=1e-4))


def test_packaged_weights_and_training():
    model = block_labeller.load(block_labeller.packaged())
    assert train_block_labeller.accuracy(model, train_block_labeller.examples(300, 4321)) > 0.99
    small = train_block_labeller.train(n=1500, epochs=3, say=lambda _: None)
    assert train_block_labeller.accuracy(small, train_block_labeller.examples(100, 77)) > 0.8


def test_gradient_is_the_slope():
    model = block_labeller.Labeller.start(3)
    data = train_block_labeller.examples(3, 5)
    x, live = block_labeller.pad([d[0] for d in data])
    y = np.zeros(live.shape, np.float32)
    for j, (_, labels) in enumerate(data):
        y[: len(labels), j] = labels
    _, grad = train_block_labeller.gradients(model, x, live, y)
    for key in ("xf", "hb", "cf", "out"):
        at = np.unravel_index(np.abs(grad[key]).argmax(), grad[key].shape)
        kept, losses = model.w[key][at], []
        for step in (1e-2, -1e-2):
            model.w[key][at] = kept + step
            losses.append(train_block_labeller.gradients(model, x, live, y)[0])
        model.w[key][at] = kept
        assert abs((losses[0] - losses[1]) / 2e-2 - grad[key][at]) < 0.05 * abs(grad[key][at]) + 1e-3


def test_main_text_of_pages(spark, sf_dir):
    rows = {r["page_id"]: r for r in queries.op8_html_extraction(spark, sf_dir).collect()}
    for r in queries.table(spark, sf_dir, "pages").collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        assert rows[r["page_id"]]["text"] == "\n".join(b.text for b in html_blocks.blocks(inner))
        assert rows[r["page_id"]]["n_chars"] == len(rows[r["page_id"]]["text"])


@pytest.mark.parametrize("step", [1, 2, 5, 1000])
def test_statistics_of_long_texts_in_steps(step):
    r = random.Random(step)
    for _ in range(200):
        raw = "".join(r.choice(["a", "b", " ", "\n", "\t", "ab", "é", "a b", "\n\n"]) for _ in range(r.randint(0, 60))).encode()
        data = np.frombuffer(raw, np.uint8)
        assert quality._long_word_statistics(data, step) == quality._word_statistics(raw)
        starts = np.array([0, len(raw) // 3, len(raw) // 3, len(raw)])
        assert np.array_equal(quality._class_counts(data, starts, step), quality._class_counts(data, starts))


def test_scores_of_the_queries_text_by_text(spark, sf_dir):
    """Each score from the model and one text alone: a walk down the trees, and the weighed hits."""
    frame, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    docs = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    forest, model = queries.quality_model(frame, labels), queries.toxicity_model(frame, labels)
    for r in queries.op10_quality(spark, sf_dir).collect():
        x = quality.statistics(pa.array([docs[r["doc_id"]]]))[0]
        raw = forest.base
        for t in range(len(forest.feature)):
            at = 0
            while forest.left[t, at] != at:
                at = forest.left[t, at] if x[forest.feature[t, at]] <= forest.threshold[t, at] else forest.right[t, at]
            raw += forest.value[t, at]
        assert abs(r["score"] - 1 / (1 + np.exp(-raw))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)
    for r in queries.op9_toxicity(spark, sf_dir).collect():
        want = 0.0
        if model.weights is not None:
            want = 1 / (1 + np.exp(-float(np.r_[1.0, toxicity.Finder(model).features([docs[r["doc_id"]]])[0]] @ model.weights)))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)


def test_a_repeated_id_is_one_labelled_row(spark):
    from gleaner.llm import labelled

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (None, "d")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = labelled.sample(docs, known, "toxic", labelled.remainder("doc_id", 4) >= 0, 10).collect()
    assert sorted(tuple(r) for r in rows) == [("", 1), ("c", 0)]
