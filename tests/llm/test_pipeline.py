"""The pipeline's rows against a plain version that goes stage by stage and text by text."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from gleaner.llm import quality, queries, toxicity
from gleaner.llm.workspace import stored

from test_decontaminate import plain
from test_simhash import plain_components, plain_fingerprint


def good(docs, model):
    return {i: t for i, t in docs.items() if model.score(quality.statistics(pa.array([t])))[0] >= queries.GOOD}


def harmless(docs, model):
    if model.weights is None:
        return docs
    odds = {i: float(np.r_[1.0, toxicity.Finder(model).features([t])[0]] @ model.weights) for i, t in docs.items()}
    return {i: t for i, t in docs.items() if 1 / (1 + np.exp(-odds[i])) < queries.TOXIC}


def test_rows(spark, sf_dir):
    frame = queries.table(spark, sf_dir, "documents")
    labels = queries.table(spark, sf_dir, "labels")
    items = [(str(r["item_id"]), r["text"]) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    docs = {r["doc_id"]: r["text"] or "" for r in frame.collect()}

    kept = good(docs, queries.quality_model(frame, labels))
    # The second stage learns from what the first one kept.
    left = stored(frame.where(frame.doc_id.isin(list(kept))), "test-kept")
    kept = harmless(kept, queries.toxicity_model(left, labels))
    groups = plain_components(sorted((i, plain_fingerprint(t)) for i, t in kept.items()))
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    scans = {i: plain(t, items) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if not (scans[i][1] and 20 * len(scans[i][1]) >= scans[i][0])}
    assert 0 < len(kept) < len(docs)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in kept.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
