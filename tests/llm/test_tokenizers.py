"""Token counts, shards and SentencePiece against their libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import queries, token_shards
from gleaner.llm.bpe import NEVER, merge
from gleaner.llm.mphf import MinimalPerfectHash
from gleaner.llm.piece_bpe import PieceBpe, read_model
from gleaner.llm.tables import Table64
from gleaner.llm.token_counts import TokenCounter, prepare

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TABLES = prepare(BYTES)
COUNTER, ENCODER, LIBRARY = TokenCounter(TABLES), token_shards.IdEncoder(TABLES), Tokenizer.from_file(BYTES)
BPE, SENTENCEPIECE = PieceBpe(read_model(PIECES)), sentencepiece.SentencePieceProcessor(model_file=PIECES)

PARTS = ["the", " ", "  ", "\n", "\t", "a", "é", "日本", "<|endoftext|>", "12", "3", "'s", "'", "'re", "!!", "▁", "ß", "\0", "՘", "🙂", "Ᲊ", "​", " ", "\U000107bb", "</s>", "\r\n", "x" * 120, " " * 70, "ing", "Hello"]
TEXTS = st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=25).map("".join), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_as_the_libraries_do(texts):
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert COUNTER.count(texts).tolist() == [len(e) for e in want]
    assert ENCODER.encode(texts) == [np.array(e.ids, "<u2").tobytes() for e in want]
    ids = [i.tolist() for i in BPE.encode(texts)]
    assert ids == SENTENCEPIECE.encode(texts, add_bos=True, add_eos=True)
    assert [BPE.decode(i) for i in ids] == [SENTENCEPIECE.decode(i) for i in ids]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 258), st.integers(3, 31_999), st.integers(0, 2)), max_size=12))
def test_decoding_of_any_ids(ids):
    assert BPE.decode(ids) == SENTENCEPIECE.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=60, max_size=90))
def test_long_merging_equals_short(text):
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("b", "b"): 2, ("a", "ab"): 3}
    rank = lambda a, b: ranks.get((a, b), NEVER)
    parts = list(text)
    while True:
        best = min(((rank(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(NEVER, 0))
        if best[0] == NEVER:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert merge(list(text), rank) == parts


def test_proven_strings_are_single_tokens():
    sample = TABLES["proven"][::97]
    assert all(len(e) == 1 for e in LIBRARY.encode_batch(sample, add_special_tokens=False) if len(LIBRARY.pre_tokenizer.pre_tokenize_str(e.tokens[0])) == 1)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    function = MinimalPerfectHash.build(keys)
    assert np.array_equal(np.sort(function.slots(keys)), np.arange(len(keys)))
    assert MinimalPerfectHash.build(keys[:0]).size == 0
    with pytest.raises(ValueError):
        MinimalPerfectHash.build(np.array([1, 1], np.uint64))


def test_table():
    keys = np.unique(np.random.default_rng(2).integers(2, 1 << 63, 5000).astype(np.uint64))
    t = Table64(16)
    for part in np.array_split(np.arange(len(keys)), 7):
        t.put(keys[part], part)
    assert np.array_equal(t.get(keys), np.arange(len(keys))) and (t.get(keys + np.uint64(1 << 63)) == -1).all()


def test_shards_answer_by_key(spark, sf_dir, tmp_path):
    docs = queries.table(spark, sf_dir, "documents")
    manifest = token_shards.write_shards(docs, BYTES, str(tmp_path / "ids"), 2)
    texts = dict(docs.select("doc_id", "text").collect())
    for row in manifest.collect():
        shard = token_shards.Shard(row["stem"] + ".ids", row["stem"] + ".idx")
        for key in shard.index.keys[::7].tolist():
            (ids,) = shard.get(key)
            assert ids.tolist() == [*LIBRARY.encode(texts[key], add_special_tokens=False).ids, 2]
        absent = np.arange(10**9, 10**9 + 300)
        assert (shard.index.lookup(absent)[1] > 0).mean() < 0.01
    rows = sorted(token_shards.read_documents(manifest).collect())
    start = 0
    for key, first, n, crc in rows:
        ids = [*LIBRARY.encode(texts[key], add_special_tokens=False).ids, 2]
        assert (first, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert len(rows) == len(texts)


def test_queries_on_whole_texts(spark, sf_dir):
    texts = dict(queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    for r in queries.op3_token_counts(spark, sf_dir).collect():
        assert r["n_tokens"] == len(LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False))
    import hashlib

    for r in queries.op7_sentencepiece(spark, sf_dir).collect():
        ids = SENTENCEPIECE.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(SENTENCEPIECE.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("unit, n", [("x", 1_000_000), ("aGk0+/Q9zTe", 20_000), ("theingtioner", 20_000), ("日本語の一是不了", 8_000), (" ", 50_000), ("a▁▁b", 9_000), ("é1", 30_000)])
def test_long_words_are_as_the_library_gives_them(unit, n):
    text = unit * n
    assert BPE.encode([text])[0].tolist() == SENTENCEPIECE.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcdeingthos-0é日 \n"), min_size=65, max_size=400))
def test_both_fillings_of_the_table_agree(text):
    word = "".join(text.split())
    if word and not BPE.strange(word):
        assert BPE._long_ids(word) == BPE._table_ids([word])[0].tolist()


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_sections_change_nothing(texts):
    from gleaner.llm import piece_bpe, pretoken, tables

    ids, counts, raw = [i.tolist() for i in BPE.encode(texts)], COUNTER.count(texts).tolist(), ENCODER.encode(texts)
    decoded = [BPE.decode(i) for i in ids]
    with pytest.MonkeyPatch.context() as patch:
        cut = tables.cut_text
        patch.setattr(piece_bpe, "cut_text", lambda text, borders: cut(text, borders, 3))
        patch.setattr(pretoken, "cut_text", lambda text, borders: cut(text, borders, 3))
        patch.setattr(pretoken, "SECTION", 3)
        patch.setattr(piece_bpe, "DECODED", 2)
        assert [i.tolist() for i in BPE.encode(texts)] == ids and [BPE.decode(i) for i in ids] == decoded
        assert COUNTER.count(texts).tolist() == counts and ENCODER.encode(texts) == raw


def test_words_with_equal_hashes_are_told_apart():
    coder = token_shards.IdEncoder(TABLES)
    coder.memory.powers[:] = 0  # all words of one length share a hash
    texts = ["one two six ten", "the cat sat on the mat", "two one ten six"]
    for _ in range(2):
        assert coder.encode(texts) == [np.array(e.ids, "<u2").tobytes() for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_word_memory_is_bounded():
    coder = token_shards.IdEncoder(TABLES)
    coder.memory.room = 1000
    for k in range(20):
        coder.encode([" ".join(f"w{k}x{i}" for i in range(300)) + " " + "z" * 5000])
    assert coder.memory.kept[1] < 5000 and len(coder.memory.pool) < 40_000


def test_a_common_key_is_dealt_to_several_tasks(spark, tmp_path):
    rows = [(None if i % 2 else i, f"text number {i}") for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for key in (None, 77):
        docs = spark.createDataFrame([(key if k is None else k, t) for k, t in rows], "doc_id long, text string").repartition(8)
        manifest = token_shards.write_shards(docs, BYTES, str(tmp_path / str(key)), 2)
        per_task = [r[0] for r in manifest.groupBy("task").sum("n_records").select("sum(n_records)").collect()]
        assert max(per_task) <= 2 * sorted(per_task)[len(per_task) // 2] and len(per_task) > 2
        found = token_shards.read_documents(manifest).collect()
        assert len(found) == 4000 and sum(r["key"] == key for r in found) in (2000, 2001)
        keys = [r["key"] for r in sorted(found, key=lambda r: r["start"])]
        assert keys == sorted(keys, key=lambda k: (k is not None, k))
        want = {}
        for k, t in [(key if k is None else k, t) for k, t in rows]:
            want.setdefault(k, []).append(zlib.crc32(np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()))
        got = {}
        for r in found:
            got.setdefault(r["key"], []).append(r["ids_crc32"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(token_shards.key_order(spark.range(1000).selectExpr("id AS key", "'' AS text"))) == 1
    assert len(token_shards.key_order(spark.range(0).selectExpr("id AS key", "'' AS text"))) == 1
