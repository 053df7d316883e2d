"""Token counts and packing against the library on whole texts."""

import zlib
from functools import lru_cache

import numpy as np
import pytest
from texts import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import packing, tokens
from riskframe.llm.queries import packed_rows


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(tokens.default_tokenizer())


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(packing.default_tokenizer())


@lru_cache
def loaded(path):
    return tokens.load_tokenizer(path)


def lengths(tokenizer, texts):
    return [len(e) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts(documents, odd_texts, byte_bpe):
    docs = documents(odd_texts).withColumn("n_tokens", F.lit("clash"))
    got = sorted(tokens.token_counts(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["n_tokens"] for r in got] == lengths(byte_bpe, odd_texts)
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in odd_texts]
    assert tokens.token_counts(docs.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(50, 40), (64, 8), (1000, 300)])
def test_counts_by_chunks(documents, odd_texts, byte_bpe, chunk, overlap):
    """Chunks far shorter than most texts; a run of 5,000 letters forces wider overlaps."""
    texts = odd_texts + ["word " + "y" * 700 + " end\n\n  of it", ("ab  \n" * 300), "<|endoftext|>" * 40, "a" * 63 + "  " * 40 + "b" * 90]
    got = sorted(tokens.token_counts(documents(texts), chunk=chunk, overlap=overlap).collect(), key=lambda r: r["doc_id"])
    assert [r["n_tokens"] for r in got] == lengths(byte_bpe, texts)


LATIN = [chr(c) for c in range(0x21, 0x180)]


@settings(max_examples=1000, deadline=None)
@given(st.sampled_from(["", " "]), st.text(st.sampled_from(LATIN), min_size=1, max_size=12), st.text(st.sampled_from(LATIN[:32]), max_size=4))
def test_words_by_model_and_by_tokenizer(space, word, marks):
    for path, fold in ((tokens.default_tokenizer(), False), (packing.default_tokenizer(), True)):
        encoder = tokens.PieceEncoder(path, list, fold) if path not in ENCODERS else ENCODERS[path]
        ENCODERS[path] = encoder
        piece = space + word + marks
        assert encoder.ids(piece) == encoder.tokenizer.encode(piece, add_special_tokens=False).ids


ENCODERS = {}
TRICKY = st.text(st.sampled_from("ab 's\t\n\x0b\x1c\x85\xa0 　é1½!<|endoftext|>"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_pieces_encode_alone(text):
    for path in (tokens.default_tokenizer(),):
        t = loaded(path)
        assert "".join(tokens.pieces_of(text)) == text
        assert [i for p in tokens.pieces_of(text) for i in t.encode(p, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_words_encode_alone(text):
    t = loaded(packing.default_tokenizer())
    got = packing._encoder(packing.default_tokenizer())(packing._WORD.findall(text))
    assert np.frombuffer(b"".join(got), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing(documents, odd_texts, word_bpe):
    texts = odd_texts + [prose(i, 20 + 37 * i) for i in range(60)] + ["one two three " * 3000]
    docs = documents(texts).repartition(5)
    rows = packed_rows(packing.token_pieces(docs.select("doc_id", "text"))).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = word_bpe.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = ids[at : at + 2048]
            assert (r["piece"], r["start"], r["length"]) == (k, at, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += len(part)
        assert at == len(ids)
    for items in by_bin.values():
        at = 0
        for r in sorted(items, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_bin) <= 1.03 * total / 2048 + 2


def test_packing_merges_over_tasks(spark):
    """Every task alone leaves a bin a tenth full; merged, they fill few bins."""
    items = spark.range(0, 64, 1, 64).select(F.col("id").alias("doc_id"), F.lit(200).cast("long").alias("length"))
    got = packing.pack(items).collect()
    assert len({r["sequence_id"] for r in got}) == -(-64 // 10)
    assert packing.pack(items.filter("doc_id < 0")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_valid(sizes):
    bins, offsets = packing.best_fit(sizes, 50)
    filled = {}
    for b, o, n in sorted(zip(bins, offsets, sizes)):
        assert filled.get(b, 0) == o
        filled[b] = o + n
    assert all(v <= 50 for v in filled.values())
    # two bins at most half full would have been one
    assert sum(v <= 25 for v in filled.values()) <= 1


def test_null_keys_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, None, 3), (None, "a b", None), (2, "a b", 3)], "doc_id long, text string, length int")
    rows = packed_rows(packing.token_pieces(docs))
    assert rows.count() == 3 and sorted(r["length"] for r in rows.collect()) == [1, 3, 3]
    assert sorted(r["n_tokens"] for r in tokens.token_counts(docs).collect()) == [0, 2, 2]
