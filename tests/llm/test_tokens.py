from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import byte_bpe, catalog, token_counts
from factloom.llm.pretokens import Memory, PieceEncoder, Splitter, pattern_sources

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TRICKY = ["", None, " ", "\n\n  x", "it's  we'll 'S", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "Ünïcödé 中文字 🙂🙂 \U0002ebf0\U00031350 x", "١٢٣ ½ Ⅷ", "​　\xa0 \x1c\x85", "é न्म", "x" * 3000, "ab " * 2000, "퟿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference_bpe():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counter(library):
    sources = pattern_sources("tokenizers")
    with open(JSON, encoding="utf-8") as f:
        return token_counts.Counter(f.read(), sources, token_counts.proven_whole_tokens(library, Splitter(sources)))


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.library_model(byte_bpe.load_ranks(RANKS)), pattern_sources("tiktoken"))


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids string")


def test_counts_equal_the_library(spark, library):
    got = {r.doc_id: r for r in token_counts.token_counts(rows(spark, TRICKY + TRICKY), JSON).collect()}
    for i, text in enumerate(TRICKY + TRICKY):
        text = text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 512)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="ab 'sl\n\t09é中<|endoftext>", max_size=60))
def test_any_text(counter, codec, library, reference_bpe, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    ids = reference_bpe.encode_ordinary(text)
    packed = codec.encode(text)
    assert packed == struct.pack(f"<{len(ids)}I", *ids)
    assert codec.decode(packed) == text.encode()
    spans = codec.offsets(text)
    assert len(spans) == len(ids)
    assert all(token in text[a:b].encode() for (a, b), token in zip(spans, map(reference_bpe.decode_single_token_bytes, ids), strict=True))


def test_shortcut_holds_for_every_proven_string(counter, library):
    proven = list(counter.whole)
    assert len(proven) > 45_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(proven, add_special_tokens=False))


def test_a_full_memory_changes_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 1)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 1)
    sources = pattern_sources("tokenizers")
    with open(JSON, encoding="utf-8") as f:
        small = token_counts.Counter(f.read(), sources, [])
    codec = byte_bpe.Codec(byte_bpe.library_model(byte_bpe.load_ranks(RANKS)), pattern_sources("tiktoken"))
    for text in ("qqq zzz xkcd", "zqj qzj jzq " * 30, "qqq new words qqq zzz"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert small.count(text) == len(ids)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_memory_carries_over_what_is_met_again():
    learned = []

    def learn(names):
        learned.extend(names)
        return [(n, len(n)) for n in names]

    memory = Memory(learn, 3)
    for piece in ("a", "b", "a", "cc", "ddd", "a", "e", "f", "a"):
        assert list(memory.of([piece, piece])) == [len(piece)] * 2
    assert sorted(learned) == sorted({"a", "b", "cc", "ddd", "e", "f"})


def test_many_pieces_in_one_call_equal_single_calls(library, monkeypatch):
    with open(JSON, encoding="utf-8") as f:
        pieces = PieceEncoder(f.read())
    monkeypatch.setattr(PieceEncoder, "STEP", 3)
    names = [" the", "ÿ", "\xff\xfe", " Ünï", "🙂", "1234", "zqxj", "\n", "ÿÿ"]
    got = []
    for part, ids, stops in pieces.ids(names):
        got += [a.tolist() for a in np.split(ids, stops)[:-1]]
        assert stops[-1] == len(ids)
    assert got == [library.encode(n, add_special_tokens=False).ids for n in names]


def test_other_definitions_are_refused():
    with open(JSON, encoding="utf-8") as f:
        definition = json.load(f)
    token_counts.check_definition(json.dumps(definition))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        with pytest.raises(ValueError):
            token_counts.check_definition(json.dumps(definition | change))


def test_null_and_repeated_ids(spark, reference_bpe):
    docs = spark.createDataFrame([(None, "one two"), (None, None), (3, "one two"), (3, "three"), (3, "three")], "doc_id long, text string")
    counts = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(docs, JSON).collect())
    assert counts == [(-1, 0), (-1, 2), (3, 1), (3, 1), (3, 2)]
    coded = sorted((r.doc_id or -1, r.n_tokens) for r in byte_bpe.encode(docs, RANKS).collect())
    assert coded == counts


def test_long_text_is_split_lazily(counter, codec, library, reference_bpe, monkeypatch):
    import factloom.llm.pretokens as pretokens

    monkeypatch.setattr(pretokens, "LAZY_CHARS", 10)
    monkeypatch.setattr(pretokens, "LAZY_PIECES", 3)
    text = "One two  three, four 5 six!\n\n seven's   "
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    ids = reference_bpe.encode_ordinary(text)
    assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_encode_then_decode_a_table(spark, reference_bpe):
    coded = byte_bpe.encode(rows(spark, TRICKY), RANKS, decoded=True, offsets=True)
    again = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(coded, RANKS).collect()}
    for r in coded.collect():
        ids = reference_bpe.encode_ordinary(TRICKY[r.doc_id] or "")
        assert r.n_tokens == len(ids) == len(r.offsets)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.decoded) == again[r.doc_id] == (TRICKY[r.doc_id] or "").encode()


def test_split_characters_decode():
    assert byte_bpe.decode_text([b"\xf0\x9f", b"\x99\x82", b"!"]) == "🙂!"
    assert byte_bpe.decode_text([b"\xf0\x9f"]) == "�"


def test_empty_tables(spark):
    empty = rows(spark, []).limit(0)
    assert token_counts.token_counts(empty, JSON).count() == 0
    assert byte_bpe.encode(empty, RANKS).count() == 0


def test_queries_on_the_smallest_tables(spark, library, reference_bpe):
    import duckdb

    texts = dict(duckdb.connect().execute("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall())
    for r in catalog.op1_token_counts(spark, "/root/testdata/sf0.001").collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
    for r in catalog.op7_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = reference_bpe.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
