import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framekit.llm import bpe
from tests.llm.helpers import none, odd_documents

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdefghinorst 'ld\n", max_size=80))
def test_as_the_library(own, theirs, text):
    packed = own.encode(text)
    assert ids(packed) == theirs.encode_ordinary(text)
    assert own.decode(packed) == text


@pytest.mark.parametrize("text", ["a" * 30000, " " * 9000 + "x", "=" * 5000, "ab" * 9000, "\U0001f600" * 500, "don't we'll I'd", "\x1c\x85\xa0 　x", "\U0001e5d0՘"])
def test_hard_texts(own, theirs, text):
    assert ids(own.encode(text)) == theirs.encode_ordinary(text) and own.decode(own.encode(text)) == text


def test_blocks_and_small_tables(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    small = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN, 20, 5)
    text = "Thereonation of hedgehogs, überaus 1234567 unhelpfully; antidisestablishmentarianism! " * 4 + "q" * 500
    assert ids(small.encode(text)) == theirs.encode_ordinary(text) and small.decode(small.encode(text)) == text


def test_stream_decodes_any_cut(own):
    data = "aé日\U0001f600z".encode()
    for size in range(1, 5):
        machine = bpe.Utf8Stream()
        out = [machine.feed(data[i : i + size]) for i in range(0, len(data), size)] + [machine.close()]
        assert "".join(out) == data.decode()
    machine = bpe.Utf8Stream()
    assert machine.feed(b"\xe6\x97") == "" and machine.close() == "�"


def test_other_merges():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaaa": 260}
    t = bpe.Transducer(ranks)
    theirs = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "aabc", "abab", "aaaaaaa", "bcbcab", "cab", "abcabcaa" * 3):
        assert t.encode(text.encode()) == theirs.encode_ordinary(text)


def test_odd_documents(spark, theirs):
    docs = odd_documents(spark)
    out = bpe.encode_documents(docs, PATH, P.PATTERN)
    assert out.count() == docs.count() and "Score" in out.columns
    for r in out.collect():
        text = r["text"] or ""
        assert ids(r["ids"]) == theirs.encode_ordinary(text) and r["decoded"] == text and r["n_tokens"] == len(ids(r["ids"]))
    again = bpe.decode_documents(out.select("doc_id", "ids"), PATH, P.PATTERN, keep=["doc_id"])
    assert sorted(r[1] for r in again.collect()) == sorted(r["text"] or "" for r in docs.collect())
    assert bpe.encode_documents(none(spark), PATH, P.PATTERN).count() == 0


def test_query(spark, theirs):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in bpe.op4_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = theirs.encode_ordinary(d["text"])
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()
