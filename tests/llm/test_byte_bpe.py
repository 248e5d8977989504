from __future__ import annotations

import base64
from array import array
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = byte_bpe.codec(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


def ids(text):
    return list(array("I", BPE.encode(text)))


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text("abcdeinst ñé.日本\n\t$1'", max_size=80))
def test_ids_are_those_of_the_library_and_decode_to_the_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "\n" * 900, "é" * 900, " " * 900, "abcde" * 900, "\x00\x1f\x85"])
def test_long_pieces(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_backtracking_equals_merging_on_a_small_vocabulary():
    words = [b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aab", b"dd", b"abcd", b"da"]
    ranks = {bytes([i]): i for i in range(256)} | {w: 256 + i for i, w in enumerate(words)}
    small = byte_bpe.ByteBpe(ranks, r"[\s\S]+")
    library = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 8):
        for i in range(4**n):
            text = "".join("abcd"[i // 4**k % 4] for k in range(n))
            assert list(array("I", small.encode(text))) == library.encode_ordinary(text), text


def check(rows, docs):
    want = []
    for d in docs.collect():
        text = d["text"] or ""
        encoded = array("I", LIBRARY.encode_ordinary(text))
        want.append((d["doc_id"], len(encoded), sha256(encoded.tobytes()).hexdigest(), sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_messy_rows(messy, no_docs):
    check(byte_bpe.encode_documents(messy, PATH, public_tokenizers.PATTERN).collect(), messy)
    assert byte_bpe.encode_documents(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_query_equals_library(documents):
    check(byte_bpe.encode_documents(documents, PATH, public_tokenizers.PATTERN).collect(), documents)


def test_round_trip_as_tables(messy):
    rows = byte_bpe.encode_documents(messy, PATH, public_tokenizers.PATTERN, keep_ids=True)
    back = byte_bpe.decode_documents(rows, PATH).collect()
    texts = sorted((d["text"] or "").encode() for d in messy.collect())
    assert sorted(bytes(r["decoded"]) for r in back) == texts


def test_bytes_of_ranks_are_read_whole():
    with open(PATH, "rb") as file:
        assert BPE.ranks == {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
