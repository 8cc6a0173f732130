"""op7 against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from wefthread.llm import bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(bpe.default_path()))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.fixture(scope="module")
def plain(vocabulary):
    """The library with a pattern that doesn't split."""
    return tiktoken.Encoding("plain", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


ODD = [None, "", " ", "\n\n  \t x", "don't STOP", "<|endoftext|>", "𝒳𝒴 漢字かな 한국 👩‍👩‍👧 é", "a" * 300, "ab" * 200, "0123456789" * 20, "\u0000​", "   leading", "x" * 3 + " " * 70 + "y", "ééé" * 50]


def test_documents_match_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, None, None, 0) for i, t in enumerate(ODD)] * 2 + [(None, "x", "", "", 0)], DOCS)
    rows = docs.union(odd).selectExpr("*", "1 as n_tokens", "2 as ids")
    text = {r.doc_id: r.text for r in rows.collect()}
    got = bpe.encode_documents(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, text[r.doc_id])
    assert bpe.encode_documents(rows.limit(0)).collect() == []


def test_long_text_is_whole(spark, library, monkeypatch):
    text = " ".join(random.Random(1).choice(["the", "édition", "x1", "!!", "\n"]) for _ in range(300_000))
    enc = bpe.TextEncoder(bpe.Vocabulary(bpe.read_ranks(bpe.default_path())), P.PATTERN)
    assert len(text) > bpe.LONG_TEXT
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_appends_and_edits(vocabulary, plain):
    rng = random.Random(2)
    letters = "abcdefgh the ing tion éü 12\n"
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 200)))
        state = bpe.PrefixEncoding(vocabulary)
        for i in range(0, len(text), 7):
            state.append(text[i : i + 7].encode())
        for _ in range(5):
            data = state.data
            assert vocabulary.decode(state.ids()) == data
            if vocabulary.ranks.get(data) is None:
                try:
                    assert state.ids() == plain.encode_ordinary(data.decode())
                except UnicodeDecodeError:
                    pass
            a = rng.randrange(len(data) + 1)
            b = rng.randrange(a, min(len(data), a + 9) + 1)
            state.replace(a, b, "".join(rng.choice("abc the") for _ in range(rng.randrange(6))).encode())


def test_edit_stays_local(vocabulary):
    state = bpe.PrefixEncoding(vocabulary, b"the quick brown fox jumps over the lazy dog. " * 200)
    again = state.replace(2000, 2005, b"XYZ")
    assert again < 1000
    assert state.last == bpe.PrefixEncoding(vocabulary, state.data).last
