import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from corpusmill.llm import bpe as B

from .util import collect, docs

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", "a", " ", "  ", " a", "a ", "a  b", " \n a", "a\n b", "é" * 50, "x" * 5000, " " * 999 + "a", "it's we'll 'Re",
       "日本語 text<|endoftext|> 😀😀\n\n\t  z", "　a  b\x1c c", "0123456789" * 300, "\x00\x01", "a\r\nb \r\n"]


@pytest.fixture(scope="module")
def codec():
    return B.Codec(B.load_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("abcdé theing ingstion 12345!!??\n\t  'ß") for _ in range(rnd.randrange(300)))
                  for _ in range(500)]


def test_ids_equal_the_library_and_round_trip(codec, library):
    some = texts()
    for text, ids in zip(some, codec.encode(some)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_one_tree_and_trees_side_by_side_agree(codec):
    rnd = random.Random(4)
    pieces = [bytes(rnd.choice(b"abctheing \xc3\xa9") for _ in range(rnd.randrange(1, 64))) for _ in range(2000)]
    import numpy as np
    want = [np.array(B.merge_piece(p, codec.ranks), np.int32).tobytes() for p in pieces]
    assert codec.merge_many(pieces) == want


def test_memo_is_bounded_and_changes_nothing(codec, monkeypatch):
    some = texts()
    want = [x.tolist() for x in codec.encode(some)]
    monkeypatch.setattr(B, "MEMO", 5)
    small = B.Codec(codec.ranks, P.PATTERN)
    for text, ids in zip(some, want):
        assert small.encode([text])[0].tolist() == ids


def test_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, None), (3, None), (2, "again")]
    got = collect(B.digests(docs(spark, rows), PATH, P.PATTERN, with_ids=True), "doc_id", "n_tokens", "ids_sha256",
                  "decoded_sha256", "ids")
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert B.digests(docs(spark, []), PATH, P.PATTERN).count() == 0
