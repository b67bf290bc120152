import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from emberlake.llm import bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in B.ranks_of(PATH).encode(list(B.pieces(texts)))]


def test_random_texts_equal_the_library(library):
    random.seed(1)
    parts = ["a", "s", "t", "ll", "ve", "re", "'", " ", "  ", "\n", "\t", "1", "²", "é", "!", "-", " ", "　", "漢", "😀", "́", "'s", "’s", "\x1c", "\x85", "Z", "<|endoftext|>"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(5000)]
    texts += ["", "'", " ", " 's", "'s's", "''s", "'r", "\n\n x", "a" * 5000, "$" * 3000, " " * 3000, "ab'" * 900, "é" * 49]
    for t, got in zip(texts, ours(texts)):
        assert got == library.encode_ordinary(t), t
        assert B.ranks_of(PATH).decode(np.array(got, "<u4").tobytes()) == t.encode()


def test_every_code_point_has_the_library_s_class(library):
    texts = [f"a{c} 1{c} \n{c}x" for c in map(chr, range(0x3000)) if not c.isspace() or c in B.WHITE]
    assert ours(texts) == [library.encode_ordinary(t) for t in texts]


def test_whole_documents_and_digests(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = B.digests(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_nulls_repeats_offsets(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "it's é", 5), (3, "x", 5), (3, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in B.encode(df, PATH).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and B.encode(df, PATH).count() == 5
    ends = got[None].token_ends
    assert ends[-1] == len("it's é".encode()) and len(ends) == got[None].n_tokens
    assert B.digests(df.limit(0), PATH).count() == 0


def test_long_and_short_pieces_merge_alike(library):
    ranks = B.ranks_of(PATH)
    random.seed(2)
    for n in (B.SIDE_BY_SIDE, B.SIDE_BY_SIDE + 1, 200):
        piece = "".join(random.choices("etaoinsr", k=n))
        want = library.encode_ordinary(piece)
        assert np.frombuffer(ranks.learn({piece})[piece], "<u4").tolist() == want
        assert [ranks.ranks[p] for p in B._heap(piece.encode(), ranks.ranks)] == want


def test_states_equal_a_plain_walk():
    random.seed(3)
    go, _ = B.automaton()
    for n in (0, 1, 63, 64, 65, 1000):
        kind = np.array([random.randrange(10) for _ in range(n)], np.uint8)
        state, want = B.NEW, []
        for k in kind:
            want.append(state)
            state = go[k, state]
        assert B.states_before(kind).tolist() == want
