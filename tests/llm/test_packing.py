import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlake.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = P.Encoder(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sSt ée,.-1\n\t\r\x0b\x1c\x85\xa0　​中ß½ñ×́…")), max_size=40))
def test_parts_have_the_ids_of_the_whole(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)[:-1]


def test_forgetting_and_long_parts(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    text = "one two three  four don't l'été " + "w" * 500 + " one\n\n\nx <|endoftext|> you'll"
    for _ in range(2):
        assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)[:-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_tree_finds_the_tightest_window(lengths):
    windows, rooms = P.best_fit(lengths, 16)
    # The slow twin scans all windows.
    slow = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [r for r in slow if r >= lengths[item]]
        if fit:
            slow.remove(min(fit))
            slow.append(min(fit) - lengths[item])
        else:
            slow.append(16 - lengths[item])
    assert sorted(rooms) == sorted(slow)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert all(16 - sum(lengths[i] for i in w) == r for w, r in zip(windows, rooms))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.sampled_from([1, 40, 10**6]))
def test_sequences_hold_every_token_once(lengths, block):
    docs = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(lengths)]
    found = list(P.sequences(iter(docs), 32, block))
    sizes = [sum(map(P.tokens, s)) for s in found]
    assert all(n == 32 or n & (n - 1) == 0 and n < 32 for n in sizes) and sum(n < 32 for n in sizes) <= 5
    for i, n in enumerate(lengths):
        pieces = sorted((p[1], p[2]) for s in found for p in s if p[0] == i)
        assert b"".join(x for _, x in pieces) == np.arange(n, dtype="<u4").tobytes()
        assert [s for s, _ in pieces] == np.cumsum([0, *(len(x) // 4 for _, x in pieces)])[:-1].tolist()


def check(rows, found, window):
    """Every token of every document is in one place, and places are gapless."""
    docs, places = {}, {}
    for r in found:
        docs.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append(r)
    assert sum(r["length"] for r in found) == sum(len(ids(t)) for _, t in rows)
    for parts in places.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or at < window and at & (at - 1) == 0
    for key, text in {k: t for k, t in rows}.items():
        if sum(k == key for k, _ in rows) == 1:
            parts = sorted(docs[key], key=lambda r: r["start"])
            assert np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist() == ids(text)
            assert all(r["doc_tokens"] == len(ids(text)) for r in parts)


@pytest.mark.parametrize("block", [64, 1 << 22])
def test_packed_documents(spark, block):
    rows = [(i, f"Word{i} " * (i % 37)) for i in range(120)] + [(500, None), (501, ""), (502, "x y " * 3000), (None, "null id"), (503, "same"), (503, "same")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, sequence_id string").repartition(3)
    check(rows, P.packed(df, PATH, window=64, block=block).collect(), 64)


def test_query_equals_the_library_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = P.packed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH).collect()
    check(rows, found, 2048)
    crc = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in found}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in P.op12_packing(spark, "/root/testdata/sf0.001").collect()} == crc


def test_empty_table_and_text_ids(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    assert P.packed(df.limit(0), PATH).collect() == []
    assert [r.doc_id for r in P.packed(df, PATH).collect()] == ["a"]
