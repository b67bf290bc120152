import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from emberlake.llm import language, mixing, ngram_join


def test_stages_equal_their_brute_force_versions(spark, tmp_path):
    """Every stage on small documents: rejected texts, groups of copies, sources, token digests."""
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9001, "12345 67890 !!!", "en", "src1", 15), (9002, None, None, None, None), (9003, "你好世界 我们 是 学生 你们 好", None, "src1", 9)]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["known_language", "one_of_each_group", "mixed_sources", "encoded"]

    def step(k, given):
        out = corpus_pipeline.STAGES[k][1](spark, given, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert out.columns == docs.columns
        return out, out.collect()

    one, rows = step(0, docs)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows} == {9001, 9002, 9003}

    texts = {r.doc_id: r.text for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.encode().lower().split())}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    two, rows = step(1, one)
    assert sorted(r.doc_id for r in rows) == sorted(i for i in sets if label[i] == i)

    copies = {r.doc.doc_id: r.copies for r in mixing.mix(two, max_epochs=corpus_pipeline.MAX_EPOCHS).collect()}
    three, rows = step(2, two)
    assert Counter(r.doc_id for r in rows) == Counter({i: c for i, c in copies.items() if c}) and min(copies.values()) >= 1

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, rows = step(3, three)
    assert Counter(r.doc_id for r in rows) == Counter({i: c for i, c in copies.items() if c})
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 0
    assert language.REJECTED > 0 and ngram_join.THRESHOLD == 0.8
