"""Token store: exact round trips through the files."""

import numpy as np
import pytest
from seismark.llm import token_store as T
from seismark.llm.common import shared_dir

TEXTS = ["", None, "a  b\n\n c  d  ", " x ", "don't, it's.\nOk", "a\n b", "x,\ny", "　 hi  there\x1c \x1fq", "é,b .c\r\nd", "1,2.\n3a.b\nC", "x" * 3000 + " " + "y" * 3001, "日本語 text, 🙂🙂 ok"]


@pytest.mark.parametrize("seed", range(5))
def test_bounds(seed):
    rnd = np.random.default_rng(seed)
    ends = np.cumsum(rnd.integers(1, [2, 5, 400, 40_000, 3][seed], [1, 700, 1000, 900, 5000][seed]))
    form = T.encode_bounds(ends)
    b = T.Bounds(len(ends), *form)
    assert (b.all() == ends).all() and [b.end(i) for i in range(-1, len(ends))] == [0, *ends.tolist()]
    assert sum(map(len, form[1:])) * 8 <= len(ends) * (3.3 + np.log2(max(2, ends[-1] / len(ends)))) + 200


def test_round_trip(spark):
    tok = T.public_tokenizer("byte_bpe_50k.json")
    rows = [(i * 7 % 12, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, (None, "no id", "y"), (3, TEXTS[4], "z")], "doc_id long, text string, ids string").repartition(4)
    path = shared_dir(spark, "test")
    T.write_store(docs, path, tok)
    got = sorted(T.read_store(spark, path).collect(), key=lambda r: r.start)
    want = sorted([(-1, "no id"), (3, TEXTS[4]), *((d, t or "") for d, t, _ in rows)])
    at, t = 0, tok()
    for r, (d, text) in zip(got, want, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (d, at, len(ids), ids)
        at += len(ids)
    digest = {r.start: r.ids_crc32 for r in T.token_digest(docs, tok).collect()}
    assert digest == {r.start: T.crc(np.frombuffer(r.ids, "<u4")) for r in got}


def test_real_texts_like_the_library(spark):
    tok = T.public_tokenizer("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = shared_dir(spark, "test")
    T.write_store(docs, path, tok)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in T.read_store(spark, path).collect()}
    t = tok()
    assert got == {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}


def test_empty_table(spark):
    assert T.token_digest(spark.createDataFrame([], "doc_id long, text string"), T.public_tokenizer("byte_bpe_50k.json")).collect() == []
