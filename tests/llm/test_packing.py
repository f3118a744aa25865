"""Packing: best bounds against all choices; batches hold every piece once and keep their budget."""

from itertools import combinations

import numpy as np
import pytest
from seismark.llm import packing as P


def waste(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(8))
def test_bounds_are_the_best(seed):
    rnd = np.random.default_rng(seed)
    lengths = rnd.choice(np.arange(1, 60), rnd.integers(4, 10), replace=False)
    counts = rnd.integers(1, 50, len(lengths))
    k = int(rnd.integers(1, 4))
    got = P.best_bounds(lengths, counts, k)
    top = max(lengths)
    best = min(waste(lengths, counts, (*c, top)) for n in range(k) for c in combinations(sorted(set(lengths) - {top}), n))
    assert len(got) <= k and waste(lengths, counts, got) == best


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 50)
    rnd = np.random.default_rng(3)
    sizes = {i: int(n) for i, n in enumerate(rnd.integers(0, 700, 400))} | {500: 0, 501: 5000}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()] + [(None, 7, "y"), (502, None, "z")], "doc_id long, n_tokens long, bucket string")
    rows = P.pack(df, max_len=512, n_buckets=4, budget=2048).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == sizes | {None: 7, 502: 0}
    full = [r for r in rows if r.n_tokens]
    assert all(r.bucket is None and r.batch is None for r in rows if not r.n_tokens)
    assert len({(r.bucket, r.batch, r.slot) for r in full}) == len(full)
    batches = {}
    for r in full:
        batches.setdefault((r.bucket, r.batch), []).append(r)
        assert r.n_tokens + r.padding == r.bucket_len <= 512 and r.slot < 2048 // r.bucket_len
    for b in {b for b, _ in batches}:  # only the last batch of a bucket may be short
        sizes_of = [len(v) for (x, n), v in sorted(batches.items()) if x == b]
        assert set(sizes_of[:-1]) <= {2048 // batches[(b, 0)][0].bucket_len}
    pieces = sorted((r.first_token, r.n_tokens) for r in rows if r.doc_id == 501)
    assert pieces == [(i, min(512, 5000 - i)) for i in range(0, 5000, 512)]


def test_word_lengths_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, " a b\tc "), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in P.word_lengths(docs).collect()} == {1: 3, 2: 0, 3: 0}
    assert P.pack(P.word_lengths(docs.limit(0))).collect() == []
    with pytest.raises(ValueError):
        P.pack(P.word_lengths(docs), max_len=100, budget=50)
