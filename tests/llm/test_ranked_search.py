"""Ranked search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from seismark.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores, key=lambda x: (x[0], -math.inf if x[1] is None else x[1]))[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kid", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("score", F.lit(1)).repartition(2)
    return sorted(map(tuple, R.search(d, q, k).collect()), key=str)


def corpus(seed, n=300, n_items=40):
    rnd = random.Random(seed)
    words = [rnd.choice(["é", "W", "w", "1"]) + str(i) for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    text = lambda k: rnd.choice([" ", ", ", "\n", "_"]).join(rnd.choices(words, weights, k=k))
    docs = [(i, text(rnd.choice([1, 5, 60, 300]))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)] + [(n + 60, None), (n + 61, ""), (n + 62, "-- !"), (None, docs[0][1]), (5, docs[5][1])]
    shared = [text(12) for _ in range(5)]
    items = [(i, text(rnd.choice([2, 10])) + " " + " ".join(rnd.sample(shared, rnd.randrange(4)))) for i in range(n_items)]
    items += [(900, items[0][1]), (901, None), (902, "..."), (903, "unknownterm"), (904, items[1][1] + " " + items[1][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_like_plain_python(spark, monkeypatch, seed):
    docs, items = corpus(seed)
    want = plain(docs, items)
    assert len(want) > 700
    assert run(spark, docs, items) == want
    for name, value in (("TEXT", 3000), ("SLICE", 3), ("ITEMS", 9), ("CELLS", 2000), ("ALIKE", 2), ("SLOTS", 1 << 15)):
        monkeypatch.setattr(R, name, value)
    assert run(spark, docs, items) == want


def test_repeated_and_null_items_empty_tables(spark):
    docs = [(1, "a b c"), (2, "a a"), (3, "x" * 100000), (4, "q")]
    got = run(spark, docs, [(1, "a"), (1, "a"), (None, "B"), (2, "x" * 100000)])
    assert got == plain(docs, [(1, "a"), (None, "B"), (2, "x" * 100000)])
    assert run(spark, [], [(1, "a")]) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def test_graph_shares_work():
    rng = np.random.default_rng(1)
    sets = rng.random((30, 8)) < 0.3  # terms of eight shared passages
    uses = (sets @ (rng.random((8, 60)) < 0.4)).astype(bool)
    merges, of_item = R.mined(uses)
    terms_of = [{i} for i in range(30)]
    for a, b in merges:
        assert not terms_of[a] & terms_of[b]
        terms_of.append(terms_of[a] | terms_of[b])
    for i, nodes in enumerate(of_item):
        assert sorted(x for g in nodes for x in terms_of[g]) == np.flatnonzero(uses[:, i]).tolist()
    assert len(merges) + sum(map(len, of_item)) < 0.6 * uses.sum()
