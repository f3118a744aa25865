"""The language model against plain Python, and the classifier on the test corpus."""

from math import exp

import brute
import numpy as np
from pyspark.sql import functions as F
from seismark.llm import perplexity as P


def grams_of(text):
    p = [1, 1, 1, *map(ord, " ".join(text.split()))]
    return [tuple(p[i:i + 4]) for i in range(len(p) - 3)]


def test_like_plain_python(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "the dog  sat\non the log", "en"), (3, "a cat and a dog", "en"), (4, "zebra quiz the cat", "en"), (5, None, "en"), (6, " \n ", None),
            (7, "été là", "fr"), (None, "the cat", "en"), (4, "zebra quiz the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 1, 0), (3, 1, 0), (4, 1, 1), (7, 0, 0), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    texts = [(d, t or "", lang) for d, t, lang in rows]
    model = brute.kneser_ney([g for d, t, _ in texts if d in (1, 2, 3) for g in grams_of(t)], {g for _, t, _ in texts for g in grams_of(t)})
    got = sorted(P.score(docs, labels).collect(), key=lambda r: (r.doc_id or 0))
    for r, (d, t, lang) in zip(got, sorted(texts, key=lambda x: x[0] or 0), strict=True):
        g = grams_of(t)
        assert (r.doc_id, r.lang, r.trusted, r.n_chars) == (d, lang or "und", d in (1, 2, 3), len(g))
        assert (r.loss is None) if not g else abs(r.loss + np.mean([model[x] for x in g])) < 1e-9


def test_probabilities_of_a_context_add_up():
    text = grams_of("the cat sat on the mat and the dog sat on the cat")
    letters = {g[-1] for g in text}
    for h in {g[:-1] for g in text}:
        p = brute.kneser_ney(text, [(*h, c) for c in letters])
        assert sum(map(exp, p.values())) < 1 + 1e-9


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = P.classify(docs, labels).join(labels, "doc_id")
    kept = {(r.quality, r.toxic): r.k for r in out.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[(1, 0)] > 0.98 and kept[(0, 0)] < 0.4


def test_empty_and_untrusted(spark):
    docs, labels = spark.createDataFrame([(1, "abc", None), (2, None, "x")], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert P.classify(docs.limit(0), labels).collect() == []
    assert {r.doc_id: r.kept for r in P.classify(docs, labels).collect()} == {1: True, 2: False}
