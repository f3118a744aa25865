"""Language ID on the test corpus: held-out accuracy, the filter's answers, odd texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from seismark.llm import language_id as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return L.train(docs.where(~L.held_out()))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(L.held_out())
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert out.where("score < 0 or score > 1").count() == 0


def test_filter_never_loses_a_member():
    rnd = np.random.default_rng(0)
    profiles = {f"l{i:02d}": rnd.integers(0, 2**63, 300).astype(np.uint64) for i in range(70)}
    f = L.build(profiles)
    for i, (name, grams) in enumerate(sorted(profiles.items())):
        assert ((f.languages(grams)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all(), name
    other = rnd.integers(0, 2**63, 20000).astype(np.uint64)
    hits = ((f.languages(other)[:, 0] >> np.uint64(3)) & np.uint64(1)).mean()
    assert abs(hits - f.false_rate[3]) < 0.01


def test_odd_texts(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !? \n", "x"), (4, "é", "x"), (None, "der die und ist nicht " * 2000, "x"), (6, "a" * 100_000, "x"), (4, "é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    out = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(docs, model).collect()]
    assert len(out) == 7 and {p for d, p, s in out if d in (1, 2, 3)} == {"und"} and all(s == 0 for d, p, s in out if d in (1, 2, 3))
    assert all(p in model.langs for d, p, s in out if d not in (1, 2, 3)) and dict((d, p) for d, p, _ in out)[None] == "de"
    assert L.identify(docs.limit(0), model).collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(docs, L.train(docs)).collect()] == [(1, "und", 0.0)]
