"""The pipeline against plain Python on the smallest table; queries against their SQL twins."""

import brute
import corpus_pipeline
import oracle
import pytest
from pyspark.sql import functions as F
from seismark.llm import quality_rules, queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_pipeline_like_plain_python(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r.text for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).where("kept").collect()}
    groups = brute.jaccard(list(rows.items()))
    rows = {d: t for d, t in rows.items() if groups[d][1] == d}
    cut = {}
    removed = brute.substring(list(rows.items()))
    firsts = {}
    for d in sorted(rows):
        w = brute.words(rows[d])
        gone = set()
        for i in range(len(w) - 19):
            if firsts.setdefault(tuple(w[i:i + 20]), (d, i)) != (d, i):
                gone |= set(range(i, i + 20))
        assert len(gone) == removed[d][1]
        cut[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else rows[d]
    cut = {d: t for d, t in cut.items() if t}
    leaks = brute.leaks(list(cut.items()), [(r.item_id, r.text) for r in bench.collect()])
    left = {d: len(brute.words(t)) for d, t in cut.items() if not leaks[d][1]}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == left


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0


def test_stages_keep_other_columns(spark):
    names = ["a.b", "score", "kept", "row", "n_words", "kid", "tv", "places", "root"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) > 50 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twins(spark, con, name):
    r = oracle.compare(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert r["ok"], r["why"]
