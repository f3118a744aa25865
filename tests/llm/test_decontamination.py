"""Decontamination against plain Python."""

import random
import re

import brute
import pytest
from seismark.llm import decontamination as D


def run(spark, rows, items, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = D.find(docs, spark.createDataFrame(items, "item_id long, text string"), **how).collect()
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out}


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "naïve", "7"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 9, 10, 11, 30])))) for i in range(40)] + [(50, None), (51, ""), (52, "...")]
    items += [(60, items[5][1]), (61, items[7][1])]
    rows = []
    for d in range(50):
        w = rnd.choices(vocabulary, k=rnd.randrange(40))
        if rnd.random() < 0.7:
            x = rnd.choice(items)[1] or ""
            w += [x.upper().replace(" ", "--") if rnd.random() < 0.3 else x] * rnd.randrange(1, 3) + rnd.choices(vocabulary, k=rnd.randrange(5))
        rows.append((d, " ".join(w)))
    return [*rows, (90, None), (91, ""), (92, "?!")], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("depth", [1, 3])
def test_like_plain_python(spark, seed, depth):
    rows, items = corpus(seed)
    assert run(spark, rows, items, depth=depth) == brute.leaks(rows, items)


def test_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 100)
    rows, items = corpus(3)
    assert run(spark, rows, items) == brute.leaks(rows, items)


def test_near(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, item), (2, "kappa iota theta eta zeta epsilon delta gamma beta alpha"), (3, "alpha " + "x " * 30 + "beta " + "y " * 30 + "gamma"), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in D.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), near=True).collect()}
    assert got == {1: (10, 1), 2: (0, 1), 3: (0, 0), 4: (10, 1)}


def test_near_is_registered(spark, tmp_path):
    from seismark.llm import queries, registry  # noqa: F401

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, item), (2, item.replace("gamma", "gamma indeed")), (3, "nothing of it"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = registry.QUERIES["op10_proximity"](spark, str(tmp_path))
    assert out.columns == [*registry.QUERIES["op10_decontamination"](spark, str(tmp_path)).columns, "n_near"]
    assert {r.doc_id: (r.contaminated, r.n_near) for r in out.collect()} == {1: (True, 1), 2: (False, 1), 3: (False, 0), 4: (False, 0)}


def test_clean_repeated_rows_null_ids_clashing_columns(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, item, 0), (1, item, 0), (None, item, 1), (2, "fine", 2), (None, "fine", 3)], "doc_id long, text string, tv long")
    bench = spark.createDataFrame([(5, item), (None, "fine")], "item_id long, text string")
    assert sorted(r.tv for r in D.clean(docs, bench).collect()) == [2, 3]
    assert sorted(r.n_hit for r in D.find(docs, bench).collect()) == [0, 0, 12, 12, 12]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert D.find(docs.limit(0), bench).collect() == []
    assert [(r.n_hit, r.contaminated) for r in D.find(docs, bench.limit(0)).collect()] == [(0, False)]


def test_no_python_in_the_plan(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert not re.search("Python|Pandas|Arrow", D.find(docs, bench)._jdf.queryExecution().executedPlan().toString())
