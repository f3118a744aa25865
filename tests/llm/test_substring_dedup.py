"""Substring dedup against plain Python."""

import random

import brute
import pytest
from pyspark.sql import functions as F
from seismark.llm import substring_dedup as S


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = S.dedup(df, **how).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s")).collect()
    return {r.doc_id: (r.n_words, r.n_removed, r.s) for r in out}


def texts(seed, n=60):
    rnd = random.Random(seed)
    passage = [[f"w{rnd.randrange(6)}" for _ in range(rnd.randrange(15, 60))] for _ in range(5)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rnd.randrange(5)):
            w += [f"{rnd.choice('ab')}{rnd.randrange(300)}" for _ in range(rnd.randrange(30))] + (rnd.choice(passage)[rnd.randrange(8):] if rnd.random() < 0.6 else [])
        rows.append((d, rnd.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("first", [5, 10])
def test_like_plain_python(spark, seed, first):
    rows = texts(seed)
    assert run(spark, rows, first=first) == brute.substring(rows)


def test_periodic_and_odd_texts(spark):
    rows = [(1, "a " * 50), (2, None), (3, ""), (4, " \n "), (5, "a " * 19), (6, "a " * 20), (7, "é x " * 30), (8, "b" * 5000 + " " + "c " * 400),
            (9, "b" * 5000 + " " + "c " * 30)]
    assert run(spark, rows) == brute.substring(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    a, b = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(30))
    df = spark.createDataFrame([(2, a, 1), (2, a, 2), (None, b, 3), (7, b, 4), (9, a, 5)], "doc_id long, text string, tv long")
    got = sorted((r.doc_id or -1, r.n_removed) for r in S.dedup(df).collect())
    assert got == [(-1, 0), (2, 0), (2, 0), (7, 30), (9, 40)]


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_width_must_double(spark):
    with pytest.raises(ValueError):
        S.dedup(spark.createDataFrame([], "doc_id long, text string"), width=20, first=3)
