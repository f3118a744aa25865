"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from seismark.llm import hard_negatives as H


def plain(rows, every=100):
    """[(id, vector, label)] -> sorted result rows; ids differ and are not null."""
    use = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use[i] = ([math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = []
    for a, (va, la) in use.items():
        if a % every:
            continue
        s = {b: sum(x * y for x, y in zip(va, vb)) for b, (vb, _) in use.items() if b != a}
        order = sorted(s, key=lambda b: (-s[b], b))
        for p in [b for b in order if use[b][1] == la][:5]:
            fit = [b for b in order if use[b][1] != la and 30 * s[p] <= 100 * s[b] <= 90 * s[p]]
            out += [(a, p, k + 1, b, s[p], s[b]) for k, b in enumerate(fit[:10])]
    return sorted(out)


def run(spark, rows, every=100):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kid", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(3)
    return sorted(map(tuple, H.mine(H.prepared(df), F.col("kid") % every == 0).collect()), key=str)


def vectors(seed, n=400, dims=20):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [x + rnd.gauss(0, 0.15) for x in rnd.choice(base)]
        rows.append((i, list(base[0]) if rnd.random() < 0.1 else v, rnd.randrange(10) if rnd.random() < 0.95 else None))
    rows[3] = (3, None, 1)
    rows[4] = (4, [None] * dims, 1)
    rows[5] = (5, [float("nan")] * dims, 1)
    rows[6] = (6, [float("inf")] + [0.0] * (dims - 1), 1)
    rows[8] = (8, [0.1, 2.0], 1)
    rows[9] = (9, [], 1)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_plain_python(spark, monkeypatch, seed):
    rows = vectors(seed)
    want = plain(rows, 20)
    assert len(want) > 100
    assert run(spark, rows, 20) == sorted(want, key=str)
    monkeypatch.setattr(H, "ANCHORS", 6)
    monkeypatch.setattr(H, "SLICE", 37)
    assert run(spark, rows, 20) == sorted(want, key=str)


def test_large_components(spark):
    rnd = random.Random(5)
    rows = [(i, [float(np.float32(rnd.uniform(-1, 1) * 10 ** rnd.randrange(5))) for _ in range(9)], i % 3) for i in range(60)]
    assert run(spark, rows, 10) == sorted(plain(rows, 10), key=str)


def test_planes_and_tables():
    rng = np.random.default_rng(3)
    for dims in (1, 8, 13):
        for top in (1, 256, 1 << 20):
            x, y = rng.integers(-top, top, (7, dims)), rng.integers(-top, top, (50, dims))
            planes = H.bit_planes(y)
            assert (H.from_planes(planes, dims) == y).all()
            assert (H.scores(H.subset_sums(x), planes) == y @ x.T).all()


def test_repeats_null_ids_empty(spark):
    v = [0.5, 0.5]
    rows = [(100, v, 1), (100, v, 1), (None, v, 1), (None, v, 1), (101, [0.3, 0.3], 2), (102, [0.3, 0.3], 2)]
    assert run(spark, rows) == [(100, None, 1, 101, 32768, 19456), (100, None, 2, 102, 32768, 19456)]
    assert run(spark, []) == []
    assert run(spark, [(1, v, 1)]) == []
