"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from seismark.llm import simhash_join as S


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, tau=4):
    """[(id, fingerprint)] -> {id: component}"""
    label = {d: d for d, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if label[b] < label[a] and (x ^ y).bit_count() <= tau:
                    label[a], changed = label[b], True
    return label


def texts(seed):
    rnd = random.Random(seed)
    words = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    out = [None, "", "  \n ", "One", "one", "one two three", "ONE\ttwo  three", "a b c d", "a  b\nc d e"]
    for _ in range(12):
        base = rnd.choices(words, k=rnd.choice([5, 40, 300]))
        for _ in range(8):
            w = list(base)
            w[rnd.randrange(len(w))] = rnd.choice(words)
            out.append(rnd.choice([" ", "\n", "  "]).join(w if rnd.random() < 0.7 else base))
    rnd.shuffle(out)
    return out


def test_fingerprints_like_plain_python():
    t = texts(1) + ["x y " * 70000]
    assert S.fingerprints(pa.array(t)).tolist() == [plain_fingerprint(x) for x in t]


@pytest.mark.parametrize("seed", [2, 3])
def test_groups_like_all_pairs(spark, seed):
    rows = list(enumerate(texts(seed)))
    got = {r.doc_id: (r.h, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("h", S.digits()).collect()}
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    label = plain_groups(fps)
    assert got == {d: (f"{x:016x}", label[d]) for d, x in fps}


def near_fingerprints(seed, n=150):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rnd.getrandbits(64) if not out or rnd.random() < 0.2 else rnd.choice(sorted(out))
        for b in rnd.sample(range(64), rnd.randrange(7)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("thresholds", [[0, 0, 0, 0, 0], [1, 0, -1, 1], [2, 1], [3, 0], [4], None])
def test_no_choice_of_partitions_loses_a_link(spark, thresholds):
    fps = near_fingerprints(5)
    df = spark.createDataFrame([(S.signed(x),) for x in fps], "fp long")
    bits = list(range(64))
    random.Random(9).shuffle(bits)
    parts = None if thresholds is None else [(bits[i::len(thresholds)], t) for i, t in enumerate(thresholds) if t >= 0]
    for block in (7, 4096) if thresholds in ([1, 0, -1, 1], None) else (4096,):
        edges = [(r.a % 2**64, r.b % 2**64) for r in S.links(df, parts=parts, block=block).collect()]
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        assert {x: find(x) for x in fps} == plain_groups([(x, x) for x in fps])


def test_thresholds_add_up_and_are_cheapest():
    rnd = random.Random(3)
    for m in range(1, 6):
        cost = [[0.0, *sorted(rnd.random() for _ in range(5))] for _ in range(m)]
        total, ts = S.allocate(cost, 4)
        assert sum(t + 1 for t in ts) == 5

        def all_ways(i, left):
            if i == m:
                yield 0.0 if left == 0 else float("inf")
                return
            for u in range(left + 1):
                for rest in all_ways(i + 1, left - u):
                    yield cost[i][u] + rest

        assert total == pytest.approx(min(all_ways(0, 5)))


def test_correlated_bits_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (2000, 64))
    x[:, 40:48] = x[:, :8]  # eight pairs of equal bits
    groups = S.correlated_groups((x.T @ x).astype(float), 2000, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    where = {b: i for i, g in enumerate(groups) for b in g}
    assert sum(where[i] == where[40 + i] for i in range(8)) >= 7


def test_null_ids_repeats_empty_tables_other_columns(spark):
    rows = [(None, "p q r s t", 1), (3, "p q r s t", 2), (3, "p q r s t", 3), (5, None, 4), (6, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("kid", F.lit("x")).withColumn("a.b", F.lit(1))
    got = sorted(((r.doc_id, r.component_id, r.fp == 0) for r in S.near_duplicates(df).collect()), key=str)
    assert got == [(3, None, False), (3, None, False), (5, 5, True), (6, 5, True), (None, None, False)]
    assert S.near_duplicates(df.limit(0)).collect() == []
