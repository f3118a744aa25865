"""Statistics against plain Python; the trees, their constraints and their flat form."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from seismark.llm import quality_rules as Q

TEXTS = ["", None, " a\n a\n a\n", "\n\n\n", "é é\n", "a " * 50, "x", "a\n", "a\n\na", "# a b c d e f g h\n# a b c d e f g h", "A! B! 1 2 | <x>\t\x0b z", "w" * 3000,
         " ".join(f"w{i % 9}" for i in range(40)), "\n".join(["same line here"] * 5 + ["other"])]


def test_statistics_like_plain_python():
    assert Q.statistics(pa.array(TEXTS, pa.string()))[0].tolist() == [brute.rule_stats(t) for t in TEXTS]


def test_trees_learn_and_keep_their_constraints():
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(4000, 3))
    y = (x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + rnd.normal(0, 0.1, 4000) > 0.6).astype(float)
    trees = Q.fit_trees(x, y, [1, 0, -1])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    line = np.linspace(0, 1, 200)
    for at in rnd.uniform(size=(20, 3)):
        grid = np.tile(at, (200, 1))
        grid[:, 0] = line
        assert (np.diff(trees.score(grid)) >= -1e-12).all()
        grid = np.tile(at, (200, 1))
        grid[:, 2] = line
        assert (np.diff(trees.score(grid)) <= 1e-12).all()


def test_flat_trees_like_walking_one_row():
    rnd = np.random.default_rng(1)
    x = rnd.uniform(size=(500, 2))
    t = Q.fit_trees(x, (x[:, 0] > x[:, 1]).astype(float), [0, 0], n_trees=5)

    def walk(row):
        out = t.base
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            out += t.value[at]
        return 1 / (1 + np.exp(-out))

    assert np.allclose(t.score(x), [walk(r) for r in x])


def test_judge(spark):
    good = [(i, " ".join(f"plain{i}x{j}" for j in range(60)), "a") for i in range(60)]
    bad = [(100 + i, "!! ## " * 40 + " ".join(f"JUNK{i}x{j}!!" for j in range(30)), "b") for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (None, None, "c"), (7, "a " * 30, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in good[:40]] + [(d, 0) for d, *_ in bad[:40]] + [(0, None), (None, 1)], "doc_id long, quality int")
    trees = Q.train(docs, labels)
    out = {r.text: r for r in Q.judge(docs, trees).collect()}
    assert all(out[t].kept for _, t, _ in good) and not any(out[t].kept for _, t, _ in bad)
    assert out[None].base_failed and not out[None].kept and out["a " * 30].base_failed
    assert Q.train(docs, labels.where("quality = 1")) is None
    assert Q.judge(docs, None).where("not base_failed and not kept").count() == 0
    assert Q.judge(docs.limit(0), trees).collect() == []


@pytest.mark.parametrize("n", [0, 5])
def test_sample_bound(spark, n):
    docs = spark.createDataFrame([(i, "x " * (i + 1)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert n or Q.train(docs, labels, sample=n) is None
