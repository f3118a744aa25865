"""The Jaccard join against all pairs."""

import random

import brute
import pytest
from seismark.llm import jaccard_join as J


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.groups(df).collect()}


def corpus(seed, groups=6, copies=25):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = rnd.choices(vocabulary, k=40)
    rows = []
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.choice([8, 30, 120, 200]))
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randrange(9)):
                at = rnd.randrange(len(w))
                w[at: at + rnd.randrange(3)] = rnd.choices(vocabulary, k=rnd.randrange(3))
            if rnd.random() < 0.3:
                w += common
            rows.append(" ".join(w).upper() if rnd.random() < 0.2 else "\n".join(w))
    rows += [" ".join(common + rnd.choices(vocabulary, k=rnd.randrange(60))) for _ in range(30)]
    rows += [None, "", " ", "One", "one", "one two three four", "a b c d e", "a b c d e", "One Two Three Four"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute.jaccard(rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS", 8)
    monkeypatch.setattr(J, "COLUMNS", 16)
    rows = corpus(4, groups=3, copies=80)
    assert run(spark, rows) == brute.jaccard(rows)


def test_repeated_rows_null_ids_clashing_columns(spark):
    a, b = " ".join(f"x{i}" for i in range(40)), "y z"
    df = spark.createDataFrame([(2, a, 1), (2, a, 1), (None, b, 3), (7, b, 4), (9, a + " q", 5)], "doc_id long, text string, sid long")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.groups(df).collect()), key=str)
    assert got == sorted([(-1, 1, None), (2, 36, 2), (2, 36, 2), (7, 1, None), (9, 37, 2)], key=str)
    kept = sorted(((r.doc_id or -1, r.sid) for r in J.keep_one(df).collect()))
    assert kept == [(-1, 3), (2, 1)]


def test_one_document_of_each_group_not_of_each_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, 1), (None, b, 2), (7, a + " q", 3), (7, c, 4), (7, d, 5), (8, d + " q", 6), (9, b, 7), (None, "", 8), (None, None, 9), (None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    assert sorted(r.n for r in J.keep_one(df).collect()) == [1, 2, 4, 5, 8, 9]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.groups(df).collect() == []
    assert J.keep_one(df).collect() == []


def test_common_counts_like_sets():
    import numpy as np

    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(0, 40))).astype(np.uint64) for _ in range(50)]
    got = J.common_counts(sets[:20], sets[20:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]]


def test_stars_of_unlike_sets_are_not_written_whole(spark, monkeypatch):
    """Documents that share a passage with a leader and link with nothing leave no differences behind; those that do link are found."""
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = [passage + [f"v{rnd.randrange(9000)}" for _ in range(110)] for _ in range(60)]
    texts += [t + ["more"] for t in texts[:3]]
    rows = list(enumerate(" ".join(t) for t in texts))
    tables = {}

    def kept(df, name, write=J.written):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(J, "written", kept)
    got = run(spark, rows)
    assert got == brute.jaccard(rows)
    assert sum(got[i][1] != i for i in got) == 3
    whole = sum(8 * size for size, _ in got.values())
    assert tables["pairs"].count() >= 60
    assert sum(len(r.diff) for r in tables["diffs"].select("diff").collect()) < whole / 4


def test_all_documents_pass_a_full_bitmap(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(J, "wanted", lambda keys: np.full(J.SLOTS // 8, 255, np.uint8))
    rows = corpus(6, groups=3)
    assert run(spark, rows) == brute.jaccard(rows)


@pytest.mark.parametrize("size", [1, 7, 60, 900, 30000])
def test_sketches_never_lie_further_apart_than_the_sets(size):
    import numpy as np

    rnd = np.random.default_rng(size)
    x = np.unique(rnd.integers(0, 2**64, size, dtype=np.uint64))
    for keep in (0.0, 0.5, 0.9, 1.0):
        y = np.unique(np.concatenate((x[rnd.random(len(x)) < keep], rnd.integers(0, 2**64, max(1, size // 9), dtype=np.uint64))))
        a, b = (np.unpackbits(np.frombuffer(J.sketch(s, size), np.uint8)) for s in (x, y))
        assert len(a) == len(b) <= J.SKETCH
        apart = len(np.setxor1d(x, y))
        assert 0.6 * apart - 3 <= (a != b).sum() <= apart
