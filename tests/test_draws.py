"""The multinomial kernel against exact probabilities and the plain case bootstrap."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from seismark.operators import compare as C
from seismark.operators import draws as D
from seismark.operators import infer as I
from seismark.operators import resample as R


def test_binomial_table_is_the_distribution():
    for m, p in ((1, 0.3), (8, 0.5), (64, 0.02), (512, 0.71)):
        base, cut = D.binomial_table(m, p)
        pmf = [math.comb(m, x) * p**x * (1 - p) ** (m - x) for x in range(m + 1)]
        at = np.concatenate(([0], cut.astype(float), [2.0**32])) / 2**32
        assert np.allclose(np.diff(at), pmf[base: base + len(at) - 1], atol=1e-9) and sum(pmf[base: base + len(at) - 1]) > 1 - 1e-8
    base, cut = D.binomial_table(1 << 30, 0.37)
    mean = base + (1 - cut.astype(float) / 2**32).sum()
    assert abs(mean / (0.37 * 2**30) - 1) < 1e-5


@pytest.mark.parametrize("weights", [[1, 2], [2, 0, 1, 1], [1, 1, 1]])
def test_small_multinomials_have_exact_probabilities(weights):
    n, reps = sum(weights), 200_000
    got = D.draws(12345, np.array(weights), np.full(reps, n), np.arange(reps))
    assert (got.sum(axis=1) == n).all()
    for counts, times in Counter(map(tuple, got.tolist())).items():
        p = math.factorial(n) * math.prod((w / n) ** k / math.factorial(k) for w, k in zip(weights, counts))
        assert abs(times - reps * p) < 5 * math.sqrt(reps * p * (1 - p)) + 1


def test_moments_of_many_cells():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 400, 37)
    n, reps = int(w.sum()), 4000
    got = D.draws(99, w, np.full(reps, n), np.arange(reps)).astype(float)
    p = w / n
    assert np.abs((got.mean(axis=0) - w) / np.sqrt(np.maximum(w, 1) / reps)).max() < 4.5
    cov, want = np.cov(got.T), n * (np.diag(p) - np.outer(p, p))
    assert np.abs(cov - want).max() < 0.12 * want.max()


def test_buckets_are_parts_of_one_draw():
    w = np.random.default_rng(2).integers(0, 5, 70)
    rep = np.arange(50)
    n = np.full(50, int(w.sum()))
    whole = D.draws(5, w, n, rep)
    totals = np.array([w[i:i + 16].sum() for i in range(0, 70, 16)])
    for b in range(5):
        nb = D.draws(5, totals, n, rep, 4, 0, b)[:, 0]
        own = w[16 * b: 16 * b + 16]
        height = int(len(own) - 1).bit_length()
        assert (D.draws(5, own, nb, rep, 0, b << (4 - height)) == whole[:, 16 * b: 16 * b + 16]).all()


def table(spark, seed=5, n=30, parts=3):
    r = random.Random(seed)
    rows = [Row(family="f", subsystem_id=f"s{s}", case_id=f"s{s}c{i}", method=m, score=r.choice([0.0, 0.5, 1.0]))
            for s in range(3) for i in range(n) for m in ("x|y", "y", "z") if r.random() < 0.9]
    return rows, spark.createDataFrame(rows).repartition(parts)


def test_replicates_follow_the_cell_draws(spark, monkeypatch):
    """Every mean must be the mean over the drawn cases; block size and buckets change nothing."""
    rows, df = table(spark)
    got = {(r.subsystem_id, r.a, r.b, r.rep): r.d for r in R.pair_replicates(df, 40).collect()}
    want = {}
    for s in ("s0", "s1", "s2"):
        cases = {}
        for r in rows:
            if r.subsystem_id == s:
                cases.setdefault(r.case_id, {})[r.method] = r.score
        vectors = sorted(Counter(tuple(sorted(v.items())) for v in cases.values()).items())
        stream = spark.range(1).select(D.hash32(F.lit(7), F.lit(s)).alias("h")).first().h
        drawn = D.draws(stream, np.array([c for _, c in vectors]), np.full(40, len(cases)), np.arange(40))
        for rep in range(40):
            for a, b in (("x|y", "y"), ("x|y", "z"), ("y", "z")):
                d = [(k, dict(v)[a] - dict(v)[b]) for (v, _), k in zip(vectors, drawn[rep]) if a in dict(v) and b in dict(v)]
                want[s, a, b, rep] = sum(k * x for k, x in d) / sum(k for k, _ in d)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(D, "BLOCK", 7)
    monkeypatch.setattr(D, "CELL_BITS", 2)
    again = {(r.subsystem_id, r.a, r.b, r.rep): r.d for r in R.pair_replicates(df.repartition(7), 40).collect()}
    assert again.keys() == want.keys() and all(abs(again[k] - want[k]) < 1e-9 for k in want)


def test_spread_is_that_of_the_case_bootstrap(spark):
    rows, df = table(spark, n=60)
    sd = {(r.subsystem_id, r.a, r.b): (r.sd, r.m) for r in R.pair_replicates(df, 3000).groupBy("subsystem_id", "a", "b").agg(F.stddev_samp("d").alias("sd"), F.avg("d").alias("m")).collect()}
    for r in C.pair_deltas(C.pair_diffs(df)).collect():
        s, m = sd[r.subsystem_id, r.a, r.b]
        # without missing scores the variance of a replicate mean is (n - 1) / n of var
        assert abs(s / math.sqrt(r["var"]) - 1) < 0.08 and abs(m - r.delta) < 5 * s / math.sqrt(3000)


@pytest.mark.parametrize("bits", [10, 1])
def test_bonferroni_like_numpy(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "CELL_BITS", bits)
    _, df = table(spark)
    deltas = C.pair_deltas(C.pair_diffs(df))
    got = R.bonferroni(df, deltas, C.pool(deltas), reps=6000).collect()
    d = {}
    for r in R.pair_replicates(df, 6000).collect():
        d.setdefault((r.a, r.b, r.subsystem_id), []).append(r.d)
    assert len(got) == 9
    for r in got:
        v = np.array(d[r.a, r.b, r.subsystem_id])
        q = 0.05 / 18
        assert np.allclose([r.lo95, r.hi95, r.lo, r.hi], np.quantile(v, [0.025, 0.975, q, 1 - q]), atol=1e-9)
        assert abs(r.p_zero - (np.abs(v) < 1e-12).mean()) < 1e-9
        opposite = abs(r.pooled_se) > 1e-9 and r.delta != 0 and np.sign(r.delta) != np.sign(r.pooled_se)
        assert (r.point_reversal, r.rev_ci95, r.rev_ci_adj) == (opposite, opposite and (r.lo95 > 0 or r.hi95 < 0), opposite and (r.lo > 0 or r.hi < 0))


def test_draws_without_replacement_have_exact_probabilities():
    got = D.without_replacement(D.stream_of(3, 1), np.array([2, 3, 1]), np.full(100_000, 3))
    assert (got.sum(axis=1) == 3).all() and (got <= [2, 3, 1]).all()
    for counts, times in Counter(map(tuple, got.tolist())).items():
        p = math.prod(math.comb(w, k) for w, k in zip([2, 3, 1], counts)) / math.comb(6, 3)
        assert abs(times - 100_000 * p) < 5 * math.sqrt(100_000 * p)


@pytest.mark.parametrize("bits", [10, 2])
def test_subsamples(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "CELL_BITS", bits)
    r = random.Random(6)
    rows = [Row(system=f"s{s}", case_id=f"s{s}c{i}", a="x", b="y", tol=t, d=r.choice([-1.0, 0.0, 0.5, 1.0])) for s in range(2) for i in range(40) for t in (0, 60)]
    df = spark.createDataFrame(rows)
    got = I.influence_subsample(df, 400).first()
    plain = Counter()
    for _ in range(4000):
        kept = {c for s in range(2) for c in r.sample([f"s{s}c{i}" for i in range(40)], 32)}
        c = [np.mean([x.d for x in rows if x.case_id in kept and x.tol == t]) for t in (0, 60)] if _ < 400 else None
        if c:
            plain["pos" if min(c) > 1e-9 else "neg" if max(c) < -1e-9 else "mixed"] += 1
    assert got.reps == 400 and got.pos + got.neg + got.mixed == 400
    for k in ("pos", "neg", "mixed"):
        p = (plain[k] + 1) / 402
        assert abs(got[k] - plain[k]) <= 6 * math.sqrt(2 * 400 * p * (1 - p)) + 2


def test_joint_lrt_like_the_pairwise_one_and_a_plain_fit(spark):
    _, df = table(spark, n=60)
    two = df.filter("method <> 'z'")
    both = two.groupBy("case_id").count().filter("count = 2").select("case_id")
    two = two.join(both, "case_id")
    want = I.interaction_lrt(C.pair_deltas(C.pair_diffs(two))).first()
    got = I.permutation_lrt(two, ["x|y", "y"], 5).filter("rep = -1").first()
    assert abs(got.lrt - want.lrt) < 1e-6 and got.lrt_df == want.lrt_df
    rng = np.random.default_rng(1)
    n = rng.integers(1, 40, (3, 5, 4)).astype(float)
    y = np.floor(rng.random((3, 5, 4)) * (n + 1))
    y[0, 1] = 0  # a system without hits
    for k in range(3):
        design = np.array([[float(i == s) for s in range(5)] + [float(j == m) for m in range(1, 4)] for i in range(5) for j in range(4)])
        b, yy, nn = np.zeros(8), y[k].ravel(), n[k].ravel()
        for _ in range(200):
            p = 1 / (1 + np.exp(-design @ b))
            b = b + np.linalg.solve(design.T @ (design * (nn * p * (1 - p))[:, None]) + 1e-9 * np.eye(8), design.T @ (yy - nn * p))
            b = np.clip(b, -30, 30)
        eta = design @ b
        assert abs(I.additive_llf(y, n)[k] - (yy * eta - nn * np.logaddexp(0, eta)).sum()) < 1e-5


def test_permutation_p_like_shuffled_cases(spark):
    rows, df = table(spark, seed=9, n=25)
    got = I.permutation_test(I.permutation_lrt(df, ["x|y", "y", "z"], 600)).first()
    cases = {}
    for r in rows:
        cases.setdefault((r.subsystem_id, r.case_id), {})[r.method] = r.score
    labels, values = [s for s, _ in cases], list(cases.values())
    rng, stats = random.Random(2), []
    for k in range(601):
        own = list(labels)
        if k:
            rng.shuffle(own)
        y, n = np.zeros((1, 3, 3)), np.zeros((1, 3, 3))
        for s, v in zip(own, values):
            for j, m in enumerate(("x|y", "y", "z")):
                if m in v:
                    y[0, int(s[1]), j] += v[m]
                    n[0, int(s[1]), j] += 1
        stats.append(2 * float((I.saturated_llf(y, n) - I.additive_llf(y, n))[0]))
    assert abs(got.lrt_observed - stats[0]) < 1e-6 and got.perms == 600
    p = sum(x >= stats[0] - 1e-9 for x in stats[1:]) / 600
    assert abs(got.p_perm - p) < 5 * math.sqrt(2 * max(p * (1 - p), 0.01) / 600) and abs(got.lrt_mean / np.mean(stats[1:]) - 1) < 0.15


def test_twin_draws_all_cases_of_large_groups():
    """Over 2 ** 14 cases a group: the SQL draws as many as the kernel, from the same thresholds."""
    import duckdb
    from seismark.plans import registry, sqltext

    weights, reps = [100_000, 7, 200_001, 69_992], 40
    con = duckdb.connect()
    con.execute("create table large_vectors as select 'g' as grp, unnest(range(4)) as v, unnest(?) as c", [weights])
    before = dict(registry.CTES)
    try:
        sqltext.draw_ctes("large_draws", "select grp, v, c from large_vectors", "grp", reps)
        got = con.execute(registry.with_ctes("select rep, cell, n from large_draws")).fetchall()
    finally:
        registry.CTES.clear()
        registry.CTES.update(before)
    stream = con.execute(f"select {sqltext.h32(chr(39) + '7' + chr(39), chr(39) + 'g' + chr(39))}").fetchone()[0]
    # the twin walks from height 6; the kernel's tree is as high as it needs, with the same numbers of a node
    want = D.draws(stream, np.array(weights), np.full(reps, sum(weights)), np.arange(reps))
    have = np.zeros((reps, 4), np.int64)
    for rep, cell, n in got:
        have[rep, cell] = n
    assert (have.sum(axis=1) == sum(weights)).all() and np.abs(have - want).max() <= 2


def test_reweighted_twin_has_the_thresholds_of_the_kernel():
    """Strata of a million cases: the draws of c21's SQL follow the kernel's thresholds, where log factorials moved thousands of them."""
    import duckdb
    from seismark.plans import q_compare, registry  # noqa: F401

    con = duckdb.connect()
    con.execute("create table large_cells as select 's' as stratum, unnest(range(3)) as v, unnest(?) as c, unnest(range(3)) as cell", [[300_001, 611_953, 88_046]])
    before = dict(registry.CTES)
    try:
        registry.CTES["drawsf_c"] = "select * from large_cells"
        tables = con.execute(registry.with_ctes("select j, wl / w as p, base, cuts from drawsf_t join drawsf_w using (stratum, h, i)")).fetchall()
    finally:
        registry.CTES.clear()
        registry.CTES.update(before)
    moved = 0
    for j, p, base, cuts in tables:
        first, own = D.binomial_table(1 << j, p)
        assert (base, len(cuts)) == (first, len(own))
        moved += int((np.array(cuts, np.int64) != own).sum())
    assert len(tables) >= 40 and moved <= 20
