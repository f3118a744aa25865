"""Edge rules and invariants on small hand-made tables."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seismark.functions import names as N
from seismark.functions import series as Z
from seismark.functions.stats import chi2_sf, t975
from seismark.operators import compare as C
from seismark.operators import holdout as H
from seismark.operators import detect as D
from seismark.operators import infer as I
from seismark.operators import ranking as K
from seismark.operators import resample as R
from seismark.operators import telemetry as T


def signal_frame(spark, metrics, event=50, n=100):
    """Readings at seconds 0..n-1 of one case; ``metrics`` maps a name to a function of the time."""
    rows = [Row(case_id="c", component=m.split("_")[0], metric_id=m, sec=i, value=float(f(i))) for m, f in metrics.items() for i in range(n)]
    df = spark.createDataFrame(rows)
    return df.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).withColumn("t0", F.timestamp_seconds(F.lit(event)).cast("timestamp_ntz"))


def noise(seed):
    r = random.Random(seed)
    v = [r.gauss(0, 1) for _ in range(200)]
    return lambda i: v[i]


def test_shifted_metric_ranks_first(spark):
    a, b, c = noise(1), noise(2), noise(3)
    df = signal_frame(spark, {"metric_a": a, "metric_b": lambda i: b(i) + (10 if i >= 50 else 0), "metric_c": c})
    got = [r.metric_id for r in D.rank_metrics(D.max_abs_z(df)).orderBy("rank").collect()]
    assert got[0] == "metric_b"


def test_empty_event_side_ranks_by_name(spark):
    df = signal_frame(spark, {"z_m": noise(1), "a_m": noise(2)}, event=1000)
    got = [(r.metric_id, r.z) for r in D.rank_metrics(D.max_abs_z(df)).orderBy("rank").collect()]
    assert got == [("a_m", 0.0), ("z_m", 0.0)]


def test_constant_baseline_scores_zero(spark):
    df = signal_frame(spark, {"k_m": lambda i: 5 if i < 50 else 50})
    assert D.max_abs_z(df).first().z == 0.0


def test_alert_count_orders_services(spark):
    jump = lambda s, h: (lambda i, f=noise(s): f(i) + (h if i >= 50 else 0))
    df = signal_frame(spark, {"serviceA_cpu": jump(1, 50), "serviceA_mem": jump(2, 50), "serviceA_disk": jump(3, 50), "serviceB_cpu": noise(4),
                              "serviceB_mem": noise(5), "serviceC_cpu": jump(6, 90), "serviceC_mem": lambda i: 1.0})
    x = D.alert_count(D.max_abs_z(df), 6.0).orderBy("rank").collect()
    assert list(dict.fromkeys(r.component for r in x)) == ["serviceA", "serviceC", "serviceB"]


@pytest.mark.parametrize("name,want", [("cart_cpu", "cart"), ("carts-db_container-mem", "carts"), ("10.1.2.3_node-load", "10.1.2.3"), ("web_latency-90", "web"), ("web", "web")])
def test_extract_service(spark, name, want):
    assert spark.range(1).select(N.extract_service(F.lit(name)).alias("s")).first().s == want


def score_rows(spark, n=40, parts=3):
    r = random.Random(5)
    rows = [Row(family="f", subsystem_id=f"f::s{s}", case_id=f"s{s}c{i}", method=m, score=r.choice([0.0, 0.5, 1.0]))
            for s in range(5) for i in range(n) for m in ("x", "y", "z")]
    return spark.createDataFrame(rows).repartition(parts)


def test_layout_does_not_change_replicates(spark):
    a = R.method_replicates(score_rows(spark, parts=1), 20).orderBy("subsystem_id", "rep", "method").collect()
    b = R.method_replicates(score_rows(spark, parts=7), 20).orderBy("subsystem_id", "rep", "method").collect()
    assert [(r.subsystem_id, r.rep, r.method, round(r.score, 9)) for r in a] == [(r.subsystem_id, r.rep, r.method, round(r.score, 9)) for r in b]


def test_swapping_methods_negates_deltas(spark):
    x = score_rows(spark)
    y = x.withColumn("method", F.when(F.col("method") == "x", "y").when(F.col("method") == "y", "x").otherwise("z"))
    d = lambda df: {r.subsystem_id: r.delta for r in C.pair_deltas(C.pair_diffs(df)).filter("a = 'x' and b = 'y'").collect()}
    p, q = d(x), d(y)
    assert all(math.isclose(p[s], -q[s], abs_tol=1e-12) for s in p)


def test_three_kernels_agree_on_the_spread(spark):
    x = score_rows(spark, n=200)
    d = C.pair_diffs(x).filter("a = 'x' and b = 'y'")
    want = {r.subsystem_id: math.sqrt(r.var) for r in C.pair_deltas(d).collect()}
    sd = lambda df: {r.subsystem_id: r.sd for r in df.groupBy("subsystem_id").agg(F.stddev_samp("d").alias("sd")).collect()}
    of = "a = 'x' and b = 'y'"
    keys = [*C.PAIR, "subsystem_id"]
    kernels = [R.pair_replicates(x, 300).filter(of), R.replicate_differences(R.poisson_replicates(x, 300)).filter(of), R.histogram_replicates(R.value_histogram(d, keys), keys, 2000)]
    for k in kernels:
        got = sd(k)
        assert all(abs(got[s] / want[s] - 1) < 0.2 for s in want)


def test_deltas_of_histogram_match(spark):
    d = C.pair_diffs(score_rows(spark))
    keys = [*C.PAIR, "subsystem_id"]
    a = {(r.a, r.b, r.subsystem_id): r for r in C.pair_deltas(d).collect()}
    for r in R.deltas_of_histogram(R.value_histogram(d, keys), keys).collect():
        w = a[r.a, r.b, r.subsystem_id]
        assert r.n == w.n and math.isclose(r.delta, w.delta, abs_tol=1e-9) and math.isclose(r["var"], w["var"], abs_tol=1e-9)


def test_assignment_is_exact_for_any_length(spark):
    import itertools
    r = random.Random(3)
    for n in (1, 2, 3, 4, 5):
        g = [[r.random() for _ in range(n)] for _ in range(n)]
        df = spark.createDataFrame([Row(g=g, n=n)])
        got = df.select(K.best_assignment(F.col("n"), lambda i, j: F.get(F.get("g", i), j)).alias("b")).first().b
        assert math.isclose(got, max(sum(g[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n))), abs_tol=1e-9)


def test_augmenting_paths_equal_brute_force(spark):
    import itertools
    r = random.Random(4)
    rows = []
    for n in (1, 2, 3, 5, 7, 8):
        for values in ([0.0, 1.0, 2.0, 3.0], [r.random() for _ in range(50)]):
            g = [[r.choice(values) for _ in range(n)] for _ in range(n)]
            rows.append(Row(g=g, want=max(sum(g[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))))
    order = list(range(30))
    r.shuffle(order)
    rows.append(Row(g=[[3.0 if order[i] == j else r.choice([0.0, 1.0, 2.0]) for j in range(30)] for i in range(30)], want=90.0))
    rows.append(Row(g=None, want=None))
    df = spark.createDataFrame(rows, "g array<array<double>>, want double").withColumn("got", K.large_assignment()("g"))
    for x in df.collect():
        assert x.got == (None if x.want is None else pytest.approx(x.want, abs=1e-9))


def test_thirty_slots_are_scored_exactly(spark):
    """Slots in reverse order, half of the components named wrongly; slots of equal truths compete for one answer each."""
    ans = lambda c, r, t: f'{{"root cause occurrence datetime": "2021-03-04 00:{t:02d}:00", "root cause component": "{c}", "root cause reason": "{r}"}}'
    pts = "".join(f"The {i}-th predicted root cause component is c{i % 15}\nThe {i}-th predicted root cause reason is r{i}\n"
                  f"The {i}-th root cause occurrence time is within 1 minutes (i.e., <=1min) of 2021-03-04 00:{i:02d}:00\n" for i in range(30))
    full = "".join(ans(f"c{i % 15}", f"r{i}", i) for i in reversed(range(30)))
    half = "".join(ans(f"c{i % 15}" if i % 2 else "no", f"r{i}", i) for i in reversed(range(30)))
    df = spark.createDataFrame([Row(k=1, prediction=full, scoring_points=pts), Row(k=2, prediction=half, scoring_points=pts), Row(k=3, prediction=full + ans("x", "y", 1), scoring_points=pts)])
    assert {x.k: x.score for x in K.score_answer(df).collect()} == {1: 1.0, 2: 0.83, 3: 0.0}


def test_score_rules(spark):
    ans = lambda c, t: f'{{"root cause occurrence datetime": "2021-03-04 00:0{t}:00", "root cause component": "{c}", "root cause reason": "r"}}'
    pts = ("The only predicted root cause component is a\nThe only predicted root cause reason is q\n"
           "The only root cause occurrence time is within 1 minutes (i.e., <=1min) of 2021-03-04 00:01:00\n")
    rows = [Row(k=1, prediction=ans("a", 2), scoring_points=pts), Row(k=2, prediction=ans("a", 2) + ans("b", 2), scoring_points=pts),
            Row(k=3, prediction="no answer", scoring_points=pts), Row(k=4, prediction=ans("a", 9), scoring_points="")]
    got = {r.k: r.score for r in K.score_answer(spark.createDataFrame(rows)).collect()}
    assert got == {1: 0.67, 2: 0.0, 3: 0.0, 4: 0.0}


def test_hot_key_helpers_match_plain_windows(spark):
    """One key holds most rows; the chunked helpers must give what one big window gives."""
    from pyspark.sql import Window as W
    r = random.Random(11)
    rows = [Row(k="hot" if i % 10 else "cold", step=i, value=None if r.random() < 0.4 else r.random()) for i in range(2000)]
    df = spark.createDataFrame(rows)
    w = W.partitionBy("k").orderBy("step")
    x = df.withColumn("f", F.last("value", True).over(w)).withColumn("n", F.row_number().over(w) - 1).withColumn("p", F.lag("value").over(w))
    want = {q.step: (q.f, q.n, q.p) for q in x.collect()}
    ch = F.floor(F.col("step") / 16)
    y = Z.fill_forward(df, ["k"], ch, "step", "value", "f")
    y = Z.row_index(y, ["k"], ch, [F.col("step")], "n")
    y = Z.previous(y, ["k"], ch, ["step"], "value", "p", 1)
    got = {q.step: (q.f, q.n, q.p[0] if q.p else None) for q in y.collect()}
    assert got == want


def test_exact_percentiles_with_ties_and_signs(spark):
    r = random.Random(2)
    df = spark.createDataFrame([Row(k=str(i % 3), v=float(r.choice([-1e6, -2.5, 0.0, 0.0, 1e-3, 7.0, 1e9]) + r.choice([0, 1]))) for i in range(500)])
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = {x.k: x.p for x in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("p")).collect()}
    for x in Z.exact_percentiles(df, ["k"], "v", qs, [f"q{i}" for i in range(len(qs))]).collect():
        assert all(math.isclose(x[f"q{i}"], want[x.k][i], rel_tol=1e-9, abs_tol=1e-9) for i in range(len(qs)))


def test_chi_square_tail(spark):
    rows = [(3.841458820694124, 1, 0.05), (9.487729036781154, 4, 0.05), (11.070497693516351, 5, 0.05), (-1e-9, 4, 1.0), (4e-9, 2, 1.0), (1e6, 3, 0.0), (6.0, 0, None), (None, 3, None)]
    # Wilson-Hilferty is good to three digits for many degrees of freedom
    far = [(1500.0, 1500), (2000.0, 2001), (1700.0, 1500), (400.0, 501), (90.0, 101)]
    rows += [(x, k, 0.5 * math.erfc(((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(4 / (9 * k)))) for x, k in far]
    got = spark.createDataFrame(rows, "x double, k int, p double").select(chi2_sf("x", "k").alias("got"), "p").collect()
    assert all((r.got is None) == (r.p is None) and (r.p is None or math.isclose(r.got, r.p, abs_tol=1e-3)) for r in got)
    assert all(math.isclose(r.got, 0.05, rel_tol=1e-9) for r in got[:3])


def test_percentiles_of_finite_values_and_narrow_metrics(spark):
    inf = float("inf")
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0, float("nan"), inf, -inf, None)] + [("b", 100 + i * 3 / 999) for i in range(1000)]
    got = {r.k: (r.q1, r.q2, r.q3) for r in Z.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.25, 0.5, 0.75], ["q1", "q2", "q3"]).collect()}
    assert got["a"] == (2.0, 3.0, 4.0)
    assert all(math.isclose(x, y) for x, y in zip(got["b"], (100.75, 101.5, 102.25)))


def test_intervals_belong_to_matched_cases(spark):
    """B covers only the easy half of A's cases and equals A there: no difference, and no interval away from zero."""
    rows = [Row(family="f", subsystem_id="s", case_id=f"c{i}", method="A", score=float(i % 2)) for i in range(200)]
    rows += [Row(family="f", subsystem_id="s", case_id=f"c{i}", method="B", score=1.0) for i in range(1, 200, 2)]
    x = spark.createDataFrame(rows)
    r = R.attach_ci(C.pair_deltas(C.pair_diffs(x)), R.pair_replicates(x, 100)).first()
    assert (r.n, r.delta, r.lo, r.hi) == (100, 0.0, 0.0, 0.0)


def test_a_tie_against_a_side_is_a_sign_change(spark):
    row = lambda s, d: Row(family="f", a="x", b="y", subsystem_id=s, n=10, delta=d, acc_a=0.5, acc_b=0.5 - d)
    ref, alt = spark.createDataFrame([row("p", 0.0), row("q", 0.2)]), spark.createDataFrame([row("p", 0.3), row("q", 0.1)])
    assert {r.subsystem_id: r.sign_change for r in C.compare_conditions(ref, alt).collect()} == {"p": True, "q": False}


def test_valid_only_accuracy_is_taken_per_seed(spark):
    rows = [("A", 1, 1.0, 1), ("A", 1, 1.0, 1), ("A", 2, 1.0, 1), ("A", 2, 0.0, 1), ("B", 1, 1.0, 1), ("B", 1, 0.0, 0), ("B", 2, 1.0, 1), ("B", 2, 0.0, 1)]
    rows = [("f", s, f"c{i % 2}", m, seed, score, v) for s in ("p", "q") for i, (m, seed, score, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "family string, subsystem_id string, case_id string, method string, seed int, score double, valid_output int")
    r = C.denominator_effect(df).first()
    assert (r.delta_all, r.delta_valid) == (0.25, 0.0)  # B: all (0.5 + 0.5) / 2, valid (1.0 + 0.5) / 2; A: (1.0 + 0.5) / 2


def test_release_with_two_equal_methods_recommends_nothing(spark):
    acc = [(m, s, v) for m, v in (("A", 0.5), ("B", 0.5), ("C", 0.4)) for s in ("s1", "s2") if (m, s) != ("C", "s2")]
    df = spark.createDataFrame(acc, "method string, subsystem_id string, acc double")
    rows = H.cross_decisions(df, df).collect()
    assert rows and {(r.a, r.b, r.recommended) for r in rows} == {("A", "B", False)}


def test_one_separating_cell_is_dropped(spark):
    rows = [(m, s, 40.0, p) for m, ps in (("A", (0.5, 0.6, 1.0)), ("B", (0.4, 0.7, 0.3)), ("C", (0.2, 0.3, 0.8))) for s, p in zip("xyz", ps)]
    cells = spark.createDataFrame(rows, "method string, sys string, n double, p double")
    left = I.drop_separating(cells)
    assert left.count() == 8 and left.filter("method = 'A' and sys = 'z'").count() == 0
    r = I.joint_interaction(left).first()
    assert r.lrt_df == 3 and r.lrt > 0 and 0 <= r.p <= 1
    assert I.joint_interaction(cells.filter("p < 1 or method <> 'A'")).first().lrt_df == 3


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "src string, dst string")
    pairs = spark.createDataFrame([("n0", "n12"), ("n3", "zz")], "pred string, truth string")
    assert {(r.pred, r.dist) for r in D.graph_distance(pairs, edges).collect()} == {("n0", 12), ("n3", 13)}


def test_t_quantile_beyond_the_table(spark):
    got = [r.t for r in spark.createDataFrame([(10,), (40,), (120,)], "d int").select(t975("d").alias("t")).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-5) for a, b in zip(got, [2.228138852, 2.021075390, 1.979930405]))




def test_interaction_is_zero_without_interaction(spark):
    rows = [Row(family="f", a="x", b="y", subsystem_id=f"s{i}", n=100, acc_a=1 / (1 + math.exp(-(i - 2) - 0.7)), acc_b=1 / (1 + math.exp(-(i - 2)))) for i in range(5)]
    r = I.interaction_lrt(spark.createDataFrame(rows)).first()
    assert abs(r.lrt) < 1e-6 and math.isclose(r.beta, 0.7, abs_tol=1e-6)


def test_heterogeneity_of_equal_effects_is_zero(spark):
    rows = [Row(family="f", a="x", b="y", subsystem_id=f"s{i}", delta=0.1, var=0.01 * (i + 1)) for i in range(6)]
    r = I.meta(spark.createDataFrame(rows)).first()
    assert r.tau2 < 1e-12 and r.i2 == 0.0 and math.isclose(r.re_delta, 0.1)


# published values: case counts and accuracies of two methods on eleven subsystems, and what their comparison came to
GOLDEN_N = [125, 125, 125, 136, 70, 78, 51, 26, 26, 8, 8]
GOLDEN_A = [0.392, 0.376, 0.048, 0.17213235294117646, 0.144, 0.19653846153846155, 0.2415686274509804, 0.038461538461538464, 0.0, 0.0, 0.25]
GOLDEN_B = [0.736, 0.848, 0.56, 0.16044117647058823, 0.05714285714285714, 0.10576923076923077, 0.18274509803921568, 0.15384615384615385,
            0.15384615384615385, 0.25, 0.25]
GOLDEN = {"pooled_cw": -0.20212082262210795, "pooled_se": -0.14537178997473116, "sd_sub_delta": 0.22128348915704182, "lrt": 104.92165662686511}


def test_published_pair_is_reproduced(spark):
    rows = [Row(family="all", a="x", b="y", subsystem_id=f"s{i:02d}", n=n, acc_a=p, acc_b=q, delta=p - q)
            for i, (n, p, q) in enumerate(zip(GOLDEN_N, GOLDEN_A, GOLDEN_B))]
    d = spark.createDataFrame(rows)
    r, s, i = C.reversals(d).first(), C.spread(d).first(), I.interaction_lrt(d).first()
    got = {"pooled_cw": r.pooled_cw, "pooled_se": r.pooled_se, "sd_sub_delta": s.sd_sub_delta, "lrt": i.lrt}
    assert all(math.isclose(got[k], v, rel_tol=1e-7) for k, v in GOLDEN.items())
    assert (r.n_rev_cw, r.rev_cw, r.n_rev_se, s.n_pos, s.n_neg, i.lrt_df) == (4, "s03;s04;s05;s06", 4, 4, 6, 10)


def test_distances_and_diameter(spark):
    """A searched distance and the bounded diameter must be those of a plain breadth-first search."""
    r = random.Random(8)
    for n, m in ((24, 26), (12, 5)):
        edges = {(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)} | {(f"n{i}", f"n{i + 1}") for i in range(n // 2)}
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
        dist = {}
        for a in near:
            front, d = {a}, 0
            while front:
                dist.update({(a, b): d for b in front if (a, b) not in dist})
                front, d = {c for b in front for c in near[b] if (a, c) not in dist}, d + 1
        far = max(dist.values())
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        assert D.diameter(D.both_ways(df), at_once=2) == far
        pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(20)] + [("x", "n0"), ("n0", "x")]
        got = {(x.pred, x.truth): (x.dist, x.in_graph) for x in D.graph_distance(spark.createDataFrame(sorted(set(pairs)), "pred string, truth string"), df).collect()}
        assert got == {(a, b): (dist.get((a, b), far + 1), b in near) for a, b in pairs}


def test_budget_baseline_counts(spark):
    r = random.Random(4)
    o = [Row(family="f", held_out=f"h{i % 7}", a=f"a{i}", b="z", m_cw=round(r.uniform(-1.5, 1.5), 2), m_se=round(r.uniform(-1, 1), 2), dir_cw=r.choice([-1, 0, 1]), dir_rule=r.choice([-1, 1]),
             out_cw=r.choice(["error", "tie", "correct"]), out_rule=r.choice(["error", "tie", "correct"]), strict_cw=r.random() < 0.3, strict_rule=r.random() < 0.3) for i in range(200)]
    c = [Row(threshold=str(k), recommended=k) for k in (0, 1, 17, 120, 500)]
    got = {x.threshold: x for x in H.budget_baseline(spark.createDataFrame(o), spark.createDataFrame(c)).collect()}
    for k in (0, 1, 17, 120, 500):
        for name, tag, m in (("pooled_only", "cw", "m_cw"), ("system_equal", "rule", "m_se")):
            top = sorted((x for x in o if x[f"dir_{tag}"]), key=lambda x: (-abs(x[m]), x.family, x.held_out, x.a, x.b))[:k]
            want = (len(top), sum(x[f"out_{tag}"] == "error" for x in top), sum(x[f"out_{tag}"] == "tie" for x in top), sum(x[f"strict_{tag}"] for x in top))
            assert tuple(got[str(k)][f"{name}_{s}"] for s in ("n", "errors", "ties", "strict_errors")) == want


def test_short_series_have_no_graph(spark):
    rows = [("long", c, t, float((t * 7 + k * (t % 3)) % 5)) for k, c in enumerate("uv") for t in range(30)]
    rows += [("short", c, t, float(t % 2)) for c in "uv" for t in range(4)] + [("one", "u", t, float(t % 3)) for t in range(30)]
    df = spark.createDataFrame(rows, "case_id string, component string, step long, z double")
    assert {r.case_id for r in D.lagcorr_graph(df, threshold=-1.0, margin=-2.0).collect()} == {"long"}


def test_block_correlations_equal_numpy(spark, monkeypatch):
    """Many blocks and chunks, missing steps, a constant series, one that is constant on the common steps, ties."""
    import numpy as np

    from seismark.functions import moments as M

    monkeypatch.setattr(M, "BLOCK", 3)
    monkeypatch.setattr(M, "STEPS", 16)
    g = np.random.default_rng(5)
    x, y, has = g.normal(100, 1, (8, 50)), g.normal(size=(8, 50)), g.random((8, 50)) < 0.8
    x[2], y[2] = 7.1, 7.1
    x[5], y[5] = x[4], y[4]
    rows = [("k", f"m{i}", t, float(x[i, t]), float(y[i, t])) for i in range(8) for t in range(50) if has[i, t]] + [("k", "m0", 99, None, 1.0), ("alone", "m0", 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "case_id string, name string, step long, x double, y double")
    got = {(r.u, r.v): (r.uv, r.vu) for r in M.pair_correlations(df, ["case_id"], "name", "step", "x", "y", 1e-8).collect()}
    assert len(got) == 28
    for (u, v), (uv, vu) in got.items():
        i, j = int(u[1:]), int(v[1:])
        both = has[i] & has[j]
        for a, b, c in ((x[i], y[j], uv), (x[j], y[i], vu)):
            if 2 in (i, j) and (a is x[2] or b is y[2] or np.ptp(a[both]) == 0 or np.ptp(b[both]) == 0):
                assert c is None
            else:
                assert c == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-9)


def test_prefilter_drops_near_copies_of_kept_metrics_only(spark):
    """A copy of a dropped metric stays; fewer than three survivors give none."""
    a, b, c, d = (noise(s) for s in (1, 2, 3, 4))
    series = {"m1": a, "m2": lambda i: a(i) + 0.001 * b(i), "m3": lambda i: -2 * a(i), "m4": b, "m5": c, "m6": d}
    rows = [(case, m, t, f(t)) for case, names in (("full", list(series)), ("few", ["m1", "m2", "m3", "m4"])) for m, f in series.items() if m in names for t in range(40)]
    grid = spark.createDataFrame(rows, "case_id string, metric_id string, step long, value double")
    scores = grid.select("case_id", "metric_id").distinct().withColumn("z", 10.0 - F.substring("metric_id", 2, 1).cast("double"))
    got = [(r.case_id, r["rank"], r.metric_id) for r in D.prefilter_topk(scores, grid, 3).orderBy("rank").collect()]
    assert got == [("full", 1, "m1"), ("full", 4, "m4"), ("full", 5, "m5")]


def test_clean_window_drops_metrics_and_fills_gaps(spark):
    """Constant, half-empty and infinite metrics go, exactly half is too empty; leading gaps are zero; small cases vanish."""
    nan, inf = float("nan"), float("inf")
    up = lambda t: float(t)
    series = {"a": up, "b": lambda t: None if t < 2 else up(t), "c": lambda t: nan if t == 5 else -up(t), "d": lambda t: 2 * up(t), "e": lambda t: up(t) ** 2,
              "const": lambda t: 3.0, "half": lambda t: up(t) if t % 2 else None, "inf": lambda t: inf if t == 4 else up(t), "empty": lambda t: None}
    rows = [("big", m, t, f(t)) for m, f in series.items() for t in range(10)] + [("small", m, t, series[m](t)) for m in "abcd" for t in range(10)]
    rows += [("big", "a", 3, 5.0)]  # a second reading at one time
    df = spark.createDataFrame(rows, "case_id string, metric_id string, rel int, value double").withColumn("ts", F.timestamp_seconds("rel").cast("timestamp_ntz"))
    got = {(r.metric_id, r.rel): r.value for r in T.clean_window(df, "case_id").collect() if r.case_id == "big"}
    assert {m for m, _ in got} == set("abcde") and len(got) == 50
    assert [got["b", t] for t in range(4)] == [0.0, 0.0, 2.0, 3.0] and got["c", 5] == -4.0 and got["a", 3] == 4.0
    assert T.clean_window(df.filter("case_id = 'small'"), "case_id").isEmpty()
    assert T.clean_window(df.limit(0), "case_id").isEmpty()


def test_slopes_do_not_depend_on_the_spread_of_the_covariate(spark):
    """Entropies of large tables differ in the sixth decimal only; the fit is the same as on the differences at full size."""
    import numpy as np

    rnd = np.random.default_rng(8)
    place = rnd.normal(size=12)
    rows, diff = [], {"near": [], "wide": []}
    for i, x in enumerate(place):
        diff["near"].append((f"s{i:02d}", 2.3219 + 5e-6 * float(x)))
        diff["wide"].append((f"s{i:02d}", float(x)))
        for j, slope in enumerate((0.0, 0.02, -0.03)):
            p = 1 / (1 + np.exp(-(0.1 * i - 0.5 + 0.2 * j + slope * x)))
            rows.append((f"m{j}", f"s{i:02d}", 360000.0, float(np.round(360000 * p) / 360000)))
    cells = spark.createDataFrame(rows, "method string, sys string, n double, p double")
    got = {k: I.difficulty_nested(cells, spark.createDataFrame(v, "sys string, x double"), "x").first() for k, v in diff.items()}
    assert got["near"].df_slopes == got["wide"].df_slopes == 2
    assert got["wide"].lrt_slopes > 100
    assert abs(got["near"].lrt_slopes - got["wide"].lrt_slopes) < 1e-4
    same = I.difficulty_nested(cells, spark.createDataFrame([(s, 0.1 + 0.2) for s, _ in diff["wide"]], "sys string, x double"), "x").first()
    assert (same.df_slopes, abs(same.lrt_slopes) < 1e-6) == (0, True)


def test_log_likelihoods_are_summed_in_the_order_of_the_cells():
    import numpy as np

    rnd = np.random.default_rng(3)
    n = rnd.integers(300000, 400000, 100).astype(float)
    y = np.floor(n * rnd.uniform(0.3, 0.6, 100))
    want = 0.0
    for v in I.saturated_terms(y, n).tolist():
        want += v
    assert I._cells_llf(y, n) == want


def test_cells_keep_their_hits(spark):
    cs = spark.createDataFrame([("m", "s", 1.0 if i == 0 else 0.0) for i in range(49)], "method string, subsystem_id string, score double")
    assert I._arrays(I.cells_of(cs).toArrow())[2].tolist() == [1.0]  # 49 * (1 / 49) is less
