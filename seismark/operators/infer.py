"""Heterogeneity, interaction tests, influence and sensitivity.

Everything here starts from cell tables (pair x subsystem) that one aggregation over the cases produces.
Root finding is a bisection expressed with ``aggregate`` over the short array of a pair's cells.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions.stats import chi2_sf, TIE_EPS, hash32, pctl, sgn, t975
from seismark.operators.compare import PAIR, pair_diffs
from seismark.operators.draws import replicate_sums, stream_of, without_replacement
from seismark.session import checkpoint

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

STEPS = 60  # bisection steps


def _sum(arr, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + f(e))


def _bisect(lo: Column, hi: Column, go_up) -> Column:
    """Midpoint after a fixed number of halvings; ``go_up(mid)`` says that the root is above mid."""
    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def step(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        up = go_up(mid)
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def _q(es, t) -> Column:
    """Cochran's Q around the weighted mean for weights 1 / (var + t)."""
    z = F.lit(0.0)
    s = F.aggregate(es, F.struct(z.alias("w"), z.alias("wd"), z.alias("wdd")), lambda acc, e: F.struct(
        (acc["w"] + 1 / (e["var"] + t)).alias("w"), (acc["wd"] + e["delta"] / (e["var"] + t)).alias("wd"),
        (acc["wdd"] + e["delta"] * e["delta"] / (e["var"] + t)).alias("wdd")),
        lambda acc: acc["wdd"] - acc["wd"] * acc["wd"] / acc["w"])
    return s


def meta_of(df: DataFrame, es: str = "es") -> DataFrame:
    """Random-effects summary of an array of (delta, var): needs four or more positive variances, else nulls."""
    k = F.size(es)
    ok = (k >= 4) & F.forall(es, lambda e: e["var"] > 0)
    x = df.withColumn("k", k).withColumn("_es", F.when(ok, F.col(es)))
    m = _sum("_es", lambda e: e["delta"]) / F.col("k")
    x = x.withColumn("_hi", _sum("_es", lambda e: F.pow(e["delta"] - m, 2)) / (F.col("k") - 1))
    x = x.withColumn("tau2", _bisect(F.lit(0.0), F.col("_hi"), lambda t: _q("_es", t) > F.col("k") - 1))
    x = x.withColumn("q", _q("_es", F.lit(0.0)))
    w = lambda e: 1 / (e["var"] + F.col("tau2"))
    x = x.withColumn("fe_delta", _sum("_es", lambda e: e["delta"] / e["var"]) / _sum("_es", lambda e: 1 / e["var"]))
    x = x.withColumn("re_delta", _sum("_es", lambda e: w(e) * e["delta"]) / _sum("_es", w))
    se = F.sqrt(_sum("_es", lambda e: w(e) * F.pow(e["delta"] - F.col("re_delta"), 2)) / _sum("_es", w) / (F.col("k") - 1))
    x = x.withColumn("re_se", se)
    x = x.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).when(F.col("q").isNotNull(), 0.0))
    ci = t975(F.col("k") - 1) * F.col("re_se")
    pi = t975(F.col("k") - 2) * F.sqrt(F.col("tau2") + F.pow(F.col("re_se"), 2))
    x = x.withColumn("re_lo", F.col("re_delta") - ci).withColumn("re_hi", F.col("re_delta") + ci)
    x = x.withColumn("pi_lo", F.col("re_delta") - pi).withColumn("pi_hi", F.col("re_delta") + pi)
    return x.withColumn("pi_crosses_0", (F.col("pi_lo") < 0) & (F.col("pi_hi") > 0)).drop("_es", "_hi")


META_COLS = ["k", "q", "i2", "tau2", "fe_delta", "re_delta", "re_se", "re_lo", "re_hi", "pi_lo", "pi_hi", "pi_crosses_0"]


def meta(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    g = d.groupBy(*keys).agg(F.collect_list(F.struct("delta", "var")).alias("es"))
    return meta_of(g).select(*keys, *META_COLS)


def tier(m: DataFrame) -> DataFrame:
    """Heterogeneity level from I2, one level lower when the prediction interval keeps one sign."""
    base = F.when(F.col("i2") > 0.5, 3).when(F.col("i2") >= 0.25, 2).when(F.col("i2").isNotNull(), 1)
    keeps = ~((F.col("pi_lo") <= 0) & (F.col("pi_hi") >= 0))
    level = F.when(keeps, F.greatest(F.lit(1), base - 1)).otherwise(base)
    names = F.array(F.lit("limited"), F.lit("moderate"), F.lit("substantial"))
    return m.select("*", base.alias("base_level"), keeps.alias("override"), level.alias("level"), F.get(names, level - 1).alias("tier"))


def leave_family_out(d: DataFrame) -> DataFrame:
    """Meta summary over all families together with one family left out at a time."""
    g = d.groupBy("a", "b").agg(F.collect_list(F.struct("family", "delta", "var")).alias("all"),
                                F.array_sort(F.collect_set("family")).alias("fams"))
    x = g.select("a", "b", "all", F.explode("fams").alias("dropped"))
    x = x.withColumn("es", F.filter("all", lambda e: e["family"] != F.col("dropped")))
    x = x.withColumn("pooled", _sum("es", lambda e: e["delta"]) / F.size("es"))
    p = sgn("pooled")
    x = x.withColumn("n_pos", F.size(F.filter("es", lambda e: sgn(e["delta"]) > 0))).withColumn("n_neg", F.size(F.filter("es", lambda e: sgn(e["delta"]) < 0)))
    x = x.withColumn("n_rev", F.when(p > 0, F.col("n_neg")).when(p < 0, F.col("n_pos")).otherwise(0))
    return meta_of(x).select("a", "b", "dropped", "pooled", "n_pos", "n_neg", "n_rev", *META_COLS)


def leave_two_out(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Drop every combination of two subsystems: do both signs remain, does the prediction interval cross zero,
    and how often does leave-one-out selection among the rest pick the loser."""
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("subsystem_id", "delta", "var"))).alias("all"))
    combos = F.flatten(F.transform("all", lambda x, i: F.transform(
        F.slice("all", i + 2, F.size("all")), lambda y: F.struct(x["subsystem_id"].alias("s1"), y["subsystem_id"].alias("s2")))))
    x = g.select(*keys, "all", F.explode(combos).alias("c"))
    x = x.withColumn("es", F.filter("all", lambda e: (e["subsystem_id"] != F.col("c.s1")) & (e["subsystem_id"] != F.col("c.s2"))))
    x = meta_of(x)
    total = _sum("es", lambda e: e["delta"])
    x = x.withColumn("_t", total)
    wrong = F.filter("es", lambda e: sgn((F.col("_t") - e["delta"]) / (F.col("k") - 1)) * sgn(e["delta"]) < 0)
    return x.filter("k >= 2").select(
        *keys, F.col("c.s1").alias("s1"), F.col("c.s2").alias("s2"),
        (F.exists("es", lambda e: sgn(e["delta"]) > 0) & F.exists("es", lambda e: sgn(e["delta"]) < 0)).alias("both_signs"),
        F.coalesce("pi_crosses_0", F.lit(False)).alias("pi_crosses_0"), (F.size(wrong) / F.col("k")).alias("mis_rate"),
        (_sum(wrong, lambda e: F.abs(e["delta"])) / F.col("k")).alias("mean_regret"))


def leave_two_summary(l: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return l.groupBy(*keys).agg(F.count("*").alias("n_drops"), F.count_if("both_signs").alias("both_signs"), F.count_if("pi_crosses_0").alias("pi_crosses_0"),
                                pctl("mis_rate", 0.5).alias("mis_median"), F.max("mis_rate").alias("mis_max"),
                                pctl("mean_regret", 0.5).alias("regret_median"), F.max("mean_regret").alias("regret_max"))


# ---- interaction of method and subsystem ---------------------------------------------------------------------

def _ylogp(y: Column, p: Column) -> Column:
    return F.when(y > 1e-12, y * F.ln(p)).otherwise(0.0)


def _binom(n: Column, y: Column, p: Column) -> Column:
    return _ylogp(y, p) + _ylogp(n - y, 1 - p)


def interaction_of(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Likelihood ratio of the saturated model against method + subsystem, from an array of (na, ya, nb, yb).

    The full model is the cell means. In the additive model the intercept of a cell solves a quadratic given the
    method effect, and the effect is the root of one monotone score; cells without any or with only hits drop out.
    """
    inside = F.filter(cells, lambda c: (c["ya"] + c["yb"] > 1e-9) & (c["ya"] + c["yb"] < c["na"] + c["nb"] - 1e-9))
    x = df.withColumn("_in", inside)

    def odds(c, b):
        t = c["ya"] + c["yb"]
        qa = b * (c["na"] + c["nb"] - t)
        qb = c["na"] * b + c["nb"] - t * (1 + b)
        return (-qb + F.sqrt(qb * qb + 4 * qa * t)) / (2 * qa)

    def expected(beta):
        b = F.exp(beta)
        return _sum("_in", lambda c: c["na"] * (b * odds(c, b)) / (1 + b * odds(c, b)))

    x = x.withColumn("_ya", _sum("_in", lambda c: c["ya"]))
    x = x.withColumn("beta", _bisect(F.lit(-20.0), F.lit(20.0), lambda m: expected(m) < F.col("_ya")))
    x = x.withColumn("_b", F.exp("beta"))
    red = _sum("_in", lambda c: _binom(c["na"], c["ya"], F.col("_b") * odds(c, F.col("_b")) / (1 + F.col("_b") * odds(c, F.col("_b"))))
               + _binom(c["nb"], c["yb"], odds(c, F.col("_b")) / (1 + odds(c, F.col("_b")))))
    full = _sum(cells, lambda c: _binom(c["na"], c["ya"], c["ya"] / c["na"]) + _binom(c["nb"], c["yb"], c["yb"] / c["nb"]))
    z = F.lit(0.0)
    tot = F.aggregate(cells, F.struct(z.alias("n"), z.alias("y")), lambda acc, c: F.struct(
        (acc["n"] + c["na"] + c["nb"]).alias("n"), (acc["y"] + c["ya"] + c["yb"]).alias("y")))
    x = x.withColumn("_t", tot).withColumn("llf_full", full).withColumn("llf_reduced", red)
    x = x.withColumn("llf_null", _binom(F.col("_t.n"), F.col("_t.y"), F.col("_t.y") / F.col("_t.n")))
    x = x.withColumn("lrt", 2 * (F.col("llf_full") - F.col("llf_reduced"))).withColumn("lrt_df", F.size(cells) - 1)
    return x.drop("_in", "_ya", "_b", "_t")


def cell_array() -> Column:
    n = F.col("n").cast("double")
    return F.collect_list(F.struct("subsystem_id", n.alias("na"), (n * F.col("acc_a")).alias("ya"), n.alias("nb"), (n * F.col("acc_b")).alias("yb")))


def interaction_lrt(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    g = d.groupBy(*keys).agg(cell_array().alias("cells"))
    return interaction_of(g.filter(F.size("cells") >= 2)).select(*keys, "lrt", "lrt_df", "beta", "llf_full", "llf_reduced", "llf_null")


def mcfadden(i: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return i.select(*keys, "llf_null", F.try_divide(F.col("llf_full") - F.col("llf_null"), -F.col("llf_null")).alias("r2_full"),
                    F.try_divide(F.col("llf_reduced") - F.col("llf_null"), -F.col("llf_null")).alias("r2_reduced"))


def interaction_wald(diffs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Cluster-robust Wald test that all subsystems share one log odds ratio; cases are the clusters.

    Cases belong to one subsystem, so the covariance is block diagonal and each block needs only second moments.
    No small-sample factor. Null under separation (a cell without or with only hits).
    """
    g = diffs.groupBy(*keys, "subsystem_id").agg(
        F.count("*").alias("n"), F.avg("ya").alias("pa"), F.avg("yb").alias("pb"), F.var_pop("ya").alias("saa"),
        F.var_pop("yb").alias("sbb"), F.covar_pop("ya", "yb").alias("sab"))
    va, vb = F.col("pa") * (1 - F.col("pa")), F.col("pb") * (1 - F.col("pb"))
    ok = (va > 1e-12) & (vb > 1e-12)
    theta = F.ln(F.col("pa") / (1 - F.col("pa"))) - F.ln(F.col("pb") / (1 - F.col("pb")))
    var = (F.col("saa") / va / va - 2 * F.col("sab") / va / vb + F.col("sbb") / vb / vb) / F.col("n")
    x = g.select(*keys, F.when(ok, theta).alias("theta"), F.when(ok, var).alias("v"), ok.alias("ok"))
    w = 1 / F.col("v")
    s = x.groupBy(*keys).agg(F.count("*").alias("k"), F.bool_and("ok").alias("ok"), F.sum(w).alias("w"), F.sum(w * F.col("theta")).alias("wt"),
                             F.sum(w * F.col("theta") * F.col("theta")).alias("wtt"))
    stat = F.col("wtt") - F.col("wt") * F.col("wt") / F.col("w")
    return s.select(*keys, F.when(F.col("ok"), stat).alias("wald"), (F.col("k") - 1).alias("wald_df"), (~F.col("ok")).alias("separation"))


def separation(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    bad = (F.least("acc_a", "acc_b") <= 1e-12) | (F.greatest("acc_a", "acc_b") >= 1 - 1e-12)
    return d.groupBy(*keys).agg(F.bool_or(bad).alias("separation"))


def cells_of(cs: DataFrame, system: str = "subsystem_id") -> DataFrame:
    """Hits and trials per (method, system), with the system's family if there is one: all a binomial model needs."""
    family = ["family"] if "family" in cs.columns else []
    return cs.groupBy(*family, "method", F.col(system).alias("sys")).agg(F.count("*").cast("double").alias("n"), F.avg("score").alias("p"), F.sum("score").alias("hits"))


def _design(cells: DataFrame, factors: Sequence[str], numeric: Sequence[str]):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    idx = [f"{f}_ix" for f in factors]
    hot = [f"{f}_oh" for f in factors]
    stages = [StringIndexer(inputCols=list(factors), outputCols=idx, stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=idx, outputCols=hot), VectorAssembler(inputCols=[*hot, *numeric], outputCol="features")]
    return Pipeline(stages=stages).fit(cells).transform(cells)


def in_order(v: np.ndarray) -> float:
    """The sum, term after term. Log-likelihoods of ten million cases have their sixth decimal among the last bits of a double, so
    the order of the sum is part of the result: by system, then by method."""
    return float(np.add.accumulate(v)[-1]) if len(v) else 0.0


def system_fit(system: np.ndarray, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(log-likelihood, rank) of logit(p) = effect of the system + z b on cells of y hits in n trials.

    The Hessian is diagonal in the systems, so a Newton step solves for b only, by least squares: columns of z that depend on each
    other or on the systems (nested or deficient designs) neither break the step nor count for the rank. Columns are brought to one
    scale first, else a covariate of small spread would pass for a dependent one beside the methods.
    """
    s = np.unique(system, return_inverse=True)[1]
    k = int(s.max(initial=-1)) + 1
    per = lambda v: np.stack([np.bincount(s, v[:, c], k) for c in range(v.shape[1])], axis=1)
    size = np.bincount(s, minlength=k)
    z = z[:, z.any(axis=0)]
    z = z / np.abs(z).max(axis=0, initial=0)
    within = z - (per(z) / size[:, None])[s]
    rank = k + (int(np.linalg.matrix_rank(within, tol=1e-9 * max(1.0, np.abs(z).max(initial=0)) * np.sqrt(z.size + 1))) if z.shape[1] else 0)
    alpha, b = np.zeros(k), np.zeros(z.shape[1])
    value = lambda al, be: in_order(y * (al[s] + z @ be) - n * np.logaddexp(0.0, al[s] + z @ be))
    now = value(alpha, b)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(alpha[s] + z @ b)))
        w, r = n * p * (1 - p), y - n * p
        d, ga = np.maximum(np.bincount(s, w, k), 1e-12), np.bincount(s, r, k)
        wz = per(w[:, None] * z) if z.shape[1] else np.zeros((k, 0))
        schur = z.T @ (w[:, None] * z) - wz.T @ (wz / d[:, None])
        db = np.linalg.lstsq(schur, z.T @ r - wz.T @ (ga / d), rcond=1e-10)[0]
        da = (ga - wz @ db) / d
        step, new = 1.0, value(alpha + da, b + db)
        while not new >= now - 1e-12 and step > 1e-9:
            step /= 2
            new = value(alpha + step * da, b + step * db)
        alpha, b = alpha + step * da, b + step * db
        if abs(new - now) < 1e-11 * (1 + abs(new)):
            now = new
            break
        now = new
    return now, rank


def one_hot(values) -> np.ndarray:
    code = np.unique(np.array(values, object).astype(str), return_inverse=True)[1]
    return np.eye(int(code.max(initial=-1)) + 1)[code]


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_by([("sys", "ascending"), ("method", "ascending")])
    n = t["n"].to_numpy().astype(float)
    hits = t["hits"].to_numpy() if "hits" in t.column_names else n * t["p"].to_numpy()  # n * p may be a last bit off
    return t, np.array(t["sys"].to_pylist(), object), np.clip(hits, 0, n), n


def _cells_llf(y: np.ndarray, n: np.ndarray) -> float:
    return in_order(saturated_terms(y, n))


def joint_interaction(cells: DataFrame) -> DataFrame:
    """All methods at once, on hits and trials per method and system: (test, llf_full, llf_reduced, lrt, lrt_df, p).

    ``method_x_subsystem``: saturated cells against method + system. ``method_x_family`` (if the cells have a family): own method
    effects in each family against common ones, both with the systems, which are nested in the families. Degrees of freedom
    are differences of ranks, over the cells that exist. The cells (methods x subsystems) are one small table by nature.
    """
    family = "family" in cells.columns

    def fit(t: pa.Table) -> pa.Table:
        t, system, y, n = _arrays(t)
        method = t["method"].to_pylist()
        reduced, rank = system_fit(system, one_hot(method), y, n)
        rows = [("method_x_subsystem", _cells_llf(y, n), reduced, len(y) - rank)]
        if family:
            full, more = system_fit(system, one_hot([f"{f}\x00{m}" for f, m in zip(t["family"].to_pylist(), method)]), y, n)
            rows.append(("method_x_family", full, reduced, more - rank))
        return pa.table({"test": [r[0] for r in rows], "llf_full": [r[1] for r in rows], "llf_reduced": [r[2] for r in rows], "lrt_df": pa.array([r[3] for r in rows], pa.int64())})

    x = cells.groupBy(F.lit(1).alias("all")).applyInArrow(fit, "test string, llf_full double, llf_reduced double, lrt_df long")
    x = x.select("test", "llf_full", "llf_reduced", (2 * (F.col("llf_full") - F.col("llf_reduced"))).alias("lrt"), "lrt_df")
    return x.withColumn("p", chi2_sf("lrt", "lrt_df"))


def difficulty_nested(cells: DataFrame, diff: DataFrame, covariate: str) -> DataFrame:
    """Do method x difficulty slopes absorb the interaction? Nested models on the same cells.

    ``diff``: (sys, covariate). Models: additive; additive + slope per method; saturated. A common slope is a system effect, so
    there is one slope less than methods.
    """
    x = cells.join(diff.select("sys", F.col(covariate).cast("double").alias("cov")), "sys")

    def fit(t: pa.Table) -> pa.Table:
        t, system, y, n = _arrays(t)
        hot, cov = one_hot(t["method"].to_pylist()), t["cov"].to_numpy()
        additive, rank = system_fit(system, hot, y, n)
        off = cov - cov.mean()
        off = np.where(np.abs(off).max(initial=0) > 1e-12 * np.abs(cov).max(initial=0), off, 0.0)  # a constant but for its last bits
        slopes, more = system_fit(system, np.hstack([hot, hot * off[:, None]]), y, n)
        full = _cells_llf(y, n)
        return pa.table({"llf_additive": [additive], "llf_slopes": [slopes], "llf_full": [full], "lrt_slopes": [2 * (slopes - additive)], "df_slopes": pa.array([more - rank], pa.int64()),
                         "lrt_left": [2 * (full - slopes)], "df_left": pa.array([len(y) - more], pa.int64())})

    g = x.groupBy(F.lit(1).alias("all")).applyInArrow(fit, "llf_additive double, llf_slopes double, llf_full double, lrt_slopes double, df_slopes long, lrt_left double, df_left long")
    return g.select("*", chi2_sf("lrt_slopes", "df_slopes").alias("p_slopes"), chi2_sf("lrt_left", "df_left").alias("p_left"))


def l2_interaction(cells: DataFrame, reg: float = 0.01) -> DataFrame:
    """Penalised logit with and without interaction columns; finite even under separation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    x = cells.withColumn("cell", F.concat_ws("@", "method", "sys")).select("*", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("w")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("w")))).alias("o")).select("*", "o.*").drop("o").filter("w > 0")
    for name, factors in (("reduced", ["method", "sys"]), ("full", ["method", "sys", "cell"])):
        d = _design(x, factors, [])
        lr = LogisticRegression(regParam=reg, elasticNetParam=0.0, weightCol="w", maxIter=200, tol=1e-10)
        x = lr.fit(d).transform(d).select(*x.columns, F.get(vector_to_array(F.col("probability")), 1).alias(name))
    ll = lambda c: F.sum(F.col("w") * F.when(F.col("label") == 1, F.ln(c)).otherwise(F.ln(1 - F.col(c))))
    g = x.agg(ll("reduced").alias("llf_reduced"), ll("full").alias("llf_full"))
    return g.withColumn("lrt", 2 * (F.col("llf_full") - F.col("llf_reduced")))


def drop_separating(cells: DataFrame) -> DataFrame:
    """Cells without the most separating one: the cell with no or only hits that has the most trials (then by name)."""
    bad = cells.filter((F.col("p") <= 1e-12) | (F.col("p") >= 1 - 1e-12)).orderBy(F.desc("n"), "method", "sys").limit(1).select("method", "sys")
    return cells.join(bad, ["method", "sys"], "left_anti")


def additive_llf(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-likelihood of logit(p) = system + method on (tables, systems, methods) hits and trials.

    Newton steps on both factors at once: the Hessian is diagonal in the systems, so a step solves for the methods only. Systems
    and methods with no hits, or with hits only, have fitted means of 0 or 1 and add nothing.
    """
    y, n = y.copy(), n.copy()
    for _ in range(sum(y.shape[1:])):  # leaving a row out may empty a column
        before = n.sum()
        for axis in (1, 2):
            hits, trials = y.sum(axis=axis, keepdims=True), n.sum(axis=axis, keepdims=True)
            flat = (hits <= 1e-12) | (hits >= trials - 1e-12)
            y, n = np.where(flat, 0.0, y), np.where(flat, 0.0, n)
        if n.sum() == before:
            break
    tables, systems, methods = y.shape
    alpha, beta = np.zeros((tables, systems)), np.zeros((tables, methods))

    def value(al, be):
        eta = al[:, :, None] + be[:, None, :]
        return (y * eta - n * np.logaddexp(0.0, eta)).sum(axis=(1, 2))

    now = value(alpha, beta)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(alpha[:, :, None] + beta[:, None, :])))
        w, r = n * p * (1 - p), y - n * p
        d, ga, gb = np.maximum(w.sum(axis=2), 1e-12), r.sum(axis=2), r.sum(axis=1)
        schur = np.einsum("tm,mk->tmk", w.sum(axis=1), np.eye(methods)) - np.einsum("tsm,tsk->tmk", w / d[:, :, None], w)
        schur += 1e-9 * np.eye(methods)  # the methods' common level is the systems'
        db = np.linalg.solve(schur, (gb - np.einsum("tsm,ts->tm", w, ga / d))[:, :, None])[:, :, 0]
        da = (ga - np.einsum("tsm,tm->ts", w, db)) / d
        step = np.ones(tables)
        for _ in range(30):
            new = value(alpha + step[:, None] * da, beta + step[:, None] * db)
            worse = ~(new >= now - 1e-12)
            if not worse.any():
                break
            step = np.where(worse, step / 2, step)
        alpha, beta = alpha + step[:, None] * da, beta + step[:, None] * db
        done = np.abs(new - now).max(initial=0) < 1e-10
        now = new
        if done:
            break
    return now


def saturated_terms(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = np.divide(y, n, out=np.zeros_like(y), where=n > 0)
    part = lambda k, q: np.where(k > 1e-12, k * np.log(np.where(q > 0, q, 1.0)), 0.0)
    return part(y, p) + part(n - y, 1 - p)


def saturated_llf(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    return saturated_terms(y, n).sum(axis=(1, 2))


PERM_BLOCK = 100


def permutation_lrt(cs: DataFrame, methods: Sequence[str], perms: int = 2000, seed: int = 11) -> DataFrame:
    """Shuffle the case -> subsystem labels of a family and recompute the joint LRT of method x subsystem.

    (family, rep, lrt, lrt_df); rep -1 is the observed labelling. Cases with equal score vectors are alike, so a shuffle is a
    table of vectors x subsystems with fixed margins, drawn subsystem by subsystem without replacement: no row per case and
    replicate. A task holds the counts of a family and a block of shuffles; a family has at most 10^9 cases.
    """
    item = F.array_sort(F.collect_list(F.struct(F.col("method").alias("name"), F.col("score").alias("v"))))
    cases = cs.filter(F.col("method").isin(*methods)).groupBy("family", "subsystem_id", "case_id").agg(item.alias("v"))
    cells = checkpoint(cases.groupBy("family", "v", "subsystem_id").agg(F.count("*").alias("c")))
    blocks = -(-perms // PERM_BLOCK)
    x = cells.withColumn("stream", hash32(F.lit(seed), "family")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def shuffle(t: pa.Table) -> pa.Table:
        names = sorted(methods)
        vectors = [tuple({e["name"]: e["v"] for e in v}.get(m) for m in names) for v in t["v"].to_pylist()]
        kinds, systems = sorted(set(vectors), key=str), sorted(set(t["subsystem_id"].to_pylist()))
        observed = np.zeros((1, len(systems), len(kinds)), np.int64)
        for v, s, c in zip(vectors, t["subsystem_id"].to_pylist(), t["c"].to_pylist()):
            observed[0, systems.index(s), kinds.index(v)] += c
        value = np.array([[np.nan if e is None else min(max(e, 0.0), 1.0) for e in v] for v in kinds]).reshape(len(kinds), len(names))
        has = ~np.isnan(value)

        def lrt(table: np.ndarray) -> tuple[np.ndarray, int]:
            y, n = table @ np.where(has, value, 0.0), (table @ has).astype(float)
            used = n[0] > 0
            return 2 * (saturated_llf(y, n) - additive_llf(y, n)), int(used.sum() - used.any(axis=0).sum() - used.any(axis=1).sum() + 1)

        block = int(t["block"][0].as_py())
        rep = np.arange(block * PERM_BLOCK, min((block + 1) * PERM_BLOCK, perms))
        rng = stream_of(int(t["stream"][0].as_py()), block)
        left, tables = np.repeat(observed.sum(axis=1), len(rep), axis=0), np.zeros((len(rep), len(systems), len(kinds)), np.int64)
        for s, size in enumerate(observed[0].sum(axis=1)):
            tables[:, s] = without_replacement(rng, left, np.full(len(rep), size))
            left = left - tables[:, s]
        stat, df = lrt(np.concatenate((observed, tables)) if block == 0 else tables)
        df = lrt(observed)[1]
        rep = np.concatenate(([-1], rep)) if block == 0 else rep
        return pa.table({"family": pa.array([t["family"][0].as_py()] * len(rep), pa.string()), "rep": pa.array(rep.astype(np.int32)), "lrt": stat, "lrt_df": np.full(len(rep), df, np.int64)})

    return x.groupBy("family", "block").applyInArrow(shuffle, "family string, rep int, lrt double, lrt_df long")


def permutation_test(lrts: DataFrame) -> DataFrame:
    """Observed LRT, its share among the shuffles, and the spread of the shuffled ones."""
    obs = F.max(F.when(F.col("rep") == -1, F.col("lrt"))).over(W.partitionBy("family"))
    x = lrts.withColumn("obs", obs).filter("rep >= 0")
    return x.groupBy("family", F.col("obs").alias("lrt_observed"), "lrt_df").agg(
        F.count("*").alias("perms"), F.avg(F.when(F.col("lrt") >= F.col("obs") - 1e-9, 1.0).otherwise(0.0)).alias("p_perm"), F.avg("lrt").alias("lrt_mean"),
        pctl("lrt", 0.5).alias("lrt_median"), pctl("lrt", 0.95).alias("lrt_p95"), pctl("lrt", 0.99).alias("lrt_p99"), F.max("lrt").alias("lrt_max"))


def influence_loso(d: DataFrame) -> DataFrame:
    """Case-weighted tolerance curve of a pair with one system left out: extremes and sign class.

    ``d``: (a, b, system, tol, n, delta).
    """
    w = W.partitionBy("a", "b", "tol")
    nd = F.col("n") * F.col("delta")
    x = d.select("a", "b", "system", "tol", ((F.sum(nd).over(w) - nd) / (F.sum("n").over(w) - F.col("n"))).alias("delta"))
    return _sign_class(x, ["a", "b", F.concat(F.lit("loso:"), "system").alias("check_name")])


def _sign_class(x: DataFrame, keys) -> DataFrame:
    lo, hi = F.min("delta"), F.max("delta")
    return x.groupBy(*keys).agg(
        lo.alias("min_delta"), hi.alias("max_delta"), ((hi > TIE_EPS) & (lo < -TIE_EPS)).alias("inverted"),
        F.when(lo > TIE_EPS, "pos").when(hi < -TIE_EPS, "neg").otherwise("mixed").alias("sign_class"))


def influence_top_k(diffs: DataFrame, ks: Sequence[int] = (1, 2, 5), weight: str | None = None, cases_of=None) -> DataFrame:
    """The curve without the k cases that move the two extreme tolerances most.

    ``diffs``: (a, b, system, case_id, tol, d). Only the largest k contributions per pair are ranked: each task
    keeps its own top k first, so no task sorts all cases. With ``weight``, a row stands for that many equal cases of a kind (case_id);
    ``cases_of`` then gives (system, kind, case_id) of the kinds (system, kind) that can be among the first k.
    """
    kmax = max(ks)
    one = F.col(weight) if weight else F.lit(1)
    ext = diffs.groupBy("a", "b").agg(F.min("tol").alias("t_lo"), F.max("tol").alias("t_hi"))
    x = diffs.join(ext, ["a", "b"])
    contrib = (x.filter("tol = t_lo or tol = t_hi").groupBy("a", "b", "system", "case_id").agg(F.sum(F.abs("d")).alias("c"), F.max(one).alias("_n"))
               .withColumn("c", F.round("c", 9)))
    if weight:
        before = W.partitionBy("a", "b").orderBy(F.desc("c"), F.desc("system")).rowsBetween(W.unboundedPreceding, -1)
        first = contrib.groupBy("a", "b", "system", "c").agg(F.sum("_n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        first = contrib.join(first.filter(F.col("_before") < kmax).select("a", "b", "system", "c"), ["a", "b", "system", "c"]).withColumnRenamed("case_id", "kind")
        contrib = first.join(cases_of(first.select("system", "kind").distinct()), ["system", "kind"])
    else:
        contrib = contrib.withColumn("kind", F.col("case_id"))
    contrib = contrib.withColumn("part", F.pmod(F.xxhash64("case_id"), F.lit(256)))
    order = [F.desc("c"), F.desc("system"), F.desc("case_id")]
    local = contrib.withColumn("r", F.row_number().over(W.partitionBy("a", "b", "part").orderBy(*order))).filter(F.col("r") <= kmax)
    top = local.withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy(*order))).filter(F.col("r") <= kmax)
    tot = diffs.groupBy("a", "b", "tol").agg(F.sum(one * F.col("d")).alias("s"), F.sum(one).alias("n"))
    sub = (top.select("a", "b", "system", F.col("kind").alias("case_id"), "r").join(diffs, ["a", "b", "system", "case_id"])
           .select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).filter("r <= k")
           .groupBy("a", "b", "tol", "k").agg(F.sum("d").alias("ds"), F.count("*").alias("dn")))
    left = tot.join(sub, ["a", "b", "tol"]).select("a", "b", "k", "tol", F.try_divide(F.col("s") - F.col("ds"), F.col("n") - F.col("dn")).alias("delta"))
    return _sign_class(left, ["a", "b", F.concat(F.lit("leave_top_"), F.col("k").cast("string")).alias("check_name")])


def influence_subsample(diffs: DataFrame, reps: int = 200, frac: float = 0.8, seed: int = 13, weight: str | None = None) -> DataFrame:
    """Exactly floor(frac * n) cases per system in each replicate, drawn from the counts of equal cases; sign classes counted.

    A case's vector holds its differences by pair and tolerance, so all pairs and tolerances share a subsample. With ``weight``, a row
    stands for that many equal cases.
    """
    part = F.to_json(F.struct("a", "b", "tol"))
    items = diffs.groupBy("system", "case_id", *([weight] if weight else [])).agg(F.collect_list(F.struct(part.alias("name"), F.col("d").alias("v"))).alias("items"))
    r = replicate_sums(items, "system", reps, seed, share=frac, weight=weight)
    kind = next(f.dataType.simpleString() for f in diffs.schema if f.name == "tol")
    x = r.withColumn("of", F.from_json("name", f"a string, b string, tol {kind}")).select("of.*", "rep", "s", "k")
    curve = x.groupBy("a", "b", "rep", "tol").agg((F.sum("s") / F.sum("k")).alias("delta"))
    s = _sign_class(curve, ["a", "b", "rep"])
    return s.groupBy("a", "b").agg(F.count("*").alias("reps"), F.count_if("inverted").alias("inverted"), *[
        F.count_if(F.col("sign_class") == c).alias(c) for c in ("pos", "neg", "mixed")])


def sensitivity(d: DataFrame, drop: Sequence[str], keys: Sequence[str] = PAIR) -> DataFrame:
    """A block's pooled delta, heterogeneity and interaction with and without some subsystems, side by side."""
    def block(x: DataFrame, tag: str) -> DataFrame:
        g = x.groupBy(*keys).agg(F.collect_list(F.struct("delta", "var")).alias("es"), cell_array().alias("cells"), F.avg("delta").alias("pooled"))
        m = interaction_of(meta_of(g))
        return m.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in ("k", "pooled", "i2", "tau2", "lrt")])

    old, new = block(d, "old"), block(d.filter(~F.col("subsystem_id").isin(*drop)), "new")
    return old.join(new, list(keys)).withColumn("sign_kept", sgn("pooled_old") == sgn("pooled_new"))
