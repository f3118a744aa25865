"""Bootstrap kernels and the statistics taken from their replicates.

Three kernels give the same kind of table (keys, rep, name, mean):

* ``draws.replicate_means``: the case bootstrap as multinomial draws on the counts of joint score vectors; the draws are shared
  by all methods and hashed, the cost depends on the number of distinct vectors and not on n;
* ``poisson_replicates``: independent Poisson(1) case weights, one pass and no join, for very large n;
* ``histogram_replicates``: multinomial draws on the counts of distinct values of one pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions.stats import TIE_EPS, hash32, pctl, sgn
from seismark.operators.compare import PAIR, case_items, pair_array
from seismark.operators.draws import counted_quantiles, replicate_means, replicate_values


def spread_parts(df: DataFrame) -> int:
    """Partitions for rows that are few before an explode and many after it (adaptive coalescing would merge them)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def method_replicates(cs: DataFrame, reps: int, seed: int = 7, weight: str | None = None) -> DataFrame:
    """(family, subsystem_id, rep, method, score) from one set of draws shared by all methods. ``weight``: number of equal cases of a case."""
    r = replicate_means(case_items(cs, weight), "subsystem_id", reps, seed, keep=["family"], weight=weight)
    return r.select("family", "subsystem_id", "rep", F.col("name").alias("method"), F.col("mean").alias("score"))


def pair_replicates(cs: DataFrame, reps: int, seed: int = 7, weight: str | None = None) -> DataFrame:
    """Mean paired difference per replicate over the drawn cases that both methods of the pair cover, so the interval belongs
    to the delta of the matched cases. The draws are those of ``method_replicates``."""
    r = replicate_means(case_items(cs, weight), "subsystem_id", reps, seed, keep=["family"], pairs=True, weight=weight)
    return r.select("family", "a", "b", "subsystem_id", "rep", F.col("mean").alias("d"))


def replicate_differences(mr: DataFrame) -> DataFrame:
    """Difference of replicate means per method pair; the paired one only where all methods cover all cases."""
    g = mr.groupBy("family", "subsystem_id", "rep").agg(
        F.collect_list(F.struct("method", "score")).alias("ms"))
    return (g.select("family", "subsystem_id", "rep", F.explode(pair_array("ms")).alias("p"))
            .select("family", "p.a", "p.b", "subsystem_id", "rep", (F.col("p.ya") - F.col("p.yb")).alias("d")))


# fixed values: Poisson(1) probabilities, cumulated, as 32-bit thresholds (weight = number of thresholds passed)
_POISSON1 = [float(sum(np.exp(-1.0) / float(np.prod(np.arange(1, j + 1))) for j in range(i + 1))) for i in range(12)]
POISSON1_CUTS = [int(p * 2**32) for p in _POISSON1]


def poisson1(h: Column) -> Column:
    """Poisson(1) weight from a uniform 32-bit integer."""
    w = F.when(h < POISSON1_CUTS[0], F.lit(0))
    for i, cut in enumerate(POISSON1_CUTS[1:], start=1):
        w = w.when(h < cut, F.lit(i))
    return w.otherwise(F.lit(len(POISSON1_CUTS)))


def poisson_replicates(cs: DataFrame, reps: int, seed: int = 7) -> DataFrame:
    """Poisson bootstrap of method means: one pass over the cases, only (subsystem, rep, method) sums shuffle."""
    w = poisson1(hash32(F.lit(seed), "rep", "case_id"))
    items = case_items(cs)
    x = (items.repartition(spread_parts(items), "case_id")
         .select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
         .withColumn("w", w).filter("w > 0")
         .select("family", "subsystem_id", "rep", "w", F.explode("items").alias("it")))
    return (x.groupBy("family", "subsystem_id", "rep", F.col("it.name").alias("method"))
            .agg((F.sum(F.col("w") * F.col("it.v")) / F.sum("w")).alias("score")))


def value_histogram(diffs: DataFrame, keys: Sequence[str], value: str = "d", digits: int = 12) -> DataFrame:
    """Counts of distinct values; rounding merges values that differ in float noise only."""
    return diffs.groupBy(*keys, F.round(value, digits).alias("v")).agg(F.count("*").alias("c"))


def deltas_of_histogram(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean and its sampling variance from the value counts, without another pass over the cases."""
    c, v = F.col("c"), F.col("v")
    g = hist.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(c * v) / F.sum("c")).alias("delta"), F.sum(c * v * v).alias("_ss"))
    var = F.try_divide(F.greatest(F.col("_ss") - F.col("n") * F.col("delta") * F.col("delta"), F.lit(0.0)), F.col("n") * (F.col("n") - 1))
    return g.select(*keys, "n", "delta", var.alias("var"))


def histogram_replicates(hist: DataFrame, keys: Sequence[str], reps: int, seed: int = 7, block: int = 2500) -> DataFrame:
    """Replicate means (keys, rep, d) by multinomial draws on a value histogram, in blocks of replicates.

    The work per group is ``distinct values x reps``. Groups with many distinct values are still split over
    replicate blocks; the histogram itself is the only thing a task holds.
    """
    keys = list(keys)
    nblocks = (reps + block - 1) // block
    spread = hist.select(*keys, "v", "c", F.explode(F.sequence(F.lit(0), F.lit(nblocks - 1))).alias("block"))
    key_text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k) for k in keys], F.col("block").cast("string"))
    spread = spread.withColumn("stream", hash32(key_text))
    out = ", ".join(f"{k} string" for k in keys) + ", rep int, d double"

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        n = int(pdf["c"].sum())
        first = int(pdf["block"].iloc[0]) * block
        size = min(block, reps - first)
        rng = np.random.Generator(np.random.Philox(key=int(pdf["stream"].iloc[0])))
        counts = rng.multinomial(n, (pdf["c"] / n).to_numpy(), size=size)
        means = counts @ pdf["v"].to_numpy() / n
        res = pd.DataFrame({k: [pdf[k].iloc[0]] * size for k in keys})
        res["rep"] = np.arange(first, first + size, dtype="int32")
        res["d"] = means
        return res

    spread = spread.repartition(spread_parts(spread), *keys, "block")
    return spread.groupBy(*keys, "block").applyInPandas(draw, out)


# ---- statistics of replicates ------------------------------------------------------------------------------

def percentile_ci(reps: DataFrame, keys: Sequence[str], value: str = "d", alpha: float = 0.05) -> DataFrame:
    return reps.groupBy(*keys).agg(pctl(value, alpha / 2).alias("lo"), pctl(value, 1 - alpha / 2).alias("hi"))


def attach_ci(deltas: DataFrame, reps: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Deltas per pair and subsystem with their percentile interval."""
    return deltas.join(percentile_ci(reps, [*PAIR, "subsystem_id"], alpha=alpha), [*PAIR, "subsystem_id"])


def pooled_replicates(deltas: DataFrame, reps: DataFrame) -> DataFrame:
    """Both pooling weights applied to each replicate."""
    n = deltas.select(*PAIR, "subsystem_id", "n")
    return (reps.join(n, [*PAIR, "subsystem_id"]).groupBy(*PAIR, "rep")
            .agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("cw"), F.avg("d").alias("se")))


def pooled_ci(deltas: DataFrame, reps: DataFrame, alpha: float = 0.05) -> DataFrame:
    p = pooled_replicates(deltas, reps)
    return p.groupBy(*PAIR).agg(
        pctl("cw", alpha / 2).alias("pooled_cw_lo"), pctl("cw", 1 - alpha / 2).alias("pooled_cw_hi"),
        pctl("se", alpha / 2).alias("pooled_se_lo"), pctl("se", 1 - alpha / 2).alias("pooled_se_hi"))


def centred_p(reps: DataFrame, points: DataFrame, keys: Sequence[str], point: str = "delta") -> DataFrame:
    """Two-sided p: share of centred replicates at least as far from zero as the point estimate."""
    far = F.abs(F.col("d") - F.col(point)) >= F.abs(F.col(point)) - TIE_EPS
    return (reps.join(points.select(*keys, point), list(keys)).groupBy(*keys)
            .agg(F.avg(F.when(far, 1.0).otherwise(0.0)).alias("p")))


def crossing_p(reps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Twice the smaller share of replicates on one side of zero, at most 1."""
    le = F.avg(F.when(F.col("d") <= TIE_EPS, 1.0).otherwise(0.0))
    ge = F.avg(F.when(F.col("d") >= -TIE_EPS, 1.0).otherwise(0.0))
    return reps.groupBy(*keys).agg(F.least(F.lit(1.0), 2 * F.least(le, ge)).alias("p"))


def strata_replicates(cs: DataFrame, reps: int, seed: int = 7) -> DataFrame:
    """Bootstrap inside subsystem x fault cells, then the mean over cells (each fault class weighs the same)."""
    cell = F.concat_ws("@", "subsystem_id", "fault")
    items = cs.withColumn("cell", cell).groupBy("family", "subsystem_id", "cell", "case_id").agg(
        F.collect_list(F.struct(F.col("method").alias("name"), F.col("score").alias("v"))).alias("items"))
    r = replicate_means(items, "cell", reps, seed, keep=["family", "subsystem_id"])
    return (r.groupBy("family", "subsystem_id", "rep", F.col("name").alias("method")).agg(F.avg("mean").alias("score")))


def strata_pair_replicates(cs: DataFrame, reps: int, seed: int = 7, weight: str | None = None) -> DataFrame:
    """(family, a, b, subsystem_id, rep, d): mean over the fault classes of the paired differences drawn inside each."""
    items = case_items(cs.withColumn("stratum", F.concat_ws("@", "subsystem_id", "fault")), weight, ["stratum"])
    r = replicate_means(items, "stratum", reps, seed, keep=["family", "subsystem_id"], pairs=True, weight=weight)
    return r.groupBy("family", "a", "b", "subsystem_id", "rep").agg(F.avg("mean").alias("d"))


def bonferroni(cs: DataFrame, deltas: DataFrame, pooled: DataFrame, reps: int = 400_000, alpha: float = 0.05, seed: int = 7, weight: str | None = None) -> DataFrame:
    """Intervals at level alpha and at alpha / m, with m the number of (pair, subsystem) comparisons, and the reversals each supports.

    A delta is reversed when its sign differs from the pooled one (subsystems equal), supported when the interval lies off zero.
    """
    keys = [*PAIR, "subsystem_id"]
    m = deltas.groupBy("family").agg(F.count("*").alias("m"))
    values = replicate_values(case_items(cs, weight), "subsystem_id", reps, seed, keep=["family"], weight=weight).join(F.broadcast(m), "family")  # a row per family
    q = F.lit(alpha) / (2 * F.col("m"))
    ci = counted_quantiles(values, [*keys, "m"], {"lo95": F.lit(alpha / 2), "hi95": F.lit(1 - alpha / 2), "lo": q, "hi": 1 - q})
    zero = values.groupBy(*keys).agg((F.sum(F.when(F.abs("d") <= 1e-12, F.col("times")).otherwise(0)) / F.sum("times")).alias("p_zero"))
    x = ci.join(zero, keys).join(deltas.select(*keys, "n", "delta"), keys).join(pooled.select(*PAIR, "pooled_se"), PAIR)
    reversed_ = (F.abs("pooled_se") > TIE_EPS) & (F.col("delta") != 0) & (F.signum("delta") != F.signum("pooled_se"))
    off = lambda lo, hi: (F.col(lo) > 0) | (F.col(hi) < 0)
    return x.select(*keys, "m", "n", "delta", "pooled_se", "lo95", "hi95", "lo", "hi", "p_zero", reversed_.alias("point_reversal"),
                    (reversed_ & off("lo95", "hi95")).alias("rev_ci95"), (reversed_ & off("lo", "hi")).alias("rev_ci_adj"))


def holm(df: DataFrame, group: Sequence[str], p: str = "p", tie: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p within groups of comparisons (a result table); null p stays null."""
    w = W.partitionBy(*group).orderBy(F.col(p).asc_nulls_last(), *tie)
    m = F.count(p).over(W.partitionBy(*group))
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("_step", step)
    return x.withColumn(f"{p}_holm", F.when(F.col(p).isNotNull(), F.max("_step").over(run))).drop("_step")


def both_signs(reps: DataFrame) -> DataFrame:
    """Share of replicates in which some subsystem favours each side."""
    per = reps.groupBy(*PAIR, "rep").agg(((F.max("d") > TIE_EPS) & (F.min("d") < -TIE_EPS)).alias("both"))
    return per.groupBy(*PAIR).agg(F.count("*").alias("reps"), F.avg(F.col("both").cast("double")).alias("share_both_signs"))


def win_probability(ra: DataFrame, rb: DataFrame) -> DataFrame:
    """P(A ahead), P(B ahead), P(tie) when the two methods are resampled independently (two streams of draws)."""
    a = ra.select("family", "subsystem_id", "rep", F.col("method").alias("a"), F.col("score").alias("ma"))
    b = rb.select("family", "subsystem_id", "rep", F.col("method").alias("b"), F.col("score").alias("mb"))
    j = a.join(b, ["family", "subsystem_id", "rep"]).filter("a < b").withColumn("s", sgn(F.col("ma") - F.col("mb")))
    j = j.withColumn("d", F.col("ma") - F.col("mb"))
    share = [F.avg(F.when(F.col("s") == v, 1.0).otherwise(0.0)).alias(n) for v, n in ((1, "p_a"), (-1, "p_b"), (0, "p_tie"))]
    return j.groupBy(*PAIR, "subsystem_id").agg(*share, pctl("d", 0.025).alias("lo"), pctl("d", 0.975).alias("hi"))


def regret_replicates(mr: DataFrame) -> DataFrame:
    """Mean held-out regret per replicate: for each subsystem the winner on the others is scored there."""
    tot = W.partitionBy("family", "rep", "method")
    x = mr.withColumn("k", F.count("*").over(tot)).withColumn("rest", (F.sum("score").over(tot) - F.col("score")) / (F.col("k") - 1))
    per = x.groupBy("family", "rep", "subsystem_id").agg(
        F.max("score").alias("best"),
        F.min_by("score", F.struct(-F.round("rest", 9), F.col("method"))).alias("won"))
    return per.groupBy("family", "rep").agg(F.avg(F.col("best") - F.col("won")).alias("regret"))


def tolerance_replicates(scores: DataFrame, reps: int, seed: int = 7, weight: str | None = None) -> DataFrame:
    """Replicate means per (system, tolerance, method); draws do not depend on the tolerance. ``weight``: number of equal cases of a row."""
    items = scores.groupBy("system", "case_id", *([weight] if weight else [])).agg(F.collect_list(
        F.struct(F.concat_ws("@", "method", F.col("tol").cast("string")).alias("name"), F.col("score").alias("v"))).alias("items"))
    r = replicate_means(items, "system", reps, seed, weight=weight)
    return r.select("system", "rep", F.substring_index("name", "@", 1).alias("method"),
                    F.substring_index("name", "@", -1).cast("int").alias("tol"), F.col("mean").alias("score"))


def inversions(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tolerance pairs whose delta changes sign: robust (both intervals off zero), weak (one), raw (none)."""
    pts = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tol", "delta", "lo", "hi"))).alias("c"))
    prs = F.flatten(F.transform("c", lambda x, i: F.transform(
        F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    p = pts.select(*keys, F.explode(prs).alias("p"))
    off = lambda s: ((F.col(f"p.{s}.lo") > 0) | (F.col(f"p.{s}.hi") < 0)).cast("int")
    return (p.filter(sgn("p.x.delta") * sgn("p.y.delta") < 0)
            .select(*keys, F.col("p.x.tol").alias("t1"), F.col("p.y.tol").alias("t2"),
                    F.col("p.x.delta").alias("delta_t1"), F.col("p.y.delta").alias("delta_t2"),
                    F.when(off("x") + off("y") == 2, "robust").when(off("x") + off("y") == 1, "weak").otherwise("raw").alias("kind")))


def max_t_band(reps: DataFrame, points: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Simultaneous band over tolerances: point +- c * sd, c the 1 - alpha quantile of the largest |t|."""
    keys = list(keys)
    sd = reps.groupBy(*keys, "tol").agg(F.stddev_samp("d").alias("sd"))
    x = reps.join(sd, [*keys, "tol"]).join(points.select(*keys, "tol", "delta"), [*keys, "tol"])
    t = F.when(F.col("sd") > 1e-12, F.abs(F.col("d") - F.col("delta")) / F.col("sd")).otherwise(0.0)
    c = x.groupBy(*keys, "rep").agg(F.max(t).alias("t")).groupBy(*keys).agg(pctl("t", 1 - alpha).alias("crit"))
    return (points.select(*keys, "tol", "delta").join(sd, [*keys, "tol"]).join(c, keys)
            .select(*keys, "tol", "delta", "sd", "crit", (F.col("delta") - F.col("crit") * F.col("sd")).alias("lo"),
                    (F.col("delta") + F.col("crit") * F.col("sd")).alias("hi")))


def focal_contrast(reps: DataFrame, points: DataFrame, focal: str) -> DataFrame:
    """Delta in one subsystem minus the mean delta of the others, with interval and one-sided p."""
    def contrast(v: str) -> Column:
        own = F.max(F.when(F.col("subsystem_id") == focal, F.col(v)))
        rest = F.avg(F.when(F.col("subsystem_id") != focal, F.col(v)))
        return own - rest

    c = reps.groupBy("a", "b", "rep").agg(contrast("d").alias("c"))
    stats = c.groupBy("a", "b").agg(pctl("c", 0.025).alias("lo"), pctl("c", 0.975).alias("hi"),
                                    F.avg(F.when(F.col("c") <= TIE_EPS, 1.0).otherwise(0.0)).alias("p_le_0"))
    return points.groupBy("a", "b").agg(contrast("delta").alias("contrast")).join(stats, ["a", "b"])


def ci_separation(d: DataFrame, max_width: float) -> DataFrame:
    """Pairs separated by two subsystems: opposite signs, disjoint intervals, both narrow enough."""
    g = d.groupBy(*PAIR).agg(F.collect_list(F.struct("subsystem_id", "delta", "lo", "hi")).alias("s"))
    prs = F.flatten(F.transform("s", lambda x: F.transform(
        F.filter("s", lambda y: x["subsystem_id"] < y["subsystem_id"]),
        lambda y: F.struct(x.alias("x"), y.alias("y")))))
    p = g.select(*PAIR, F.explode(prs).alias("p"))
    x, y = "p.x", "p.y"
    return p.filter(
        (sgn(f"{x}.delta") * sgn(f"{y}.delta") < 0)
        & ((F.col(f"{x}.lo") > F.col(f"{y}.hi")) | (F.col(f"{x}.hi") < F.col(f"{y}.lo")))
        & (F.col(f"{x}.hi") - F.col(f"{x}.lo") <= max_width) & (F.col(f"{y}.hi") - F.col(f"{y}.lo") <= max_width)
    ).select(*PAIR, F.col(f"{x}.subsystem_id").alias("s1"), F.col(f"{y}.subsystem_id").alias("s2"),
             F.col(f"{x}.delta").alias("delta_1"), F.col(f"{y}.delta").alias("delta_2"))
