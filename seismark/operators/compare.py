"""Paired comparison of methods: deltas per subsystem, pooling, reversals, regret, views and summaries.

Grains used below: case scores (family, subsystem_id, case_id, method, score); paired differences per case;
deltas per pair and subsystem. From deltas on, tables have pairs x subsystems rows and no longer grow with
the number of cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions.stats import TIE_EPS, sgn, pctl

PAIR = ["family", "a", "b"]
CASE = ["family", "subsystem_id", "case_id"]


def with_layers(df: DataFrame) -> DataFrame:
    """Layer L1 keeps published rows, L2 keeps all; one row per layer a row belongs to."""
    layers = F.when(F.col("role") == "published", F.array(F.lit("L1"), F.lit("L2"))).otherwise(F.array(F.lit("L2")))
    return df.withColumn("layer", F.explode(layers))


def case_score(df: DataFrame, variant: str = "mean", extra: Sequence[str] = (), value: str = "score") -> DataFrame:
    """One score per case and method: the mean over seeds, or one seed (rows without a seed are kept)."""
    keys = [*CASE[:2], *extra, CASE[2], "method"]
    if variant != "mean":
        df = df.filter(F.col("seed").isNull() | (F.col("seed") == int(variant.removeprefix("seed"))))
    return df.groupBy(*keys).agg(F.avg(value).alias("score"))


def case_items(cs: DataFrame, weight: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One row per case with the array of its method scores (as many entries as there are methods)."""
    return cs.groupBy(*CASE, *extra, *([weight] if weight else [])).agg(
        F.collect_list(F.struct(F.col("method").alias("name"), F.col("score").alias("v"))).alias("items"))


def case_kinds(cs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Case scores with ``times``: cases of a subsystem (and ``extra``) with equal scores are one case (named by them) that counts ``times``."""
    kinds = case_items(cs, extra=extra).groupBy(*CASE[:2], *extra, F.array_sort("items").alias("items")).agg(F.count("*").alias("times"))
    return kinds.select(*CASE[:2], *extra, F.to_json("items").alias("case_id"), "times", F.explode("items").alias("it")).select(
        *CASE[:2], *extra, CASE[2], F.col("it.name").alias("method"), F.col("it.v").alias("score"), "times")


def pair_array(ms: str | Column) -> Column:
    """All (a < b) pairs of an array of (method, score) structs; the array has one entry per method."""
    s = F.array_sort(F.col(ms) if isinstance(ms, str) else ms)
    return F.flatten(F.transform(s, lambda x, i: F.transform(
        F.slice(s, i + 2, F.size(s)),
        lambda y: F.struct(x["method"].alias("a"), y["method"].alias("b"), x["score"].alias("ya"), y["score"].alias("yb")))))


def method_pairs(df: DataFrame, keys: Sequence[str] = ("family",)) -> DataFrame:
    """Unordered pairs of the methods present under ``keys``."""
    ms = df.groupBy(*keys).agg(F.sort_array(F.collect_set("method")).alias("ms"))
    prs = F.flatten(F.transform("ms", lambda x, i: F.transform(
        F.slice("ms", i + 2, F.size("ms")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return ms.select(*keys, F.explode(prs).alias("p")).select(*keys, "p.*")


def pair_diffs(cs: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """Paired differences on matched cases. The methods of a case meet in one row, so there is no self join."""
    g = cs.groupBy(*keys).agg(F.collect_list(F.struct("method", "score")).alias("ms"))
    return (g.select(*keys, F.explode(pair_array("ms")).alias("p"))
            .select(*keys, "p.*", (F.col("p.ya") - F.col("p.yb")).alias("d")))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def pair_deltas(diffs: DataFrame, keys: Sequence[str] = (*PAIR, "subsystem_id"), weight: str | None = None) -> DataFrame:
    """Means, and the sampling variance of the mean difference. With ``weight``, a row stands for that many equal cases."""
    if weight:
        g = diffs.groupBy(*keys).agg(
            F.sum(weight).alias("n"), weighted_mean("ya", weight).alias("acc_a"), weighted_mean("yb", weight).alias("acc_b"),
            weighted_mean("d", weight).alias("delta"), (F.min("d") == F.max("d")).alias("_flat"), F.sum(F.when(F.col("d").isNotNull(), F.col(weight))).alias("_k"))
        # squares about the mean; equal differences have none, whatever the rounding of their mean
        ss = F.sum(F.when(F.col("_flat"), 0.0).otherwise(F.col(weight) * F.pow(F.col("d") - F.col("delta"), 2)))
        x = diffs.select(*keys, weight, "d").join(g, list(keys)).groupBy(*keys, "n", "acc_a", "acc_b", "delta", "_k").agg(ss.alias("_ss"))
        return x.select(*keys, "n", "acc_a", "acc_b", "delta", (F.try_divide(F.col("_ss"), F.col("_k") - 1) / F.col("n")).alias("var"))
    return diffs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("ya").alias("acc_a"), F.avg("yb").alias("acc_b"), F.avg("d").alias("delta"),
        (F.var_samp("d") / F.count("*")).alias("var"))


def pool(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Case-weighted and system-equal means of the subsystem deltas, for pairs seen on two or more subsystems."""
    return d.groupBy(*keys).agg(
        F.count("*").alias("k"), (F.sum(F.col("n") * F.col("delta")) / F.sum("n")).alias("pooled_cw"),
        F.avg("delta").alias("pooled_se")).filter("k >= 2")


def pooling_rules(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Mean, median, case-weighted, without the extremes, and 10 % trimmed mean, with reversals under each."""
    g = d.groupBy(*keys).agg(
        F.count("*").alias("k"), F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.5)).alias("median"),
        (F.sum(F.col("n") * F.col("delta")) / F.sum("n")).alias("case_weighted"),
        F.sort_array(F.collect_list("delta")).alias("ds"))
    cut = F.floor(F.col("k") * 0.1).cast("int")

    def inner(c: Column) -> Column:
        part = F.slice("ds", c + 1, F.greatest(F.col("k") - 2 * c, F.lit(0)).cast("int"))
        return F.try_divide(F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v), F.size(part))

    g = g.withColumn("drop_extremes", inner(F.lit(1))).withColumn("trimmed", inner(cut))
    rules = ["mean", "median", "case_weighted", "drop_extremes", "trimmed"]
    long = g.select(*keys, "k", "ds", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("pooled")) for r in rules])).alias("r")).select("*", "r.*")
    p = sgn("pooled")
    n_rev = F.size(F.filter("ds", lambda v: sgn(v) * p < 0))
    return long.select(*keys, "k", "rule", "pooled", n_rev.alias("n_rev"))


def join_pooled(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Attach the pooled values to the deltas. One window over the delta table (pairs x subsystems rows), so the
    cases behind the deltas are read once."""
    w = W.partitionBy(*keys)
    return (d.withColumn("k", F.count("*").over(w))
            .withColumn("pooled_cw", F.sum(F.col("n") * F.col("delta")).over(w) / F.sum("n").over(w))
            .withColumn("pooled_se", F.avg("delta").over(w)).filter("k >= 2"))


def _names(cond: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("subsystem_id")))), ";")


def reversals(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Subsystems whose sign contradicts the pooled sign; a tie on either side is no reversal."""
    x = join_pooled(d, keys)
    rev = {w: sgn("delta") * sgn(f"pooled_{w}") < 0 for w in ("cw", "se")}
    return x.groupBy(*keys, "k", "pooled_cw", "pooled_se").agg(
        F.count_if(rev["cw"]).alias("n_rev_cw"), _names(rev["cw"]).alias("rev_cw"),
        F.count_if(rev["se"]).alias("n_rev_se"), _names(rev["se"]).alias("rev_se"))


def ci_reversal(pooled: str) -> Column:
    p = F.col(pooled)
    return ((p > TIE_EPS) & (F.col("hi") < 0)) | ((p < -TIE_EPS) & (F.col("lo") > 0))


def reversals_ci(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Reversals whose whole interval lies on the other side of zero."""
    x = join_pooled(d, keys)
    return x.groupBy(*keys).agg(
        F.count_if(ci_reversal("pooled_cw")).alias("n_rev_ci_cw"), _names(ci_reversal("pooled_cw")).alias("rev_ci_cw"),
        F.count_if(ci_reversal("pooled_se")).alias("n_rev_ci_se"), _names(ci_reversal("pooled_se")).alias("rev_ci_se"))


def spread(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return d.groupBy(*keys).agg(
        F.stddev_samp("delta").alias("sd_sub_delta"), F.count_if(sgn("delta") > 0).alias("n_pos"),
        F.count_if(sgn("delta") < 0).alias("n_neg"))


def margins(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Pair table with margin, spread and reversal flags."""
    p = join_pooled(d, keys).groupBy(*keys, "k", "pooled_se").agg(
        F.stddev_samp("delta").alias("sd_sub_delta"), F.count_if(sgn("delta") * sgn("pooled_se") < 0).alias("n_rev_se"))
    return p.select(*keys, "k", "pooled_se", F.abs("pooled_se").alias("abs_margin"), "sd_sub_delta",
                    (F.abs("pooled_se") < F.col("sd_sub_delta")).alias("margin_lt_sd"), "n_rev_se",
                    (F.col("n_rev_se") > 0).alias("reverses"))


def margin_dispersion(d: DataFrame, keys: Sequence[str] = PAIR, by: Sequence[str] = ()) -> DataFrame:
    return margins(d, keys).groupBy(*by, "margin_lt_sd").agg(
        F.count("*").alias("pairs"), F.count_if("reverses").alias("reverse"))


def table_margins(t: DataFrame) -> DataFrame:
    """The same on a published method x unit table (long form: tbl, method, unit, value)."""
    diffs = pair_diffs(t.select("tbl", "unit", "method", F.col("value").alias("score")), ["tbl", "unit"])
    g = diffs.groupBy("tbl", "a", "b").agg(
        F.count("*").alias("k"), F.avg("d").alias("pooled"), F.stddev_samp("d").alias("sd_units"),
        F.count_if(sgn("d") > 0).alias("units_a_wins"), F.count_if(sgn("d") < 0).alias("units_b_wins"))
    p = sgn("pooled")
    return g.select("tbl", "a", "b", "k", "pooled", F.abs("pooled").alias("abs_margin"), "sd_units",
                    F.when(p > 0, F.col("units_b_wins")).when(p < 0, F.col("units_a_wins")).otherwise(0).alias("n_rev"),
                    "units_a_wins", "units_b_wins")


def adjacent_gaps(t: DataFrame) -> DataFrame:
    """Method means in order and the gap to the next one (one row per method of a table)."""
    m = t.groupBy("tbl", "method").agg(F.avg("value").alias("mean"))
    w = W.partitionBy("tbl").orderBy(F.round("mean", 9).desc(), "method")
    return m.select("tbl", "method", "mean", (F.col("mean") - F.lead("mean").over(w)).alias("gap_to_next"))


def cross_release(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """The same pair and application in two releases: sign agreement, intervals on opposite sides."""
    cols = ["n", "delta", "lo", "hi"]
    x = r1.select("a", "b", "app", *[F.col(c).alias(f"{c}_1") for c in cols])
    y = r2.select("a", "b", "app", *[F.col(c).alias(f"{c}_2") for c in cols])
    opposite = ((F.col("lo_1") > 0) & (F.col("hi_2") < 0)) | ((F.col("hi_1") < 0) & (F.col("lo_2") > 0))
    return x.join(y, ["a", "b", "app"]).select(
        "*", (sgn("delta_1") == sgn("delta_2")).alias("sign_agree"), opposite.alias("ci_opposite"),
        (F.abs("delta_1") - F.abs("delta_2")).alias("abs_delta_diff"))


def accuracy(cs: DataFrame, extra: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mean score per subsystem and method with the number of cases; with ``weight``, a row stands for that many equal cases."""
    if weight:
        return cs.groupBy(*extra, "family", "subsystem_id", "method").agg(weighted_mean("score", weight).alias("acc"), F.sum(weight).alias("n"))
    return cs.groupBy(*extra, "family", "subsystem_id", "method").agg(F.avg("score").alias("acc"), F.count("*").alias("n"))


def accuracy_table(cs: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """Subsystem x method; wide when the method columns are named."""
    acc = accuracy(cs)
    if methods is None:
        return acc.select("family", "subsystem_id", "method", "acc")
    return acc.groupBy("family", "subsystem_id").pivot("method", list(methods)).agg(F.first("acc"))


def subsystem_sizes(cs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return (cs.select(*extra, *CASE).distinct().groupBy(*extra, "family", "subsystem_id").agg(F.count("*").alias("n_cases")))


def regret(cs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Loss of using the pooled winner everywhere. Winner and runner-up come from methods present on every
    subsystem; the best of a subsystem comes from all methods.

    All steps are windows over the accuracy table (subsystems x methods rows). A complete method has a row in every
    subsystem, so the leaderboard can be read inside each subsystem.
    """
    grp = [*extra, "family"]
    fam, meth, sub = W.partitionBy(*grp), W.partitionBy(*grp, "method"), W.partitionBy(*grp, "subsystem_id")
    x = accuracy(cs, extra).drop("n").join(subsystem_sizes(cs, extra), [*grp, "subsystem_id"])
    x = x.withColumn("complete", F.count("*").over(meth) == F.size(F.collect_set("subsystem_id").over(fam)))
    x = x.withColumn("cw", F.sum(F.col("acc") * F.col("n_cases")).over(meth) / F.sum("n_cases").over(meth)).withColumn("se", F.avg("acc").over(meth))
    names = lambda keep: F.collect_set(F.when(F.col("complete") == keep, F.col("method"))).over(fam)
    x = x.withColumn("methods_ranked", F.size(names(True))).withColumn("methods_excluded", F.array_join(F.sort_array(names(False)), ";"))
    long = x.select("*", F.explode(F.array(
        F.struct(F.lit("case_weighted").alias("weighting"), F.col("cw").alias("pooled")),
        F.struct(F.lit("system_equal").alias("weighting"), F.col("se").alias("pooled")))).alias("p")).select("*", "p.*")
    lead = F.struct((~F.col("complete")).alias("c"), (-F.round("pooled", 9)).alias("p"), F.col("method").alias("m"))
    g = long.groupBy(*grp, "weighting", "subsystem_id", "n_cases", "methods_ranked", "methods_excluded").agg(
        F.array_sort(F.collect_list(F.struct(lead.alias("o"), "method", "pooled", "acc", "complete"))).alias("b"),
        F.min_by("method", F.struct(-F.round("acc", 9), F.col("method"))).alias("best_method"), F.max("acc").alias("best_acc"))
    w, r = F.get("b", 0), F.get("b", 1)
    second = lambda f: F.when(r["complete"], r[f])
    return g.filter(w["complete"]).select(
        *grp, "weighting", w["method"].alias("winner"), w["pooled"].alias("winner_pooled"), second("method").alias("runner_up"),
        second("pooled").alias("runner_up_pooled"), "subsystem_id", "n_cases", w["acc"].alias("winner_acc"), "best_method", "best_acc",
        (F.col("best_acc") - w["acc"]).alias("regret"), "methods_ranked", "methods_excluded")


def small_sample(d: DataFrame, mins: Sequence[int] = (0, 25, 50)) -> DataFrame:
    """Pooled value and reversals when only subsystems with at least n_min cases count."""
    x = d.withColumn("n_min", F.explode(F.array(*[F.lit(m) for m in mins]))).filter("n >= n_min")
    keys = ["n_min", *PAIR]
    return join_pooled(x, keys).groupBy(*keys, "k", "pooled_se").agg(
        F.count_if(sgn("delta") * sgn("pooled_se") < 0).alias("n_rev"), F.count_if(ci_reversal("pooled_se")).alias("n_rev_ci"))


def compare_conditions(ref: DataFrame, alt: DataFrame) -> DataFrame:
    """Sign change (a tie against either side counts) and reversal status of each pair x subsystem under two conditions.

    With intervals (lo, hi) in both tables also the reversals that these confirm, and where the confirmation changes.
    """
    ci = {"lo", "hi"} <= set(ref.columns) & set(alt.columns)

    def side(d: DataFrame, tag: str) -> DataFrame:
        x = join_pooled(d)
        named = [F.col(c).alias(f"{c}_{tag}") for c in ("n", "acc_a", "acc_b", "delta", *(("lo", "hi") if ci else ()))]
        flags = [ci_reversal("pooled_se").alias(f"rev_ci_{tag}")] if ci else []
        return x.select(*PAIR, "subsystem_id", *named, F.col("pooled_se").alias(f"pooled_{tag}"), (sgn("delta") * sgn("pooled_se") < 0).alias(f"rev_{tag}"), *flags)

    j = side(ref, "ref").join(side(alt, "alt"), [*PAIR, "subsystem_id"]).select(
        "*", (sgn("delta_ref") != sgn("delta_alt")).alias("sign_change"),
        (F.col("rev_ref") != F.col("rev_alt")).alias("status_change"))
    return j.withColumn("ci_status_change", F.col("rev_ci_ref") != F.col("rev_ci_alt")) if ci else j


def kendall_tau(ref: DataFrame, alt: DataFrame) -> DataFrame:
    """Tau-b of the method orders of a subsystem under two conditions, and the top method of each."""
    j = ref.select("family", "subsystem_id", "method", F.col("acc").alias("x")).join(
        alt.select("family", "subsystem_id", "method", F.col("acc").alias("y")), ["family", "subsystem_id", "method"])
    g = j.groupBy("family", "subsystem_id").agg(
        F.collect_list(F.struct("method", "x", "y")).alias("m"),
        F.min_by("method", F.struct(-F.round("x", 9), F.col("method"))).alias("top_ref"),
        F.min_by("method", F.struct(-F.round("y", 9), F.col("method"))).alias("top_alt"))
    prs = F.flatten(F.transform("m", lambda u: F.transform(
        F.filter("m", lambda v: u["method"] < v["method"]),
        lambda v: F.struct(sgn(u["x"] - v["x"]).alias("sx"), sgn(u["y"] - v["y"]).alias("sy")))))
    p = g.select("family", "subsystem_id", "top_ref", "top_alt", F.explode(prs).alias("p"))
    s = p.groupBy("family", "subsystem_id", "top_ref", "top_alt").agg(
        F.sum(F.col("p.sx") * F.col("p.sy")).alias("c"), F.sum(F.abs("p.sx")).alias("nx"), F.sum(F.abs("p.sy")).alias("ny"))
    return s.select("family", "subsystem_id", F.try_divide(F.col("c").cast("double"), F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"),
                    "top_ref", "top_alt", (F.col("top_ref") == F.col("top_alt")).alias("same_top"))


def coverage(df: DataFrame) -> DataFrame:
    """Valid outputs and accuracy on all and on valid rows per subsystem, method and seed (null seed is a group)."""
    valid = F.col("valid_output") == 1
    return df.groupBy("family", "subsystem_id", "method", "seed").agg(
        F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.avg(F.col("valid_output").cast("double")).alias("coverage"),
        F.avg("score").alias("acc_all"), F.try_divide(F.sum(F.when(valid, F.col("score"))), F.count_if(valid)).alias("acc_valid_only"))


def denominator_effect(df: DataFrame) -> DataFrame:
    """Deltas with all cases and with valid rows only as denominator, per pair and subsystem.

    Both accuracies are taken per seed (hits over all or over valid rows), then averaged over the seeds. Pooled values are
    means over the subsystems where both methods have valid rows, two at least.
    """
    n_valid = F.sum("valid_output")
    seeds = df.groupBy("family", "subsystem_id", "method", "seed").agg(F.avg("score").alias("_all"), F.when(n_valid > 0, F.sum("score") / n_valid).alias("_valid"))
    m = seeds.groupBy("family", "subsystem_id", "method").agg(F.struct(F.avg("_all").alias("x"), F.avg("_valid").alias("v")).alias("score")).filter("score.v is not null")
    g = m.groupBy("family", "subsystem_id").agg(F.collect_list(F.struct("method", "score")).alias("ms"))
    j = g.select("family", "subsystem_id", F.explode(pair_array("ms")).alias("p")).select(
        "family", "p.a", "p.b", "subsystem_id", (F.col("p.ya.x") - F.col("p.yb.x")).alias("delta_all"), (F.col("p.ya.v") - F.col("p.yb.v")).alias("delta_valid"))
    pooled = j.groupBy(*PAIR).agg(F.avg("delta_all").alias("pooled_all"), F.avg("delta_valid").alias("pooled_valid"), F.count("*").alias("_k")).filter("_k >= 2").drop("_k")
    return j.join(pooled, PAIR).select("*", (sgn("delta_all") != sgn("delta_valid")).alias("sign_change"),
                                       ((sgn("delta_all") * sgn("pooled_all") < 0) != (sgn("delta_valid") * sgn("pooled_valid") < 0)).alias("status_change"))


def stratified_deltas(cs: DataFrame) -> DataFrame:
    """Deltas per fault class and whether the classes of a subsystem disagree in sign. ``cs`` carries ``fault``."""
    d = pair_diffs(cs, [*CASE, "fault"]).groupBy(*PAIR, "subsystem_id", "fault").agg(
        F.count("*").alias("n"), F.avg("d").alias("delta"))
    w = W.partitionBy(*PAIR, "subsystem_id")
    return d.withColumn("sign_disagree", (F.max(sgn("delta")).over(w) > 0) & (F.min(sgn("delta")).over(w) < 0))


def common_values(df: DataFrame, value: str, over: str, keys: Sequence[str] = ()) -> DataFrame:
    """Values of ``value`` present under every ``over`` of their group."""
    seen = df.select(*keys, value, over).distinct()
    have = seen.groupBy(*keys, value).agg(F.count("*").alias("_h"))
    if not keys:
        return have.filter(F.col("_h") == seen.agg(F.count_distinct(over)).scalar()).select(value)
    total = seen.groupBy(*keys).agg(F.count_distinct(over).alias("_k"))
    return have.join(total, list(keys)).filter("_h = _k").select(*keys, value)


def common_faults(cs: DataFrame) -> DataFrame:
    """Scores of the fault classes that every subsystem of the family has."""
    return cs.join(common_values(cs, "fault", "subsystem_id", ["family"]), ["family", "fault"], "left_semi")


def fault_cells(cs: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean, number and sum of the paired differences of each fault class. With ``weight``, a row stands for that many equal cases."""
    d = pair_diffs(cs, [*CASE, "fault", *([weight] if weight else [])])
    mean, n, s = (weighted_mean("d", weight), F.sum(weight), F.sum(F.col(weight) * F.col("d"))) if weight else (F.avg("d"), F.count("*"), F.sum("d"))
    return d.groupBy(*PAIR, "subsystem_id", "fault").agg(mean.alias("cell"), n.alias("n"), s.alias("s"))


def reweighted(cs: DataFrame, weight: str | None = None) -> DataFrame:
    """Deltas with each common fault class weighing the same."""
    cell = fault_cells(common_faults(cs), weight)
    return cell.groupBy(*PAIR, "subsystem_id").agg(
        F.count("*").alias("classes"), (F.sum("s") / F.sum("n")).alias("delta_raw"), F.avg("cell").alias("delta_rw"))


def reweighted_reversals(cs: DataFrame, rw: DataFrame, reps: DataFrame, weight: str | None = None) -> DataFrame:
    """Plain and re-weighted deltas of each pair x subsystem with their pooled values, the interval of the re-weighted delta and
    the reversals under both; pairs of one subsystem only are left out.

    ``cs``: scores of all faults, ``rw``: their ``reweighted``, ``reps``: (family, a, b, subsystem_id, rep, d) of the re-weighted delta.
    """
    keys = [*PAIR, "subsystem_id"]
    ref = fault_cells(cs, weight).groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias("delta_ref"), ((F.max("cell") > 0) & (F.min("cell") < 0)).alias("fault_sign_disagree"))
    ci = reps.groupBy(*keys).agg(pctl("d", 0.025).alias("lo_rw"), pctl("d", 0.975).alias("hi_rw"))
    x = ref.join(rw.select(*keys, "classes", "delta_rw"), keys).join(ci, keys)
    w = W.partitionBy(*PAIR)  # the subsystems of a pair
    x = x.withColumns({"pooled_ref": F.avg("delta_ref").over(w), "pooled_rw": F.avg("delta_rw").over(w), "_k": F.count("*").over(w)}).filter("_k >= 2")
    off = ((F.col("pooled_rw") > TIE_EPS) & (F.col("hi_rw") < 0)) | ((F.col("pooled_rw") < -TIE_EPS) & (F.col("lo_rw") > 0))
    return x.drop("_k").select("*", (sgn("delta_ref") * sgn("pooled_ref") < 0).alias("rev_ref"), (sgn("delta_rw") * sgn("pooled_rw") < 0).alias("rev_rw"),
                               off.alias("rev_ci_rw"), (sgn("delta_ref") != sgn("delta_rw")).alias("sign_change"))


def fault_composition(cs: DataFrame, faults: Sequence[str]) -> DataFrame:
    x = cs.select(*CASE, "fault").distinct()
    return x.groupBy("family", "subsystem_id").pivot("fault", list(faults)).count().na.fill(0)


def views(cs: DataFrame) -> DataFrame:
    """Means per method for the pooled table, each family alone, and each family left out.

    One pass gives sums per family; drop-X is total minus part, so nothing is scanned again per view.
    """
    part = cs.groupBy("family", "method").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    tot = part.groupBy("method").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    j = part.join(tot, "method")
    only = j.select(F.concat(F.lit("only:"), "family").alias("view"), "method", "s", "n")
    drop = j.select(F.concat(F.lit("drop:"), "family").alias("view"), "method", (F.col("ts") - F.col("s")).alias("s"), (F.col("tn") - F.col("n")).alias("n"))
    return (only.unionByName(drop).unionByName(tot.select(F.lit("pooled").alias("view"), "method", F.col("ts").alias("s"), F.col("tn").alias("n")))
            .filter("n > 0").select("view", "method", "n", (F.col("s") / F.col("n")).alias("acc")))


def view_deltas(v: DataFrame) -> DataFrame:
    return pair_diffs(v.select("view", "method", F.col("acc").alias("score")), ["view"]).select("view", "a", "b", F.col("d").alias("delta"))


def rank_flips(vd: DataFrame) -> DataFrame:
    """Pairs whose nonzero sign differs across views."""
    s = sgn("delta")
    g = vd.groupBy("a", "b").agg(F.count_if(s > 0).alias("views_a"), F.count_if(s < 0).alias("views_b"), F.count_if(s == 0).alias("views_tie"))
    return g.select("*", ((F.col("views_a") > 0) & (F.col("views_b") > 0)).alias("flips"))


def headline(cs: DataFrame) -> DataFrame:
    """Rank of each method per subsystem, its best and worst rank, spread, and accuracy range."""
    acc = accuracy(cs)
    r = acc.withColumn("rk", F.rank().over(W.partitionBy("family", "subsystem_id").orderBy(F.round("acc", 9).desc())))
    return r.groupBy("family", "method").agg(
        F.min("rk").alias("best_rank"), F.max("rk").alias("worst_rank"), (F.max("rk") - F.min("rk")).alias("rank_spread"),
        F.min("acc").alias("min_acc"), F.max("acc").alias("max_acc"))


def variance_decomposition(d: DataFrame) -> DataFrame:
    """Sums of squares of the deltas between and within families for each pair of methods."""
    fam = d.groupBy("a", "b", "family").agg(F.count("*").alias("k"), F.avg("delta").alias("m"), F.var_pop("delta").alias("v"))
    g = fam.withColumn("gm", F.sum(F.col("k") * F.col("m")).over(W.partitionBy("a", "b")) / F.sum("k").over(W.partitionBy("a", "b")))
    s = g.groupBy("a", "b").agg(F.sum(F.col("k") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ss_between"), F.sum(F.col("k") * F.col("v")).alias("ss_within"))
    tot = F.col("ss_between") + F.col("ss_within")
    return s.select("*", tot.alias("ss_total"), F.when(tot > TIE_EPS, F.col("ss_between") / tot).alias("share_between"))


def difficulty(df: DataFrame, group: str, label: str, service: str) -> DataFrame:
    """Majority share, entropy in bits, number of services and the lift of always naming the largest class."""
    c = df.groupBy(group, label).agg(F.count("*").alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy(group)))
    e = p.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("classes"), F.max("p").alias("majority_share"),
                             F.sum(-F.col("p") * F.log2("p")).alias("entropy_bits"))
    s = df.select(group, service).distinct().groupBy(group).agg(F.count("*").alias("services"))
    return e.join(s, group).withColumn("lift", F.col("majority_share") * F.col("classes"))


def stability_lines(d: DataFrame, ref: str) -> DataFrame:
    """Each method against one reference method: interval wins, ties, losses and the worst subsystem."""
    x = d.filter((F.col("a") == ref) | (F.col("b") == ref))
    own = F.col("b") == ref
    o = x.select("family", F.when(own, F.col("a")).otherwise(F.col("b")).alias("method"), "subsystem_id",
                 F.when(own, F.col("delta")).otherwise(-F.col("delta")).alias("gap"),
                 F.when(own, F.col("lo")).otherwise(-F.col("hi")).alias("lo"), F.when(own, F.col("hi")).otherwise(-F.col("lo")).alias("hi"))
    return o.groupBy("family", "method").agg(
        F.count_if(F.col("lo") > 0).alias("wins"), F.count_if((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("ties"),
        F.count_if(F.col("hi") < 0).alias("losses"),
        F.min_by("subsystem_id", F.struct(F.round("gap", 9), F.col("subsystem_id"))).alias("worst_subsystem"), F.min("gap").alias("worst_gap"))


def seed_effect(d: DataFrame, randomized: DataFrame) -> DataFrame:
    """Per pair and subsystem: does some single seed change the sign of the delta, or its reversal status, of the seed mean?

    ``d``: deltas with ``variant`` 'mean' or 'seed<k>'. Only pairs with a method of ``randomized`` (column ``method``) count.
    """
    keys = ["variant", *PAIR]
    x = join_pooled(d, keys).select(*keys, "subsystem_id", sgn("delta").alias("s"), (sgn("delta") * sgn("pooled_se") < 0).alias("r"))
    own = F.array("a", "b")
    pairs = x.select(*PAIR, F.explode(own).alias("method")).distinct().join(randomized.select("method").distinct(), "method", "left_semi").select(*PAIR).distinct()
    x = x.join(pairs, PAIR, "left_semi")
    m = x.filter("variant = 'mean'").select(*PAIR, "subsystem_id", F.col("s").alias("sm"), F.col("r").alias("rm"))
    s = x.filter("variant <> 'mean'").join(m, [*PAIR, "subsystem_id"])
    return s.groupBy(*PAIR, "subsystem_id").agg(F.count("*").alias("seeds"), F.bool_or(F.col("s") != F.col("sm")).alias("any_sign"), F.bool_or(F.col("r") != F.col("rm")).alias("any_status"))


def factor_summary(c: DataFrame, by: Sequence[str]) -> DataFrame:
    return c.groupBy(*by).agg(F.count("*").alias("comparisons"), F.count_if("sign_change").alias("sign_changes"),
                              F.avg(F.col("sign_change").cast("double")).alias("sign_share"), F.count_if("status_change").alias("status_changes"))


def flip_diagnostics(loso: DataFrame, diff: DataFrame, conc: DataFrame) -> DataFrame:
    """Mis-selected held-out rows next to the difficulty and the answer concentration of the subsystem."""
    return loso.filter("reversal").join(diff, "subsystem_id", "left").join(conc, "subsystem_id", "left")


def merge_alias(acc: DataFrame, alias: str, canon: str) -> DataFrame:
    """Fold rows of one method name into another; ``overlap`` marks subsystems that had both."""
    n = acc.withColumn("method", F.when(F.col("method") == alias, F.lit(canon)).otherwise(F.col("method")))
    return n.groupBy("family", "subsystem_id", "method").agg(F.max("acc").alias("acc"), (F.count("*") > 1).alias("overlap"))


def preset_recall(full: DataFrame, presets: DataFrame) -> DataFrame:
    """Inversions that some preset interval of the same pair contains with the same signs.

    The containment test is an extra predicate on an equi join over the pair and both signs.
    """
    k = ["a", "b"]
    f = full.withColumn("s1", sgn("delta_t1")).withColumn("s2", sgn("delta_t2"))
    p = presets.select(*k, F.col("t1").alias("p1"), F.col("t2").alias("p2"), sgn("delta_t1").alias("s1"), sgn("delta_t2").alias("s2"))
    hit = f.join(p, [*k, "s1", "s2"], "left").withColumn("in", (F.col("p1") <= F.col("t1")) & (F.col("p2") >= F.col("t2")))
    return hit.groupBy(*k, "t1", "t2").agg(F.coalesce(F.bool_or("in"), F.lit(False)).alias("captured"))


def reversal_summary(p: DataFrame, by: Sequence[str]) -> DataFrame:
    return p.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(F.col("n_rev_se") > 0).alias("with_reversal"),
                              F.count_if(F.col("n_rev_ci_se") > 0).alias("with_ci_reversal"), F.sum("n_rev_se").alias("reversals"))


def variant_pivot(v: DataFrame, variants: Sequence[str]) -> DataFrame:
    return v.groupBy(*PAIR).pivot("variant", list(variants)).agg(F.first("pooled_se"))
