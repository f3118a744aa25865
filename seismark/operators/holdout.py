"""Held-out validation of method choices. Inputs are result tables (pairs x subsystems), not cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions.series import row_index
from seismark.functions.stats import HELDOUT_EPS, sgn
from seismark.operators.compare import PAIR


def loso_pairs(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Leave one subsystem out per pair: pooled value of the rest, winner, reversal and regret.

    The rest is total minus own value, so no held-out copy of the table is made. A tie on the training side
    names no winner; ties of either side are counted apart.
    """
    w = W.partitionBy(*keys)
    nd = F.col("n") * F.col("delta")
    x = d.select(
        *keys, "subsystem_id", F.col("delta").alias("held_delta"), F.count("*").over(w).alias("k"),
        ((F.sum("delta").over(w) - F.col("delta")) / (F.count("*").over(w) - 1)).alias("mean"),
        ((F.sum(nd).over(w) - nd) / (F.sum("n").over(w) - F.col("n"))).alias("case_weighted"))
    long = x.filter("k >= 2").select(*keys, "subsystem_id", "held_delta", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("pooled_train")) for r in ("mean", "case_weighted")])).alias("r")).select("*", "r.*").drop("r")
    return _judge(long)


def _judge(x: DataFrame) -> DataFrame:
    s = sgn("pooled_train")
    wrong = s * sgn("held_delta") < 0
    return x.select("*", F.when(s > 0, F.col("a")).when(s < 0, F.col("b")).alias("winner"), wrong.alias("reversal"),
                    ((s == 0) | (sgn("held_delta") == 0)).alias("tie"), F.when(wrong, F.abs("held_delta")).otherwise(0.0).alias("regret"))


def loso_summary(l: DataFrame, by: Sequence[str] = ("family", "rule")) -> DataFrame:
    return l.groupBy(*by).agg(F.count("*").alias("decisions"), F.count_if("reversal").alias("reversals"), F.count_if("tie").alias("ties"),
                              F.avg("regret").alias("mean_regret"), F.max("regret").alias("max_regret"))


def loso_pooling(d: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Leave one out under four pooling rules. Each pair's deltas (one per subsystem) meet in one array."""
    g = d.groupBy(*keys).agg(F.collect_list(F.struct("subsystem_id", "n", "delta")).alias("s"))
    x = g.select(*keys, F.explode("s").alias("h"), "s")
    rest = F.filter("s", lambda v: v["subsystem_id"] != F.col("h.subsystem_id"))
    x = x.withColumn("rest", F.sort_array(F.transform(rest, lambda v: v["delta"]))).withColumn("restn", rest).filter(F.size("rest") > 0)
    m = F.size("rest")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    mid = (F.get("rest", F.floor((m - 1) / 2).cast("int")) + F.get("rest", F.floor(m / 2).cast("int"))) / 2
    cw = (F.aggregate("restn", F.lit(0.0), lambda acc, v: acc + v["n"] * v["delta"])
          / F.aggregate("restn", F.lit(0.0), lambda acc, v: acc + v["n"]))
    cut = F.slice("rest", 2, F.greatest(m - 2, F.lit(0)))
    rules = [("mean", total(F.col("rest")) / m), ("median", mid), ("case_weighted", cw), ("trimmed", F.try_divide(total(cut), F.size(cut)))]
    long = x.select(*keys, F.col("h.subsystem_id").alias("subsystem_id"), F.col("h.delta").alias("held_delta"),
                    F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("pooled_train")) for n, c in rules])).alias("r"))
    return _judge(long.select(*keys, "subsystem_id", "held_delta", "r.*"))


def complete_accuracy(acc: DataFrame, keys: Sequence[str] = ("family",)) -> DataFrame:
    """Accuracy rows of methods present on every subsystem of their family."""
    keys = list(keys)
    k = acc.groupBy(*keys).agg(F.count_distinct("subsystem_id").alias("_k"))
    ok = acc.groupBy(*keys, "method").agg(F.count("*").alias("_h")).join(k, keys).filter("_h = _k").select(*keys, "method")
    return acc.join(ok, [*keys, "method"], "left_semi")


def loso_family(acc: DataFrame, keys: Sequence[str] = ("family",)) -> DataFrame:
    """Within a family: the method that leads on the other subsystems, and its regret on the held-out one."""
    keys = list(keys)
    w = W.partitionBy(*keys, "method")
    x = complete_accuracy(acc, keys).withColumn("k", F.count("*").over(w)).filter("k >= 2")
    x = x.withColumn("train", (F.sum("acc").over(w) - F.col("acc")) / (F.col("k") - 1))
    best = F.max(F.round("acc", 9)).over(W.partitionBy(*keys, "subsystem_id"))
    x = x.withColumn("is_best", F.round("acc", 9) == best)
    lead = F.struct(-F.round("train", 9), F.col("method"))
    return x.groupBy(*keys, F.col("subsystem_id").alias("held_out")).agg(
        F.count("*").alias("n_methods"), F.min_by("method", lead).alias("winner"), F.min_by("acc", lead).alias("winner_acc"),
        F.max("acc").alias("best_acc"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("is_best"), F.col("method")))), ";").alias("best_methods"),
        (F.max("acc") - F.min_by("acc", lead)).alias("regret"))


def suite_holdout(d: DataFrame) -> DataFrame:
    """Per pair: choose on the systems of all other families (plain and case-weighted mean), judge on the held-out
    family as a whole and on each of its systems.

    ``d``: pair deltas per subsystem. Family sums are formed once; the training value is total minus own.
    """
    n = F.col("n")
    fam = d.groupBy("family", "a", "b").agg(
        F.count("*").alias("k"), F.sum("acc_a").alias("sa"), F.sum("acc_b").alias("sb"), F.sum(n * F.col("acc_a")).alias("wa"),
        F.sum(n * F.col("acc_b")).alias("wb"), F.sum("n").alias("n"), F.collect_list(F.struct("acc_a", "acc_b")).alias("sys"))
    w = W.partitionBy("a", "b")
    rest = lambda c: F.sum(c).over(w) - F.col(c)
    x = fam.withColumn("rk", rest("k")).filter("rk > 0")
    rules = F.array(
        F.struct(F.lit("macro").alias("rule"), ((rest("sa") - rest("sb")) / F.col("rk")).alias("train"), ((F.col("sa") - F.col("sb")) / F.col("k")).alias("held")),
        F.struct(F.lit("case_weighted").alias("rule"), ((rest("wa") - rest("wb")) / rest("n")).alias("train"), ((F.col("wa") - F.col("wb")) / F.col("n")).alias("held")))
    x = x.withColumn("r", rules).select("family", "a", "b", "sys", F.explode("r").alias("r")).select("family", "a", "b", "sys", "r.*")
    s = sgn("train")
    off = F.filter("sys", lambda e: s * sgn(e["acc_a"] - e["acc_b"]) < 0)
    lost = F.transform(off, lambda e: F.abs(e["acc_a"] - e["acc_b"]))
    return x.select(
        "family", "a", "b", "rule", "train", "held", F.when(s > 0, F.col("a")).when(s < 0, F.col("b")).otherwise("tie").alias("selected"),
        (s * sgn("held") < 0).alias("mis_selected"), F.when(s * sgn("held") < 0, F.abs("held")).otherwise(0.0).alias("family_regret"),
        F.size(off).alias("systems_missed"), (F.aggregate(lost, F.lit(0.0), lambda acc, v: acc + v) / F.size("sys")).alias("system_regret"))


def decisions(acc: DataFrame, held_ci: DataFrame, kind: str = "adjacent") -> DataFrame:
    """Recommendations learnt without one subsystem: leaderboard of the others, neighbours or all pairs.

    ``acc``: family, subsystem_id, method, acc, n for complete methods. The rows of one held-out subsystem are the
    training leaderboard (one entry per method) with that method's accuracy vector, which is short by nature.
    """
    vec = F.map_from_entries(F.collect_list(F.struct("subsystem_id", F.struct("acc", "n"))))
    per = acc.groupBy("family", "method").agg(vec.alias("v"))
    h = per.select("family", "method", "v", F.explode(F.map_keys("v")).alias("held_out"))
    train = F.array_sort(F.filter(F.map_entries("v"), lambda e: e["key"] != F.col("held_out")))
    h = h.withColumn("tr", train).filter(F.size("tr") >= 1)
    h = h.withColumn("se", F.aggregate("tr", F.lit(0.0), lambda s, e: s + e["value"]["acc"]) / F.size("tr"))
    w = W.partitionBy("family", "held_out").orderBy(F.round("se", 9).desc(), "method")
    h = h.withColumn("rank", F.row_number().over(w)).select("family", "held_out", F.struct("rank", "method", "se", "tr").alias("m"))
    board = h.groupBy("family", "held_out").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    take = F.lit(1) if kind == "adjacent" else F.size("ms")
    prs = F.flatten(F.transform("ms", lambda x, i: F.transform(F.slice("ms", i + 2, take), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    p = board.select("family", "held_out", F.explode(prs).alias("p"))
    dl = F.transform(F.arrays_zip(F.col("p.x.tr").alias("x"), F.col("p.y.tr").alias("y")),
                     lambda z: F.struct((z["x"]["value"]["acc"] - z["y"]["value"]["acc"]).alias("d"), z["x"]["value"]["n"].alias("n")))
    p = p.select("family", "held_out", F.col("p.x.method").alias("a"), F.col("p.y.method").alias("b"), F.col("p.x.rank").alias("rank_a"),
                 F.col("p.y.rank").alias("rank_b"), F.col("p.x.se").alias("se_a"), F.col("p.y.se").alias("se_b"), dl.alias("dl"))
    k = F.size("dl")
    mean = F.aggregate("dl", F.lit(0.0), lambda s, e: s + e["d"]) / k
    cw = F.aggregate("dl", F.lit(0.0), lambda s, e: s + e["d"] * e["n"]) / F.aggregate("dl", F.lit(0.0), lambda s, e: s + e["n"])
    p = p.withColumn("k_train", k).withColumn("m_se", mean).withColumn("m_cw", cw)
    ss = F.aggregate("dl", F.lit(0.0), lambda s, e: s + F.pow(e["d"] - F.col("m_se"), 2))
    p = p.withColumn("sd", F.sqrt(F.try_divide(ss, F.col("k_train") - 1)))
    n_if = lambda f: F.size(F.filter("dl", lambda e: f(e["d"])))
    p = p.select("family", "held_out", "a", "b", "rank_a", "rank_b", "se_a", "se_b", "k_train", "m_se", "m_cw", "sd",
                 F.when(F.col("sd") > HELDOUT_EPS, F.abs("m_se") / F.col("sd")).when(F.abs("m_se") > HELDOUT_EPS, F.lit(float("inf"))).otherwise(0.0).alias("t"),
                 n_if(lambda d: d > HELDOUT_EPS).alias("train_wins"), n_if(lambda d: F.abs(d) <= HELDOUT_EPS).alias("train_ties"),
                 n_if(lambda d: d < -HELDOUT_EPS).alias("train_losses"))
    return p.join(oriented(held_ci), ["family", "held_out", "a", "b"])


def oriented(ci: DataFrame) -> DataFrame:
    """Held-out deltas with intervals in both orientations of the pair."""
    base = ["family", F.col("subsystem_id").alias("held_out")]
    fwd = ci.select(*base, "a", "b", F.col("n").alias("n_held"), F.col("delta").alias("d_held"), F.col("lo").alias("lo_held"), F.col("hi").alias("hi_held"))
    rev = ci.select(*base, F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("n_held"), (-F.col("delta")).alias("d_held"),
                    (-F.col("hi")).alias("lo_held"), (-F.col("lo")).alias("hi_held"))
    return fwd.unionByName(rev)


def _outcome(direction: Column) -> Column:
    return (F.when(direction == 0, "none").when(F.abs("d_held") < HELDOUT_EPS, "tie")
            .when(direction * F.col("d_held") < 0, "error").otherwise("correct"))


def outcomes(d: DataFrame) -> DataFrame:
    """Direction and outcome of each decision under both pooled margins, and errors the interval confirms."""
    x = d
    for tag, m in (("rule", "m_se"), ("cw", "m_cw")):
        dr = sgn(m, HELDOUT_EPS)
        strict = ((dr > 0) & (F.col("hi_held") < 0)) | ((dr < 0) & (F.col("lo_held") > 0))
        x = x.withColumn(f"dir_{tag}", dr).withColumn(f"out_{tag}", _outcome(dr)).withColumn(f"strict_{tag}", strict)
    return x


def curve(o: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Coverage and errors when only decisions with t >= c are recommended; 'allwin' asks for a clean sweep."""
    pts = F.array(*[F.struct(F.lit(str(c)).alias("threshold"), F.lit(float(c)).alias("c")) for c in thresholds],
                  F.struct(F.lit("allwin").alias("threshold"), F.lit(None).cast("double").alias("c")))
    ok = (F.col("dir_rule") != 0) & F.when(F.col("c").isNull(), F.col("train_wins") == F.col("k_train")).otherwise(F.col("t") >= F.col("c"))
    x = o.withColumn("p", F.explode(pts)).select("*", "p.*").withColumn("ok", ok)
    err = F.col("out_rule") == "error"
    g = x.groupBy(*by, "threshold").agg(
        F.count("*").alias("n_decisions"), F.count_if("ok").alias("recommended"), F.count_if(F.col("ok") & err).alias("rule_errors"),
        F.count_if(F.col("ok") & (F.col("out_rule") == "tie")).alias("rule_ties"), F.count_if(F.col("ok") & F.col("strict_rule")).alias("rule_strict_errors"),
        F.count_if(~F.col("ok")).alias("flagged"), F.count_if(~F.col("ok") & err).alias("flagged_errors"),
        F.count_if(~F.col("ok") & (F.col("out_rule") == "tie")).alias("flagged_ties"), F.count_if(~F.col("ok") & F.col("strict_rule")).alias("flagged_strict_errors"),
        F.count_if(F.col("dir_rule") != 0).alias("n_directed"), F.count_if((F.col("dir_rule") != 0) & err).alias("all_errors"),
        F.count_if((F.col("dir_rule") != 0) & F.col("strict_rule")).alias("all_strict_errors"))
    return g.select("*", (F.col("recommended") / F.col("n_decisions")).alias("coverage"),
                    F.try_divide("rule_errors", "recommended").alias("rule_error_rate"),
                    F.try_divide("rule_strict_errors", "recommended").alias("rule_strict_error_rate"), F.try_divide("flagged_errors", "flagged").alias("flagged_error_rate"))


def budget_baseline(o: DataFrame, c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors, ties and strict errors of the r decisions with the largest absolute margin, r being what the rule recommends.

    Ranks run over the whole table, so they come from bands of the margin: counts of the bands before give a band its offset,
    and no task holds more than a band.
    """
    by = list(by)
    out = c.select(*by, "threshold", "recommended")
    budgets = out.select(*by, "recommended").distinct()
    for tag, name, m in (("cw", "pooled_only", "m_cw"), ("rule", "system_equal", "m_se")):
        size = F.round(F.abs(m), 9)
        directed = o.filter(F.col(f"dir_{tag}") != 0)
        # bands in falling order of the margin; margins lie in [0, 1] for scores in [0, 1], larger ones share band 0
        band = F.greatest(F.lit(0), 1024 - F.floor(size * 1024))
        ranked = row_index(directed, by, band, [size.desc(), F.col("family"), F.col("held_out"), F.col("a"), F.col("b")], "_i")
        marks = ranked.select(*by, "_i", *[v.cast("long").alias(k) for k, v in (("errors", F.col(f"out_{tag}") == "error"), ("ties", F.col(f"out_{tag}") == "tie"), ("strict_errors", F.col(f"strict_{tag}")))])
        cond = F.col("d._i") < F.col("r.recommended")
        for k in by:
            cond = cond & F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}"))
        # one row for each budget, that is for each threshold at most
        top = marks.alias("d").join(F.broadcast(budgets).alias("r"), cond).groupBy(*[F.col(f"r.{k}").alias(k) for k in by], F.col("r.recommended").alias("recommended")).agg(
            F.count("*").alias(f"{name}_n"), *[F.sum(f"d.{k}").alias(f"{name}_{k}") for k in ("errors", "ties", "strict_errors")])
        out = out.join(top, [*by, "recommended"], "left")
    return out.select(*by, "threshold", "recommended", *[F.coalesce(f"{n}_{k}", F.lit(0)).alias(f"{n}_{k}") for n in ("pooled_only", "system_equal") for k in ("n", "errors", "ties", "strict_errors")])


def _log_choose(n: Column, k: Column) -> Column:
    terms = F.transform(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")),
                        lambda i: F.ln((n - k + i).cast("double")) - F.ln(i.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def random_baseline(c: DataFrame) -> DataFrame:
    """Expected errors of a random choice of the same size, and P(at most as many errors) (hypergeometric)."""
    n, k, r, e = F.col("n_directed"), F.col("all_errors"), F.col("recommended"), F.col("rule_errors")
    lo = F.greatest(F.lit(0), r + k - n)
    total = _log_choose(n, r)
    probs = F.transform(F.when(lo <= e, F.sequence(lo.cast("long"), e.cast("long"))).otherwise(F.array().cast("array<bigint>")),
                        lambda i: F.exp(_log_choose(k, i) + _log_choose(n - k, r - i) - total))
    p = F.aggregate(probs, F.lit(0.0), lambda s, v: s + v)
    return c.select("*", F.try_divide(r * k, n).alias("random_expected_errors"), F.try_divide(k, n).alias("random_error_rate"),
                    F.try_divide(r * F.col("all_strict_errors"), n).alias("random_expected_strict_errors"),
                    F.when((n > 0) & (r > 0), F.least(F.lit(1.0), p)).alias("p_random_le_rule"))


def verdict(c: DataFrame, b: DataFrame, frozen: str = "1.0", by: Sequence[str] = ()) -> DataFrame:
    """Does the rule at the frozen threshold find the wrong recommendations, and does it beat the baselines?"""
    x = c.join(b.drop("recommended"), [*by, "threshold"]).filter(F.col("threshold") == frozen)
    some = F.col("recommended") > 0
    identification = some & (F.col("flagged") > 0) & (F.col("flagged_error_rate") > F.col("rule_error_rate"))
    rate = lambda c_: F.try_divide(F.col(c_), F.col("recommended"))
    reduction = (some & (F.col("rule_error_rate") < rate("pooled_only_errors")) & (F.col("rule_error_rate") < rate("system_equal_errors"))
                 & (F.col("rule_error_rate") < F.try_divide("all_errors", "n_directed")))
    x = x.withColumn("identification", F.coalesce(identification, F.lit(False))).withColumn("reduction", F.coalesce(reduction, F.lit(False)))
    return x.select(*by, "threshold", "recommended", "rule_errors", "pooled_only_errors", "system_equal_errors", "identification", "reduction",
                    F.when(F.col("reduction"), "reduction").when(F.col("identification"), "identification_only").otherwise("neither").alias("verdict"))


def cross_decisions(train: DataFrame, held: DataFrame, c: float = 1.0) -> DataFrame:
    """Neighbours of one release's leaderboard, judged on every subsystem of another release.

    Only methods that cover every subsystem of both releases are ranked; a pair without direction is never recommended.
    """
    def whole(x: DataFrame) -> DataFrame:
        all_of = x.agg(F.count_distinct("subsystem_id").alias("_all"))
        return x.groupBy("method").agg(F.count_distinct("subsystem_id").alias("_n")).crossJoin(F.broadcast(all_of)).filter("_n = _all").select("method")  # one row

    both = whole(train).join(whole(held), "method")
    train = train.join(both, "method", "left_semi")
    per = train.groupBy("method").agg(F.avg("acc").alias("se"), F.map_from_entries(F.collect_list(F.struct("subsystem_id", "acc"))).alias("v"))
    board = per.groupBy(F.lit(1).alias("_g")).agg(F.array_sort(F.collect_list(F.struct((-F.round("se", 9)).alias("o"), F.col("method"), F.col("se"), F.col("v")))
                                                              , _by_order).alias("ms"))
    p = board.select(F.posexplode(F.transform(F.slice("ms", 1, F.size("ms") - 1), lambda x, i: F.struct(x.alias("x"), F.get("ms", i + 1).alias("y")))).alias("i", "p"))
    ds = F.transform(F.map_keys("p.x.v"), lambda s: F.element_at(F.col("p.x.v"), s) - F.element_at(F.col("p.y.v"), s))
    p = p.select(F.col("p.x.method").alias("a"), F.col("p.y.method").alias("b"), (F.col("i") + 1).alias("rank_a"), (F.col("p.x.se") - F.col("p.y.se")).alias("m_se"), ds.alias("ds"))
    mean = F.aggregate("ds", F.lit(0.0), lambda s, e: s + e) / F.size("ds")
    p = p.withColumn("_m", mean).withColumn("sd", F.sqrt(F.try_divide(F.aggregate("ds", F.lit(0.0), lambda s, e: s + F.pow(e - F.col("_m"), 2)), F.size("ds") - 1)))
    ha = held.select(F.col("method").alias("a"), F.col("subsystem_id").alias("held_out"), F.col("acc").alias("xa"))
    hb = held.select(F.col("method").alias("b"), F.col("subsystem_id").alias("held_out"), F.col("acc").alias("xb"))
    j = p.select("a", "b", "rank_a", "m_se", "sd").join(ha, "a").join(hb, ["b", "held_out"])
    d = F.col("xa") - F.col("xb")
    return j.select("a", "b", "rank_a", "m_se", "sd", "held_out", d.alias("d_held"), (sgn("m_se") * sgn(d) < 0).alias("error"),
                    ((sgn("m_se") != 0) & (F.abs("m_se") >= c * F.col("sd"))).alias("recommended"))


def _by_order(x: Column, y: Column) -> Column:
    return (F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).when(x["method"] < y["method"], -1).when(x["method"] > y["method"], 1).otherwise(0))
