"""Scores of rankings and of free-text answers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions.stats import time_credit
from seismark.functions.text import parse_answers, parse_truth


def hit_rank(ranks: DataFrame, service: Column, truth: Column | None = None, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Rank of the true service among the distinct services of a ranking, in rank order; null when absent.

    ``ranks``: (keys..., pos, item, truth). Items fold to the first position of their service before anything else.
    """
    keys = list(keys)
    t = truth if truth is not None else F.col("truth")
    first = ranks.select(*keys, t.alias("truth"), service.alias("service"), "pos").groupBy(*keys, "truth", "service").agg(F.min("pos").alias("pos"))
    at = F.min(F.when(F.col("service") == F.col("truth"), F.col("pos"))).over(W.partitionBy(*keys, "truth"))
    x = first.withColumn("_at", at)
    r = F.count_if(F.col("pos") <= F.col("_at"))
    return x.groupBy(*keys, "truth").agg(F.count("*").alias("services"), F.when(F.max("_at").isNotNull(), r).alias("r"))


def acc_at_k(hits: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    return hits.select("*", *[F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0)).alias(f"acc{k}") for k in ks])


def avg_at(r: Column, k: int) -> Column:
    """Mean of the hits at 1..k for a first-hit rank."""
    return F.coalesce(F.greatest(F.lit(0), k - r + 1) / k, F.lit(0.0))


def avg_at_k(hits: DataFrame, k: int = 5) -> DataFrame:
    return hits.withColumn(f"avg{k}", avg_at(F.col("r"), k))


def mrr(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    inv = 1.0 / F.col("r")
    return hits.groupBy(*by).agg(F.count("*").alias("n"), F.count("r").alias("n_hit"), F.avg(F.coalesce(inv, F.lit(0.0))).alias("mrr"), F.avg(inv).alias("mrr_hit"))


def rank_summary(hits: DataFrame, fault: str = "fault") -> DataFrame:
    """Acc@1/3/5 and Avg@5 per fault and over all."""
    acc = lambda k: F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))).alias(f"acc{k}")
    g = hits.groupingSets([[fault], []], F.col(fault)).agg(F.count("*").alias("n"), acc(1), acc(3), acc(5), F.avg(avg_at(F.col("r"), 5)).alias("avg5"))
    return g.withColumn(fault, F.coalesce(fault, F.lit("_all")))


def rescore_top1(df: DataFrame, extractor, by: Sequence[str]) -> DataFrame:
    """Stored first answers scored again with another extractor. ``df``: (by..., top1, truth, acc1)."""
    new = (extractor(F.col("top1")) == F.col("truth")).cast("double")
    return df.withColumn("new", F.coalesce(new, F.lit(0.0))).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("acc1").alias("acc1_old"), F.avg("new").alias("acc1_new"), F.count_if(F.col("new") != F.col("acc1")).alias("changed"))


def score_two_rules(ranks: DataFrame, service: Column, k: int = 3) -> DataFrame:
    """The same list under two rules: the first item names the truth exactly; the truth is in the first k services."""
    exact = ranks.filter("pos = 1").select("case_id", (F.col("item") == F.col("truth")).cast("double").alias("exact1"))
    h = hit_rank(ranks, service)
    return h.join(exact, "case_id").select("case_id", "exact1", F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0)).alias("folded"))


# ---- answers ---------------------------------------------------------------------------------------------------

def seconds(text: Column) -> Column:
    """Epoch seconds of a date-time text, null when it is not one."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def best_assignment(n: Column, gain) -> Column:
    """Largest total gain of a one-to-one assignment of n predictions to n slots.

    Dynamic programme over sets of used predictions: 2^n states instead of n! orders, for a few slots (``SET_SLOTS``).
    """
    full = F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), n).cast("int") - 1
    masks = F.sequence(F.lit(0), full)
    start = F.transform(masks, lambda m: F.when(m == 0, F.lit(0.0)).otherwise(F.lit(-1.0)))

    def add_slot(dp, slot):
        def best(m):
            used = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.getbit(m, j) == 1)
            prev = F.transform(used, lambda j: F.when(F.get(dp, m - F.pow(F.lit(2), j).cast("int")) >= 0, F.get(dp, m - F.pow(F.lit(2), j).cast("int")) + gain(slot, j)).otherwise(F.lit(-1.0)))
            return F.when(F.bit_count(m) == slot + 1, F.coalesce(F.array_max(prev), F.lit(-1.0))).otherwise(F.lit(-1.0))
        return F.transform(masks, best)

    return F.get(F.aggregate(F.sequence(F.lit(0), n - 1), start, add_slot), full)


# slots up to which the assignment is a dynamic programme over 2^n sets; beyond, shortest augmenting paths in n^3 steps
SET_SLOTS = 8


def large_assignment():
    """UDF: largest total gain of a one-to-one assignment for a square matrix of gains (rows: slots), null for null.

    Every slot is added along the shortest augmenting path under reduced costs, so potentials stay feasible and the result is exact.
    """
    @F.pandas_udf("double")
    def best(gains: pd.Series) -> pd.Series:
        import numpy as np

        def solve(m):
            cost = -np.stack([np.asarray(r, dtype=float) for r in m])
            n = len(cost)
            owner = np.full(n, -1)  # slot that a prediction is given to
            of_slot, of_pred = np.zeros(n), np.zeros(n)
            for slot in range(n):
                dist, before, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, dtype=bool)
                row, last, reach = slot, -1, 0.0
                while True:
                    step = reach + cost[row] - of_slot[row] - of_pred
                    closer = ~done & (step < dist)
                    dist[closer], before[closer] = step[closer], last
                    last = int(np.argmin(np.where(done, np.inf, dist)))
                    reach, done[last] = dist[last], True
                    if owner[last] < 0:
                        break
                    row = owner[last]
                passed = done & (owner >= 0)
                of_slot[slot] += reach
                of_slot[owner[passed]] += reach - dist[passed]
                of_pred[passed] -= reach - dist[passed]
                while last >= 0:  # hand the predictions of the path on, back to the new slot
                    owner[last] = owner[before[last]] if before[last] >= 0 else slot
                    last = before[last]
            return float(-cost[owner, np.arange(n)].sum())

        return gains.map(lambda m: None if m is None else solve(m)).astype("float64")

    return best


def parse_slots(df: DataFrame) -> DataFrame:
    """Answers and scoring points parsed once: predictions ``_p``, truths ``_t``, truth times ``_ts``, slots ``_n``."""
    x = df.withColumn("_p", parse_answers("prediction")).withColumn("_t", parse_truth("scoring_points"))
    x = x.withColumn("_p", F.transform("_p", lambda p: F.struct(p["component"].alias("c"), p["reason"].alias("r"), seconds(p["dt"]).alias("s"))))
    x = x.withColumn("_ts", F.transform("_t.times", seconds))
    nc, nr, nt = F.size("_t.components"), F.size("_t.reasons"), F.size("_t.times")
    return x.withColumn("_n", F.greatest(nc, nr, nt)).withColumn("criteria", nc + nr + nt)


PARSED = ["_p", "_t", "_ts", "_n"]


def _best(x: DataFrame, time_gain) -> DataFrame:
    """Adds ``best``: total gain of the best assignment, 0 where the numbers of slots differ."""
    n = F.col("_n")
    nc, nr, nt = F.size("_t.components"), F.size("_t.reasons"), F.size("_t.times")

    def gain(slot, j):
        p = F.get("_p", j)
        comp = F.when((nc == n) & (F.get("_t.components", slot) == p["c"]), 1.0).otherwise(0.0)
        reason = F.when((nr == n) & (F.get("_t.reasons", slot) == p["r"]), 1.0).otherwise(0.0)
        time = F.when(nt == n, F.coalesce(time_gain(F.abs(F.get("_ts", slot) - p["s"])), F.lit(0.0))).otherwise(0.0)
        return comp + reason + time

    return _assigned(x, n, (n > 0) & (F.size("_p") == n), gain)


def _assigned(x: DataFrame, n: Column, fits: Column, gain) -> DataFrame:
    at = F.sequence(F.lit(0), n - 1)
    gains = F.when(fits & (n > SET_SLOTS), F.transform(at, lambda i: F.transform(at, lambda j: gain(i, j))))
    # exploding the one matrix of a row keeps its lambdas out of the UDF's argument, where they are not evaluated
    x = x.select("*", F.explode(F.array(gains)).alias("_gains")).withColumn("_far", large_assignment()("_gains"))
    best = F.when(~fits, 0.0).when(n == 1, gain(F.lit(0), F.lit(0))).when(n > SET_SLOTS, F.col("_far")).otherwise(best_assignment(n, gain))
    return x.withColumn("best", best).drop("_gains", "_far")


def answer_profiles(df: DataFrame, predictions: dict[str, Column]) -> DataFrame:
    """All that the scores of a case depend on besides the tolerance, as ``profiles``, an array of (method, criteria, m).

    m[slot][prediction] holds the matched components and reasons g and the time gap d in seconds; null where the numbers of slots
    differ. Cases with equal profiles have equal scores, so they are scored once. ``predictions``: a column for each method.
    """
    x = df.withColumn("_t", parse_truth("scoring_points"))
    x = x.withColumn("_ts", F.transform("_t.times", seconds))
    nc, nr, nt = F.size("_t.components"), F.size("_t.reasons"), F.size("_t.times")
    x = x.withColumn("_n", F.greatest(nc, nr, nt))
    n, at = F.col("_n"), F.sequence(F.lit(0), F.col("_n") - 1)
    for i, prediction in enumerate(predictions.values()):
        x = x.withColumn("_p", F.transform(parse_answers(prediction), lambda p: F.struct(p["component"].alias("c"), p["reason"].alias("r"), seconds(p["dt"]).alias("s"))))

        def cell(slot, j):
            p = F.get("_p", j)
            comp = F.when((nc == n) & (F.get("_t.components", slot) == p["c"]), 1).otherwise(0)
            reason = F.when((nr == n) & (F.get("_t.reasons", slot) == p["r"]), 1).otherwise(0)
            return F.struct((comp + reason).alias("g"), F.when(nt == n, F.abs(F.get("_ts", slot) - p["s"])).alias("d"))

        m = F.when((n > 0) & (F.size("_p") == n), F.transform(at, lambda slot: F.transform(at, lambda j: cell(slot, j))))  # noqa: B023
        x = x.withColumn(f"_m{i}", m)
    each = [F.struct(F.lit(k).alias("method"), (nc + nr + nt).alias("criteria"), F.col(f"_m{i}").alias("m")) for i, k in enumerate(predictions)]
    return x.select(*df.columns, F.array(*each).alias("profiles"))


def score_profiles(df: DataFrame, tolerance: Column) -> DataFrame:
    """``score_answer`` of a column ``profile`` of ``answer_profiles``."""
    def gain(slot, j):
        c = F.get(F.get("profile.m", slot), j)
        return c["g"] + F.when(c["d"] <= tolerance, 1.0).otherwise(0.0)

    x = _assigned(df, F.coalesce(F.size("profile.m"), F.lit(0)), F.col("profile.m").isNotNull(), gain)
    criteria = F.col("profile.criteria")
    return x.withColumn("score", F.when(criteria > 0, F.bround(F.col("best") / criteria, 2)).otherwise(0.0)).drop("best", "profile")


def score_answer(df: DataFrame, tolerance: Column | int = 60) -> DataFrame:
    """Share of matched components, reasons and times (within the tolerance), rounded half-even to two digits.

    ``df`` may come from ``parse_slots`` already, so that several tolerances share one parse.
    """
    tol = F.lit(tolerance) if isinstance(tolerance, int) else tolerance
    x = df if "_p" in df.columns else parse_slots(df)
    x = _best(x, lambda d: F.when(d <= tol, 1.0).otherwise(0.0))
    return x.withColumn("score", F.when(F.col("criteria") > 0, F.bround(F.col("best") / F.col("criteria"), 2)).otherwise(0.0)).drop("best", "criteria", *PARSED)


def with_tolerances(df: DataFrame, tolerances: Sequence[int]) -> DataFrame:
    return df.withColumn("tol", F.explode(F.array(*[F.lit(t) for t in tolerances])))


def score_sweep(df: DataFrame, tolerances: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    s = score_answer(with_tolerances(parse_slots(df), tolerances), F.col("tol"))
    return s.groupBy(*by, "tol").agg(F.count("*").alias("n"), F.count_if(F.col("score") == 1).alias("correct"),
                                     F.count_if((F.col("score") > 0) & (F.col("score") < 1)).alias("partial"), F.avg("score").alias("mean_score"))


def score_continuous(df: DataFrame, kind: str, p: float) -> DataFrame:
    x = _best(parse_slots(df), lambda d: time_credit(d.cast("double"), kind, p))
    return x.withColumn("score", F.when(F.col("criteria") > 0, F.col("best") / F.col("criteria")).otherwise(0.0)).drop("best", "criteria", *PARSED)


def post_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Acc@1 over cases that have a labelled component (any of them counts), and the most frequent answer.

    ``df``: (by..., answer, truths array). Answers are counted before the modal one is chosen.
    """
    by = list(by)
    lab = F.size("truths") > 0
    hit = F.coalesce(F.array_contains("truths", F.col("answer")), F.lit(False))
    c = df.groupBy(*by, "answer").agg(F.count("*").alias("c"), F.count_if(lab).alias("l"), F.count_if(lab & hit).alias("h"))
    top = F.struct(-F.col("c"), F.col("answer"))
    return c.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("l").alias("labelled"), (F.sum("h") / F.sum("l")).alias("acc1"),
                              F.min_by("answer", top).alias("modal_answer"), (F.max("c") / F.sum("c")).alias("modal_share"))


def first_times(df: DataFrame) -> DataFrame:
    """First predicted and first true time of parsed answers (``parse_slots``) as epoch seconds; null where there is none."""
    return df.select("*", F.get("_p", F.lit(0))["s"].alias("pred_time"), F.get("_ts", F.lit(0)).alias("true_time"))


def flips(scores: DataFrame, a: str, b: str, t1: int, t2: int) -> DataFrame:
    """Cases in which A beats B at tolerance t1 and loses at t2, with both differences and their magnitude.

    ``scores``: (system, case_id, method, tol, score). One conditional aggregation replaces four self joins.
    """
    x = scores.filter(F.col("method").isin(a, b) & F.col("tol").isin(t1, t2))
    at = lambda m, t: F.max(F.when((F.col("method") == m) & (F.col("tol") == t), F.col("score")))
    g = x.groupBy("system", "case_id").agg((at(a, t1) - at(b, t1)).alias("d1"), (at(a, t2) - at(b, t2)).alias("d2"))
    return g.filter((F.col("d1") > 1e-9) & (F.col("d2") < -1e-9)).withColumn("magnitude", F.abs("d1") + F.abs("d2"))


def largest_flips(flipped: DataFrame, k: int) -> DataFrame:
    """The k largest changes per system."""
    from seismark.functions.series import top_n

    return top_n(flipped, ["system"], [F.round("magnitude", 9).desc(), F.col("case_id")], k, "case_id")


def flip_times(top: DataFrame, a: str, b: str, times: DataFrame) -> DataFrame:
    """Adds the true time, what both methods predicted, and how far off they are (case_id, method, pred_time, true_time in seconds)."""
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    t = times.join(top.select("case_id").distinct(), "case_id", "left_semi")
    t = t.groupBy("case_id").agg(F.max("true_time").alias("true_time"), of(a, "pred_time").alias("time_a"), of(b, "pred_time").alias("time_b"))
    return top.join(t, "case_id", "left").select("*", *[F.abs(F.col(f"time_{m}") - F.col("true_time")).alias(f"gap_{m}") for m in ("a", "b")])


def flip_cases(scores: DataFrame, a: str, b: str, t1: int, t2: int, k: int, times: DataFrame | None = None) -> DataFrame:
    """Cases in which A beats B at one tolerance and loses at the other; the k largest changes per system, with ``times`` their times."""
    top = largest_flips(flips(scores, a, b, t1, t2), k)
    return top if times is None else flip_times(top, a, b, times)


def to_case_schema(scores: DataFrame, tol: int, family: str) -> DataFrame:
    """Rows of one tolerance in the common per-case layout."""
    sub = F.concat_ws("::", F.lit(family), "system")
    return scores.filter(F.col("tol") == tol).select(
        F.lit(family).alias("family"), sub.alias("subsystem_id"), F.concat(sub, F.lit("|"), F.col("case_id"), F.lit("#0")).alias("case_id"),
        "method", F.lit(None).cast("int").alias("seed"), "score", F.when(F.col("score") == 1, 1.0).otherwise(0.0).alias("score_strict"))
