"""Statistical detectors and rankers on long telemetry (case_id, component, metric_id, ts, t0, value).

Per-metric statistics need one aggregation: the largest deviation from the baseline mean follows from the
extremes of the event side, so readings are scanned once and never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions.moments import numbered_items, pair_correlations
from seismark.functions.series import exact_percentiles, previous
from seismark.session import checkpoint

METRIC = ["case_id", "component", "metric_id"]

# fixed values: detector thresholds
Z_MIN, PCT_MIN, BASE_MIN, SD_MIN = 3.0, 5.0, 10, 1e-8


def before_event() -> Column:
    return F.col("ts") < F.col("t0")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def side_stats(df: DataFrame, keys: Sequence[str] = METRIC) -> DataFrame:
    """Baseline count, mean and both standard deviations, and the event side's count and extremes."""
    v = finite(F.col("value"))
    b, a = F.when(before_event(), v), F.when(~before_event(), v)
    return df.groupBy(*keys).agg(
        F.count(b).alias("n_base"), F.avg(b).alias("mu"), F.stddev_pop(b).alias("sd_pop"), F.stddev_samp(b).alias("sd_samp"),
        F.count(a).alias("n_event"), F.max(a).alias("w_max"), F.min(a).alias("w_min"), F.count_if(F.abs("value") == float("inf")).alias("n_inf"))


def max_abs_z(df: DataFrame) -> DataFrame:
    """Largest |z| of the event side against the baseline (population SD); 0 where it is not defined or not finite."""
    s = side_stats(df)
    far = F.greatest(F.abs(F.col("w_max") - F.col("mu")), F.abs(F.col("w_min") - F.col("mu")))
    return s.select(*METRIC, F.coalesce(F.when((F.col("sd_pop") > 0) & (F.col("n_inf") == 0), far / F.col("sd_pop")), F.lit(0.0)).alias("z"))


def _down(c: str) -> Column:
    return F.round(c, 9).desc()


def rank_metrics(scores: DataFrame, score: str = "z") -> DataFrame:
    """Rank by score, then name. The window holds the metrics of one case, not its readings."""
    w = W.partitionBy("case_id").orderBy(_down(score), "metric_id")
    return scores.withColumn("rank", F.row_number().over(w))


def alert_count(scores: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Services by number of alerting metrics, then name; metrics inside a service by score, then name."""
    alerts = F.count_if(F.col("z") > threshold).over(W.partitionBy("case_id", "component"))
    x = scores.withColumn("alerts", alerts)
    w = W.partitionBy("case_id").orderBy(F.desc("alerts"), "component", _down("z"), "metric_id")
    return x.withColumn("rank", F.row_number().over(w))


def robust_scores(df: DataFrame, absolute: bool = False, constant: bool = False) -> DataFrame:
    """(v - median) / IQR against the baseline: signed maximum, or the largest absolute value.

    Short sides drop out, constant baselines too unless ``constant``; an IQR of zero divides by one.
    """
    q = exact_percentiles(df.filter(before_event()), METRIC, "value", [0.25, 0.5, 0.75], ["q1", "q2", "q3"])
    s = side_stats(df).filter((F.lit(constant) | (F.col("sd_samp") > SD_MIN)) & (F.col("n_base") >= 5) & (F.col("n_event") >= 2))
    iqr = F.col("q3") - F.col("q1")
    scale = F.when(iqr > 1e-12, iqr).otherwise(1.0)
    top = F.col("w_max") - F.col("q2")
    if absolute:
        top = F.greatest(F.abs(top), F.abs(F.col("w_min") - F.col("q2")))
    return s.join(q, METRIC).select(*METRIC, (top / scale).alias("z"))


def metric_anomalies(df: DataFrame, z: float = Z_MIN, pct: float = PCT_MIN, keys: Sequence[str] = METRIC) -> DataFrame:
    """Metrics whose farther extreme passes both thresholds (sample SD, at least ten baseline values)."""
    return threshold_stats(side_stats(df, keys), keys).filter((F.col("z") >= z) & (F.abs("pct") >= pct))


def threshold_stats(s: DataFrame, keys: Sequence[str] = METRIC) -> DataFrame:
    s = s.filter((F.col("n_base") >= BASE_MIN) & (F.col("n_event") >= 1) & (F.col("sd_samp") >= SD_MIN))
    up, down = F.abs(F.col("w_max") - F.col("mu")), F.abs(F.col("w_min") - F.col("mu"))
    peak = F.when(up >= down, F.col("w_max")).otherwise(F.col("w_min"))
    x = s.withColumn("peak", peak)
    return x.select(*keys, (F.abs(F.col("peak") - F.col("mu")) / F.col("sd_samp")).alias("z"),
                    ((F.col("peak") - F.col("mu")) / (F.abs("mu") + 1e-8) * 100).alias("pct"))


def detect_components(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("case_id", "component").agg(
        F.count("*").alias("n_anomalies"), F.max("z").alias("max_z"), F.max(F.abs("pct")).alias("max_pct"))


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy(*order)))


def rank_threshold(comps: DataFrame) -> DataFrame:
    return _ranked(comps, _down("max_pct"), _down("max_z"), "component")


def rank_by_z(comps: DataFrame, candidates: DataFrame) -> DataFrame:
    """By largest z among the candidate names (column ``component``)."""
    return _ranked(comps.join(candidates, "component", "left_semi"), _down("max_z"), "component")


def pick_diverse(ranked: DataFrame, family: Column, n: int) -> DataFrame:
    """First the best component of each family, then the rest, up to n per case. A single pick is the best one."""
    x = ranked.withColumn("family_key", family)
    first = F.row_number().over(W.partitionBy("case_id", "family_key").orderBy("rank")) == 1
    x = x.withColumn("family_first", first)
    w = W.partitionBy("case_id").orderBy(F.desc("family_first"), "rank")
    return x.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)


def sibling_by_onset(picks: DataFrame, comps: DataFrame, onsets: DataFrame, family: Column) -> DataFrame:
    """Re-rank picks inside their replica family: the j-th pick of a family becomes its member with the j-th
    earliest onset (no onset last, then larger pct), as long as two or more members are still free."""
    mem = comps.withColumn("family_key", family).join(onsets, ["case_id", "component"], "left")
    fam = W.partitionBy("case_id", "family_key")
    mem = mem.select("case_id", "family_key", F.col("component").alias("member"), F.count("*").over(fam).alias("members"),
                     F.row_number().over(fam.orderBy(F.col("onset").asc_nulls_last(), _down("max_pct"), "component")).alias("nth"))
    p = picks.select("case_id", "pick", F.col("component").alias("picked"), "family_key",
                     F.row_number().over(fam.orderBy("pick")).alias("nth"))
    j = p.join(mem, ["case_id", "family_key", "nth"], "left")
    free = F.col("members") - F.col("nth") >= 1
    return j.select("case_id", "pick", "picked", "family_key", F.when(free, F.col("member")).otherwise(F.col("picked")).alias("chosen"))


# ---- onsets on a regular grid: (case_id, metric_id, step, value, at) with ``at`` the event's step ---------------

SERIES = ["case_id", "metric_id"]


def _window_stats(grid: DataFrame, lookbacks: Sequence[int], base: int, min_base: int) -> DataFrame:
    """First lookback whose baseline (``base`` steps before it) has enough values, with that baseline's moments."""
    lb = F.explode(F.array(*[F.struct(F.lit(i).alias("pri"), F.lit(v).alias("lb")) for i, v in enumerate(lookbacks)]))
    x = grid.select(*SERIES, "step", "value", "at", lb.alias("l")).select("*", "l.*")
    start = F.col("at") - F.col("lb")
    x = x.filter((F.col("step") >= start - base) & (F.col("step") < start))
    s = x.groupBy(*SERIES, "at", "pri", "lb").agg(F.count("value").alias("n"), F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    s = s.filter(F.col("n") >= min_base)
    return s.groupBy(*SERIES, "at").agg(F.min_by(F.struct("lb", "mu", "sd"), "pri").alias("s")).select(*SERIES, "at", "s.*")


def _smoothed(x: DataFrame, n: int = 3) -> DataFrame:
    """Rolling mean inside a window that is already bounded in steps."""
    w = W.partitionBy(*SERIES).orderBy("step").rowsBetween(-(n - 1), 0)
    return x.withColumn("sm", F.avg("value").over(w))


def _deviation(v: str) -> tuple[Column, Column]:
    z = F.abs(F.col(v) - F.col("mu")) / F.col("sd")
    pct = F.abs((F.col(v) - F.col("mu")) / (F.abs("mu") + 1e-8) * 100)
    return z, pct


def onset_first_cross(grid: DataFrame, lookback: int = 60, base: int = 60, min_base: int = 10) -> DataFrame:
    """Earliest step whose smoothed value is off by z > 3 and 5 percent, with a shrinking lookback."""
    tries = [lookback, 60, 30, 15]
    s = _window_stats(grid, tries, base, min_base).filter(F.col("sd") >= SD_MIN)
    x = grid.drop("at").join(s, SERIES).filter((F.col("step") >= F.col("at") - F.col("lb")) & (F.col("step") < F.col("at") + 2))
    z, pct = _deviation("sm")
    return _smoothed(x).filter((z > 3.0) & (pct > 5.0)).groupBy(*SERIES).agg(F.min("step").alias("onset"))


def onset_max_diff(grid: DataFrame, fallback: DataFrame, window: int = 60, step_minutes: float = 1.0) -> DataFrame:
    """Step of the largest change of the smoothed series around the event; the first crossing where that is weak.

    Guards: 20 rows, the change is at least three baseline SDs of changes, and not over 30 minutes early.
    """
    x = grid.filter((F.col("step") >= F.col("at") - window) & (F.col("step") < F.col("at") + 5))
    w = W.partitionBy(*SERIES).orderBy("step")
    x = _smoothed(x).withColumn("diff", F.abs(F.col("sm") - F.lag("sm").over(w))).withColumn("pos", F.row_number().over(w) - 1)
    x = x.withColumn("first", F.min("step").over(W.partitionBy(*SERIES)))
    half = F.greatest(F.lit(15), F.floor((F.col("at") - F.col("first")) / 2))
    pre = F.when(F.col("pos") < half, F.col("diff"))
    s = x.groupBy(*SERIES, "at").agg(
        F.count("*").alias("rows"), F.count(pre).alias("n_pre"), F.stddev_samp(pre).alias("sd_pre"), F.stddev_samp("diff").alias("sd_all"),
        F.max("diff").alias("top"), F.min_by("step", F.when(F.col("diff").isNotNull(), F.struct(-F.round("diff", 9), F.col("step")))).alias("where"))
    base = F.when((F.col("n_pre") >= 5) & (F.col("sd_pre") >= SD_MIN), F.col("sd_pre")).otherwise(F.col("sd_all"))
    ok = ((F.col("rows") >= 20) & (base >= SD_MIN) & (F.col("top") >= 3 * base) & ((F.col("at") - F.col("where")) * step_minutes <= 30))
    s = s.select(*SERIES, F.when(ok, F.col("where")).alias("by_diff"))
    j = s.join(fallback, SERIES, "full")
    return j.select(*SERIES, F.coalesce("by_diff", "onset").alias("onset"), F.col("by_diff").isNotNull().alias("from_diff")).filter("onset is not null")


def peak_time(grid: DataFrame, window: int = 30, base: int = 240, min_base: int = 10) -> DataFrame:
    """Step of the largest deviation from the baseline mean within the window around the event; first on ties."""
    ws = F.col("at") - window
    b = F.when((F.col("step") >= ws - base) & (F.col("step") < ws), F.col("value"))
    near = grid.filter((F.col("step") >= ws - base) & (F.col("step") <= F.col("at") + window))
    s = near.groupBy(*SERIES).agg(F.count(b).alias("n"), F.avg(b).alias("mu")).filter(F.col("n") >= min_base)
    x = grid.filter((F.col("step") >= ws) & (F.col("step") <= F.col("at") + window) & F.col("value").isNotNull()).join(s, SERIES)
    dev = F.round(F.abs(F.col("value") - F.col("mu")), 9)
    return x.groupBy(*SERIES).agg(F.min_by("step", F.struct(-dev, F.col("step"))).alias("peak"), F.max(dev).alias("deviation"))


def onset_strict(grid: DataFrame, lookback: int = 30, base: int = 120, min_base: int = 20) -> DataFrame:
    """First step with z > 5 and over 20 percent; else the step of the largest z if that exceeds 3."""
    s = _window_stats(grid, [lookback], base, min_base).filter(F.col("sd") >= SD_MIN)
    x = grid.drop("at").join(s, SERIES).filter((F.col("step") >= F.col("at") - F.col("lb")) & (F.col("step") < F.col("at") + 2) & F.col("value").isNotNull())
    z, pct = _deviation("value")
    g = x.withColumn("z", z).groupBy(*SERIES).agg(
        F.min(F.when((F.col("z") > 5.0) & (pct > 20.0), F.col("step"))).alias("hard"), F.max("z").alias("top"),
        F.min_by("step", F.struct(-F.round("z", 9), F.col("step"))).alias("soft"))
    return g.select(*SERIES, F.coalesce("hard", F.when(F.col("top") > 3.0, F.col("soft"))).alias("onset"), F.col("hard").isNotNull().alias("strict")).filter("onset is not null")


# ---- component series and graphs -----------------------------------------------------------------------------

def component_series(grid: DataFrame) -> DataFrame:
    """Per component and step the largest |z| over its metrics (population SD, five or more values).

    ``grid``: (case_id, component, metric_id, step, value).
    """
    s = grid.groupBy(*METRIC).agg(F.count("value").alias("n"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    s = s.filter((F.col("n") >= 5) & (F.col("sd") >= SD_MIN))
    return grid.join(s, METRIC).groupBy("case_id", "component", "step").agg(F.max(F.abs(F.col("value") - F.col("mu")) / F.col("sd")).alias("z"))


def lagcorr_graph(series: DataFrame, threshold: float = 0.35, margin: float = 0.05) -> DataFrame:
    """Edges u -> v where corr(u[t-1], v[t]) reaches the threshold and beats the reverse lag by the margin.

    Pairs of components meet in blocks (``functions.moments``), so no row per pair and step is made. A case of fewer than five steps
    or two components has no graph.
    """
    steps = series.select("case_id", "step").distinct().groupBy("case_id").agg(F.count("*").alias("_s")).filter("_s >= 5")
    parts = series.select("case_id", "component").distinct().groupBy("case_id").agg(F.count("*").alias("_c")).filter("_c >= 2")
    series = series.join(steps.join(parts, "case_id").select("case_id"), "case_id", "left_semi")
    x = previous(series, ["case_id", "component"], F.floor(F.col("step") / 64), ["step"], "z", "_p", k=1)
    x = x.withColumn("zp", F.get("_p", F.lit(0))).select("case_id", "component", "step", "z", "zp")
    c = pair_correlations(x, ["case_id"], "component", "step", "zp", "z", SD_MIN, numbered_items(series, ["case_id"], "component", "z", "z"))
    way = lambda src, dst, c, rev: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(c).alias("weight"), F.coalesce(rev, F.lit(0.0)).alias("rev"))
    e = c.select("case_id", F.explode(F.array(way("u", "v", "uv", "vu"), way("v", "u", "vu", "uv"))).alias("b")).select("case_id", "b.*")
    return e.filter((F.round("weight", 9) >= threshold) & (F.round(F.col("weight") - F.col("rev"), 9) >= margin)).drop("rev")


def ancestors(edges: DataFrame, depth: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(node, anc) for every ancestor within ``depth`` edges, without the node itself."""
    keys = list(keys)
    step = edges.select(*keys, F.col("src").alias("anc"), F.col("dst").alias("node")).distinct()
    up = edges.select(*keys, F.col("src").alias("_up"), F.col("dst").alias("anc")).distinct()
    out = step
    for _ in range(depth - 1):
        step = step.join(up, [*keys, "anc"]).select(*keys, F.col("_up").alias("anc"), "node").distinct()
        out = out.unionByName(step)
    return out.filter("anc <> node").select(*keys, "node", "anc").distinct()


def rank_causal(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Anomalies divided by one plus the number of anomalous ancestors; plain threshold rank in cases without edges."""
    edges = checkpoint(edges)  # read several times below
    anc = ancestors(edges, 3, ["case_id"])
    c = comps.select("case_id", F.col("component").alias("anc"))
    up = anc.join(c, ["case_id", "anc"], "left_semi").groupBy("case_id", F.col("node").alias("component")).agg(F.count("*").alias("upstream"))
    x = comps.join(up, ["case_id", "component"], "left").withColumn("upstream", F.coalesce("upstream", F.lit(0)))
    graphs = edges.select("case_id").distinct().withColumn("has_graph", F.lit(True))
    x = x.join(graphs, "case_id", "left").withColumn("has_graph", F.coalesce("has_graph", F.lit(False)) & (F.count("*").over(W.partitionBy("case_id")) >= 2))
    x = x.withColumn("root_score", F.when(F.col("has_graph"), F.col("n_anomalies") / (1.0 + F.col("upstream"))).otherwise(0.0))
    return _ranked(x, _down("root_score"), _down("max_pct"), _down("max_z"), "component")


# fixed values: change in percent from which an anomalous ancestor counts as strong
STRONG_PCT = 5.0


def rank_causal_metric(anomalies: DataFrame, edges: DataFrame, strong_pct: float = STRONG_PCT) -> DataFrame:
    """Component score: sum over its anomalous metrics of 1 / (1 + strongly anomalous ancestors of the metric)."""
    edges = checkpoint(edges)
    anc = ancestors(edges, 3, ["case_id"])
    strong = anomalies.filter(F.abs("pct") > strong_pct).select("case_id", F.col("metric_id").alias("anc"))
    up = anc.join(strong, ["case_id", "anc"], "left_semi").groupBy("case_id", F.col("node").alias("metric_id")).agg(F.count("*").alias("up"))
    x = anomalies.join(up, ["case_id", "metric_id"], "left").withColumn("w", 1.0 / (1.0 + F.coalesce("up", F.lit(0))))
    g = x.groupBy("case_id", "component").agg(F.sum("w").alias("root_score"), F.max(F.abs("pct")).alias("max_pct"))
    return _ranked(g, _down("root_score"), _down("max_pct"), "component")


def graph_protocol(edges: DataFrame, protocol: str) -> DataFrame:
    if protocol == "none":
        return edges.limit(0)
    if protocol in ("original", "callgraph-original"):
        return edges
    if protocol in ("reverse", "callgraph-reverse"):
        return edges.select(*[c for c in edges.columns if c not in ("src", "dst")], F.col("dst").alias("src"), F.col("src").alias("dst"))
    raise ValueError(f"unknown graph protocol {protocol}")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    return checkpoint(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())


def distances_from(both: DataFrame, sources: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(node, other, dist): shortest-path lengths from the nodes of ``sources``, a join per hop, lineage cut after each.

    With ``wanted`` (node, other) a node's search ends when all its wanted nodes are found.
    """
    seen = checkpoint(sources.select("node").distinct().select("node", F.col("node").alias("other"), F.lit(0).alias("dist")))
    front = seen
    for hop in count(1):
        if wanted is not None:
            open_ = wanted.join(seen, ["node", "other"], "left_anti").select("node").distinct()
            front = front.join(open_, "node", "left_semi")
        nxt = front.join(both, front["other"] == both["src"]).select("node", F.col("dst").alias("other")).distinct()
        front = checkpoint(nxt.join(seen, ["node", "other"], "left_anti").withColumn("dist", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = checkpoint(seen.unionByName(front))


def diameter(both: DataFrame, at_once: int = 16) -> int:
    """The longest shortest path, from a few searches: a search from v with eccentricity e bounds every node u it reaches,
    max(d, e - d) <= ecc(u) <= e + d. Nodes that cannot exceed the best lower bound are out; the most promising are searched next.
    """
    inf = 2**31 - 1
    state = both.select(F.col("src").alias("node")).distinct().withColumns({"lo": F.lit(0), "hi": F.lit(inf)})
    state, best = checkpoint(state), 0
    while True:
        pick = state.filter(F.col("hi") > best).orderBy(F.desc("hi"), F.desc("lo"), F.xxhash64("node")).limit(at_once).select("node")
        d = distances_from(both, checkpoint(pick))
        ecc = d.groupBy("node").agg(F.max("dist").alias("e"))
        top = ecc.agg(F.max("e")).first()[0]
        if top is None:  # no node is left that could lie farther
            return best
        best = max(best, top)
        b = d.join(ecc, "node").groupBy("other").agg(F.max(F.greatest("dist", F.col("e") - F.col("dist"))).alias("l"), F.min(F.col("e") + F.col("dist")).alias("h"))
        own = ecc.select(F.col("node").alias("other"), F.col("e").alias("l2"))
        b = b.join(own, "other", "left").select(F.col("other").alias("node"), F.coalesce("l2", "l").alias("l"), F.coalesce("l2", "h").alias("h"))
        state = checkpoint(state.join(b, "node", "left").select("node", F.greatest("lo", F.coalesce("l", "lo")).alias("lo"), F.least("hi", F.coalesce("h", "hi")).alias("hi")))
        best = max(best, state.agg(F.max("lo")).first()[0])


def graph_distance(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Distance between predicted and true node; diameter + 1 where a node is missing or out of reach.

    Only the predicted nodes are searched from, and only until their true nodes are found; the diameter is made if it is needed.
    """
    both = both_ways(edges)
    nodes = both.select(F.col("src").alias("node")).distinct()
    asked = checkpoint(pairs.select(F.col("pred").alias("node"), F.col("truth").alias("other")).distinct().join(nodes, "node", "left_semi").join(
        nodes.select(F.col("node").alias("other")), "other", "left_semi").select("node", "other"))
    d = distances_from(both, asked, asked)
    j = pairs.join(d.select(F.col("node").alias("pred"), F.col("other").alias("truth"), "dist"), ["pred", "truth"], "left")
    j = j.join(nodes.select(F.col("node").alias("truth"), F.lit(True).alias("in_graph")), "truth", "left")
    far = None if j.filter("dist is null").isEmpty() else diameter(both) + 1
    return j.select(*pairs.columns, F.coalesce(F.col("dist"), F.lit(far).cast("int")).alias("dist"), F.coalesce("in_graph", F.lit(False)).alias("in_graph"))


def prefilter_topk(scores: DataFrame, grid: DataFrame, k: int, corr_max: float = 0.98) -> DataFrame:
    """The k best metrics of a case that are not near-copies of a better one.

    Candidates are the 3k best by score. Their correlations are exact and come from blocks of series (``functions.moments``); the
    greedy choice folds over at most 3k positions. A case with fewer than three survivors has none.
    """
    pool = rank_metrics(scores).filter(F.col("rank") <= 3 * k).select("case_id", "metric_id", "rank")
    x = grid.join(pool, ["case_id", "metric_id"]).select("case_id", "rank", "step", "value")
    c = pair_correlations(x, ["case_id"], "rank", "step", "value", "value", SD_MIN)
    near = c.filter(F.round(F.abs("uv"), 9) >= corr_max).groupBy("case_id", "v").agg(F.collect_list("u").alias("us"))
    near = near.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "us"))).alias("near"))
    names = pool.groupBy("case_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks")).filter(F.size("ranks") >= 3).join(near, "case_id", "left")
    names = names.withColumn("near", F.coalesce("near", F.create_map().cast("map<int,array<int>>")))
    kept = F.aggregate("ranks", F.array().cast("array<int>"), lambda acc, r: F.when(
        (F.size(acc) < k) & ~F.coalesce(F.arrays_overlap(acc, F.try_element_at("near", r)), F.lit(False)), F.concat(acc, F.array(r))).otherwise(acc))
    names = names.select("case_id", kept.alias("kept")).filter(F.size("kept") >= 3)
    return names.select("case_id", F.explode("kept").alias("rank")).join(pool, ["case_id", "rank"])


def anomalous_counts(scores: DataFrame, threshold: float = 3.0) -> DataFrame:
    return scores.groupBy("case_id").agg(F.count_if(F.col("z") > threshold).alias("anomalous"), F.count("*").alias("metrics"))


def count_profile(counts: DataFrame, system: Column) -> DataFrame:
    """Mean, population SD and coefficient of variation of the anomalous count per system."""
    g = counts.groupBy(system.alias("system")).agg(F.count("*").alias("cases"), F.avg("anomalous").alias("mean"), F.stddev_pop("anomalous").alias("sd"))
    return g.select("*", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).alias("cv"))


def sigma_rank(df: DataFrame) -> DataFrame:
    """Components by number of metrics above mean + 3 SD; inside, alerting metrics first, then deviation, then name.

    Readings that are not finite count as 0.
    """
    zero = F.when(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(0.0)).otherwise(F.col("value"))
    s = side_stats(df.withColumn("value", zero)).filter((F.col("n_base") >= 2) & (F.col("n_event") >= 1))
    x = s.select(*METRIC, (F.col("w_max") > F.col("mu") + 3 * F.col("sd_pop")).alias("alerted"),
                 F.when(F.col("sd_pop") > 1e-9, F.abs(F.col("w_max") - F.col("mu")) / F.col("sd_pop")).otherwise(0.0).alias("z"))
    x = x.withColumn("alerts", F.count_if("alerted").over(W.partitionBy("case_id", "component")))
    w = W.partitionBy("case_id").orderBy(F.desc("alerts"), "component", F.desc("alerted"), _down("z"), "metric_id")
    return x.withColumn("rank", F.row_number().over(w))


def sweep_summary(df: DataFrame, zs: Sequence[float], pcts: Sequence[float], windows_h: Sequence[int]) -> DataFrame:
    """Per (z, pct, window): cases with a detection, and mean and extreme numbers of detected components.

    Only the window needs the readings again; both thresholds are applied to the per-metric statistics.
    """
    x = df.withColumn("window_h", F.explode(F.array(*[F.lit(h) for h in windows_h])))
    inside = before_event() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp")) < F.col("window_h") * 3600000000)
    s = threshold_stats(side_stats(x.filter(inside), ["window_h", *METRIC]), ["window_h", *METRIC])
    conf = F.explode(F.array(*[F.struct(F.lit(float(z)).alias("z_min"), F.lit(float(p)).alias("pct_min")) for z in zs for p in pcts]))
    y = s.select("*", conf.alias("c")).select("*", "c.*").filter((F.col("z") >= F.col("z_min")) & (F.abs("pct") >= F.col("pct_min")))
    per = y.groupBy("z_min", "pct_min", "window_h", "case_id").agg(F.count_distinct("component").alias("n"))
    return per.groupBy("z_min", "pct_min", "window_h").agg(F.count("*").alias("cases"), F.avg("n").alias("mean_components"), F.min("n").alias("min_components"), F.max("n").alias("max_components"))
