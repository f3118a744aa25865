"""Telemetry preparation on long tables (keys, time, value): grids, fills, windows, profiles, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions.series import exact_percentiles, fill_forward, previous, row_index, top_n

GRID_CHUNK = 64  # grid steps per chunk


def step_of(ts: str | Column, seconds: int) -> Column:
    """Number of the time step a zone-free timestamp falls into."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(c.cast("timestamp").cast("bigint") / seconds)


def step_start(step: str, seconds: int) -> Column:
    return F.timestamp_seconds(F.col(step) * seconds).cast("timestamp_ntz")


def resample(df: DataFrame, frame: Sequence[str], metric: str, seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean per metric and time step on the regular grid of the whole frame; empty cells are null rows.

    The grid is produced in blocks of steps and joined on (frame, metric, step); readings shuffle once, after a
    map-side partial mean.
    """
    frame = list(frame)
    cells = df.groupBy(*frame, metric, step_of(ts, seconds).alias("step")).agg(F.avg(value).alias("value"))
    # first and last step per metric come from the readings (a map-side min and max), the frame's from a window over metrics
    w = W.partitionBy(*frame)
    own = df.groupBy(*frame, metric).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    span = own.withColumn("_s0", step_of(F.min("_t0").over(w), seconds)).withColumn("_s1", step_of(F.max("_t1").over(w), seconds))
    grid = (span.select(*frame, metric, "_s0", "_s1", F.explode(F.sequence("_s0", "_s1", F.lit(GRID_CHUNK))).alias("_b"))
            .select(*frame, metric, F.explode(F.sequence("_b", F.least(F.col("_b") + (GRID_CHUNK - 1), F.col("_s1")))).alias("step")))
    return grid.join(cells, [*frame, metric, "step"], "left")


def _chunk() -> Column:
    return F.floor(F.col("step") / GRID_CHUNK)


def ffill_limit(grid: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Fill gaps with the last value, at most n steps long."""
    return fill_forward(grid, keys, _chunk(), "step", "value", "_f", limit=n).withColumn("value", F.col("_f")).drop("_f")


def ffill_zero(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill gaps with the last value, leading gaps with zero."""
    x = fill_forward(grid, keys, _chunk(), "step", "value", "_f")
    return x.withColumn("value", F.coalesce("_f", F.lit(0.0))).drop("_f")


def metric_quality(grid: DataFrame, raw: DataFrame, keys: Sequence[str], min_samples: int, max_null: float, fill: int = 3) -> DataFrame:
    """Samples, null share on the grid after filling gaps of at most ``fill`` steps, and the keep decision."""
    keys = list(keys)
    grid = ffill_limit(grid, keys, fill)
    n = raw.groupBy(*keys).agg(F.count("*").alias("samples"))
    g = grid.groupBy(*keys).agg(F.avg(F.col("value").isNull().cast("double")).alias("null_share"),
                                F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    keep = (F.col("samples") >= min_samples) & (F.col("null_share") < max_null) & (F.col("_lo") < F.col("_hi"))
    return n.join(g, keys).select(*keys, "samples", "null_share", F.coalesce(keep, F.lit(False)).alias("keep"))


def prune_metrics(grid: DataFrame, raw: DataFrame, keys: Sequence[str], min_samples: int, max_null: float, fill: int = 3) -> DataFrame:
    """The filled grid of the metrics that are kept."""
    q = metric_quality(grid, raw, keys, min_samples, max_null, fill).filter("keep").select(*keys)
    return ffill_limit(grid, keys, fill).join(q, list(keys), "left_semi")


def window_case(df: DataFrame, case: str, n: int, ts: str = "ts", t0: str = "t0") -> DataFrame:
    """Rows at the last n distinct times before the event and the first n at or after it (a row window: the time
    ranks are shared by all metrics of the case)."""
    times = df.select(case, ts, t0).distinct()
    pre = top_n(times.filter(F.col(ts) < F.col(t0)), [case], [F.desc(ts)], n, ts)
    post = top_n(times.filter(F.col(ts) >= F.col(t0)), [case], [F.asc(ts)], n, ts)
    keep = pre.select(case, ts, (-F.col("rank")).alias("rel")).unionByName(post.select(case, ts, (F.col("rank") - 1).alias("rel")))
    return df.join(keep, [case, ts])


def event_window(df: DataFrame, case: str, base: int, half: int, min_len: int = 30, ts: str = "ts", t0: str = "t0") -> DataFrame:
    """Rows from ``base + half`` samples before the sample nearest the event to ``half`` after it.

    Samples are numbered over the distinct times of a case; windows shorter than ``min_len`` are dropped. Ties of
    the nearest sample go to the later one.
    """
    times = df.select(case, ts, t0).distinct()
    idx = row_index(times, [case], F.floor(F.col(ts).cast("timestamp").cast("bigint") / 3600), [F.col(ts)], "idx")
    gap = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(t0).cast("timestamp")))
    near = idx.groupBy(case).agg(F.min_by("idx", F.struct(gap, -F.col("idx"))).alias("at"), F.max("idx").alias("last"))
    lo = F.greatest(F.lit(0), F.col("at") - base - half)
    hi = F.least(F.col("last"), F.col("at") + half)
    near = near.withColumn("lo", lo).withColumn("hi", hi).filter(F.col("hi") - F.col("lo") + 1 >= min_len)
    keep = idx.join(near, case).filter("idx between lo and hi").select(case, ts, (F.col("idx") - F.col("at")).alias("rel"))
    return df.join(keep, [case, ts])


def clean_window(window: DataFrame, case: str, min_metrics: int = 5, sd_min: float = 1e-8, max_null: float = 0.5, ts: str = "ts") -> DataFrame:
    """The window of ``event_window`` as a whole table (case, metric_id, ts, rel, value) without gaps.

    Metrics that hardly vary (sample SD), or that lack ``max_null`` or more of the times of their window, go; gaps take the last value,
    leading ones zero. A case with fewer than ``min_metrics`` metrics left has no rows. Null and NaN are gaps; readings of one
    metric at one time are averaged; a metric with an infinite reading has no SD and goes. Every list and window below is as long as
    an event window, so no metric is held in one task beyond it.
    """
    v = F.when(~F.isnan("value"), F.col("value"))
    cells = window.groupBy(case, "metric_id", "rel").agg(F.avg(v).alias("value"))
    times = window.groupBy(case).agg(F.sort_array(F.collect_set(F.struct("rel", F.col(ts).alias("ts")))).alias("_times"))
    sd = F.stddev_samp("value")
    own = cells.groupBy(case, "metric_id").agg(F.count("value").alias("_n"), F.when(~F.isnan(sd), sd).alias("_sd")).join(times, case)
    own = own.filter((F.col("_sd") > sd_min) & (1 - F.col("_n") / F.size("_times") < max_null))
    own = own.withColumn("_m", F.count("*").over(W.partitionBy(case))).filter(F.col("_m") >= min_metrics)
    frame = own.select(case, "metric_id", F.explode("_times").alias("t")).select(case, "metric_id", F.col("t.ts").alias(ts), "t.rel")
    last = F.last("value", ignorenulls=True).over(W.partitionBy(case, "metric_id").orderBy("rel"))
    return frame.join(cells, [case, "metric_id", "rel"], "left").select(case, "metric_id", ts, "rel", F.coalesce(last, F.lit(0.0)).alias("value"))


def align_baseline(normal: DataFrame, abnormal: DataFrame, case: str, step_s: int = 300) -> DataFrame:
    """Put a baseline that was recorded later in front of the event on an artificial axis.

    Both inputs: (case, metric_id, ts, value, t0). The last baseline sample lands one step before the event, the
    first event sample on it. Metrics missing on either side are dropped.
    """
    def numbered(df: DataFrame) -> DataFrame:
        times = df.select(case, "ts").distinct()
        return row_index(times, [case], F.floor(F.col("ts").cast("timestamp").cast("bigint") / 3600), [F.col("ts")], "idx")

    ni, ai = numbered(normal), numbered(abnormal)
    size = ni.groupBy(case).agg(F.count("*").alias("n"))
    common = normal.select(case, "metric_id").distinct().join(abnormal.select(case, "metric_id").distinct(), [case, "metric_id"])
    nn = normal.join(ni, [case, "ts"]).join(size, case).withColumn("off", (F.col("idx") - F.col("n")) * step_s)
    aa = abnormal.join(ai, [case, "ts"]).withColumn("off", F.col("idx") * step_s)
    cols = [case, "metric_id", "off", "value"]
    return nn.select(*cols).unionByName(aa.select(*cols)).join(common, [case, "metric_id"], "left_semi")


def smooth(grid: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """Mean of the last n rows (at least one value), across chunk borders."""
    x = previous(grid, keys, _chunk(), ["step"], "value", "_prev", k=n - 1)
    vals = F.filter(F.concat("_prev", F.array("value")), lambda v: v.isNotNull())
    mean = F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals))
    return x.withColumn("smooth", mean).drop("_prev")


def counter_profile(grid: DataFrame, keys: Sequence[str], table: Sequence[str]) -> DataFrame:
    """Share of constant and of never-decreasing metrics per table; ``grid`` has no nulls."""
    keys = list(keys)
    x = previous(grid, keys, _chunk(), ["step"], "value", "_prev", k=1)
    m = x.groupBy(*keys).agg((F.stddev_pop("value") == 0).alias("constant"),
                             F.coalesce(F.bool_and(F.col("value") - F.get("_prev", 0) >= -1e-9), F.lit(True)).alias("monotone"))
    mono = F.col("monotone") & ~F.col("constant")
    return m.groupBy(*table).agg(F.count("*").alias("metrics"), F.count_if("constant").alias("constant"), F.count_if(mono).alias("monotone"),
                                 F.avg(mono.cast("double")).alias("monotone_share"))


def table_shapes(df: DataFrame, kind: Column, case: str, metric: str, ts: str = "ts") -> DataFrame:
    """Smallest, largest and most frequent number of columns and rows of the cases of each kind."""
    per = df.groupBy(kind.alias("kind"), F.col(case)).agg(F.count_distinct(metric).alias("cols"), F.count_distinct(ts).alias("rows"))
    modal = lambda c: F.mode(c, deterministic=True)
    return per.groupBy("kind").agg(
        F.count("*").alias("cases"), F.min("cols").alias("cols_min"), F.max("cols").alias("cols_max"), modal("cols").alias("cols_mode"),
        F.min("rows").alias("rows_min"), F.max("rows").alias("rows_max"), modal("rows").alias("rows_mode"))


# fixed values: name that a second time column gets when a file repeats its header
DUP_TIME = r"^time\.[0-9]+$"


def drop_dup_time(df: DataFrame, metric: str = "metric_id") -> DataFrame:
    return df.filter(~F.col(metric).rlike(DUP_TIME))


def dup_time_flags(df: DataFrame, case: str, metric: str = "metric_id") -> DataFrame:
    hit = F.col(metric).rlike(DUP_TIME)
    return df.groupBy(case).agg(F.bool_or(hit).alias("has_dup_time"), F.count_if(hit).alias("dropped_rows"))


def suffix_profile(df: DataFrame, table: Sequence[str], metric: str, k: int = 5) -> DataFrame:
    """Most frequent metric-kind suffixes per table: the last ``-`` part of what follows the first ``_``."""
    tail = F.when(F.instr(metric, "_") > 0, F.expr(f"substring({metric}, instr({metric}, '_') + 1)"))
    suffix = F.coalesce(F.substring_index(tail, "-", -1), F.lit("?"))
    names = df.select(*table, metric).distinct().withColumn("suffix", suffix)
    c = names.groupBy(*table, "suffix").agg(F.count("*").alias("metrics"))
    w = W.partitionBy(*table).orderBy(F.desc("metrics"), "suffix")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def stratified_sample(df: DataFrame, stratum: str, unit: str, n: int) -> DataFrame:
    """n units, round robin over the strata, in hash order inside each stratum."""
    h = F.md5(F.col(unit))
    x = top_n(df.withColumn("_h", h), [stratum], [F.col("_h"), F.col(unit)], n, unit, "round")
    return x.orderBy("round", stratum).limit(n).drop("_h")


def nearest_median(df: DataFrame, keys: Sequence[str], value: str, unit: str) -> DataFrame:
    """The unit whose value is nearest the median of its group; ties go to the smaller value, then the unit."""
    keys = list(keys)
    med = exact_percentiles(df, keys, value, [0.5], ["median"])
    x = df.join(med, keys)
    near = F.struct(F.round(F.abs(F.col(value) - F.col("median")), 9), F.col(value), F.col(unit))
    return x.groupBy(*keys, "median").agg(F.min_by(F.struct(unit, value), near).alias("p")).select(*keys, "median", f"p.{unit}", f"p.{value}")
