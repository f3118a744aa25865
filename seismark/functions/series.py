"""Ordered per-key operations that never hold a whole series in one task.

A plain window over ``partitionBy(key).orderBy(ts)`` sorts one key in one task. These helpers split a key
into ordered chunks (a coarse function of the order column, e.g. an hour or a hash prefix), work inside the
chunk and carry a small per-chunk summary forward. The summary has one row per chunk, not per reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def _with_summary(df: DataFrame, summary: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    joined = df.alias("x").join(summary.alias("s"), _same("x", "s", keys), "left")
    return joined.select("x.*", *[F.col(f"s.{c}") for c in cols])


def row_index(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str) -> DataFrame:
    """0-based position of each row within ``keys``; ``chunk`` must be non-decreasing along ``order``."""
    keys = list(keys)
    x = df.withColumn("_chunk", chunk)
    counts = x.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order)
    x = x.withColumn("_rn", F.row_number().over(inner))
    x = _with_summary(x, offs, [*keys, "_chunk"], ["_off"])
    return x.withColumn(name, (F.col("_rn") - 1 + F.col("_off")).cast("bigint")).drop("_rn", "_off", "_chunk")


def fill_forward(df: DataFrame, keys: Sequence[str], chunk: Column, order: str, value: str, name: str,
                 limit: int | None = None) -> DataFrame:
    """Last non-null ``value`` at or before each row, at most ``limit`` units of an integer ``order`` away."""
    keys = list(keys)
    x = df.withColumn("_chunk", chunk)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    x = x.withColumn("_seen", seen)
    last = x.groupBy(*keys, "_chunk").agg(F.max("_seen").alias("_tail"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
    inner = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_in", F.last("_seen", ignorenulls=True).over(inner))
    x = _with_summary(x, carry, [*keys, "_chunk"], ["_carry"])
    hit = F.coalesce("_in", "_carry")
    v = hit["v"]
    if limit is not None:
        v = F.when(F.col(order) - hit["o"] <= limit, v)
    return x.withColumn(name, v).drop("_seen", "_in", "_carry", "_chunk")


def previous(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: str, name: str,
             k: int = 1) -> DataFrame:
    """Array of the ``k`` values before each row (nearest last), across chunk borders."""
    keys = list(keys)
    x = df.withColumn("_chunk", chunk)
    pos = F.struct(*[F.col(o) for o in order])
    down = W.partitionBy(*keys, "_chunk").orderBy(*[F.col(o).desc() for o in order])
    x = x.withColumn("_rd", F.row_number().over(down))
    # the chunk's last k values, oldest first; a chunk may be shorter than k, so up to k chunks are merged
    tail = (x.filter(F.col("_rd") <= k).groupBy(*keys, "_chunk")
            .agg(F.sort_array(F.collect_list(F.struct(pos.alias("p"), F.col(value).alias("v")))).alias("_tail")))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(-k, -1)
    tail = tail.withColumn("_carry", F.flatten(F.collect_list("_tail").over(before))).drop("_tail")
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(-k, -1)
    x = x.withColumn("_in", F.collect_list(F.struct(F.col(value).alias("v"))).over(inner))
    x = _with_summary(x, tail, [*keys, "_chunk"], ["_carry"])
    both = F.concat(F.transform(F.coalesce("_carry", F.array()), lambda s: F.struct(s["v"].alias("v"))), "_in")
    both = F.transform(both, lambda s: s["v"])
    return (x.withColumn("_both", both)
            .withColumn(name, F.slice("_both", F.greatest(F.size("_both") - k + 1, F.lit(1)), F.lit(k)))
            .drop("_rd", "_in", "_carry", "_both", "_chunk"))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: str, name: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their 1-based rank. Each of 64 slices of a key keeps its own first n before
    the slices meet, so a hot key never sits in one task."""
    keys = list(keys)
    x = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(64)))
    x = x.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))).filter(F.col("_r") <= n)
    x = x.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return x.filter(F.col(name) <= n).drop("_part", "_r")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact linear-interpolation percentiles per key without holding a key's values in one task.

    Only finite values count. Distinct values are counted first; counts are cumulated inside value chunks and over the chunk
    totals; the values at the wanted ranks are then picked by a filter. A chunk is a band of magnitude (asinh spreads any)
    cut into 64 equal parts of the range the key really has in that band, so a narrow metric is split too.
    """
    keys = list(keys)
    real = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    vc = df.filter(real).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    vc = vc.withColumn("_band", F.floor(F.asinh(value) * 4))
    ranges = vc.groupBy(*keys, "_band").agg(F.min(value).alias("_from"), F.max(value).alias("_to"))
    vc = _with_summary(vc, ranges, [*keys, "_band"], ["_from", "_to"])
    part = F.when(F.col("_to") > F.col("_from"), F.least(F.floor((F.col(value) - F.col("_from")) / (F.col("_to") - F.col("_from")) * 64), F.lit(63))).otherwise(F.lit(0))
    vc = vc.withColumn("_chunk", F.col("_band") * 64 + part).drop("_band", "_from", "_to")
    tot = vc.groupBy(*keys, "_chunk").agg(F.sum("_c").alias("_cc"))
    wk = W.partitionBy(*keys)
    tot = (tot.withColumn("_off", F.coalesce(F.sum("_cc").over(wk.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("_n", F.sum("_cc").over(wk)).drop("_cc"))
    inner = W.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    x = vc.withColumn("_cum", F.sum("_c").over(inner))
    x = _with_summary(x, tot, [*keys, "_chunk"], ["_off", "_n"])
    hi_rank = F.col("_off") + F.col("_cum")  # ranks [hi - c, hi) hold this value
    lo_rank = hi_rank - F.col("_c")
    x = x.select(*keys, value, "_n", lo_rank.alias("_lo"), hi_rank.alias("_hi"))
    aggs = []
    for q, nm in zip(qs, names):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        fl = F.floor(pos)
        ce = F.least(fl + 1, F.col("_n") - 1)
        at = lambda r: F.max(F.when((F.col("_lo") <= r) & (F.col("_hi") > r), F.col(value)))
        aggs.append((at(fl) + (F.max(pos) - F.max(fl)) * (at(ce) - at(fl))).alias(nm))
    return x.groupBy(*keys).agg(*aggs)
