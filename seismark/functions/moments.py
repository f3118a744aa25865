"""Correlations of all pairs of series of a frame, from blocks of series instead of rows per pair and step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS, BLOCK = 512, 128  # steps of a chunk; series of a block
REL_SD = 1e-7  # a standard deviation below this share of the root mean square is rounding, not variation
SUMS = ["sx", "sy", "sxx", "syy", "sxy"]


def numbered_items(df: DataFrame, keys: Sequence[str], item: str, x: str, y: str) -> DataFrame:
    """One row per series: its number in the frame (by name), its block, the blocks of the frame, its means."""
    keys = list(keys)
    own = df.groupBy(*keys, item).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    # the window holds one row per series of a frame (the width of the system), not its steps
    no = own.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(item)) - 1)
    wide = F.count("*").over(W.partitionBy(*keys))
    return no.withColumn("_b", F.floor(F.col("_i") / BLOCK).cast("int")).withColumn("_nb", F.ceil(wide / BLOCK).cast("int"))


def pair_sums(df: DataFrame, items: DataFrame, keys: Sequence[str], item: str, step: str, x: str, y: str) -> DataFrame:
    """(keys, u, v, n, f_*, r_*) per pair of series with ``u < v``: moment sums of x of u with y of v (``f_``) and of x of v with
    y of u (``r_``) over the steps that both series have.

    A series becomes one vector per chunk of steps; a vector goes once to each block it meets, and a task holds two blocks of one
    chunk (at most 2 x 128 vectors of 512 steps). What leaves it is one row per pair and chunk, added up by a partial aggregation.
    """
    keys, steps = list(keys), STEPS
    chunk = F.floor(F.col(step) / steps).cast("long")
    rows = df.join(items, [*keys, item]).select(*keys, F.col(item).alias("_s"), "_i", "_b", "_nb", chunk.alias("_c"), F.struct(
        (F.col(step) - chunk * steps).cast("int").alias("o"), (F.col(x) - F.col("_mx")).alias("x"), (F.col(y) - F.col("_my")).alias("y")).alias("p"))
    vec = rows.groupBy(*keys, "_s", "_i", "_b", "_nb", "_c").agg(F.collect_list("p").alias("p"))
    met = vec.select(*keys, "_s", "_i", "_b", "_c", *[F.col(f"p.{n}").alias(f"_{n}") for n in "oxy"],
                     F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_m"))
    met = met.withColumn("_lo", F.least("_b", "_m")).withColumn("_hi", F.greatest("_b", "_m")).drop("_m")
    names = [f"{d}_{s}" for d in "fr" for s in SUMS]

    def block_pair(pdf):
        import numpy as np
        import pandas as pd

        def side(b):
            s = pdf[pdf["_b"] == b].sort_values("_i")
            has, xs, ys = (np.zeros((len(s), steps)) for _ in range(3))
            for r, (o, p, q) in enumerate(zip(s["_o"], s["_x"], s["_y"])):
                has[r, o], xs[r, o], ys[r, o] = 1.0, p, q
            return s["_i"].to_numpy(), s["_s"].to_numpy(), has, xs, ys

        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        a = side(lo)
        b = a if hi == lo else side(hi)
        (ia, sa, ha, xa, ya), (ib, sb, hb, xb, yb) = a, b
        n = ha @ hb.T
        u, v = np.nonzero((n > 0) & (ia[:, None] < ib[None, :]))
        named = {k: [pdf[k].iloc[0]] * len(u) for k in keys} | {"u": sa[u], "v": sb[v]}
        out = {k: pd.Series(c, dtype=object) for k, c in named.items()} | {"n": n[u, v]}  # plain objects: an empty text column has no Arrow chunk
        forth = (xa @ hb.T, ha @ yb.T, (xa * xa) @ hb.T, ha @ (yb * yb).T, xa @ yb.T)
        back = (ha @ xb.T, ya @ hb.T, ha @ (xb * xb).T, (ya * ya) @ hb.T, ya @ xb.T)
        return pd.DataFrame(out | {c: m[u, v] for c, m in zip(names, forth + back)})

    types = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"u {types[item]}, v {types[item]}, n double"] + [f"{c} double" for c in names])
    parts = met.groupBy(*keys, "_c", "_lo", "_hi").applyInPandas(block_pair, schema)
    return parts.groupBy(*keys, "u", "v").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def corr_of_sums(d: str, least: float):
    """Correlation from moment sums, null where a side hardly varies."""
    n, (sx, sy, sxx, syy, sxy) = F.col("n"), (F.col(f"{d}_{s}") for s in SUMS)
    sdx, sdy = (F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))) for q, s in ((sxx, sx), (syy, sy)))
    varies = (sdx >= F.greatest(F.lit(least), REL_SD * F.sqrt(sxx / n))) & (sdy >= F.greatest(F.lit(least), REL_SD * F.sqrt(syy / n)))
    return F.when(varies, (sxy / n - (sx / n) * (sy / n)) / (sdx * sdy))


def pair_correlations(df: DataFrame, keys: Sequence[str], item: str, step: str, x: str, y: str, least: float,
                      items: DataFrame | None = None) -> DataFrame:
    """Correlations of every pair of series of a frame: (keys, u, v, uv, vu) with ``u < v``, ``uv`` = corr(x of u, y of v), null where
    a side varies less than ``least``.

    ``df``: one row per (keys, item, step); rows where x or y is null take no part. Values are centred by the mean of their series
    before they are squared. ``items``: ``numbered_items`` of a cheaper table with the same series, where ``df`` is dear to make.
    """
    x_y = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    items = numbered_items(x_y, keys, item, x, y) if items is None else items
    sums = pair_sums(x_y, items, keys, item, step, x, y)
    return sums.select(*keys, "u", "v", corr_of_sums("f", least).alias("uv"), corr_of_sums("r", least).alias("vu"))
