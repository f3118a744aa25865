"""Case bootstrap on counts: multinomial draws of joint score vectors, no row per case and replicate.

Cases with the same scores are alike, so a replicate is a multinomial draw on the counts of the distinct score vectors (cells)
of a group, and every statistic of it (means of methods, paired differences, anything made of them) follows from the cell
counts. All methods share the draws, as in a bootstrap of whole cases.

The draws split binomially along a tree over the cells: of the n drawn cases of a node, Binomial(n, share of the left half) go
left. A binomial of n is the sum of binomials of the powers of two in n, each looked up in its cumulative distribution with a
hashed 32-bit number. The number depends on (group, node, power, replicate) only, so the draws are the same under any layout,
block size and engine. The work per replicate grows with the number of cells and the logarithm of the cases.

Cells are numbered in order and cut into buckets of 2 ** ``CELL_BITS``, replicates into blocks of ``BLOCK``; a task holds one bucket and
one block of one group. It walks the tree from the root to its bucket, so buckets need not meet.
"""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions.series import row_index
from seismark.functions.stats import hash32
from seismark.session import checkpoint

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# fixed values of the hash: two odd factors of 31 bits, a step between streams
MIX_1, MIX_2, STEP = 569420461, 1935289751, 1640531527
CELL_BITS = 10
BLOCK = 5000


def mix32(x: np.ndarray) -> np.ndarray:
    """Arithmetic of uint32, so modulo 2^32."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(MIX_1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(MIX_2)
    x ^= x >> np.uint32(15)
    return x


def uniform32(stream: int, level: int, power: int, node: int, rep: np.ndarray) -> np.ndarray:
    """Hashed integers in [0, 2^32), one for each replicate."""
    word = lambda v: np.array([v & 0xFFFFFFFF], np.uint32)
    a = mix32(word(stream + (level * 64 + power) * STEP))
    b = mix32(word(int(a[0]) + node))
    return mix32(mix32(rep + b) + a)


def _tables() -> dict:
    """Tables that later groups of a Python worker use again."""
    return sys.modules.setdefault("_seismark_draws", types.ModuleType("_seismark_draws")).__dict__.setdefault("tables", {})


def known_table(m: int, p: float) -> tuple[int, np.ndarray]:
    held = _tables()
    if len(held) > 20_000:
        held.clear()
    if (m, p) not in held:
        held[m, p] = binomial_table(m, p)
    return held[m, p]


def binomial_table(m: int, p: float) -> tuple[int, np.ndarray]:
    """(base, thresholds) of Binomial(m, p): a uniform u stands for base + the number of thresholds at or below u.

    Probabilities are products of the ratios of neighbours from the middle outwards, divided by their sum: differences of log factorials
    lose so many digits that thresholds of large m depend on the engine. The upper tail ends at 1 - 1e-12; the rest is near the rounding.
    """
    sd = math.sqrt(m * p * (1 - p))
    mid, lo, hi = int(m * p), max(0, int(m * p - 9 * sd) - 40), min(m, int(m * p + 9 * sd) + 40)
    up, down = np.arange(mid + 1, hi + 1, dtype=np.float64), np.arange(mid - 1, lo - 1, -1, dtype=np.float64)
    w = np.concatenate([np.cumprod((down + 1) / (m - down) * ((1 - p) / p))[::-1], [1.0], np.cumprod((m - up + 1) / up * (p / (1 - p)))])
    below = np.cumsum(w) / w.sum()
    cut = np.floor(np.where(below < 1 - 1e-12, below, 1.0) * 2**32).astype(np.int64)
    return lo + int((cut <= 0).sum()), cut[(cut > 0) & (cut < 2**32)].astype(np.uint32)


def left_draws(n: np.ndarray, left: int, total: int, stream: int, level: int, node: int, rep: np.ndarray) -> np.ndarray:
    """Binomial(n, left / total) for each replicate."""
    if left in (0, total):
        return n if left else np.zeros_like(n)
    out, rep = np.zeros_like(n), rep.astype(np.uint32)
    for power in range(int(n.max(initial=0)).bit_length()):
        some = np.flatnonzero(n >> power & 1)
        if len(some):
            base, cut = known_table(1 << power, left / total)
            out[some] += base + np.searchsorted(cut, uniform32(stream, level, power, node, rep[some]), side="right")
    return out


def draws(stream: int, weights: np.ndarray, n: np.ndarray, rep: np.ndarray, level: int = 0, first: int = 0, only: int | None = None) -> np.ndarray:
    """Multinomial counts (replicates, cells) of n draws; ``level`` is the height of the cells in the tree, ``first`` the place of
    the subtree's root among its peers. With ``only`` just that cell's counts are made."""
    height = max(0, int(len(weights) - 1).bit_length())
    sums = [np.concatenate([weights, np.zeros((1 << height) - len(weights), np.int64)])]
    for _ in range(height):
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    nodes = {0: n}
    for h in range(height - 1, -1, -1):
        below: dict[int, np.ndarray] = {}
        for i, drawn in nodes.items():
            go = left_draws(drawn, int(sums[h][2 * i]), int(sums[h + 1][i]), stream, level + h, (first << (height - 1 - h)) + i, rep)
            for child, k in ((2 * i, go), (2 * i + 1, drawn - go)):
                if sums[h][child] and (only is None or only >> h == child):
                    below[child] = k
        nodes = below
    out = np.zeros((len(rep), 1 if only is not None else len(weights)), np.int64)
    for i, k in nodes.items():
        out[:, 0 if only is not None else i] = k
    return out


def without_replacement(rng: np.random.Generator, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Counts (replicates, cells) of m cases drawn without replacement from cells of the given sizes, cell by cell.

    ``weights`` is one row of sizes for all replicates or a row for each.
    """
    left = np.broadcast_to(weights, (len(m), weights.shape[-1])).astype(np.int64)
    rest, todo, out = left.sum(axis=1), m.copy(), np.zeros(left.shape, np.int64)
    for j in range(left.shape[1]):
        rest = rest - left[:, j]
        out[:, j] = rng.hypergeometric(left[:, j], rest, todo)
        todo = todo - out[:, j]
    return out


def stream_of(stream: int, *parts: int) -> np.random.Generator:
    """Random numbers that depend on the given integers only."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([stream, *parts])))


def score_cells(items: DataFrame, group: str, keep: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """The distinct score vectors of each group with their counts, numbered in order."""
    vec = items.groupBy(*keep, group, F.array_sort("items").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    return row_index(vec, [group], F.get("_v", F.lit(0)), [F.col("_v")], "_cell")


def replicate_sums(items: DataFrame, group: str, reps: int, seed: int = 7, keep: Sequence[str] = (), pairs: bool = False, counted: bool = False,
                   share: float | None = None, weight: str | None = None) -> DataFrame:
    """(keep, group, name or a and b, rep, s, k, times): sum over the drawn cases that have the score (both scores), and their number.

    ``items``: one row per case with an array of (name, v), or for each ``weight`` equal cases; a null v is a missing score. With ``counted`` equal means of a block
    are one row (s is the mean, k is 1, rep is negative) where a group is one bucket. With ``share`` a replicate is a subsample of
    floor(share * n) cases without replacement instead; a group then has at most 10^9 cases.
    """
    keys, blocks = [*keep, group], -(-reps // BLOCK)
    cells = checkpoint(score_cells(items, group, keep, weight)).withColumn("_bucket", F.shiftright("_cell", CELL_BITS))
    split = bool(cells.agg(F.max("_bucket")).first()[0])
    totals = cells.groupBy(group, "_bucket").agg(F.sum("_c").alias("_w")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_bucket", "_w"))).alias("_t"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    x = cells.join(totals.select(group, F.col("_t._w").alias("_totals")), group).withColumn("_stream", hash32(F.lit(seed), group)).select("*", every)
    names = ["a", "b"] if pairs else ["name"]
    kinds = {f.name: f.dataType.simpleString() for f in items.schema if f.name in keys}
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} string" for c in names), "rep int, s double, k double, times long"])

    def draw(t: pa.Table) -> pa.Table:
        t = t.sort_by("_cell")
        at, block = int(t["_bucket"][0].as_py()), int(t["_block"][0].as_py())
        stream, buckets = int(t["_stream"][0].as_py()), np.array(t["_totals"][0].as_py(), np.int64)
        rep = np.arange(block * BLOCK, min((block + 1) * BLOCK, reps))
        weights = t["_c"].to_numpy().astype(np.int64)
        if share is None:
            n = draws(stream, buckets, np.full(len(rep), buckets.sum()), rep, CELL_BITS, 0, at)[:, 0]
            drawn = draws(stream, weights, n, rep, 0, at << (CELL_BITS - max(0, int(t.num_rows - 1).bit_length()))).astype(np.float64)
        else:  # every bucket makes the same split over the buckets
            m = without_replacement(stream_of(stream, block), buckets, np.full(len(rep), int(share * buckets.sum())))[:, at]
            drawn = without_replacement(stream_of(stream, block, at + 1), weights, m).astype(np.float64)
        vectors = [{e["name"]: e["v"] for e in v if e["v"] is not None} for v in t["_v"].to_pylist()]
        labels = sorted({m for v in vectors for m in v})
        y = np.array([[v.get(m, np.nan) for m in labels] for v in vectors]).reshape(len(vectors), len(labels))
        if pairs:
            i, j = np.triu_indices(len(labels), 1)
            y, columns = y[:, i] - y[:, j], [[labels[q] for q in i], [labels[q] for q in j]]
        else:
            columns = [labels]
        has = ~np.isnan(y)
        s, k = drawn @ np.where(has, y, 0.0), drawn @ has
        parts = []
        for q in range(y.shape[1]):
            some = k[:, q] > 0
            r, sq, kq, times = rep[some], s[some, q], k[some, q], np.ones(int(some.sum()), np.int64)
            if counted and len(buckets) == 1:
                sq, times = np.unique(np.round(sq / kq, 12), return_counts=True)
                r, kq = -1 - np.arange(len(sq)) - block * BLOCK, np.ones(len(sq))
            parts.append((np.full(len(r), q), r, sq, kq, times))
        q, r, sq, kq, times = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in range(5))
        q = q.astype(np.int64)
        fixed = {key: pa.array([t[key][0].as_py()] * len(q), t[key].type) for key in keys}
        named = {c: pa.array(np.array(v, object)[q] if len(q) else [], pa.string()) for c, v in zip(names, columns)}
        return pa.table({**fixed, **named, "rep": pa.array(r.astype(np.int32)), "s": sq.astype(np.float64), "k": kq.astype(np.float64), "times": times.astype(np.int64)})

    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = x.repartition(parts, *keys, "_bucket", "_block").groupBy(*keys, "_bucket", "_block").applyInArrow(draw, out)
    if not split:  # no group has cells in several buckets
        return sums
    return sums.groupBy(*keys, *names, "rep").agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.max("times").alias("times"))


def replicate_means(items: DataFrame, group: str, reps: int, seed: int = 7, keep: Sequence[str] = (), pairs: bool = False, weight: str | None = None) -> DataFrame:
    """(keep, group, rep, name or a and b, mean) over the drawn cases that have the score."""
    names = ["a", "b"] if pairs else ["name"]
    return replicate_sums(items, group, reps, seed, keep, pairs, weight=weight).select(*keep, group, "rep", *names, (F.col("s") / F.col("k")).alias("mean"))


def replicate_values(items: DataFrame, group: str, reps: int, seed: int = 7, keep: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keep, group, a, b, d, times): how many replicates have each mean difference. Counts of blocks add up, so any number of
    replicates leaves one row per different value."""
    x = replicate_sums(items, group, reps, seed, keep, pairs=True, counted=True, weight=weight).withColumn("d", F.round(F.col("s") / F.col("k"), 12))
    return x.groupBy(*keep, group, "a", "b", "d").agg(F.sum("times").alias("times"))


def counted_quantiles(values: DataFrame, keys: Sequence[str], qs: dict[str, Column], value: str = "d", times: str = "times") -> DataFrame:
    """Linear-interpolation quantiles of counted values; each q may differ by key."""
    w = W.partitionBy(*keys)
    x = values.withColumn("_hi", F.sum(times).over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum(times).over(w))
    aggs = []
    for name, q in qs.items():
        pos = q * (F.col("_n") - 1)
        lo = F.floor(pos)
        at = lambda r: F.max(F.when((F.col("_hi") - F.col(times) <= r) & (F.col("_hi") > r), F.col(value)))
        a, b = at(lo), at(F.least(lo + 1, F.col("_n") - 1))
        aggs.append((a + F.max(pos - lo) * (b - a)).alias(name))
    return x.groupBy(*keys).agg(*aggs)
