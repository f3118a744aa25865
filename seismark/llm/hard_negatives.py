"""Hard negatives by exact integer scores from subset-sum tables (Four Russians).

Components become integers, floor(scale * x). A row is stored as bit planes: for each group of eight dimensions and each bit
of the two's complement, one byte holds that bit of the eight components. For an anchor, a table per group holds the sums of
all 256 subsets of its eight components. The score of anchor and row is then a sum of table entries, indexed with the row's
bytes, shifted by the plane and added (the sign plane is subtracted): lookups and additions only, and exact.

Anchors in blocks meet rows in slices, one Spark group for each block and slice, so every anchor is scored against all rows
and no task holds more than one block and one slice. Each group returns its best few of every anchor; windows over these give
the positives and, in a second pass with the positives' scores as limits, the negatives.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of different
lengths count as filled up with zeros, an empty one as zeros; a null id is below all others in ties, is no anchor and is
returned as null; rows that repeat id, label and vector count once; different rows under one id are rows of their own, also as
anchors, and ties between them go by the hash of the vector; other columns are ignored; an empty table gives no rows. Scores
are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.llm.common import written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Anchors of a block, rows of a slice, rows that are scored at once.
ANCHORS, SLICE, RUN = 1024, 8192, 512
NONE = -(2**63)
ROWS = "kid long, vh long, label long, dims int, planes binary"


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(rows, dims) integers as bytes (planes, groups, rows); the last plane holds the signs."""
    n, dims = x.shape
    groups = -(-dims // 8)
    full = np.zeros((n, groups * 8), np.int64)
    full[:, :dims] = x
    top = int(max(full.max(initial=0), -(full.min(initial=0) + 1)))
    out = [np.packbits((full >> b & 1).astype(np.uint8).reshape(n, groups, 8), axis=2, bitorder="little")[:, :, 0].T for b in range(top.bit_length())]
    out.append(np.packbits((full < 0).astype(np.uint8).reshape(n, groups, 8), axis=2, bitorder="little")[:, :, 0].T)
    return np.stack(out)


def from_planes(planes: np.ndarray, dims: int) -> np.ndarray:
    """The (rows, dims) integers of bit planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes.transpose(0, 2, 1)), axis=2, bitorder="little")[:, :, :dims].astype(np.int64)
    weight = np.left_shift(1, np.arange(len(planes), dtype=np.int64))
    weight[-1] = -weight[-1]
    return np.tensordot(weight, bits, axes=1)


def subset_sums(x: np.ndarray) -> np.ndarray:
    """(anchors, dims) integers as tables (groups, 256, anchors): entry s is the sum of the components in subset s."""
    n, dims = x.shape
    groups = -(-dims // 8)
    full = np.zeros((groups * 8, n), np.int64)
    full[:dims] = x.T
    out = np.zeros((groups, 256, n), np.int64)
    for d in range(8):
        out[:, 1 << d: 2 << d] = out[:, : 1 << d] + full[d::8, None, :]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products; groups that only one side has count as zeros."""
    n, out = planes.shape[2], np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for at in range(0, n, RUN):
        part = planes[:, :, at: at + RUN]
        total, held = out[at: at + RUN], np.empty((part.shape[2], tables.shape[2]), tables.dtype)
        for b in range(len(planes) - 1, -1, -1):  # from the sign plane down, doubling what is there
            total <<= 1
            for g in range(min(len(tables), part.shape[1])):
                np.take(tables[g], part[b, g], axis=0, out=held)
                if b == len(planes) - 1:
                    total -= held
                else:
                    total += held
    return out


def prepared(vectors: DataFrame, scale: int = SCALE, relabel: int | None = 7, classes: int = 10) -> DataFrame:
    """The rows that take part: kid, vh, label, dims and their bit planes. Labels of ids divisible by ``relabel`` move on."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    if relabel is not None:
        label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % classes).otherwise(label)
    x = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NONE)).alias("kid"), F.xxhash64("embedding").alias("vh"), label.alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)

    def pack(batches):
        for b in batches:
            column = b.column("embedding")
            dims = np.asarray(pa.compute.list_value_length(column), np.int64)
            off = np.concatenate(([0], np.cumsum(dims)))
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
            flat = np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64)
            planes: list = [None] * len(dims)
            for k in np.unique(dims).tolist():
                i = np.flatnonzero(dims == k)
                packed = bit_planes(flat[off[i][:, None] + np.arange(k)])
                for at, row in zip(i.tolist(), np.ascontiguousarray(packed.transpose(2, 0, 1))):
                    planes[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("kid"), b.column("vh"), b.column("label"), pa.array(dims, pa.int32()), pa.array(planes, pa.binary())],
                                             schema=pa.schema([("kid", pa.int64()), ("vh", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("planes", pa.binary())]))

    return x.dropDuplicates(["kid", "vh", "label"]).mapInArrow(pack, ROWS)


def stacked(t: pa.Table) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Row numbers, dims and planes (planes, groups, rows) of the rows with equal dims and planes."""
    dims, data = t.column("dims").to_numpy(), t.column("planes").to_pylist()
    size = np.array([len(x) for x in data], np.int64)
    out = []
    for d, k in np.unique(np.stack([dims, size]), axis=1).T.tolist() if len(data) else []:
        i = np.flatnonzero((dims == d) & (size == k))
        groups = -(-d // 8)
        x = np.frombuffer(b"".join(data[j] for j in i), np.uint8)
        out.append((i, d, x.reshape(len(i), -1, groups).transpose(1, 2, 0) if groups else np.zeros((1, 0, len(i)), np.uint8)))
    return out


def integers(t: pa.Table) -> np.ndarray:
    """The components of all rows, filled up with zeros."""
    parts = stacked(t)
    out = np.zeros((t.num_rows, max((d for _, d, _ in parts), default=0)), np.int64)
    for i, d, planes in parts:
        out[i, :d] = from_planes(planes, d)
    return out


def score_table(anchors: pa.Table, rows: pa.Table) -> np.ndarray:
    """(anchors, rows) scores."""
    x = integers(anchors)
    tables = subset_sums(x)
    # 32 bits are enough for all sums of small components
    small = lambda planes: int(np.abs(x).sum(axis=1).max(initial=0)) << len(planes) < 2**31
    narrow = tables.astype(np.int32) if int(np.abs(tables).max(initial=0)) < 2**31 else tables
    out = np.zeros((rows.num_rows, anchors.num_rows), np.int64)
    for i, _, planes in stacked(rows):
        out[i] = scores(narrow if small(planes) else tables, planes)
    return np.ascontiguousarray(out.T)


def best(s: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Of one anchor the k best allowed rows, ties by position, best first."""
    i = np.flatnonzero(allowed)
    if len(i) > k:
        worst = np.partition(s[i], len(i) - k)[len(i) - k]
        above, level = i[s[i] > worst], i[s[i] == worst]
        i = np.concatenate((above, level[: k - len(above)]))
    return i[np.lexsort((i, -s[i]))]


def in_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, step, out: str) -> DataFrame:
    """Each block of anchors with each slice of rows through ``step``."""
    blocks, slices = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // SLICE))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "kid", "vh", "label"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own, as both sides stem from one table
    left = anchors.withColumns({"block": own(1, blocks)}).select("*", every(slices).alias("slice"))
    right = rows.withColumns({"slice": own(2, slices)}).select("*", every(blocks).alias("block"))
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(step, out)


ANCHOR = ["anchor", "anchor_vh", "anchor_label"]
FOUND = "anchor long, anchor_vh long, anchor_label long, score long, kid long, vh long"


def by_id(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.lexsort((t.column("label").to_numpy(), t.column("vh").to_numpy(), t.column("kid").to_numpy()))))


def top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows per key with their rank."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "kid", "vh")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from prepared rows."""
    rows = written(rows, "planes")
    anchors = rows.where(anchor)
    n_rows, n_anchors = rows.count(), anchors.count()

    def closest(a: pa.Table, r: pa.Table) -> pa.Table:
        r = by_id(r)
        found = [[] for _ in range(3)]
        if a.num_rows and r.num_rows:
            s = score_table(a, r)
            ids = [np.stack([t.column(c).to_numpy() for c in ("kid", "vh", "label")]) for t in (a, r)]
            for i in range(a.num_rows):
                own = ids[0][:, i, None]
                j = best(s[i], (ids[1][2] == own[2]) & (ids[1] != own).any(axis=0), positives)
                found[0].append(np.full(len(j), i)), found[1].append(j), found[2].append(s[i, j])
        i, j, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in found)
        return pa.table({"anchor": a.column("kid").to_numpy()[i], "anchor_vh": a.column("vh").to_numpy()[i], "anchor_label": a.column("label").to_numpy()[i],
                         "score": score, "kid": r.column("kid").to_numpy()[j], "vh": r.column("vh").to_numpy()[j]})

    pos = written(top(in_blocks(anchors, rows, n_anchors, n_rows, closest, FOUND), ANCHOR, positives), "positives")
    limits = pos.groupBy(*ANCHOR).agg(F.collect_list(F.struct("rank", "score")).alias("limits"))
    named = [F.col(a).alias(b) for a, b in zip(ANCHOR, ("kid", "vh", "label"))]
    with_limits = anchors.join(limits.select(*named, F.col("limits.rank").alias("ranks"), F.col("limits.score").alias("limit_scores")), ["kid", "vh", "label"])

    def between(a: pa.Table, r: pa.Table) -> pa.Table:
        r = by_id(r)
        found = [[] for _ in range(4)]
        if a.num_rows and r.num_rows:
            s, label, of = score_table(a, r), r.column("label").to_numpy(), a.column("label").to_numpy()
            for i, (ranks, ps) in enumerate(zip(a.column("ranks").to_pylist(), a.column("limit_scores").to_pylist())):
                other = np.flatnonzero(label != of[i])
                for rank, p in zip(ranks, ps):
                    # least and largest score in the band, in exact integers
                    lo, hi = -(-low * p // 100), high * p // 100
                    j = other[best(s[i, other], (s[i, other] >= max(lo, NONE)) & (s[i, other] <= hi), negatives)]
                    found[0].append(np.full(len(j), i)), found[1].append(np.full(len(j), rank)), found[2].append(j), found[3].append(s[i, j])
        i, rank, j, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in found)
        return pa.table({"anchor": a.column("kid").to_numpy()[i], "anchor_vh": a.column("vh").to_numpy()[i], "anchor_label": a.column("label").to_numpy()[i], "positive": rank.astype(np.int32),
                         "score": score, "kid": r.column("kid").to_numpy()[j], "vh": r.column("vh").to_numpy()[j]})

    neg = top(in_blocks(with_limits, rows, n_anchors, n_rows, between, FOUND.replace("score", "positive int, score")), [*ANCHOR, "positive"], negatives)
    of_pos = pos.select(*ANCHOR, F.col("rank").alias("positive"), F.col("kid").alias("positive_kid"), F.col("score").alias("positive_score"))
    name = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return neg.join(of_pos, [*ANCHOR, "positive"]).select(F.col("anchor").alias("anchor_id"), name("positive_kid").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                                          name("kid").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
