"""SimHash near-duplicates: links between fingerprints by the generalised pigeonhole principle, and their groups.

A fingerprint has 64 bits; a bit is set where more than half of the XXH64 hashes of a text's word shingles have it. Two
fingerprints link when at most ``TAU`` bits differ. The search works on the distinct fingerprints:

* Partitions: bits that are correlated over all fingerprints go into one partition, so that the others are selective.
* Thresholds: if partition i may differ in t_i bits and the sum of all t_i + 1 is TAU + 1, two linked fingerprints are within
  t_i in some partition (else they would differ in TAU + 1 bits). Thresholds are unequal, -1 leaves a partition out. Dynamic
  programming takes those with the lowest cost: probes, and candidates estimated from a sample of fingerprints. The number of
  partitions is chosen by the same cost. Estimates only steer the cost; no choice loses a link.
* Probe: both sides of a threshold t share its bit flips, t // 2 on one side and the rest on the other, so equal keys are
  within t. Keys are made by Spark from the fingerprints; a bucket of more than ``BLOCK`` entries is cut into block pairs.
* Verify: candidates are compared in full by popcount. Of the links of a task only a spanning forest leaves it.

Defined results: a null or blank text has the fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; a null id counts as the smallest and a group that holds it has a null component; each repeated row
is returned; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.common import LOWER, U64, WHITE, chunks, keyed, partitions, text_buffer, word_bounds, written
from seismark.llm.jaccard_join import connected, forest

SHINGLE, SEED, TAU, BITS = 4, 42, 4, 64
#: Fingerprints that the candidate estimates are taken from (the smallest by hash).
SAMPLE = 2048
#: Entries of one side of a bucket that are compared in one go; pairs that are held at once; entries of a task.
BLOCK, PAIRS, TASK = 4096, 1 << 21, 1 << 20
#: Cost of a probe in candidate comparisons.
PROBE = 40


def fingerprints(column, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text."""
    buf, off = text_buffer(column)
    starts, ends, words = word_bounds(buf, off)
    ink = ~WHITE[buf]
    keep = ink.copy()
    keep[1:] |= ink[:-1]  # the first white byte after a word stays, as a space
    place = np.concatenate(([0], np.cumsum(keep)))
    data = np.where(ink, LOWER[buf], np.uint8(32))[keep].tobytes()
    n_words = np.diff(words)
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    bound = np.concatenate(([0], np.cumsum(count)))
    ones = np.zeros((len(count), BITS), np.int64)
    for at in range(0, int(bound[-1]), 1 << 19):  # a very long text is added up in parts
        i = np.arange(at, min(at + (1 << 19), int(bound[-1])))
        doc = np.searchsorted(bound, i, "right") - 1
        first = words[doc] + i - bound[doc]
        last = first + np.minimum(shingle, n_words[doc]) - 1
        spans = zip(place[starts[first]].tolist(), (place[ends[last] - 1] + 1).tolist())
        h = np.fromiter((xxhash.xxh64_intdigest(data[a:b], seed) for a, b in spans), U64, len(i))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        ones[doc[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(U64)[:, 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_table(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits set, for all pairs of bits (on the diagonal: the bit)."""

    def count(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = bit_table(b.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], names=["at", "n"])

    out = np.zeros(BITS * BITS)
    for r in fps.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out.reshape(BITS, BITS)


def correlated_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits; each starts with the most correlated free pair and takes the bit that is closest to the group."""
    one = np.diag(both)
    spread = np.sqrt(np.maximum(one * (n - one), 1e-9))
    r = np.abs(n * both - np.outer(one, one)) / np.outer(spread, spread)
    np.fill_diagonal(r, -1)
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = (BITS - sum(map(len, groups))) // (m - g)
        left = sorted(free)
        if size < 2 or len(left) == size:
            own = left[:size]
        else:
            i, j = divmod(int(np.argmax(r[np.ix_(left, left)])), len(left))
            own = [left[i], left[j]]
            while len(own) < size:
                rest = [b for b in left if b not in own]
                own.append(rest[int(np.argmax(r[np.ix_(rest, own)].mean(axis=1)))])
        groups.append(own)
        free -= set(own)
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def probes_of(width: int, t: int) -> int:
    """Keys of one fingerprint in a partition with threshold t."""
    return sum(comb(width, r) for r in range((t + 1) // 2 + 1)) if t >= 0 else 0


def costs(group: list[int], sample: np.ndarray, one: np.ndarray, n: int, tau: int) -> list[float]:
    """Estimated cost of the partition for each threshold from -1 to tau: its probes and the pairs within the threshold."""
    x = sample.astype(np.int64).view(U64) & U64(mask_of(group))
    near = np.zeros(tau + 1)
    for at in range(0, len(x), 256):
        near += np.bincount(np.bitwise_count(x[at: at + 256, None] ^ x[None, :]).ravel(), minlength=BITS + 1)[: tau + 1]
    near[0] -= len(x)
    share = np.cumsum(near) / max(1, len(x) * (len(x) - 1))
    apart = np.array([1.0])  # of independent bits, for shares that the sample is too small to show
    for p in one[group] / max(n, 1):
        q = 2 * p * (1 - p)
        apart = np.convolve(apart, [1 - q, q])
    model = np.cumsum(apart)[: tau + 1]
    model = np.concatenate((model, np.ones(tau + 1 - len(model))))
    pairs = n * (n - 1) / 2 * np.maximum(share, model)
    return [0.0, *(PROBE * n * probes_of(len(group), t) + pairs[t] for t in range(tau + 1))]


def allocate(cost: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds of the partitions with the lowest total cost such that the sum of t + 1 is tau + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in best.items():
            for u in range(tau + 2 - used):
                if used + u not in step or total + c[u] < step[used + u][0]:
                    step[used + u] = (total + c[u], [*ts, u - 1])
        best = step
    return best[tau + 1]


def plan(fps: DataFrame, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition that is probed."""
    both = bit_counts(fps)
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    found = []
    for m in range(1, tau + 2):
        groups = correlated_groups(both, n, m)
        found.append((*allocate([costs(g, sample, np.diag(both), n, tau) for g in groups], tau), groups))
    _, ts, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, ts) if t >= 0]


def entries_of(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """bid, x, fp: the buckets of each fingerprint. Two entries of a bucket are within the partition's threshold if one has x."""
    keys = []
    for i, (bits, t) in enumerate(parts):
        for r in range((t + 1) // 2 + 1):
            for flip in combinations(bits, r):
                keys.append(F.struct(F.lit(i).alias("i"), F.lit(r <= t // 2).alias("x"), F.lit(signed(mask_of(bits))).alias("mask"), F.lit(signed(mask_of(list(flip)))).alias("flip")))
    each = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    return each.select(F.xxhash64("k.i", F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip"))).alias("bid"), F.col("k.x").alias("x"), "fp")


def in_blocks(entries: DataFrame, buckets: DataFrame, block: int) -> DataFrame:
    """gid, side, fp: buckets as groups (side 0: has x, 1: has not), large ones as pairs of blocks (2: has x, 3: any)."""
    hot = buckets.where(F.col("c") > block).select("bid", F.ceil(F.col("cx") / block).alias("nx"), F.ceil(F.col("c") / block).alias("ny"))
    e = entries.join(hot, "bid", "left")
    small = e.where("nx is null").select(F.col("bid").alias("gid"), F.when(F.col("x"), 0).otherwise(1).alias("side"), "fp")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    left = e.where("nx is not null and x").select("bid", own("nx").alias("bx"), every("ny").alias("by"), F.lit(2).alias("side"), "fp")
    right = e.where("nx is not null").select("bid", every("nx").alias("bx"), own("ny").alias("by"), F.lit(3).alias("side"), "fp")
    return small.unionByName(left.unionByName(right).select(F.xxhash64("bid", "bx", "by").alias("gid"), "side", "fp"))


def links(fps: DataFrame, tau: int = TAU, parts: list[tuple[list[int], int]] | None = None, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints; enough of them to join every group."""
    spark = fps.sparkSession
    n = fps.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    entries = entries_of(fps, plan(fps, n, tau) if parts is None else parts)
    buckets = entries.groupBy("bid").agg(F.count("*").alias("c"), F.sum(F.col("x").cast("long")).alias("cx"))
    rows, hot = buckets.agg(F.sum("c"), F.count(F.when(F.col("c") > block, 1))).first()
    groups = in_blocks(entries, buckets, block) if hot else entries.select(F.col("bid").alias("gid"), F.when(F.col("x"), 0).otherwise(1).alias("side"), "fp")
    shards = max(partitions(spark), -(-rows // TASK))

    def match(t: pa.Table) -> pa.Table:
        gid, side, fp = (t.column(c).to_numpy() for c in ("gid", "side", "fp"))
        right = side % 2 == 1
        order = np.lexsort((right, gid))
        gid, right, fp = gid[order], right[order], fp[order].view(U64)
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(gid)), bool), gid[1:] != gid[:-1])))
        stop = np.repeat(np.append(start[1:], len(gid)), np.diff(np.append(start, len(gid))))
        after = np.where(right, 0, stop - np.arange(len(gid)) - 1)
        total = np.concatenate(([0], np.cumsum(after)))
        found, at = [np.zeros((2, 0), np.int64)], 0

        def reduced(pairs: np.ndarray) -> np.ndarray:
            ids, code = np.unique(pairs, return_inverse=True)
            code = code.reshape(pairs.shape)
            label = forest(code[0], code[1], len(ids))
            some = np.flatnonzero(label != np.arange(len(ids)))
            return np.stack([ids[some], ids[label[some]]])

        while at < len(gid):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            times = after[at:to]
            left = np.repeat(np.arange(at, to), times)
            other = np.arange(len(left)) + total[at] - np.repeat(total[at:to], times) + left + 1
            apart = np.bitwise_count(fp[left] ^ fp[other])
            hit = np.flatnonzero((apart <= tau) & (apart > 0))
            if len(hit):
                found.append(reduced(np.stack([fp[left[hit]], fp[other[hit]]]).view(np.int64)))
            at = to
        a, b = reduced(np.concatenate(found, axis=1))
        return pa.table({"a": a, "b": b})

    return groups.groupBy(F.pmod(F.xxhash64(F.lit(7), "gid"), F.lit(shards)).alias("shard")).applyInArrow(match, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links), one row for each row of ``docs``."""

    def measure(batches):
        for t in chunks(batches, 1 << 22):
            fp = fingerprints(t.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("kid").combine_chunks(), pa.array(fp.view(np.int64))], names=["doc_id", "kid", "fp"])

    known = written(keyed(docs).select("doc_id", "kid", "text").mapInArrow(measure, "doc_id long, kid long, fp long"), "fingerprints")
    each = written(known.groupBy("fp").agg(F.min("kid").alias("kid")), "distinct_fingerprints")
    roots = connected(links(each.select("fp"), tau))
    of_fp = each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "kid", F.coalesce("root", "fp").alias("root"))
    first = of_fp.groupBy("root").agg(F.min("kid").alias("component"))
    out = known.join(of_fp.join(first, "root").select("fp", "component"), "fp")
    return out.select("doc_id", "fp", F.when(F.col("component") != F.lit(-(2**63)), F.col("component")).alias("component_id"))


def digits(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
