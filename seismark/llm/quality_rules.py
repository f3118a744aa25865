"""Quality rules: document statistics, fixed limits, and gradient-boosted trees with monotonic constraints.

The trees are fitted on the driver from a bounded sample of labelled documents (``SAMPLE`` rows) and flattened into numpy
node arrays; executors walk all rows of a batch down all trees at once.

Defined results: a null or blank text has no words, so it fails the limit on words; repeated rows are judged alike; other
columns are ignored; an empty table gives no rows; without labels of both kinds the limits alone decide. Of several labels
of a document the lowest counts; null labels count for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seismark.llm.common import MULT, WHITE, chunks, mix, piece_hash, text_buffer, window_hash, word_bounds

#: Bytes of text worked on at once: several numbers stand for each byte.
BYTES = 1 << 22
#: Labelled documents that the trees are fitted on; those of the lowest id hashes where there are more.
SAMPLE = 20_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees; +1: more of it can only speak for quality, -1: only against, 0: free.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": -1, "exclaims": -1, "digits": 0, "distinct": 1, "stops": 0}


def _count(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _table(chars: bytes | range) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SYMBOL, CAPITAL, EXCLAIM, DIGIT, FULL = _table(b"#*$%&|<>"), _table(range(65, 91)), _table(b"!"), _table(range(48, 58)), _table(b".,;:")


def _later_copies(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each owner, how many of its keys equal an earlier one of its own."""
    both = np.unique(mix(keys ^ mix(owner.astype(np.uint64) * MULT)), return_index=True)[1]
    return np.bincount(owner, minlength=n) - np.bincount(owner[both], minlength=n)


def statistics(column) -> tuple[np.ndarray, np.ndarray]:
    """STATS (integers) and FEATURES (doubles) of each text of an Arrow column."""
    buf, off = text_buffer(column)
    n = len(off) - 1
    starts, ends, words = word_bounds(buf, off)
    n_words = np.diff(words)
    doc = np.repeat(np.arange(n), n_words)
    hashes = piece_hash(buf, starts, ends)
    lead = (buf & 0xC0) != 0x80
    inside = ~WHITE[buf]
    word_chars = _count(lead & inside, off)
    symbols = _count(SYMBOL[buf], off)
    # lines
    first = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], np.flatnonzero(buf == 10) + 1))).astype(np.int64)
    first = first[first < len(buf)]
    line_end = np.minimum(np.append(first[1:], len(buf)), len(buf))
    line_doc = np.searchsorted(off, first, "right") - 1
    line_end = line_end - ((line_end > first) & (buf[np.maximum(line_end - 1, 0)] == 10)) if len(first) else line_end
    inked = np.concatenate(([0], np.cumsum(inside)))
    full = inked[line_end] > inked[first] if len(first) else np.zeros(0, bool)
    first, line_end, line_doc = first[full], line_end[full], line_doc[full]
    dup_lines = _later_copies(piece_hash(buf, first, line_end), line_doc, n)
    # windows of eight words
    repeats = np.zeros(n, np.int64)
    if len(hashes) >= 8:
        h = window_hash(hashes, 8)
        at = np.flatnonzero(doc[:-7] == doc[7:])
        key = mix(h[at] ^ mix(doc[at].astype(np.uint64) * MULT))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.subtract.at(cover, at[twice] + 8, 1)
        repeats = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    stats = np.stack([n_words, word_chars, symbols, dup_lines, repeats], axis=1).astype(np.int64)
    w, c, lines = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(np.bincount(line_doc, minlength=n), 1)
    distinct = n_words - _later_copies(hashes, doc, n)
    feats = np.stack([np.log1p(n_words), word_chars / w, symbols / c, dup_lines / lines, repeats / w, _count(CAPITAL[buf], off) / c,
                      _count(EXCLAIM[buf], off) / c, _count(DIGIT[buf], off) / c, distinct / w, _count(FULL[buf], off) / c], axis=1).astype(np.float64)
    return stats, feats


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself, so a fixed number of steps ends everywhere."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality for each row of features."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], n_trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64,
              ridge: float = 1.0, least: int = 20) -> Trees:
    """Boosting on logistic loss over quantile bins. A split on a constrained feature must order its children's values
    that way, and their subtrees stay on either side of the middle between them."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list] = []
    roots = []

    def leaf(v: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), v])
        return len(nodes) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-gs / (hs + ridge), low, high))
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - ((gs - gl) * vr + (hs - hl + ridge) * vr**2 / 2)
                ok = (nl >= least) & (len(rows) - nl >= least) & (signs[j] * (vr - vl) >= 0)
                if ok.any():
                    k = int(np.argmax(np.where(ok, gain, -np.inf)))
                    if best is None or gain[k] > best[0]:
                        best = (gain[k], j, k, vl[k], vr[k])
        if best is None or best[0] <= -(gs * own + (hs + ridge) * own**2 / 2) + 1e-9:
            return leaf(rate * own)
        _, j, k, vl, vr = best
        middle = (vl + vr) / 2
        inside = binned[rows, j] <= k
        me = leaf(0.0)
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
        left = grow(rows[inside], level + 1, *bounds[0], g, h)
        right = grow(rows[~inside], level + 1, *bounds[1], g, h)
        nodes[me] = [j, float(edges[j][k]), left, right, 0.0]
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
        f, t, le, r, v = (np.array(c) for c in zip(*nodes))
        one = Trees(f, t, le, r, v, np.array(roots[-1:]), depth, 0.0)
        q = one.score(x)
        margin = margin + np.log(np.clip(q, 1e-12, 1)) - np.log(np.clip(1 - q, 1e-12, 1))
    return Trees(f, t, le, r, v, np.array(roots), depth, base)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Fit on at most ``sample`` labelled documents; null without both kinds of labels."""
    chosen = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def measure(batches):
        for t in chunks(batches, BYTES):
            x = statistics(t.column("text"))[1]
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), t.column("quality").combine_chunks().cast(pa.float64())], names=["x", "y"])

    # one text for each id, so that at most ``sample`` rows are collected however often an id is repeated
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
            .groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
            .select("text", "quality").mapInArrow(measure, "x array<double>, y double").collect())
    rows = sorted((r["x"], r["y"]) for r in rows)
    x, y = np.array([r[0] for r in rows]), np.array([float(r[1] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return fit_trees(x, y, list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees | None, least_kept: float = 0.5) -> DataFrame:
    """docs with STATS, base_failed, score and kept added; every other column stays (own columns replace clashing ones)."""
    names = [c for c in docs.columns if c not in (*STATS, "base_failed", "score", "kept")]
    own = [*((c, T.LongType()) for c in STATS), ("base_failed", T.BooleanType()), ("score", T.DoubleType()), ("kept", T.BooleanType())]
    schema = T.StructType([*(f for f in docs.schema if f.name in names), *(T.StructField(c, kind) for c, kind in own)])

    def apply(batches):
        for t in chunks(batches, BYTES):
            stats, x = statistics(t.column("text"))
            failed = (stats[:, 0] < 20) | (100 * stats[:, 4] > 30 * stats[:, 0])
            score = trees.score(x) if trees is not None else np.ones(len(x))
            out = [*(t.column(i).combine_chunks() for i in range(t.num_columns)), *(pa.array(stats[:, i]) for i in range(len(STATS))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least_kept))]
            yield pa.RecordBatch.from_arrays(out, names=[*t.column_names, *STATS, "base_failed", "score", "kept"])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(apply, schema)
