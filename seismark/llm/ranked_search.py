"""Ranked lexical search for many items at once, sharing the work that items have in common.

The documents are tokenised once. What they hold of the items' terms is stored as postings, one row for a chunk of documents;
document frequencies come from the lengths of the lists. A fixed-size bitmap of the items' terms goes to the tasks as a
filter; terms that only share a bit drop out when the counts meet the items.

Common subexpressions: a block of items is compiled to a graph. Terms that the same items use (equally often) are a shared
term set and become one node; then pairs of nodes that several items use are merged into new nodes, the most shared pairs
first. For a chunk of documents every node's accumulator, the partial scores of its terms, is made once and added along the
graph; an item is the sum of its last nodes. Items with equal terms are one query. All scores are exact 64-bit integers, so the
order of addition does not matter.

Every chunk meets every block of items and returns the best of each item; windows over these give the final ranks.

Defined results: each row of the documents is a document, repeated rows are ranked one after the other; a null id is below
all others in ties and is returned as null; rows that repeat an item wholly count once, different texts under one item id are
items of their own; a null text has no terms and an item without terms no rows; other columns are ignored; empty tables give
no rows. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.llm.common import LOWER, U64, chunks, keyed, piece_hash, text_buffer, word_bounds, written

TOP = 20
#: Bits of the term filter; bytes of text of an index row; index rows of a slice; items and their terms of a block (on average).
SLOTS, TEXT, SLICE, ITEMS, TERMS = 1 << 24, 2 << 20, 8, 256, 50000
#: Items with one smallest term that still go to one block; nodes among which pairs are sought; rounds of merging.
ALIKE, NODES, ROUNDS = 64, 2048, 64
#: Numbers that the accumulators of a task hold at once.
CELLS = 6 << 20
NONE = -(2**63)
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
INDEX = "kids binary, sizes binary, terms binary, lens binary, docs binary, tfs binary, n_docs long, n_terms long"
PLAN = "block int, sigs binary, terms binary, weights binary, group_size binary, group_term binary, group_times binary, merges binary, item_size binary, item_node binary"


def term_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term and the n + 1 offsets between texts."""
    buf, off = text_buffer(column)
    buf = LOWER[buf]
    starts, ends, words = word_bounds(buf, off, BETWEEN)
    return piece_hash(buf, starts, ends), words


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, text) with their number, ordered by term and text."""
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
    return h[head], doc[head], np.diff(np.append(head, len(h)))


def item_terms(items: DataFrame) -> DataFrame:
    """kid, tv, h, times: the terms of every different item."""

    def emit(batches):
        for t in chunks(batches, TEXT):
            h, off = term_hashes(t.column("text"))
            h, item, times = counted(np.repeat(np.arange(t.num_rows), np.diff(off)), h)
            for at in range(0, len(h), 1 << 16):
                i = item[at: at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(t.column("kid").to_numpy()[i]), pa.array(t.column("tv").to_numpy()[i]), pa.array(h[at: at + (1 << 16)].view(np.int64)), pa.array(times[at: at + (1 << 16)])],
                                                 names=["kid", "tv", "h", "times"])

    once = keyed(items.select(F.col("item_id").alias("doc_id"), "text")).dropDuplicates(["kid", "tv"])
    return once.select("kid", "tv", "text").mapInArrow(emit, "kid long, tv long, h long, times long")


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for every term."""
    slot = F.pmod("h", F.lit(SLOTS))
    out, part = np.zeros(SLOTS // 8, np.uint8), 32768
    bits = terms.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / part).alias("part")).agg(F.bitmap_construct_agg((F.col("slot") % part)).alias("bits"))
    for r in bits.collect():
        out[r.part * part // 8: (r.part + 1) * part // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Postings of the documents for terms that the filter lets through, one row for each chunk of documents.

    kids and sizes (terms) of the chunk's documents, the terms with the lengths of their lists, documents and term frequencies.
    """

    def build(batches):
        for t in chunks(batches, TEXT):
            h, off = term_hashes(t.column("text"))
            sizes = np.diff(off)
            slot = (h % U64(SLOTS)).astype(np.int64)
            keep = np.flatnonzero(wanted[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            term, doc, tf = counted(np.repeat(np.arange(t.num_rows), sizes)[keep], h[keep])
            head = np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), term[1:] != term[:-1])))
            blobs = [t.column("kid").to_numpy(), sizes.astype(np.int64), term[head], np.diff(np.append(head, len(term))).astype(np.uint32), doc.astype(np.uint32), tf.astype(np.uint32)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])],
                                             names=["kids", "sizes", "terms", "lens", "docs", "tfs", "n_docs", "n_terms"])

    return keyed(docs).select("kid", "text").mapInArrow(build, INDEX)


def frequencies(postings: DataFrame) -> DataFrame:
    """h, df."""

    def lengths(batches):
        for b in batches:
            for terms, lens in zip(b.column("terms"), b.column("lens")):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(np.frombuffer(lens.as_buffer(), np.uint32).astype(np.int64))], names=["h", "df"])

    return postings.select("terms", "lens").mapInArrow(lengths, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def mined(uses: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Merges (left, right), each a new node, and the nodes of every item, from the nodes x items use table.

    In a round each node looks for the partner that it shares most items with; pairs that choose each other are merged.
    """
    rows = [r.copy() for r in uses]
    merges: list[tuple[int, int]] = []
    for _ in range(rounds):
        live = [i for i, r in enumerate(rows) if r.sum() > 1]
        live.sort(key=lambda i: rows[i].tobytes())
        before = len(merges)
        for at in range(0, len(live), NODES):
            some = np.array(live[at: at + NODES])
            m = np.array([rows[i] for i in some], np.float32)
            c = m @ m.T
            np.fill_diagonal(c, 0)
            choice = c.argmax(axis=1)
            for i in np.flatnonzero((choice[choice] == np.arange(len(some))) & (choice > np.arange(len(some))) & (c.max(axis=1) > 1)):
                a, b = int(some[i]), int(some[choice[i]])
                both = rows[a] & rows[b]
                rows[a], rows[b] = rows[a] & ~both, rows[b] & ~both
                rows.append(both)
                merges.append((a, b))
        if len(merges) == before:
            break
    table = np.array(rows, bool).reshape(len(rows), uses.shape[1])
    return merges, [np.flatnonzero(table[:, i]) for i in range(uses.shape[1])]


def compiled(t: pa.Table) -> pa.Table:
    """The graph of a block of items: base nodes with their terms, merges, and the nodes that add up to each item."""
    sig, h, times, weight = (t.column(c).to_numpy() for c in ("sig", "h", "times", "w"))
    sigs, item = np.unique(sig, return_inverse=True)
    terms, term = np.unique(h.view(U64), return_inverse=True)
    weights = np.zeros(len(terms), np.int64)
    weights[term] = weight
    symbols, symbol = np.unique(np.stack([term, times], axis=1), axis=0, return_inverse=True)
    used = np.zeros((len(symbols), len(sigs)), bool)
    used[symbol.ravel(), item] = True
    _, node = np.unique(np.packbits(used, axis=1), axis=0, return_inverse=True)  # equal users: one shared term set
    node = node.ravel()
    order = np.argsort(node, kind="stable")
    size = np.bincount(node)
    merges, of_item = mined(used[order[np.cumsum(size) - size]])
    blobs = [sigs, terms, weights, size.astype(np.int64), symbols[order, 0], symbols[order, 1], np.array(merges, np.int64).reshape(-1, 2), np.array([len(x) for x in of_item], np.int64), np.concatenate(of_item).astype(np.int64)]
    names = ["sigs", "terms", "weights", "group_size", "group_term", "group_times", "merges", "item_size", "item_node"]
    return pa.table({"block": t.column("block").slice(0, 1).cast(pa.int32()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(names, blobs)}})


def plans(terms: DataFrame, blocks: int) -> DataFrame:
    """One row for each block of items; items with a common smallest term meet in a block unless there are too many of them."""
    per = terms.groupBy("sig").agg(F.min(F.xxhash64("h")).alias("least"))
    many = per.groupBy("least").agg(F.count("*").alias("alike"))
    key = F.when(F.col("alike") > ALIKE, F.xxhash64("sig")).otherwise(F.col("least"))
    block = per.join(many, "least").select("sig", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    return terms.join(block, "sig").select("block", "sig", "h", "times", "w").groupBy("block").applyInArrow(compiled, PLAN)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores above zero, ties by position, best first."""
    i = np.flatnonzero(score > 0)
    if len(i) > k:
        worst = np.partition(score[i], len(i) - k)[len(i) - k]
        above, level = i[score[i] > worst], i[score[i] == worst]
        i = np.concatenate((above, level[: k - len(above)]))
    return i[np.lexsort((i, -score[i]))]


class Graph:
    """A block's plan as arrays."""

    def __init__(self, plan: dict) -> None:
        get = lambda name, kind=np.int64: np.frombuffer(plan[name], kind)
        self.sigs, self.terms, self.weights, self.size = get("sigs"), get("terms", U64), get("weights"), get("group_size")
        self.term, self.times, self.merges = get("group_term"), get("group_times"), get("merges").reshape(-1, 2)
        self.items = np.split(get("item_node"), np.cumsum(get("item_size"))[:-1])

    def score(self, row: dict, n: int, total: int):
        """(positions, their kids, items x positions scores) of an index row's documents, by id, in parts."""
        kids, sizes = np.frombuffer(row["kids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        by_kid = np.argsort(kids, kind="stable")
        place = np.empty(len(kids), np.int64)
        place[by_kid] = np.arange(len(kids))
        have, lens = np.frombuffer(row["terms"], U64), np.frombuffer(row["lens"], np.uint32)
        at = np.searchsorted(self.terms, have)
        known = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == have)
        if not known.any():
            return
        row_of = np.zeros(len(self.terms), np.int64)  # 0: not in this chunk
        row_of[at[known]] = np.arange(1, int(known.sum()) + 1)
        wide = np.repeat(known, lens)
        doc, tf = np.frombuffer(row["docs"], np.uint32)[wide].astype(np.int64), np.frombuffer(row["tfs"], np.uint32)[wide].astype(np.int64)
        term = np.repeat(at[known], lens[known])
        m = 75 + 25 * sizes * n // total
        value = self.weights[term] * (1000000000 * tf // (1000 * tf + 12 * m[doc]))
        line, spot = row_of[term], place[doc]
        nodes, present = len(self.size) + len(self.merges), int(known.sum()) + 1
        step = max(1, CELLS // (nodes + present))
        first = np.cumsum(self.size) - self.size
        for start in range(0, len(kids), step):
            width = min(step, len(kids) - start)
            base = np.zeros((present, width), np.int64)
            i = np.flatnonzero((spot >= start) & (spot < start + width))
            base[line[i], spot[i] - start] = value[i]
            node = np.empty((nodes, width), np.int64)
            for g in range(len(self.size)):
                span = slice(first[g], first[g] + self.size[g])
                node[g] = self.times[span] @ base[row_of[self.term[span]]]
            for g, (a, b) in enumerate(self.merges, start=len(self.size)):
                np.add(node[a], node[b], out=node[g])
            yield kids[by_kid[start: start + width]], np.array([node[x].sum(axis=0) for x in self.items])


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    postings = written(index(docs, term_filter(terms := written(item_terms(items), "item_terms"))), "postings")
    rows, n, total = postings.agg(F.count("*"), F.sum("n_docs"), F.sum("n_terms")).first()
    weight = F.floor(1000 * F.log(F.lit(float(2 * (n or 0) + 2)) / (2 * F.col("df") + 1))).cast("long")
    classes = terms.groupBy("kid", "tv").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("h", "times")))).alias("sig"))
    lead = classes.groupBy("sig").agg(F.min(F.struct("kid", "tv")).alias("k")).select("sig", "k.kid", "k.tv")
    weighted = written(terms.join(lead, ["kid", "tv"]).join(frequencies(postings), "h").select("sig", "h", "times", weight.alias("w")).where("w > 0"), "weighted_terms")
    queries, instances = weighted.agg(F.count_distinct("sig"), F.count("*")).first()
    blocks, slices = max(1, -(-queries // ITEMS), -(-instances // TERMS)), max(1, -(-rows // SLICE))

    def rank(plan: pa.Table, part: pa.Table) -> pa.Table:
        if plan.num_rows and part.num_rows:
            graph = Graph(plan.to_pylist()[0])
            found: list[list] = [[] for _ in graph.sigs]
            for i in range(part.num_rows):
                for kids, score in graph.score(part.slice(i, 1).to_pylist()[0], n, total):
                    for q, s in enumerate(score):
                        j = best(s, k)
                        found[q].append((s[j], kids[j]))
            out = []
            for q, x in enumerate(found):
                if x:
                    s, kid = (np.concatenate(v) for v in zip(*x))
                    j = np.lexsort((kid, -s))[:k]
                    out.append((np.full(len(j), graph.sigs[q]), s[j], kid[j]))
            if out:
                sig, s, kid = (np.concatenate(v) for v in zip(*out))
                return pa.table({"sig": sig, "score": s, "kid": kid})
        return pa.table({c: np.zeros(0, np.int64) for c in ("sig", "score", "kid")})

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = plans(weighted, blocks).select("*", every(slices).alias("slice"))
    right = postings.select("kids", "sizes", "terms", "lens", "docs", "tfs", F.pmod(F.xxhash64("kids", "sizes"), F.lit(slices)).cast("int").alias("slice")).select("*", every(blocks).alias("block"))
    scored = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(rank, "sig long, score long, kid long")
    w = W.partitionBy("sig").orderBy(F.desc("score"), "kid")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    name = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return top.withColumnRenamed("kid", "doc").join(classes, "sig").select(name("kid").alias("item_id"), F.col("rank").cast("int").alias("rank"), name("doc").alias("doc_id"), "score")
