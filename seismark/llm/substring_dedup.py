"""Substring dedup by level-wise doubling.

A window of ``width`` words that starts earlier elsewhere makes its words go. Comparing all windows at once would shuffle one
hash for each word of the corpus, so short windows are compared first, and only what repeats at one length is looked at
at twice that length:

* At a length below ``width``, each full window is represented by the smallest hash among its short windows. Equal windows
  have equal representatives, and neighbours mostly share one, so few short windows travel. A window whose representative
  occurs once in the corpus cannot repeat and is no candidate any more.
* At ``width`` itself, the surviving windows are compared under 128 bits (representative and own hash), and all but the
  first place, by document id and start, are returned.

Hashes travel in blocks: a row holds all hashes that a chunk of documents sends to one bucket. A chunk sends a window only
once however often it holds it, so a passage that fills the corpus reaches its bucket once a chunk.

Defined results: a null or blank text has no words; a null id comes before all others; rows that repeat an id and a text
are one document, returned as often as they occur; texts that share an id are different documents, ordered by a hash of the
text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seismark.llm.common import U64, by_bucket, chunks, double, keyed, mix, partitions, piece_hash, rows_keyed, sliding, text_buffer, window_hash, word_bounds, unpacked_rows

BLOCK_SCHEMA = "bucket int, own boolean, docs binary, counts binary, pos binary, key binary, hash binary, known binary"
ARROW_BLOCK = pa.schema([("bucket", pa.int32()), ("own", pa.bool_()), *((c, pa.binary()) for c in ("docs", "counts", "pos", "key", "hash", "known"))])
PLACED = "__places_of_windows"
PLACES = "kid long, tv long, places binary"
TOP = U64(2**64 - 1)


class Words:
    """Word hashes of a chunk of documents and their windows of doubling lengths."""

    def __init__(self, t: pa.Table, first: int, width: int) -> None:
        buf, off = text_buffer(t.column("text"))
        starts, ends, self.off = word_bounds(buf, off)
        h = piece_hash(buf, starts, ends)
        self.n, self.width = len(h), width
        self.docs = np.stack([t.column(c).combine_chunks().to_numpy() for c in ("kid", "tv")], axis=1)
        self.doc = np.repeat(np.arange(len(self.docs), dtype=np.int32), np.diff(self.off))
        self.hashes = {first: window_hash(h, first)}
        while first < width:
            self.hashes[2 * first] = double(self.hashes[first], first)
            first *= 2
        m = max(0, self.n - width + 1)
        self.whole = self.doc[:m] == self.doc[width - 1:] if m else np.zeros(0, bool)  # full windows inside one document

    def least(self, length: int) -> np.ndarray:
        """The representative of every full window at a length."""
        return sliding(np.minimum, self.hashes[length], self.width - length + 1)

    def picked(self, length: int, alive: np.ndarray) -> np.ndarray:
        """Places of the short windows that represent a living full window."""
        reach = self.width - length
        m = np.where(alive, self.least(length), U64(0))
        edge = np.zeros(reach, U64)
        return np.flatnonzero(sliding(np.maximum, np.concatenate((edge, m, edge)), reach + 1) == self.hashes[length]) if alive.any() else np.zeros(0, np.int64)

    def alive_after(self, length: int, places: list) -> np.ndarray:
        """Full windows whose representative at a length is among the places found repeated."""
        found = np.zeros(len(self.hashes[length]), bool)
        for d, at in enumerate(places):
            found[self.off[d] + np.frombuffer(at, np.int32)] = True
        return self.whole & (sliding(np.minimum, np.where(found, self.hashes[length], TOP), self.width - length + 1) == self.least(length))


def in_order(t: pa.Table) -> pa.Table:
    """Documents of a chunk by kid and tv, each once."""
    kid, tv = (t.column(c).combine_chunks().to_numpy() for c in ("kid", "tv"))
    order = np.lexsort((tv, kid))
    new = np.ones(len(order), bool)
    new[1:] = (kid[order][1:] != kid[order][:-1]) | (tv[order][1:] != tv[order][:-1])
    return t.take(order[new])


def blocks(w: Words, at: np.ndarray, key: np.ndarray, hashed: np.ndarray | None, n_buckets: int):
    """Rows for the buckets: one entry for each different key; and the places already known to be repeated here."""
    order = np.lexsort((at, key)) if hashed is None else np.lexsort((at, hashed, key))
    same = key[order][1:] == key[order][:-1]
    if hashed is not None:
        same &= hashed[order][1:] == hashed[order][:-1]
    later = np.concatenate(([False], same))
    first, repeat = order[~later], order[later]
    known = np.zeros(len(at), bool)  # the key occurs again in this chunk
    known[order[:-1][same]] = True
    sent = np.sort(first)
    bucket = ((key[sent] & U64(0xFFFFFFFF)) % U64(n_buckets)).astype(np.int64)
    by, bounds = by_bucket(bucket, n_buckets)
    for b in range(n_buckets):
        i = sent[by[bounds[b]: bounds[b + 1]]]
        if len(i):
            yield row(w, at[i], b, False, key[i], hashed[i] if hashed is not None else None, known[i])
    mine = np.sort(np.concatenate((repeat, first[known[first]])) if hashed is None else repeat)
    if len(mine):
        yield row(w, at[mine], int(key[mine[0]] % U64(n_buckets)), True, None, None, None)


def row(w: Words, at, bucket, own, key, hashed, known) -> dict:
    docs, counts = np.unique(w.doc[at], return_counts=True)
    pos = (at - w.off[w.doc[at]]).astype(np.uint32)
    return {"bucket": bucket, "own": own, "docs": w.docs[docs].tobytes(), "counts": counts.astype(np.uint32).tobytes(), "pos": np.diff(pos, prepend=np.uint32(0)).tobytes(),
            "key": None if key is None else key.tobytes(), "hash": None if hashed is None else hashed.tobytes(), "known": None if known is None else np.packbits(known).tobytes()}


def level(docs: DataFrame, before: int | None, length: int, first: int, width: int, n_buckets: int) -> DataFrame:
    """One length: the blocks of its windows. docs carries the places found repeated at the length ``before``."""

    def emit(batches):
        for t in chunks(batches):
            w = Words(t := in_order(t), first, width)
            alive = w.whole if before is None else w.alive_after(before, t.column("places").to_pylist())
            if length < width:
                at = w.picked(length, alive)
                key, hashed = w.hashes[length][at], None
            else:
                at = np.flatnonzero(alive)
                key, hashed = w.least(length // 2)[at], w.hashes[length][at]
            if len(at):
                yield from pa.Table.from_pylist(list(blocks(w, at, key, hashed, n_buckets)), schema=ARROW_BLOCK).to_batches(max_chunksize=16)

    return docs.mapInArrow(emit, BLOCK_SCHEMA)


def meet(found: DataFrame, last: bool, n_shards: int) -> DataFrame:
    """kid, tv, places: per document, the places whose key occurs elsewhere too; at the last length, earlier. The places
    go back to shards of documents in blocks, and each document gets one row."""

    def reduce(table: pa.Table) -> pa.Table:
        out = []
        rows = table.to_pylist()
        for r in rows:
            docs = np.frombuffer(r["docs"], np.int64).reshape(-1, 2)
            r["at"] = docs[np.repeat(np.arange(len(docs)), np.frombuffer(r["counts"], np.uint32))]
            r["pos"] = np.cumsum(np.frombuffer(r["pos"], np.uint32), dtype=np.uint32)
            if r["own"]:
                out.append((r["at"], r["pos"]))
        rows = [r for r in rows if not r["own"]]
        if rows:
            at, pos = np.concatenate([r["at"] for r in rows]), np.concatenate([r["pos"] for r in rows])
            key = np.frombuffer(b"".join(r["key"] for r in rows), U64)
            hashed = np.frombuffer(b"".join(r["hash"] for r in rows), U64) if last else np.zeros(len(key), U64)
            known = np.concatenate([np.unpackbits(np.frombuffer(r["known"], np.uint8))[: len(r["pos"])] for r in rows]).astype(bool)
            order = np.lexsort((hashed, key)) if last else np.argsort(key, kind="stable")
            same = (key[order][1:] == key[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
            start = np.flatnonzero(np.concatenate(([True], ~same)))
            size = np.diff(np.append(start, len(order)))
            many = np.repeat(size > 1, size)
            part = order[many]
            if last:
                group = np.repeat(np.arange(len(size)), size)[many]
                part = part[np.lexsort((pos[part], at[part, 1], at[part, 0], group))]
                lead = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
                top = np.maximum.accumulate(np.where(lead, np.arange(len(part)), 0)) if len(part) else part
                first = part[top]  # rows that repeat a document are no earlier place
                part = part[(at[part] != at[first]).any(axis=1) | (pos[part] != pos[first])]
            else:
                group = np.repeat(np.arange(len(size)), size)[many]
                head = part[np.searchsorted(group, group)] if len(group) else part
                other = np.zeros(len(size), bool)
                other[group[(at[part] != at[head]).any(axis=1) | (pos[part] != pos[head])]] = True
                part = part[other[group] & ~known[part]]
            out.append((at[part], pos[part]))
        at, pos = (np.concatenate([o[i] for o in out]) for i in (0, 1))
        shard = (mix(at[:, 0].view(U64) ^ mix(at[:, 1].view(U64))) % U64(n_shards)).astype(np.int64)
        by, bounds = by_bucket(shard, n_shards)
        rows = [{"shard": i, **dict(zip(("docs", "counts", "pos"), per_document(at[by[bounds[i]: bounds[i + 1]]], pos[by[bounds[i]: bounds[i + 1]]])))} for i in range(n_shards) if bounds[i] < bounds[i + 1]]
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("docs", "counts", "pos"))]))

    def gather(t: pa.Table) -> pa.Table:
        docs, counts, pos = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("docs", np.int64), ("counts", np.uint32), ("pos", np.uint32)))
        docs = docs.reshape(-1, 2)
        docs, counts, pos = per_document(docs[np.repeat(np.arange(len(docs)), counts)], pos)
        docs, ends = np.frombuffer(docs, np.int64).reshape(-1, 2), np.cumsum(np.frombuffer(counts, np.uint32), dtype=np.int64) * 4
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(np.concatenate((np.zeros(1, np.int64), ends))), pa.py_buffer(pos)])
        return pa.table({"kid": docs[:, 0], "tv": docs[:, 1], "places": raw.cast(pa.binary())})

    return found.groupBy("bucket").applyInArrow(reduce, "shard int, docs binary, counts binary, pos binary").groupBy("shard").applyInArrow(gather, PLACES)


def per_document(at: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Documents, their numbers of places, and the places, in order."""
    order = np.lexsort((pos, at[:, 1], at[:, 0]))
    at, pos = at[order], pos[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]).any(axis=1))))
    return at[start].tobytes(), np.diff(np.append(start, len(at))).astype(np.uint32).tobytes(), pos.astype(np.uint32).tobytes()


def repeats(docs: DataFrame, width: int = 20, first: int = 10) -> DataFrame:
    """kid, tv, places (arrays of 32-bit starts): windows of ``width`` words that start earlier elsewhere. docs: see keyed()."""
    if first < 1 or first >= width or width % first or (width // first) & (width // first - 1):
        raise ValueError("width must be first times a power of two")
    n = partitions(docs.sparkSession)
    length, before, source = first, None, docs
    while True:
        found = meet(level(source, before, length, first, width, n), length == width, n)
        if length == width:
            return found
        source, before, length = docs.join(found, ["kid", "tv"]), length, 2 * length


def kept_words(text: str | None, places: bytes | None, width: int) -> tuple[list[bytes], int]:
    """The words of a text without those that its windows at ``places`` cover, and how many it had."""
    words = text.encode().split() if text else []
    if not places:
        return words, len(words)
    cover = np.zeros(len(words) + width, np.int32)
    at = np.frombuffer(places, np.int32)
    cover[at] += 1
    cover[at + width] -= 1
    return list(compress(words, (np.cumsum(cover[: len(words)]) == 0).tolist())), len(words)


def dedup(docs: DataFrame, width: int = 20, first: int = 10) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    docs = keyed(docs)

    def keep(batches):
        for t in chunks(batches):
            n_words, n_removed, kept = [], [], []
            for text, places in zip(t.column("text").to_pylist(), t.column("places").to_pylist()):
                words, n = kept_words(text, places, width)
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.join(repeats(docs, width, first), ["kid", "tv"], "left").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")


def cut(docs: DataFrame, width: int = 20, first: int = 10) -> DataFrame:
    """docs with repeated passages cut out of the text; texts without any stay as they are, white space too."""
    found = repeats(keyed(docs), width, first)

    def keep(batches):
        for t in chunks(batches):
            texts = [x if not places else b" ".join(kept_words(x, places, width)[0]).decode() for x, places in zip(t.column("text").to_pylist(), t.column(PLACED).to_pylist())]
            out = t.drop_columns([PLACED])
            yield from out.set_column(out.column_names.index("text"), "text", pa.array(texts, pa.string())).combine_chunks().to_batches()

    rows = rows_keyed(docs).join(found.withColumnRenamed("places", PLACED), ["kid", "tv"], "left").select(F.col("row.text").alias("text"), F.col("row").dropFields("text").alias("row"), PLACED)
    return unpacked_rows(rows.mapInArrow(keep, T.StructType([f for f in rows.schema if f.name != PLACED])), docs.columns)
