"""Shared parts of the training-data operators: Arrow text batches, word hashes, packed columns, written tables.

Texts are handled as the byte buffers of Arrow string columns. Words are found and hashed by numpy over the whole
buffer, so no Python object is made per word.
"""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules["seismark.llm"])  # executors need no copy of the package

U64 = np.uint64
MULT, STEP, SEED = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: By number of bytes: which bits of eight bytes belong to a piece.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Pieces of more bytes are hashed one by one, in blocks.
LONG, BLOCK = 256, 4 << 20


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for caches that later tasks of the worker use again."""
    return sys.modules.setdefault("_seismark_worker_state", types.ModuleType("_seismark_worker_state")).__dict__


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset (tests on a local master)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{root.rstrip('/')}/seismark-llm/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lost executors cost nothing that is finished.

    What the job shuffled is not needed after it and is released at its end.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all the input's."""
    h = h ^ (h >> U64(32))
    h *= STEP
    h ^= h >> U64(29)
    h *= MULT
    h ^= h >> U64(32)
    return h


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def word_bounds(buf: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets between texts. A word ends at white bytes and text ends."""
    ink = ~white[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edges = off[1:-1]
    edges = edges[edges < len(buf)]
    first[edges] = ink[edges]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = edges[edges > 0] - 1
    last[inner] = ink[inner]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def piece_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time; longer pieces go round again for their next eight."""
    size = ends - starts
    out = size.astype(U64) * SEED
    if not len(starts):
        return out
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(buf) + 1,), (1,))
    left = np.minimum(size, 8)
    out ^= eights[starts] & MASKS[left]
    out = mix(out)
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest) and done < LONG:
        left = np.minimum(size[rest] - done, 8)
        out[rest] = mix(out[rest] * MULT ^ (eights[starts[rest] + done] & MASKS[left]))
        done += 8
        rest = rest[size[rest] > done]
    for i in rest:  # very long pieces one by one
        for at in range(int(starts[i]) + done, int(ends[i]), BLOCK):
            part = padded[at: min(at + BLOCK, int(ends[i]))]
            part = np.concatenate((part, np.zeros(-len(part) % 8, np.uint8))).view(U64)
            powers = np.full(len(part), MULT, U64)
            out[i: i + 1] = mix(out[i: i + 1] * MULT ^ (mix(part + SEED) * np.multiply.accumulate(powers)).sum(dtype=U64))
    return out


def sliding(op: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each run of ``width`` values; by doubling, so log(width) passes."""
    if len(a) < width:
        return a[:0]
    m, w = a, 1
    while 2 * w <= width:
        m = op(m[:-w], m[w:])
        w *= 2
    return op(m[: len(a) - width + 1], m[width - w: width - w + len(a) - width + 1]) if w < width else m


def double(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows twice as long, from those of ``width`` items."""
    return mix(h[:-width] * MULT + h[width:]) if len(h) > width else h[:0]


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` items of one array."""
    if len(h) < width:
        return h[:0]
    n = len(h) - width + 1
    out = h[:n].copy()
    for j in range(1, width):
        out *= STEP
        out += h[j: j + n]
    return mix(out)


def merge_slices(parts: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings equal buckets together, and the n + 1 bounds of the buckets in it."""
    order = np.argsort(bucket.astype(np.uint16) if n < 65536 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def keyed(docs: DataFrame) -> DataFrame:
    """kid, tv, text: the id (null: before all others) and the text's hash tell documents apart, so rows that repeat
    one document count once and different texts under one id stay apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("kid"), F.xxhash64("text").alias("tv"),
                       F.col("text"), F.col("doc_id").cast("long").alias("doc_id"))


def rows_keyed(docs: DataFrame) -> DataFrame:
    """kid and tv as in keyed(), and the whole row as a struct, so that no column of it clashes."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("kid"), F.xxhash64("text").alias("tv"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))


def packed_rows(docs: DataFrame) -> DataFrame:
    """text, and all other columns as the struct ``row``, so that none of them clashes with an operator's own."""
    return docs.select("text", F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]).alias("row"))


def unpacked_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of packed_rows() as they were."""
    return df.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])


def chunks(batches, limit: int = 1 << 23):
    """Arrow batches joined or cut to about ``limit`` bytes of their text column each; a single longer text stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        column = batch.column("text")
        lengths = np.frombuffer(pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64()).buffers()[1], np.int64)[: len(column)] if len(column) else np.zeros(0, np.int64)
        at = 0
        total = np.cumsum(lengths)
        while at < len(column):
            before = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + limit - size, "right")))
            if held and total[at] - before > limit - size:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(at, stop - at))
            size += int(total[stop - 1] - before)
            at = stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
