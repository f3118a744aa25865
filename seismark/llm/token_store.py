"""Token-ID output: concatenated ids with Elias-Fano document boundaries.

A store is a Parquet folder of shards, one row each: the ids of consecutive documents as little-endian 16- or 32-bit
integers, and the ascending ends of the documents in Elias-Fano form: the low bits of every end packed side by side,
the high bits in unary, and the position of every 256th one bit of the unary part, from which select() counts on.
That takes about 2 + log2(ids / documents) bits a document.

Defined results: a null text is an empty one (only the end id); rows with a null doc_id come first; rows that repeat an
id all stay, ordered by text; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.llm.common import chunks, partitions, piece_hash, shared_dir, text_buffer, worker_state

SAMPLE = 256
SHARD_SCHEMA = "part int, seq int, first_id long, n_docs int, n_ids long, width int, low_bits int, ids binary, doc_ids binary, id_is_null binary, low binary, high binary, samples binary"
#: Distinct pieces a worker remembers the ids of.
REMEMBERED = 1_500_000
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP = np.zeros(256, bool)
STOP[list(b",.!?;:")] = True
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14), *range(28, 32)]] = True


def encode_bounds(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Elias-Fano form of an ascending array: number of low bits, low bits, unary high bits, select samples."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    bits = max(0, (top // max(n, 1)).bit_length() - 1)
    low = (ends[:, None] >> np.arange(bits)) & 1 if bits else np.zeros((n, 0), np.int64)
    ones = (ends >> bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    pack = lambda x: np.packbits(x.astype(np.uint8), bitorder="little").tobytes()
    return bits, pack(low.ravel()), pack(high), ones[::SAMPLE].astype("<u4" if len(high) < 2**32 else "<u8").tobytes()


class Bounds:
    """Random access to the ends of a shard's documents without unpacking them."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.bits, self.low = n, bits, np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4" if len(high) * 8 < 2**32 else "<u8")

    def select(self, i: int) -> int:
        """Place of the one bit number i: from the sample before it, by counting whole bytes, then bits."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        if not left:
            return at
        byte = (at + 1) // 8
        first = int(self.high[byte]) >> ((at + 1) % 8) << ((at + 1) % 8)
        while True:
            count = first.bit_count()
            if left <= count:
                for _ in range(left - 1):
                    first &= first - 1
                return byte * 8 + (first & -first).bit_length() - 1
            left -= count
            byte += 1
            first = int(self.high[byte])

    def end(self, i: int) -> int:
        """Where document i ends (and the next starts)."""
        if i < 0:
            return 0
        at, value = i * self.bits, (self.select(i) - i) << self.bits
        raw = int.from_bytes(self.low[at // 8: (at + self.bits) // 8 + 1].tobytes(), "little")
        return value | (raw >> (at % 8)) & ((1 << self.bits) - 1)

    def all(self) -> np.ndarray:
        """Every end at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.bits) + (low << np.arange(self.bits)).sum(axis=1)


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where the tokenizer's own splitting always has a bound: before a single space, between an ASCII letter and
    a stop, and around a line feed between ink and a letter. Pieces between them encode alone as they do in the text."""
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    if len(buf) > 2:
        prev, cur, nxt = buf[:-2], buf[1:-1], buf[2:]
        ink = ~BLANK[prev]
        cut[1:-2] |= (cur == 32) & ink & ~BLANK[nxt]
        cut[1:-2] |= STOP[cur] & LETTER[prev]
        feed = (cur == 10) & ink & (prev < 128) & LETTER[nxt]
        cut[1:-2] |= feed
        cut[2:-1] |= feed
    return np.flatnonzero(cut[:-1])


def encode_texts(column, load, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, the end id after each, and the ends. Equal pieces are encoded once."""
    state = worker_state()
    tok, known = state.get("tokenizer"), state.setdefault("pieces", {})
    if tok is None:
        tok = state["tokenizer"] = load()
    if len(known) > REMEMBERED:
        known.clear()
    buf, off = text_buffer(column)
    starts = piece_starts(buf, off)
    ends = np.append(starts[1:], len(buf))
    codes = piece_hash(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    _, where, which = np.unique(codes, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    keys = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
    new = [k for k in keys if k not in known]
    for k, e in zip(new, tok.encode_batch_fast([k.decode("utf-8") for k in new], add_special_tokens=False)):
        known[k] = np.array(e.ids, np.uint32).tobytes()
    parts = [known[k] for k in keys]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    pool = np.frombuffer(b"".join(parts), np.uint32)
    base = np.cumsum(sizes) - sizes
    per = sizes[which]
    until = np.cumsum(per)
    ids = pool[np.arange(int(until[-1]) if len(until) else 0) + np.repeat(base[which] - (until - per), per)]
    words = np.searchsorted(starts, off)
    ends_at = np.concatenate(([0], until))[words[1:]]
    return np.insert(ids, ends_at, end_id), ends_at + np.arange(1, len(ends_at) + 1)


def write_store(docs: DataFrame, path: str, load_tokenizer, end_id: int = 0, vocabulary: int = 50257) -> None:
    """Encode doc_id, text in ascending doc_id order into a store at ``path``."""
    kind = "<u2" if vocabulary <= 65536 else "<u4"

    def shards(batches):
        from pyspark import TaskContext

        part, base = TaskContext.get().partitionId(), 0
        for seq, t in enumerate(chunks(batches)):
            ids, ends = encode_texts(t.column("text"), load_tokenizer, end_id)
            bits, low, high, samples = encode_bounds(ends)
            doc = t.column("doc_id").combine_chunks()
            row = {"part": part, "seq": seq, "first_id": base, "n_docs": len(ends), "n_ids": len(ids), "width": int(kind[-1]), "low_bits": bits,
                   "ids": ids.astype(kind).tobytes(), "doc_ids": doc.fill_null(0).to_numpy().astype("<i8").tobytes(),
                   "id_is_null": np.packbits(doc.is_null().to_numpy(zero_copy_only=False)).tobytes(), "low": low, "high": high, "samples": samples}
            base += len(ids)
            yield pa.RecordBatch.from_pylist([row], schema=ARROW)

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
     .mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path))


ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
                   ("width", pa.int32()), ("low_bits", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.binary()), ("id_is_null", pa.binary()),
                   ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document of a store.

    The ids before a part come from the totals of the parts, one row for each writing task.
    """
    store = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ends = Bounds(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"]).all()
                starts = np.concatenate(([0], ends[:-1]))
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                null = np.unpackbits(np.frombuffer(r["id_is_null"], np.uint8))[: r["n_docs"]].astype(bool)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)) * 4), pa.py_buffer(ids)])
                for at in range(0, len(ends), 1000):
                    cut = slice(at, at + 1000)
                    yield pa.record_batch([pa.array(np.frombuffer(r["doc_ids"], "<i8")[cut], mask=null[cut]), pa.array(starts[cut] + r["base"] + r["first_id"]),
                                           pa.array((ends - starts)[cut]), raw[cut].cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return store.join(base, "part").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, load_tokenizer, end_id: int = 0) -> DataFrame:
    """Write a store and read it back: doc_id, start, n_tokens, ids_crc32."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_store(docs, path, load_tokenizer, end_id)
    return read_store(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def public_tokenizer(name: str):
    """A loader for executors; the file is found there and is not shipped."""

    def load():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(name))

    return load


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
