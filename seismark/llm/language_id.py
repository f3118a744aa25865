"""Language identification with n-gram filters that answer for all languages at once.

One Bloom filter holds the frequent character n-grams of every language; it is sliced by language: a slot is a bit mask of
languages, and the AND of an n-gram's slots names all languages that contain it. For each text the bits are counted per
language, the share of n-grams that a language answers for is corrected by its filter's false-positive rate, and the
highest corrected share decides.

Training reads a bounded sample: about ``SAMPLE`` documents of each language, those of the lowest id hashes; the filter
keeps the ``PROFILE`` most frequent n-grams of each.

Defined results: ``und`` with score 0 for a null text, one without letters, or when nothing was learned; ties go to the
first language by name; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.llm.common import MULT, STEP, U64, chunks, mix, worker_state

SAMPLE, PROFILE, SIZES, HASHES = 2000, 20_000, (3, 4), 3
#: Bytes of text worked on at once: several 8-byte numbers stand for each character.
CHARS = 1 << 21


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    state = worker_state()
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return state["letters"]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts (lower case, every run of other characters one space), the text each belongs to,
    and which texts have a letter."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32) if t else np.array([32, 32], np.uint32) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(p) for p in points])))
    p = np.concatenate(points) if points else np.zeros(0, np.uint32)
    is_letter = letters()[p]
    owner = np.repeat(np.arange(len(texts)), np.diff(off))
    any_letter = np.bincount(owner[is_letter], minlength=len(texts)) > 0
    p = np.where(is_letter, p, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[off[:-1]] = True
    p, owner = p[keep].astype(U64), owner[keep]
    hashes, owners = [], []
    for n in SIZES:
        if len(p) < n:
            continue
        m = len(p) - n + 1
        h = np.full(m, n, U64)
        for j in range(n):
            h = h * MULT + p[j: j + m]
        ok = owner[:m] == owner[n - 1:]
        if n > 1:
            ok &= ~((p[:m] == 32) & (p[1: m + 1] == 32))
        hashes.append(mix(h[ok] * STEP))
        owners.append(owner[:m][ok])
    return np.concatenate(hashes) if hashes else np.zeros(0, U64), np.concatenate(owners) if owners else np.zeros(0, np.int64), any_letter


@dataclass
class Filter:
    langs: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        bits = int(len(self.masks) - 1).bit_length()
        return [((h >> U64(j * bits)) & U64(len(self.masks) - 1)).astype(np.int64) for j in range(HASHES)]

    def languages(self, h: np.ndarray) -> np.ndarray:
        """The mask of all languages that contain each n-gram."""
        return np.bitwise_and.reduce([self.masks[s] for s in self.slots(h)])

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of n-grams per text and language; which texts have a letter."""
        h, owner, ok = grams(texts)
        total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        masks = self.languages(h)
        out = np.empty((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            hit = (masks[:, i // 64] >> U64(i % 64)) & U64(1)
            out[:, i] = np.bincount(owner, weights=hit, minlength=len(texts)) / total
        return np.clip((out - self.false_rate) / (1 - self.false_rate), 0, 1), ok


def build(profiles: dict[str, np.ndarray]) -> Filter:
    """language -> n-gram hashes."""
    langs = sorted(profiles)
    load = sum(map(len, profiles.values()))
    slots = 1 << max(12, min(21, (8 * max(load, 1)).bit_length()))
    f = Filter(langs, np.zeros((slots, (len(langs) + 63) // 64), U64), np.zeros(len(langs)))
    for i, lang in enumerate(langs):
        for s in f.slots(profiles[lang]):
            f.masks[s, i // 64] |= U64(1 << (i % 64))
        fill = float(((f.masks[:, i // 64] >> U64(i % 64)) & U64(1)).mean())
        f.false_rate[i] = min(fill**HASHES, 0.999)
    return f


def train(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> Filter:
    """Learn from text and lang of rows that the caller chose (null langs are left out)."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return build({})
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample / n) * 2**20)))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2**20)) < share)

    def count(batches):
        for t in chunks(batches, CHARS):
            names, texts = np.array(t.column("lang").to_pylist(), object), t.column("text").to_pylist()
            for lang in sorted(set(names)):
                h, n = np.unique(grams([x for x, k in zip(texts, names == lang) if k])[0], return_counts=True)
                for at in range(0, len(h), 10_000):
                    yield pa.record_batch([pa.array([lang] * len(h[at: at + 10_000])), pa.array(h[at: at + 10_000].view(np.int64)), pa.array(n[at: at + 10_000])], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.where("n > 1").withColumn("_r", rank).where(F.col("_r") <= profile).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    found = {r["lang"]: np.array(r["grams"], np.int64).view(U64) for r in top.collect()}  # at most ``profile`` numbers a language
    return build({k: found.get(k, np.zeros(0, U64)) for k in sizes})


def identify(docs: DataFrame, model: Filter, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score; reads nothing but the text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a filter of at most 2**21 slots

    def apply(batches):
        f = shipped.value
        for t in chunks(batches, CHARS):
            texts = t.column("text").to_pylist()
            if f.langs:
                shares, ok = f.shares(texts)
                best = np.argmax(shares, axis=1)
                names = [f.langs[i] if k else "und" for i, k in zip(best, ok)]
                score = np.where(ok, shares[np.arange(len(texts)), best], 0.0)
            else:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(names, pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(apply, "key long, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
