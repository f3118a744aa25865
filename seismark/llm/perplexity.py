"""Quality by perplexity: an interpolated modified Kneser-Ney model of character n-grams, trained on all trusted text.

Four characters, as 16-bit codes, fill one 64-bit number, so contexts and suffixes are shifts. Documents are dealt to shards
by id, together with their labels. A shard sends each different n-gram once, with its count in trusted text, to the bucket
of that n-gram; buckets add the counts up. The counts are joined order by order: an n-gram with its count, its context's
totals and the probability of its suffix. The logarithms go back to the shards that asked, where each document's mean is
its log-perplexity. A document stays if that is at most the quantile of the trusted documents of its language.

Counts, contexts and probabilities are tables joined on n-grams; nothing of the model passes the driver or is broadcast but
one row of discounts for each order.

Defined results: null and blank texts have no perplexity and are not kept; a null lang is language ``und``; languages without
trusted documents take the quantile over all trusted ones; without any trusted text nothing is kept back; of several labels
of a document the worst counts; rows that repeat a document are judged alike and counted as often as they occur (a null id is
never trusted); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.llm.common import U64, by_bucket, mix, partitions, worker_state, written

ORDER, START, BASE_BITS = 4, 1, 16
#: Characters that are worked on at once.
CHARS = 1 << 21
QUANTILE, MARGIN, SALTS = 0.995, 0.05, 64


def white_points() -> np.ndarray:
    state = worker_state()
    if "white_points" not in state:
        state["white_points"] = np.fromiter((chr(c).isspace() for c in range(0x3001)), bool, 0x3001)
    return state["white_points"]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of all texts, and the number of characters of each text. White space counts as
    one space, none at either end; characters beyond the basic plane share codes."""
    parts, counts = [], []
    table = white_points()
    for t in texts:
        p = np.frombuffer(t.encode("utf-32-le"), np.uint32) if t else np.zeros(0, np.uint32)
        blank = (p < len(table)) & table[np.minimum(p, len(table) - 1)]
        p = np.where(blank, np.uint32(32), p)
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        p = p[keep]
        p = p[1:] if len(p) and p[0] == 32 else p
        p = p[:-1] if len(p) and p[-1] == 32 else p
        counts.append(len(p))
        parts.append(np.full(ORDER - 1, START, np.uint32))
        parts.append(np.maximum(p & np.uint32(0xFFFF), 2))
    p = np.concatenate(parts).astype(U64) if parts else np.zeros(0, U64)
    if len(p) < ORDER:
        return np.zeros(0, U64), np.array(counts, np.int64)
    g = p[: len(p) - ORDER + 1].copy()
    for j in range(1, ORDER):
        g = g << U64(BASE_BITS) | p[j: len(p) - ORDER + 1 + j]
    own = np.zeros(len(p), bool)
    at = np.cumsum(np.array(counts) + ORDER - 1) - np.array(counts) - ORDER + 1
    reps = np.array(counts, np.int64)
    own[np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(at, reps)] = True
    return g[own[: len(g)]], np.array(counts, np.int64)


def slices(texts: list[str | None], size: int):
    """Bounds of runs of texts with about ``size`` characters."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, code = np.unique(values, return_inverse=True)
    return u, np.bincount(code, weights=counts, minlength=len(u)).astype(np.int64)


COUNTED = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def count_grams(docs: DataFrame, trusted: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, shard, grams (64-bit, different), counts (their number in the shard's trusted text, 32-bit)."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = left.column("doc_id").to_pylist(), left.column("text").to_pylist()
        good = set(right.column("doc_id").to_pylist())
        g, c = np.zeros(0, U64), np.zeros(0, np.int64)
        for a, b in slices(texts, CHARS):
            grams, n = ngrams(texts[a:b])
            flag = np.repeat(np.array([i in good for i in ids[a:b]], np.int64), n)
            u, k = merged(grams, flag)
            g, c = merged(np.concatenate((g, u)), np.concatenate((c, k)))
        if not len(g):
            return COUNTED.empty_table()
        shard = left.column("shard")[0].as_py()
        order, bounds = by_bucket((mix(g) % U64(n_buckets)).astype(np.int64), n_buckets)
        rows = [{"bucket": b, "shard": shard, "grams": g[order[bounds[b]: bounds[b + 1]]].tobytes(), "counts": c[order[bounds[b]: bounds[b + 1]]].astype(np.uint32).tobytes()} for b in range(n_buckets)]
        return pa.Table.from_pylist([r for r in rows if r["grams"]], schema=COUNTED)

    return docs.groupBy("shard").cogroup(trusted.groupBy("shard")).applyInArrow(count, "bucket int, shard int, grams binary, counts binary")


def gram_table(counted: DataFrame) -> DataFrame:
    """bucket, g, c: every n-gram of the corpus and its count in trusted text."""

    def add(t: pa.Table) -> pa.Table:
        g, c = (np.frombuffer(b"".join(t.column(x).to_pylist()), k) for x, k in (("grams", U64), ("counts", np.uint32)))
        g, c = merged(g, c)
        return pa.table({"bucket": pa.array(np.full(len(g), t.column("bucket")[0].as_py(), np.int32)), "g": g.view(np.int64), "c": c})

    return counted.groupBy("bucket").applyInArrow(add, "bucket int, g long, c long")


def suffix(g: Column, order: int) -> Column:
    return g.bitwiseAND(F.lit((1 << BASE_BITS * order) - 1).cast("long"))


def discounts(counts: DataFrame) -> DataFrame:
    """One row: what is taken off counts of 1, 2 and more, from the numbers of n-grams that occur one to four times."""
    n = [F.sum((F.col("c") == i).cast("double")) for i in range(1, 5)]
    one = counts.agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
    y = F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0)), F.lit(0.5))
    cut = lambda i: F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.5 * i)), F.lit(0.05)), F.lit(i - 0.05))
    return one.select(*[cut(i).alias(f"d{i}") for i in (1, 2, 3)])


def probabilities(table: DataFrame) -> DataFrame:
    """bucket, g, logp of every n-gram of the table, by interpolation down to single characters and the uniform share."""
    counts = {ORDER: table.where("c > 0").select("g", "c")}
    for k in range(ORDER - 1, 0, -1):  # below the top, a count is the number of different n-grams that end so
        counts[k] = counts[k + 1].groupBy(suffix(F.col("g"), k).alias("g")).agg(F.count("*").alias("c"))
    asked = {ORDER: table.select("bucket", "g")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(suffix(F.col("g"), k).alias("g")).distinct()
    low = None
    for k in range(1, ORDER + 1):
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        less = counts[k].crossJoin(F.broadcast(discounts(counts[k]))).select("g", F.col("c"), taken.alias("d"))  # one row
        context = F.shiftrightunsigned("g", BASE_BITS) if k > 1 else F.lit(0).cast("long")
        totals = less.groupBy(context.alias("h")).agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("back"), F.count("*").alias("kinds"))
        seen = asked[k].withColumn("h", context).join(less, "g", "left")
        seen = seen.join(F.broadcast(totals) if k == 1 else totals, "h", "left")  # at order 1 one row
        if low is None:
            below = F.lit(1.0) / (F.coalesce("kinds", F.lit(0)) + 1)
        else:
            seen, below = seen.withColumn("s", suffix(F.col("g"), k - 1)).join(low.select(F.col("g").alias("s"), F.col("p").alias("below")), "s", "left"), F.col("below")
        p = F.coalesce(F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total"), F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * below
        low = seen.select(*(["bucket"] if k == ORDER else []), "g", p.alias("p"))
    return low.select("bucket", "g", F.log("p").alias("logp"))


def answers(counted: DataFrame, scored: DataFrame) -> DataFrame:
    """shard, grams, logp (64-bit floats): what each shard asked a bucket for."""

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        g, p = right.column("g").to_numpy().view(U64), right.column("logp").to_numpy()
        order = np.argsort(g)
        g, p = g[order], p[order]
        rows = [{"shard": s, "grams": x, "logp": p[np.searchsorted(g, np.frombuffer(x, U64))].tobytes()} for s, x in zip(left.column("shard").to_pylist(), left.column("grams").to_pylist())]
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("grams", pa.binary()), ("logp", pa.binary())]))

    return counted.select("bucket", "shard", "grams").groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(give, "shard int, grams binary, logp binary")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, trusted, n_chars, loss (mean negative logarithm per character, null without characters)."""
    n = partitions(docs.sparkSession)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("shard")
    docs = docs.select(shard, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    trusted = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
               .where("q > 0 and coalesce(t, 0) = 0").select(shard, "doc_id"))
    counted = written(count_grams(docs, trusted, n), "grams")
    scored = probabilities(written(gram_table(counted), "counts"))
    back = answers(counted, scored).unionByName(trusted, allowMissingColumns=True)

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = left.column("doc_id").to_pylist(), left.column("text").to_pylist()
        good = set(right.column("doc_id").drop_null().to_pylist())
        g = np.frombuffer(b"".join(x for x in right.column("grams").to_pylist() if x), U64)
        p = np.frombuffer(b"".join(x for x in right.column("logp").to_pylist() if x), np.float64)
        order = np.argsort(g)
        g, p = g[order], p[order]
        n_chars, loss = [], []
        for a, b in slices(texts, CHARS):
            grams, n = ngrams(texts[a:b])
            total = np.bincount(np.repeat(np.arange(b - a), n), weights=-p[np.searchsorted(g, grams)], minlength=b - a)
            n_chars.append(n)
            loss.append(np.where(n > 0, total / np.maximum(n, 1), np.nan))
        n_chars, loss = np.concatenate([*n_chars, np.zeros(0, np.int64)]), np.concatenate([*loss, np.zeros(0)])
        return pa.table({"doc_id": left.column("doc_id"), "lang": left.column("lang"), "trusted": pa.array([i in good for i in ids], pa.bool_()),
                         "n_chars": n_chars, "loss": pa.array(loss, from_pandas=True)})

    return docs.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(losses, "doc_id long, lang string, trusted boolean, n_chars long, loss double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, limit, kept: the limit is the quantile of the trusted documents' loss in the
    language, with a margin for documents that the model has not seen."""
    losses = written(score(docs, labels), "losses")
    good = losses.where("trusted and loss is not null")
    limit = lambda df, *by: df.groupBy(*by).agg((F.percentile_approx("loss", quantile, 100_000) * (1 + margin)).alias("limit"))
    whole = F.broadcast(limit(good).select(F.col("limit").alias("overall")))  # one row
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt")  # one language may hold most documents
    limits = limit(good, "lang").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    out = losses.select("*", salt).join(limits, ["lang", "_salt"], "left").crossJoin(whole)
    bound = F.coalesce("limit", "overall")
    return out.select("doc_id", "lang", "n_chars", F.exp("loss").alias("perplexity"), F.exp(bound).alias("limit"),
                      F.coalesce(F.col("loss") <= F.coalesce(bound, F.lit(float("inf"))), F.lit(False)).alias("kept"))
