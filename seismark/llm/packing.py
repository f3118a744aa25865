"""Length buckets of least padding and token-budget batches.

Documents longer than ``max_len`` tokens are cut into pieces of at most that many, none is shortened. The histogram of
piece lengths (at most ``max_len`` rows, whatever the number of documents) goes to the driver; dynamic programming finds
the ``n_buckets`` upper bounds with the fewest padding tokens in all. Inside a bucket, pieces are shuffled by hash and
fill batches of ``budget // bound`` slots, so a batch padded to its bound holds at most ``budget`` tokens.

Defined results: documents without tokens (null or blank texts) get one row with no bucket and no batch; a null id is an
id like others; repeated rows are packed as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.llm.common import text_buffer, word_bounds, written

#: Pieces that are numbered in one task; more of them mean more tasks, not larger ones.
RUN = 100_000


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens: the words of each text; another tokenizer's lengths serve as well."""

    def count(batches):
        for b in batches:
            n = np.diff(word_bounds(*text_buffer(b.column("text")))[2])
            yield pa.record_batch([b.column("doc_id"), pa.array(n.astype(np.int64))], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds that minimise padding: best[k][j] = min over i of best[k - 1][i] + cost of lengths i..j as one bucket."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    m = len(lengths)
    if m <= n_buckets:
        return [int(x) for x in lengths]
    rows, tokens = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    best = np.concatenate(([0.0], np.full(m, np.inf)))
    cuts = np.zeros((n_buckets, m + 1), np.int64)
    for k in range(n_buckets):
        nxt = np.full(m + 1, np.inf)
        nxt[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cuts[k, j] = int(np.argmin(cost))
            nxt[j] = cost[cuts[k, j]]
        best = nxt
    out, j = [], m
    for k in range(n_buckets - 1, -1, -1):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cuts[k, j])
    return sorted(out)


def pack(lengths: DataFrame, max_len: int = 2048, n_buckets: int = 16, budget: int = 16384) -> DataFrame:
    """doc_id, n_tokens -> doc_id, piece, first_token, n_tokens, bucket, bucket_len, batch, slot, padding."""
    if max_len < 1 or n_buckets < 1 or budget < max_len:
        raise ValueError("budget must hold a piece of max_len tokens")
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    pieces = written(lengths.select("doc_id", n.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((n - 1) / max_len), F.lit(0)))).alias("piece"))
                     .select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * max_len).alias("first_token"),
                             F.least(F.col("total") - F.col("piece") * max_len, F.lit(max_len)).alias("n_tokens")), "pieces")
    hist = pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()
    if not hist:
        bounds = [max_len]
    else:
        bounds = best_bounds(np.array([r[0] for r in hist]), np.array([r[1] for r in hist]), n_buckets)
    runs = 1 + sum(r[1] for r in hist) // RUN
    table = F.array(*[F.lit(b) for b in bounds])
    bucket = F.size(F.filter(table, lambda b: b < F.col("n_tokens")))
    h = F.xxhash64("doc_id", "piece")
    placed = pieces.where("n_tokens > 0").select("*", bucket.alias("bucket"), F.element_at(table, bucket + 1).alias("bucket_len"), h.alias("_h"), F.pmod(h, F.lit(runs)).alias("_run"))
    ahead = placed.groupBy("bucket", "_run").count().select(
        "bucket", "_run", (F.sum("count").over(W.partitionBy("bucket").orderBy("_run").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("_ahead"))
    rank = F.row_number().over(W.partitionBy("bucket", "_run").orderBy("_h", "doc_id", "piece")) - 1
    slots = F.floor(F.lit(budget) / F.col("bucket_len"))
    at = F.col("_ahead") + F.col("_rank")
    out = placed.withColumn("_rank", rank).join(ahead, ["bucket", "_run"]).select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_len", F.floor(at / slots).alias("batch"), (at % slots).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    return out.unionByName(pieces.where("n_tokens = 0"), allowMissingColumns=True)
