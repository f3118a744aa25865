"""Integrity checks and audits of run tables, rankings and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def check_case_sets(df: DataFrame) -> DataFrame:
    """Per subsystem: do all methods cover the same cases? They do if each case is covered by all methods."""
    d = df.select("subsystem_id", "method", "case_id").distinct()
    f = d.groupBy("subsystem_id", "method").agg(F.count("*").alias("n"))
    least = d.groupBy("subsystem_id", "case_id").agg(F.count("*").alias("m")).groupBy("subsystem_id").agg(F.min("m").alias("_least"))
    g = f.groupBy("subsystem_id").agg(F.count("*").alias("methods"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    return g.join(least, "subsystem_id").select("subsystem_id", "methods", "n_min", "n_max", (F.col("_least") == F.col("methods")).alias("same_cases"))


def check_recorded(df: DataFrame, recorded: DataFrame, keys: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Recorded mean and count against the recomputed ones; missing on either side counts as not ok."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("acc"))
    on = [F.col(f"g.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    j = g.alias("g").join(recorded.alias("r"), on, "full")
    ok = (F.col("n") == F.col("n_recorded")) & (F.abs(F.col("acc") - F.col("acc_recorded")) <= tol)
    return j.select(*[F.coalesce(f"g.{k}", f"r.{k}").alias(k) for k in keys], "n", "n_recorded", "acc", "acc_recorded", F.coalesce(ok, F.lit(False)).alias("ok"))


def check_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Case by case equality with another table on the shared keys."""
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    j = a.alias("x").join(b.alias("y"), on)
    same = F.abs(F.col("x.score") - F.col("y.score")) <= 1e-9
    return j.groupBy(*[F.col(f"x.{k}").alias(k) for k in by]).agg(F.count("*").alias("n"), F.count_if(same).alias("equal"), (F.count("*") - F.count_if(same)).alias("different"))


def check_one_to_one(contrast: DataFrame, main: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Contrast rows by the number of main rows with their key: exactly one is wanted. Main rows are counted first."""
    m = main.groupBy(*keys).agg(F.count("*").alias("_m"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    j = contrast.alias("c").join(m.alias("m"), on, "left").select("c.*", F.coalesce("_m", F.lit(0)).alias("_m"))
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_m") == 1).alias("one"), F.count_if(F.col("_m") == 0).alias("none"), F.count_if(F.col("_m") > 1).alias("many"))


def check_alignment(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows missing on either side of two blocks and the largest difference on the rows they share."""
    x = a.select(*keys, F.col("score").alias("sa"), F.lit(True).alias("ia"))
    y = b.select(*keys, F.col("score").alias("sb"), F.lit(True).alias("ib"))
    j = x.join(y, list(keys), "full")
    return j.groupBy(*by).agg(F.count("*").alias("keys_all"), F.count_if(F.col("ib").isNull()).alias("only_a"), F.count_if(F.col("ia").isNull()).alias("only_b"),
                              F.max(F.abs(F.col("sa") - F.col("sb"))).alias("max_abs_diff"))


def coverage_matrix(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Cases per subsystem and method, zero where a cell is empty."""
    n = df.groupBy("subsystem_id").pivot("method", list(methods)).agg(F.count_distinct("case_id"))
    return n.na.fill(0)


def degenerate_outputs(df: DataFrame, by: Sequence[str], answer: str = "top1", limit: float = 0.9) -> DataFrame:
    """Modal answer and its share; a share at or above the limit is degenerate. Answers are counted first."""
    by = list(by)
    c = df.filter(F.col(answer).isNotNull() & (F.col(answer) != "")).groupBy(*by, answer).agg(F.count("*").alias("c"))
    g = c.groupBy(*by).agg(F.sum("c").alias("n"), F.min_by(answer, F.struct(-F.col("c"), F.col(answer))).alias("modal"), (F.max("c") / F.sum("c")).alias("share"))
    return g.withColumn("label", F.when(F.col("share") >= limit, "degenerate").otherwise("valid"))


def label_matrix(df: DataFrame, system: str, methods: Sequence[str]) -> DataFrame:
    """System x method matrix of valid / degenerate / n/a."""
    d = degenerate_outputs(df, [system, "method"])
    return d.groupBy(system).pivot("method", list(methods)).agg(F.first("label")).na.fill("n/a")


# ---- rankings against the input column order: (case_id, pos, item) and (case_id, col, item) ----------------------

def with_column_pos(ranks: DataFrame, cols: DataFrame) -> DataFrame:
    """Column position of each ranked item and of the next one."""
    x = ranks.join(cols.select("case_id", "item", "col"), ["case_id", "item"], "left")
    return x.withColumn("next_col", F.lead("col").over(W.partitionBy("case_id").orderBy("pos")))


def ranks_equal_order(ranks: DataFrame, cols: DataFrame, k: int = 10) -> DataFrame:
    """Is the start of a ranking the start of the column list? Both are compared position by position."""
    r = ranks.filter(F.col("pos") <= k).select("case_id", F.col("pos").alias("p"), F.col("item").alias("ri"))
    c = cols.filter(F.col("col") <= k).select("case_id", F.col("col").alias("p"), F.col("item").alias("ci"))
    j = r.join(c, ["case_id", "p"], "full")
    return j.groupBy("case_id").agg(F.bool_and(F.col("ri").eqNullSafe(F.col("ci"))).alias("equals_order"))


def suspicious_top(ranks: DataFrame, suspicious: Column, by: Sequence[str]) -> DataFrame:
    """Cases whose first item, or one of the first five, is suspicious."""
    c = ranks.filter("pos <= 5").groupBy("case_id", *by).agg(F.bool_or(suspicious & (F.col("pos") == 1)).alias("t1"), F.bool_or(suspicious).alias("t5"))
    return c.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if("t1").alias("top1"), F.count_if("t5").alias("top5"))


def permutation_summary(original: DataFrame, permuted: DataFrame) -> DataFrame:
    """Paired outputs (case_id, equals_order, top1): does the ranking follow the order, does the first answer change?"""
    j = original.select("case_id", F.col("equals_order").alias("eo"), F.col("top1").alias("to")).join(
        permuted.select("case_id", F.col("equals_order").alias("ep"), F.col("top1").alias("tp")), "case_id")
    return j.agg(F.count("*").alias("cases"), F.count_if("eo").alias("original_follows"), F.count_if("ep").alias("permuted_follows"),
                 F.count_if(F.col("to") != F.col("tp")).alias("top1_changes"))


def top1_most_common(ranks: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    c = ranks.filter("pos = 1").groupBy(*by, "item").agg(F.count("*").alias("c"))
    w = W.partitionBy(*by).orderBy(F.desc("c"), "item")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranks_monotone(with_cols: DataFrame, by: Sequence[str], min_len: int = 5) -> DataFrame:
    """Cases whose whole ranking runs in column order, per group. ``with_cols`` from ``with_column_pos``."""
    ok = F.col("col").isNotNull() & (F.col("next_col").isNull() | (F.col("col") < F.col("next_col")))
    c = with_cols.groupBy("case_id", *by).agg((F.bool_and(ok) & (F.count("*") >= min_len)).alias("m"))
    return c.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if("m").alias("monotone"), F.avg(F.col("m").cast("double")).alias("share"))


def order_prefix(with_cols: DataFrame) -> DataFrame:
    """Length of the leading part after which the ranking follows the column order (0: all of it does)."""
    brk = F.when(F.col("col") > F.col("next_col"), F.col("pos")).otherwise(0)
    return with_cols.groupBy("case_id").agg(F.count("*").alias("len"), F.max(brk).alias("prefix"))


def concentration(ranks: DataFrame, service: Column, by: Sequence[str]) -> DataFrame:
    """Share of the most frequent first service and mean number of services among the first ten items."""
    by = list(by)
    x = ranks.filter("pos <= 10").withColumn("svc", service)
    c = x.groupBy("case_id", *by).agg(F.count_distinct("svc").alias("d"), F.min_by("svc", "pos").alias("t"))
    t = c.groupBy(*by, "t").agg(F.count("*").alias("c"), F.sum("d").alias("d"))
    return t.groupBy(*by).agg(F.sum("c").alias("cases"), F.min_by("t", F.struct(-F.col("c"), F.col("t"))).alias("top_service"),
                              (F.max("c") / F.sum("c")).alias("top_share"), (F.sum("d") / F.sum("c")).alias("mean_services"))


def presence(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Is the true component seen before and after the event, and how many metrics appear on one side only?

    ``df``: (case_id, component, metric_id, ts, t0); ``truth``: (case_id, truth).
    """
    pre = F.col("ts") < F.col("t0")
    m = df.groupBy("case_id", "component", "metric_id").agg(F.bool_or(pre).alias("pre"), F.bool_or(~pre).alias("post"))
    j = m.join(truth, "case_id")
    own = F.col("component") == F.col("truth")
    return j.groupBy("case_id", "truth").agg(F.bool_or(own & F.col("pre")).alias("in_normal"), F.bool_or(own & F.col("post")).alias("in_abnormal"),
                                             F.count_if(F.col("post") & ~F.col("pre")).alias("only_abnormal"), F.count_if(F.col("pre") & ~F.col("post")).alias("only_normal"))


# ---- texts and registries ----------------------------------------------------------------------------------------

# fixed values: what counts as a number in a text
NUMBER_PATTERN = r"[0-9]+(?:\.[0-9]+)?"


def numbers_in(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))).alias("number"))


def literal_audit(docs: DataFrame, registry: DataFrame, key: str, text: str) -> DataFrame:
    """Numbers in whole texts that the registry (column ``number``) does not know, with their occurrences."""
    n = numbers_in(docs, key, text).groupBy("number", key).agg(F.count("*").alias("c"))
    g = n.groupBy("number").agg(F.count("*").alias("docs"), F.sum("c").alias("occurrences"))
    return g.join(registry.select("number").distinct(), "number", "left_anti")


def registry_diff(old: DataFrame, new: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Entries added, removed or changed between two registries."""
    j = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.withColumn("state", state).filter("state is not null")


def survey_counts(df: DataFrame, excluded: DataFrame, key: str, by: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of a field's values per group over the items that are not excluded."""
    kept = df.join(excluded.select(key).distinct(), key, "left_anti")
    return kept.groupBy(by).agg(F.count("*").alias("items"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def inclusion_gate(df: DataFrame) -> DataFrame:
    """Which methods can enter the main comparison: those with cases on every subsystem."""
    d = df.select("method", "family", "subsystem_id").distinct()
    m = d.groupBy("method").agg(F.count_distinct("subsystem_id").alias("covered"), F.count_distinct("family").alias("families"))
    m = m.withColumn("k", d.agg(F.count_distinct("subsystem_id")).scalar())
    full = F.col("covered") == F.col("k")
    return m.select("method", "covered", "families", F.when(full, "yes").otherwise("no").alias("main"),
                                      F.when(full, F.lit("covers all subsystems")).otherwise(F.format_string("covers %d of %d subsystems", "covered", "k")).alias("reason"))
