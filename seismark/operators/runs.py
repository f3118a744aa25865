"""Building, overlaying and comparing run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.functions.series import row_index
from seismark.functions.stats import TIE_EPS


def valid_output() -> Column:
    """1 for a usable output: no error, something ranked, not the column order, not the default answer."""
    bad = ((F.coalesce("error", F.lit("None")) != "None") | (F.coalesce("n_ranks", F.lit(0)) <= 0)
           | F.coalesce("column_order", F.lit(False)) | F.coalesce("is_default", F.lit(False)))
    return F.when(bad, 0).otherwise(1)


def build_case_scores(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Append runs under their rule: role, input and window come from the rule, invalid outputs score zero.

    ``rules``: (run, role, input_repr, window_min); runs without a rule are left out.
    """
    x = runs.withColumn("valid_output", valid_output()).join(rules, "run")
    zero = F.col("valid_output") == 0
    return x.select("family", "subsystem_id", "case_id", "fault", "method", "seed", "role", "input_repr", "window_min", "valid_output",
                    F.when(zero, 0.0).otherwise(F.col("raw_score")).alias("score"), F.when(zero, 0.0).otherwise(F.coalesce("raw_strict", "raw_score")).alias("score_strict"))


def overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str], group: Sequence[str], force: Sequence[str], old_role: str) -> DataFrame:
    """Replace rows by rerun rows: a group of runs is replaced when some of its cases changed or its method is forced.

    Replaced rows stay under ``old_role``. The patch is matched once by key; groups decide by one small aggregate.
    """
    keys, group = list(keys), list(group)
    p = patch.select(*keys, F.col("score").alias("_s"), F.col("score_strict").alias("_ss"), F.col("valid_output").alias("_v"), F.lit(True).alias("_hit"))
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    x = base.alias("b").join(p.alias("p"), on, "left").select("b.*", "_s", "_ss", "_v", "_hit")
    diff = F.col("_hit") & ((F.abs(F.col("score") - F.col("_s")) > TIE_EPS) | (F.col("valid_output") != F.col("_v")))
    changed = x.filter("_hit").groupBy(*group).agg(F.count_if(diff).alias("_n"))
    g_on = [F.col(f"x.{k}").eqNullSafe(F.col(f"g.{k}")) for k in group]
    x = x.alias("x").join(changed.alias("g"), g_on, "left").select("x.*", "_n")
    take = F.coalesce(F.col("_hit"), F.lit(False)) & ((F.coalesce("_n", F.lit(0)) > 0) | F.col("method").isin(*force))
    cols = [c for c in base.columns if c not in ("role", "score", "score_strict", "valid_output")]
    old = F.struct(F.when(take, F.lit(old_role)).otherwise(F.col("role")).alias("role"), "score", "score_strict", "valid_output")
    new = F.struct("role", F.col("_s").alias("score"), F.col("_ss").alias("score_strict"), F.col("_v").alias("valid_output"))
    rows = F.when(take, F.array(old, new)).otherwise(F.array(old))
    return x.select(*cols, F.explode(rows).alias("r")).select(*cols, "r.*")


def swap_condition(base: DataFrame, contrast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows whose key has no contrast row, plus all contrast rows."""
    k = contrast.select(*keys).distinct()
    on = [F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys]
    return base.alias("b").join(k.alias("k"), on, "left_anti").unionByName(contrast, allowMissingColumns=True)


def status_for(path: Column, rules: Sequence[tuple[str, str]], default: str = "valid") -> Column:
    """Status of a run by the first pattern its path matches."""
    out = None
    for pattern, status in rules:
        out = F.when(path.rlike(pattern), status) if out is None else out.when(path.rlike(pattern), status)
    return F.lit(default) if out is None else out.otherwise(default)


def upsert_ledger(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """New rows replace old ones with the same key; running it twice changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def override_status(ledger: DataFrame, fixes: DataFrame, note: str) -> DataFrame:
    """Set the status of listed paths and append what was changed to the note. ``fixes``: (path, new_status)."""
    x = ledger.join(fixes, "path", "left")
    add = F.format_string(f" | {note} status %s->%s", F.col("status"), F.col("new_status"))
    return x.withColumn("note", F.when(F.col("new_status").isNotNull(), F.concat(F.coalesce("note", F.lit("")), add)).otherwise(F.col("note"))).withColumn(
        "status", F.coalesce("new_status", "status")).drop("new_status")


def complete_cases(df: DataFrame, methods: Sequence[str], keys: Sequence[str] = ("subsystem_id", "case_id")) -> DataFrame:
    """Rows of the named methods on cases that all of them cover."""
    x = df.filter(F.col("method").isin(*methods))
    ok = x.groupBy(*keys).agg(F.count_distinct("method").alias("_k")).filter(F.col("_k") == len(set(methods))).select(*keys)
    return x.join(ok, list(keys), "left_semi")


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """Rows of a matched in b by key, and the share with the same value (null equals null)."""
    y = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_m"))
    j = a.join(y, list(keys), "left")
    same = F.coalesce(F.col("_m"), F.lit(False)) & F.col(value).eqNullSafe(F.col("_b"))
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.count("_m").alias("matched"), F.count_if(same).alias("identical"), F.avg(same.cast("double")).alias("identical_share"))


def status_summary(df: DataFrame, by: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Counts per status and accuracy with fallbacks counted as zero."""
    return df.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses], F.count("*").alias("n"), F.avg("score").alias("acc"),
                               F.avg(F.when(F.col("status") == "ok", F.col("score")).otherwise(0.0)).alias("acc_fallback_zero"))


def accuracy_by_input(df: DataFrame, condition: str, values: Sequence[str]) -> DataFrame:
    """Accuracy of each method and subsystem under each condition, side by side (seed mean per case first)."""
    cs = df.groupBy(condition, "family", "subsystem_id", "method", "case_id").agg(F.avg("score").alias("score"))
    at = lambda v: F.avg(F.when(F.col(condition) == v, F.col("score")))
    return cs.groupBy("family", "subsystem_id", "method").agg(*[at(v).alias(f"acc_{v}") for v in values], (at(values[-1]) - at(values[0])).alias("change"))


def replication(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two releases side by side; rows of one release only are kept."""
    x, y = a.select(*keys, F.col(value).alias(f"{value}_1")), b.select(*keys, F.col(value).alias(f"{value}_2"))
    return x.join(y, list(keys), "full")


def default_answers(df: DataFrame, default: Column, by: Sequence[str]) -> DataFrame:
    """How often an answer is the template default and what score those answers earned."""
    hit = F.col("prediction") == default
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_default"), F.sum(F.when(hit, F.col("score")).otherwise(0.0)).alias("score_from_default"),
                               F.sum("score").alias("score_total"))


def window_flips(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Cases lost and gained when only the window length differs."""
    j = a.select(*keys, *[c for c in by if c not in keys], F.col("score").alias("sa")).join(b.select(*keys, F.col("score").alias("sb")), list(keys))
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((F.col("sa") == 1) & (F.col("sb") < 1)).alias("lost"),
                              F.count_if((F.col("sa") < 1) & (F.col("sb") == 1)).alias("gained"), F.avg("sa").alias("acc_a"), F.avg("sb").alias("acc_b"))


def patch_effect(old: DataFrame, new: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Accuracy before and after on cases the patch touches and on the others. ``new`` carries ``affected``."""
    j = old.select(*keys, *[c for c in by if c not in keys], F.col("score").alias("so")).join(new.select(*keys, "affected", F.col("score").alias("sn")), list(keys))
    on = lambda c, v: F.avg(F.when(F.col("affected") == v, F.col(c)))
    return j.groupBy(*by).agg(F.count_if("affected").alias("n_affected"), F.count_if(~F.col("affected")).alias("n_other"), on("so", True).alias("affected_before"),
                              on("sn", True).alias("affected_after"), on("so", False).alias("other_before"), on("sn", False).alias("other_after"))


def cell_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attempts, errors, accuracy, graph coverage, mean counts and the modal first answer of each method x system cell.

    Answers are pre-counted, so the modal answer needs no list of a cell's cases.
    """
    by = list(by)
    ok = F.col("error").isNull()
    c = df.groupBy(*by, "top1").agg(F.count("*").alias("c"), F.count_if(ok).alias("ok"), F.sum("acc1").alias("a1"), F.sum("acc3").alias("a3"), F.sum("acc5").alias("a5"),
                                    F.count_if("in_graph").alias("g"), F.sum("n_ranks").alias("nr"))
    named = F.when(F.col("top1").isNotNull(), F.struct(-F.col("c"), F.col("top1")))
    return c.groupBy(*by).agg(
        F.sum("c").alias("n_attempted"), F.sum("ok").alias("n_ok"), (F.sum("c") - F.sum("ok")).alias("n_error"), (F.sum("a1") / F.sum("c")).alias("acc1"),
        (F.sum("a3") / F.sum("c")).alias("acc3"), (F.sum("a5") / F.sum("c")).alias("acc5"), (F.sum("g") / F.sum("c")).alias("graph_coverage"),
        (F.sum("nr") / F.sum("c")).alias("mean_n_ranks"), F.min_by("top1", named).alias("modal_top1"),
        (F.max(F.when(F.col("top1").isNotNull(), F.col("c"))) / F.sum(F.when(F.col("top1").isNotNull(), F.col("c")))).alias("modal_freq"))


def cost_summary(df: DataFrame, by: Sequence[str], sec: str = "sec") -> DataFrame:
    """Wall time per method: total, mean, median and 95th percentile (exact, without holding a method's rows)."""
    from seismark.functions.series import exact_percentiles

    q = exact_percentiles(df, by, sec, [0.5, 0.95], ["p50", "p95"])
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(sec).alias("total"), F.avg(sec).alias("mean"), F.max(sec).alias("max"))
    return g.join(q, list(by))


def published_diff(runs: DataFrame, published: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Largest absolute difference at two digits between our values and published ones, and how many agree."""
    j = runs.join(published, list(keys))
    d = F.round(F.abs(F.round("value", 2) - F.col("published")), 6)
    return j.groupBy(*by).agg(F.count("*").alias("compared"), F.max(d).alias("max_abs_diff"), F.count_if(d <= 0.005).alias("agree"))


def attach_labels(queries: DataFrame, records: DataFrame) -> DataFrame:
    """Labels from a second file matched by position (idx); ``consistent`` says the record's time is among the query's.

    ``queries``: (system, idx, case_id, times array); ``records``: (system, idx, datetime, reason).
    """
    j = queries.join(records, ["system", "idx"])
    return j.select("system", "idx", "case_id", "reason", ((F.size("times") == 0) | F.array_contains("times", F.col("datetime"))).alias("consistent"))


def extend_block(base: DataFrame, extra: Sequence[DataFrame], methods: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A complete block with one more method read from several sources, and the coverage before the intersection."""
    x = base
    for e in extra:
        x = x.unionByName(e)
    cov = x.groupBy("subsystem_id", "method").agg(F.count_distinct("case_id").alias("cases"))
    return complete_cases(x, methods), cov


def before_after(a: DataFrame, b: DataFrame, values: Sequence[str]) -> DataFrame:
    """One result per unordered pair of methods before and after a correction, whichever way round it was stored."""
    def keyed(d: DataFrame, tag: str) -> DataFrame:
        return d.select("family", F.least("a", "b").alias("lo_method"), F.greatest("a", "b").alias("hi_method"),
                        *[F.when(F.col("a") < F.col("b"), F.col(v)).otherwise(-F.col(v)).alias(f"{v}_{tag}") for v in values])

    j = keyed(a, "before").join(keyed(b, "after"), ["family", "lo_method", "hi_method"], "full")
    return j.select("*", *[(F.col(f"{v}_after") - F.col(f"{v}_before")).alias(f"{v}_change") for v in values])


def query_index(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column]) -> DataFrame:
    """Number repeats of a key from zero in an explicit order; ``chunk`` is coarse and non-decreasing along it."""
    return row_index(df, keys, chunk, order, "q_idx")
