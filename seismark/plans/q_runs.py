"""Run-table and data-quality queries (B01 to B22, Q01 to Q21)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.functions import text as X2
from seismark.functions.names import service_from_col
from seismark.operators import compare as C
from seismark.operators import quality as Q
from seismark.operators import resample as R
from seismark.operators import runs as B
from seismark.plans import fixtures as X
from seismark.plans.q_compare import alt_cs, cs, deltas
from seismark.plans.q_text import p13, picks
from seismark.plans.registry import cte, query, table
from seismark.plans.sqltext import REPS, deltas_sql, diffs_sql, draw_ctes, h32, pair_means_sql, vectors_sql

KEYS = ["case_id", "method", "seed"]
OK_SQL = "cast(split_part(split_part(case_id, '|', 2), '#', 1) as bigint)"
RUN_KEYS = ["case_id", "method", "run"]


def with_run(df):
    """The seed as a key that is never null."""
    return df.withColumn("run", F.coalesce("seed", F.lit(-1)))


ON = "{0}.case_id = {1}.case_id and {0}.method = {1}.method and {0}.seed is not distinct from {1}.seed"


def order_no():
    return F.substring_index(F.substring_index("case_id", "|", -1), "#", 1).cast("bigint")


# raw runs: the fixture scores with the reasons why an output may be unusable
cte("raw_runs", f"""select family, subsystem_id, case_id, fault, method, seed, method || '#' || coalesce(seed::varchar, '-') as run, case when valid_output = 0 then 'timeout' end as error,
  case when {OK_SQL} % 13 = 0 then 0 else 5 end as n_ranks, method = 'm_cust' and {OK_SQL} % 17 = 0 as column_order, method = 'm_price' and {OK_SQL} % 19 = 0 as is_default,
  score as raw_score, score_strict as raw_strict from case_scores""")


def raw_runs(spark, sf):
    x = X.case_scores(spark, sf)
    k = order_no()
    return x.select("family", "subsystem_id", "case_id", "fault", "method", "seed", F.concat_ws("#", "method", F.coalesce(F.col("seed").cast("string"), F.lit("-"))).alias("run"),
                    F.when(F.col("valid_output") == 0, "timeout").alias("error"), F.when(k % 13 == 0, 0).otherwise(5).alias("n_ranks"),
                    ((F.col("method") == "m_cust") & (k % 17 == 0)).alias("column_order"), ((F.col("method") == "m_price") & (k % 19 == 0)).alias("is_default"),
                    F.col("score").alias("raw_score"), F.col("score_strict").alias("raw_strict"))


RULES = [("m_cust#-", "published", "csv", 20), ("m_price#-", "published", "csv", 20), ("m_prio#-", "probe", "csv", 10), ("m_seeded#0", "published", "json", 20), ("m_seeded#1", "published", "json", 20)]
cte("run_rules", "select * from (values " + ", ".join(str(r) for r in RULES) + ") t(run, role, input_repr, window_min)")
cte("vruns", "select *, case when coalesce(error, 'None') <> 'None' or n_ranks <= 0 or column_order or is_default then 0 else 1 end as valid_output from raw_runs")


def rules(spark):
    return spark.createDataFrame(RULES, "run string, role string, input_repr string, window_min int")


@query("b01_build_case_scores", """select family, subsystem_id, case_id, fault, method, seed, role, input_repr, window_min, valid_output, case when valid_output = 0 then 0 else raw_score end as score,
  case when valid_output = 0 then 0 else raw_strict end as score_strict from vruns join run_rules using (run)""", rnd="score score_strict")
def b01(spark, sf):
    return B.build_case_scores(raw_runs(spark, sf), rules(spark))


@query("b02_valid_output", "select run, valid_output, count(*) as n from vruns group by all")
def b02(spark, sf):
    return raw_runs(spark, sf).withColumn("valid_output", B.valid_output()).groupBy("run", "valid_output").agg(F.count("*").alias("n"))


# rerun of every third case: seeded runs come out the same, the price run is forced, the others change
cte("patch", f"""select case_id, method, seed, case when method = 'm_cust' then 1 - score_strict else score end as score, case when method = 'm_cust' then 1 - score_strict else score_strict end as score_strict,
  valid_output from case_scores where {OK_SQL} % 3 = 0""")
cte("overlaid", f"""
with j as (select b.*, p.score as s, p.score_strict as ss, p.valid_output as v, p.case_id is not null as hit from case_scores b left join patch p on {ON.format('b', 'p')}),
 g as (select method, seed, count(*) filter (where hit and (abs(score - s) > 1e-9 or valid_output <> v)) as n from j group by all),
 t as (select j.*, hit and (n > 0 or j.method = 'm_price') as take from j join g on j.method = g.method and j.seed is not distinct from g.seed)
select family, subsystem_id, case_id, fault, method, seed, case when take then 'superseded' else role end as role, score, score_strict, valid_output from t
union all select family, subsystem_id, case_id, fault, method, seed, role, s, ss, v from t where take""")


def patch(spark, sf):
    x = X.case_scores(spark, sf).filter(order_no() % 3 == 0)
    flip = F.col("method") == "m_cust"
    return x.select(*KEYS, F.when(flip, 1.0 - F.col("score_strict")).otherwise(F.col("score")).alias("score"),
                    F.when(flip, 1.0 - F.col("score_strict")).otherwise(F.col("score_strict")).alias("score_strict"), "valid_output")


@query("b03_overlay", "select * from overlaid", rnd="score score_strict")
def b03(spark, sf):
    return B.overlay(X.case_scores(spark, sf), patch(spark, sf), KEYS, ["method", "seed"], ["m_price"], "superseded")


@query("b04_swap_condition", """select b.* from case_scores b anti join (select case_id, method, coalesce(seed, -1) as s from contrast) c on c.case_id = b.case_id and c.method = b.method and c.s = coalesce(b.seed, -1)
  union all select * from contrast""", rnd="score score_strict")
def b04(spark, sf):
    return B.swap_condition(X.case_scores(spark, sf), X.contrast(spark, sf), KEYS)


STATUS = [("#2$", "contaminated"), ("^runs/m_prio", "diagnostic")]
LEDGER = "select 'runs/' || {src}.method || '/' || subsystem_id || '#' || coalesce(seed::varchar, '-') as path, count(*) as n_cases, avg({v}) as acc from {src} group by all"
cte("ledger_old", LEDGER.format(src="case_scores", v="score"))
cte("ledger_new", LEDGER.format(src="contrast", v="score") + " having subsystem_id like 'A%'")
cte("ledger", """select *, case when regexp_matches(path, '#2$') then 'contaminated' when regexp_matches(path, '^runs/m_prio') then 'diagnostic' else 'valid' end as status from
  (select * from ledger_old where path not in (select path from ledger_new) union all select * from ledger_new)""")


def ledger_of(df):
    path = F.concat(F.lit("runs/"), F.col("method"), F.lit("/"), F.col("subsystem_id"), F.lit("#"), F.coalesce(F.col("seed").cast("string"), F.lit("-")))
    return df.groupBy(path.alias("path")).agg(F.count("*").alias("n_cases"), F.avg("score").alias("acc"))


def ledger(spark, sf):
    new = ledger_of(X.contrast(spark, sf).filter(F.col("subsystem_id").startswith("A")))
    return B.upsert_ledger(ledger_of(X.case_scores(spark, sf)), new).withColumn("status", B.status_for(F.col("path"), STATUS))


@query("b05_upsert_ledger", "select * from ledger", rnd="acc")
def b05(spark, sf):
    return ledger(spark, sf)


# gaps for block building: each method misses some cases
cte("gappy", f"select * from case_scores where not (method = 'm_cust' and {OK_SQL} % 5 = 0) and not (method = 'm_prio' and subsystem_id like '%3')")


def gappy(spark, sf):
    x = X.case_scores(spark, sf)
    return x.filter(~((F.col("method") == "m_cust") & (order_no() % 5 == 0)) & ~((F.col("method") == "m_prio") & F.col("subsystem_id").endswith("3")))


BLOCK = ["m_cust", "m_price", "m_prio"]
cte("block", """select g.* from gappy g join (select case_id from gappy where method in ('m_cust', 'm_price', 'm_prio') group by case_id having count(distinct method) = 3) using (case_id)
  where method in ('m_cust', 'm_price', 'm_prio')""")


@query("b06_complete_cases", "select subsystem_id, case_id, method, score from block", rnd="score")
def b06(spark, sf):
    return B.complete_cases(gappy(spark, sf), BLOCK).select("subsystem_id", "case_id", "method", "score")


@query("b07_common_methods", """select x.family, x.method from (select family, method, count(distinct subsystem_id) as h from gappy group by all) x
  join (select family, count(distinct subsystem_id) as k from gappy group by all) y on x.family = y.family and x.h = y.k""")
def b07(spark, sf):
    return C.common_values(gappy(spark, sf), "method", "subsystem_id", ["family"])


@query("b08_common_classes", "select fault from case_scores group by fault having count(distinct subsystem_id) = (select count(distinct subsystem_id) from case_scores)")
def b08(spark, sf):
    return C.common_values(X.case_scores(spark, sf), "fault", "subsystem_id")


@query("b09_compare_runs", """select method, count(*) as n, count(p.case_id) as matched, count(*) filter (where p.case_id is not null and b.score is not distinct from p.score) as identical,
  avg((p.case_id is not null and b.score is not distinct from p.score)::int::double) as identical_share from (select *, coalesce(seed, -1) as run from case_scores) b
  left join (select case_id, method, coalesce(seed, -1) as run, score from patch) p using (case_id, method, run) group by all""", rnd="identical_share")
def b09(spark, sf):
    return B.compare_runs(with_run(X.case_scores(spark, sf)), with_run(patch(spark, sf)), RUN_KEYS, "score", ["method"])


STAT = "case when error is not null then 'error' when is_default then 'fallback' else 'ok' end"


@query("b10_status_summary", f"""select method, count(*) filter (where st = 'ok') as n_ok, count(*) filter (where st = 'fallback') as n_fallback, count(*) filter (where st = 'error') as n_error,
  count(*) as n, avg(raw_score) as acc, avg(case when st = 'ok' then raw_score else 0 end) as acc_fallback_zero from (select *, {STAT} as st from raw_runs) group by all""", rnd="acc acc_fallback_zero")
def b10(spark, sf):
    st = F.when(F.col("error").isNotNull(), "error").when(F.col("is_default"), "fallback").otherwise("ok")
    x = raw_runs(spark, sf).withColumn("status", st).withColumn("score", F.col("raw_score"))
    return B.status_summary(x, ["method"], ["ok", "fallback", "error"])


cte("two_inputs", "select *, 'main' as cond from case_scores union all select *, 'alt' as cond from contrast")


@query("b11_accuracy_by_input", """select family, subsystem_id, method, avg(score) filter (where cond = 'main') as acc_main, avg(score) filter (where cond = 'alt') as acc_alt,
  avg(score) filter (where cond = 'alt') - avg(score) filter (where cond = 'main') as change from (select cond, family, subsystem_id, method, case_id, avg(score) as score from two_inputs group by all) group by all""",
       rnd="acc_main acc_alt change")
def b11(spark, sf):
    x = X.case_scores(spark, sf).withColumn("cond", F.lit("main")).unionByName(X.contrast(spark, sf).withColumn("cond", F.lit("alt")))
    return B.accuracy_by_input(x, "cond", ["main", "alt"])


@query("b12_replication", """select subsystem_id, method, x.acc as acc_1, y.acc as acc_2 from (select subsystem_id, method, avg(score) as acc from cs group by all) x
  full join (select subsystem_id, method, avg(score) as acc from block group by all) y using (subsystem_id, method)""", rnd="acc_1 acc_2")
def b12(spark, sf):
    a = C.accuracy(cs(spark, sf))
    b = B.complete_cases(gappy(spark, sf), BLOCK).groupBy("subsystem_id", "method").agg(F.avg("score").alias("acc"))
    return B.replication(a, b, ["subsystem_id", "method"], "acc")


@query("b13_default_answers", """select system, count(*) as n, count(*) filter (where is_default) as n_default, sum(case when is_default then n_chars else 0 end) as score_from_default, sum(n_chars) as score_total
  from (select case when case_id::bigint % 2 = 0 then 'Bank' else 'Telecom' end as system, is_default, length(prediction)::double as n_chars from built) group by all""", rnd="score_from_default score_total")
def b13(spark, sf):
    """The score of an answer is its length here; the template is rebuilt from the system, time and count."""
    p = picks(spark, sf)
    meta = p.groupBy("case_id", "system", "n_expected").agg(F.min("dt").alias("dt"))
    x = X2.build_answers(p).join(meta, "case_id").withColumn("score", F.length("prediction").cast("double"))
    return B.default_answers(x, X2.default_answer(F.col("system"), F.col("dt"), F.col("n_expected")), ["system"])


@query("b14_window_flips", """select method, count(*) as n, count(*) filter (where a.score = 1 and b.score < 1) as lost, count(*) filter (where a.score < 1 and b.score = 1) as gained, avg(a.score) as acc_a, avg(b.score) as acc_b
  from (select *, coalesce(seed, -1) as run from case_scores) a join (select *, coalesce(seed, -1) as run from contrast) b using (case_id, method, run) group by all""", rnd="acc_a acc_b")
def b14(spark, sf):
    return B.window_flips(with_run(X.case_scores(spark, sf)), with_run(X.contrast(spark, sf)), RUN_KEYS, ["method"])


@query("b15_patch_effect", f"""
with n as (select case_id, method, coalesce(seed, -1) as run, {OK_SQL} % 3 = 0 as affected, case when {OK_SQL} % 3 = 0 and method = 'm_cust' then 1 - score_strict else score end as score from case_scores)
select method, count(*) filter (where affected) as n_affected, count(*) filter (where not affected) as n_other, avg(o.score) filter (where affected) as affected_before, avg(n.score) filter (where affected) as affected_after,
  avg(o.score) filter (where not affected) as other_before, avg(n.score) filter (where not affected) as other_after from (select *, coalesce(seed, -1) as run from case_scores) o join n using (case_id, method, run) group by all""",
       rnd="affected_before affected_after other_before other_after")
def b15(spark, sf):
    old = with_run(X.case_scores(spark, sf))
    aff = order_no() % 3 == 0
    new = old.withColumn("affected", aff).withColumn("score", F.when(F.col("affected") & (F.col("method") == "m_cust"), 1.0 - F.col("score_strict")).otherwise(F.col("score")))
    return B.patch_effect(old, new, RUN_KEYS, ["method"])


# one row per case and method: first answer, hits, errors
cte("outcomes_raw", f"""select (case_id::bigint % 7)::varchar as system, m.method, case_id, case when m.method = 'm_const' and case_id::bigint % 20 <> 0 then 's0' when m.method = 'm_last' then last_item else first_item end as top1,
  truth, n_ranks, case when case_id::bigint % 23 = 0 then 'err' end as error from
  (select case_id, truth, count(*) as n_ranks, split_part(first(item order by pos), '_', 1) as first_item, split_part(first(item order by pos desc), '_', 1) as last_item from rankings group by all)
  cross join (select unnest(['m_first', 'm_last', 'm_const']) as method) m""")


def outcomes_raw(spark, sf):
    r = X.rankings(spark, sf).groupBy("case_id", "truth").agg(
        F.count("*").alias("n_ranks"), F.substring_index(F.min_by("item", "pos"), "_", 1).alias("f"), F.substring_index(F.max_by("item", "pos"), "_", 1).alias("l"))
    k = F.col("case_id").cast("bigint")
    x = r.withColumn("method", F.explode(F.array(F.lit("m_first"), F.lit("m_last"), F.lit("m_const"))))
    top = F.when((F.col("method") == "m_const") & (k % 20 != 0), "s0").when(F.col("method") == "m_last", F.col("l")).otherwise(F.col("f"))
    return x.select((k % 7).cast("string").alias("system"), "method", "case_id", top.alias("top1"), "truth", "n_ranks", F.when(k % 23 == 0, "err").alias("error"))


@query("b16_cell_summary", """
with x as (select *, (top1 = truth)::int::double as acc1, (n_ranks >= 3)::int::double as acc3, (n_ranks >= 5)::int::double as acc5, truth in ('s1', 's2', 's3') as in_graph from outcomes_raw),
 m as (select system, method, first(top1 order by c desc, top1) as modal_top1, max(c) / sum(c) as modal_freq from (select system, method, top1, count(*) as c from x group by all) group by all)
select system, method, count(*) as n_attempted, count(*) filter (where error is null) as n_ok, count(error) as n_error, avg(acc1) as acc1, avg(acc3) as acc3, avg(acc5) as acc5,
  avg(in_graph::int::double) as graph_coverage, avg(n_ranks) as mean_n_ranks, modal_top1, modal_freq from x join m using (system, method) group by all""",
       rnd="acc1 acc3 acc5 graph_coverage mean_n_ranks modal_freq")
def b16(spark, sf):
    x = outcomes_raw(spark, sf)
    for k, c in ((1, F.col("top1") == F.col("truth")), (3, F.col("n_ranks") >= 3), (5, F.col("n_ranks") >= 5)):
        x = x.withColumn(f"acc{k}", c.cast("double"))
    return B.cell_summary(x.withColumn("in_graph", F.col("truth").isin("s1", "s2", "s3")), ["system", "method"])


@query("b17_cost_summary", """select event_type, count(*) as n, sum(value) as total, avg(value) as mean, max(value) as max, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by all""",
       rnd="total mean max p50 p95")
def b17(spark, sf):
    return B.cost_summary(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value")


@query("b18_published_diff", """select method, count(*) as compared, max(round(abs(round(x.acc, 2) - y.published), 6)) as max_abs_diff, count(*) filter (where round(abs(round(x.acc, 2) - y.published), 6) <= 0.005) as agree
  from (select family, method, avg(score) as acc from cs group by all) x join (select family, method, round(avg(score_strict), 2) as published from case_scores group by all) y using (family, method) group by all""", rnd="max_abs_diff")
def b18(spark, sf):
    """The strict accuracies, rounded to two digits, play the published table."""
    runs = cs(spark, sf).groupBy("family", "method").agg(F.avg("score").alias("value"))
    pub = X.case_scores(spark, sf).groupBy("family", "method").agg(F.round(F.avg("score_strict"), 2).alias("published"))
    return B.published_diff(runs, pub, ["family", "method"], ["method"])


@query("b19_attach_labels", """
with q as (select case_id::bigint % 5 as system, row_number() over (partition by case_id::bigint % 5 order by case_id::bigint) - 1 as idx, case_id, regexp_extract_all(scoring_points, '\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') as times from answers),
 r as (select o_orderkey % 5 as system, row_number() over (partition by o_orderkey % 5 order by o_orderkey) - 1 as idx, cast(cast(o_orderdate as date) as varchar) || case when o_orderkey % 9 = 0 then ' 00:09:00' else ' 00:01:00' end as datetime, o_orderpriority as reason from orders)
select system, idx, case_id, reason, len(times) = 0 or list_contains(times, datetime) as consistent from q join r using (system, idx)""")
def b19(spark, sf):
    from seismark.functions.series import row_index
    k = F.col("case_id").cast("bigint")
    q = X.answers(spark, sf).select((k % 5).alias("system"), k.alias("ord"), "case_id", F.regexp_extract_all("scoring_points", F.lit(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"), F.lit(0)).alias("times"))
    o = F.col("o_orderkey")
    r = table(spark, sf, "orders").select((o % 5).alias("system"), o.alias("ord"), F.concat(F.to_date("o_orderdate").cast("string"), F.when(o % 9 == 0, " 00:09:00").otherwise(" 00:01:00")).alias("datetime"),
                                          F.col("o_orderpriority").alias("reason"))
    idx = lambda d: row_index(d, ["system"], F.floor(F.col("ord") / 1000), [F.col("ord")], "idx")
    return B.attach_labels(idx(q), idx(r))


@query("b20_override_status", """select l.path, n_cases, acc, coalesce(f.new_status, status) as status, case when f.new_status is not null then ' | check status ' || status || '->' || f.new_status end as note
  from ledger l left join (select path, 'superseded' as new_status from ledger where n_cases < 610) f using (path)""", rnd="acc")
def b20(spark, sf):
    l = ledger(spark, sf)
    fixes = l.filter("n_cases < 610").select("path", F.lit("superseded").alias("new_status"))
    return B.override_status(l.withColumn("note", F.lit(None).cast("string")), fixes, "check")


cte("extended", """select family, subsystem_id, case_id, method, score from gappy where method <> 'm_seeded' union all select family, subsystem_id, case_id, 'm_new', score from case_scores where seed = 0 and family < 'B'
  union all select family, subsystem_id, case_id, 'm_new', score from contrast where seed = 0 and family > 'B'""")


def extended(spark, sf):
    cols = ["family", "subsystem_id", "case_id", "method", "score"]
    base = gappy(spark, sf).filter("method <> 'm_seeded'").select(*cols)
    new = lambda d, cond: d.filter("seed = 0").filter(cond).withColumn("method", F.lit("m_new")).select(*cols)
    return B.extend_block(base, [new(X.case_scores(spark, sf), "family < 'B'"), new(X.contrast(spark, sf), "family > 'B'")], ["m_cust", "m_price", "m_new"])


@query("b21_extend_block", """select x.* from extended x join (select case_id from extended where method in ('m_cust', 'm_price', 'm_new') group by case_id having count(distinct method) = 3) using (case_id)
  where method in ('m_cust', 'm_price', 'm_new')""", rnd="score")
def b21(spark, sf):
    return extended(spark, sf)[0]


@query("b21_extend_coverage", "select subsystem_id, method, count(distinct case_id) as cases from extended group by all")
def b21c(spark, sf):
    return extended(spark, sf)[1]


@query("b22_before_after", "select family, a as lo_method, b as hi_method, x.pooled_se as pooled_se_before, y.pooled_se as pooled_se_after, y.pooled_se - x.pooled_se as pooled_se_change from pooled x full join alt_pooled y using (family, a, b)",
       rnd="pooled_se_before pooled_se_after pooled_se_change")
def b22(spark, sf):
    """The second table stores its pairs the other way round."""
    after = C.pool(C.pair_deltas(C.pair_diffs(alt_cs(spark, sf)))).select("family", F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("pooled_se")).alias("pooled_se"))
    return B.before_after(C.pool(deltas(spark, sf)), after, ["pooled_se"])


@query("b00_query_index", "select case_id, method, score, row_number() over (partition by subsystem_id, fault, method, coalesce(seed, -1) order by case_id) - 1 as q_idx from case_scores", rnd="score")
def b00(spark, sf):
    x = X.case_scores(spark, sf)
    chunk = F.substring(F.substring_index("case_id", "|", -1), 1, 2)  # ids of a subsystem sort by this prefix first
    return B.query_index(x, ["subsystem_id", "fault", "method", "seed"], chunk, [F.col("case_id")]).select("case_id", "method", "score", "q_idx")


# ---- integrity ---------------------------------------------------------------------------------------------------

@query("q01_check_unique", "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all having count(*) > 1")
def q01(spark, sf):
    return Q.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q02_check_case_sets", """
with d as (select distinct subsystem_id, method, case_id from gappy), f as (select subsystem_id, method, count(*) as n from d group by all),
 e as (select subsystem_id, min(m) as least from (select subsystem_id, case_id, count(*) as m from d group by all) group by all)
select subsystem_id, count(*) as methods, min(n) as n_min, max(n) as n_max, any_value(least) = count(*) as same_cases from f join e using (subsystem_id) group by subsystem_id""")
def q02(spark, sf):
    return Q.check_case_sets(gappy(spark, sf))


@query("q03_check_recorded", """
with g as (select subsystem_id, method, seed, count(*) as n, avg(score) as acc from case_scores group by all),
 r as (select subsystem_id, method, seed, count(*) as n_recorded, avg(score) as acc_recorded from gappy group by all)
select subsystem_id, method, seed, n, n_recorded, acc, acc_recorded, coalesce(n = n_recorded and abs(acc - acc_recorded) <= 1e-6, false) as ok from
 (select coalesce(g.subsystem_id, r.subsystem_id) as subsystem_id, coalesce(g.method, r.method) as method, coalesce(g.seed, r.seed) as seed, n, n_recorded, acc, acc_recorded
  from g full join r on g.subsystem_id = r.subsystem_id and g.method = r.method and g.seed is not distinct from r.seed)""", rnd="acc acc_recorded")
def q03(spark, sf):
    k = ["subsystem_id", "method", "seed"]
    rec = gappy(spark, sf).groupBy(*k).agg(F.count("*").alias("n_recorded"), F.avg("score").alias("acc_recorded"))
    return Q.check_recorded(X.case_scores(spark, sf), rec, k)


@query("q04_check_equal", f"select b.method, count(*) as n, count(*) filter (where abs(b.score - p.score) <= 1e-9) as equal, count(*) filter (where not abs(b.score - p.score) <= 1e-9) as different from case_scores b join patch p on {ON.format('b', 'p')} group by all")
def q04(spark, sf):
    return Q.check_equal(X.case_scores(spark, sf), patch(spark, sf), KEYS, ["method"])


@query("q05_check_one_to_one", """select c.method, count(*) as n, count(*) filter (where m = 1) as one, count(*) filter (where coalesce(m, 0) = 0) as none, count(*) filter (where m > 1) as many
  from contrast c left join (select case_id, method, count(*) as m from gappy group by all) g on c.case_id = g.case_id and c.method = g.method group by all""")
def q05(spark, sf):
    return Q.check_one_to_one(X.contrast(spark, sf), gappy(spark, sf), ["case_id", "method"], ["method"])


@query("q06_check_alignment", """select method, count(*) as keys_all, count(*) filter (where b.i is null) as only_a, count(*) filter (where a.i is null) as only_b, max(abs(a.score - b.score)) as max_abs_diff from
  (select *, coalesce(seed, -1) as run, 1 as i from gappy) a full join (select case_id, method, coalesce(seed, -1) as run, score, 1 as i from contrast) b using (case_id, method, run) group by all""", rnd="max_abs_diff")
def q06(spark, sf):
    return Q.check_alignment(with_run(gappy(spark, sf)), with_run(X.contrast(spark, sf)), RUN_KEYS, ["method"])


MS = ["m_cust", "m_price", "m_prio", "m_seeded"]


@query("q07_coverage_matrix", "select subsystem_id, " + ", ".join(f"count(distinct case_id) filter (where method = '{m}') as {m}" for m in MS) + " from gappy group by all")
def q07(spark, sf):
    return Q.coverage_matrix(gappy(spark, sf), MS)


DEGEN = """select system, method, sum(c)::bigint as n, first(top1 order by c desc, top1) as modal, max(c) / sum(c) as share, case when max(c) / sum(c) >= 0.9 then 'degenerate' else 'valid' end as label
  from (select system, method, top1, count(*) as c from outcomes_raw group by all) group by all"""
cte("degen", DEGEN)


@query("q08_degenerate_outputs", "select * from degen", rnd="share")
def q08(spark, sf):
    return Q.degenerate_outputs(outcomes_raw(spark, sf), ["system", "method"])


@query("q21_label_matrix", "select system, " + ", ".join(f"coalesce(max(label) filter (where method = '{m}'), 'n/a') as {m}" for m in ("m_first", "m_last", "m_const", "m_none")) + " from degen group by all")
def q21(spark, sf):
    return Q.label_matrix(outcomes_raw(spark, sf), "system", ["m_first", "m_last", "m_const", "m_none"])


# rankings without repeated items, and the column order of each case (by name)
cte("uranks", "select case_id, truth, item, row_number() over (partition by case_id order by min(pos)) as pos from rankings group by case_id, truth, item")
cte("ucols", "select case_id, item, row_number() over (partition by case_id order by item) as col from (select distinct case_id, item from rankings)")
cte("withcol", "select u.*, c.col, lead(c.col) over (partition by case_id order by pos) as next_col from uranks u left join ucols c using (case_id, item)")


def uranks(spark, sf):
    x = X.rankings(spark, sf).groupBy("case_id", "truth", "item").agg(F.min("pos").alias("p"))
    return x.withColumn("pos", F.row_number().over(W.partitionBy("case_id").orderBy("p"))).drop("p")


def ucols(spark, sf):
    return X.rankings(spark, sf).select("case_id", "item").distinct().withColumn("col", F.row_number().over(W.partitionBy("case_id").orderBy("item")))


cte("eqorder", "select case_id, bool_and(u.item is not distinct from c.item) as equals_order from (select case_id, pos as p, item from uranks where pos <= 10) u full join (select case_id, col as p, item from ucols where col <= 10) c using (case_id, p) group by all")


@query("q09_ranks_equal_order", "select * from eqorder")
def q09(spark, sf):
    return Q.ranks_equal_order(uranks(spark, sf), ucols(spark, sf))


@query("q10_suspicious_top", """select truth, count(*) as cases, count(*) filter (where t1) as top1, count(*) filter (where t5) as top5 from
  (select case_id, truth, bool_or(item like '%\\_7' escape '\\' and pos = 1) as t1, bool_or(item like '%\\_7' escape '\\') as t5 from uranks where pos <= 5 group by all) group by all""")
def q10(spark, sf):
    return Q.suspicious_top(uranks(spark, sf), F.col("item").endswith("_7"), ["truth"])


@query("q11_permutation_summary", """
with o as (select case_id, equals_order, split_part(item, '_', 1) as top1 from eqorder join uranks using (case_id) where pos = 1),
 rv as (select case_id, item, row_number() over (partition by case_id order by pos desc) as pos from uranks),
 pe as (select case_id, bool_and(u.item is not distinct from c.item) as equals_order from (select case_id, pos as p, item from rv where pos <= 10) u full join (select case_id, col as p, item from ucols where col <= 10) c using (case_id, p) group by all),
 p as (select case_id, equals_order, split_part(item, '_', 1) as top1 from pe join rv using (case_id) where pos = 1)
select count(*) as cases, count(*) filter (where o.equals_order) as original_follows, count(*) filter (where p.equals_order) as permuted_follows, count(*) filter (where o.top1 <> p.top1) as top1_changes from o join p using (case_id)""")
def q11(spark, sf):
    u, c = uranks(spark, sf), ucols(spark, sf)
    rev = u.withColumn("pos", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("pos"))))
    side = lambda d: Q.ranks_equal_order(d, c).join(d.filter("pos = 1").select("case_id", service_from_col("item").alias("top1")), "case_id")
    return Q.permutation_summary(side(u), side(rev))


@query("q12_top1_most_common", "select * from (select *, row_number() over (partition by truth order by c desc, item) as rank from (select truth, item, count(*) as c from uranks where pos = 1 group by all)) where rank <= 3")
def q12(spark, sf):
    return Q.top1_most_common(uranks(spark, sf), ["truth"])


@query("q17_ranks_monotone", """select truth, count(*) as cases, count(*) filter (where m) as monotone, avg(m::int::double) as share from
  (select case_id, truth, bool_and(next_col is null or col < next_col) and count(*) >= 2 as m from withcol group by all) group by all""", rnd="share")
def q17(spark, sf):
    return Q.ranks_monotone(Q.with_column_pos(uranks(spark, sf), ucols(spark, sf)), ["truth"], 2)


@query("q20_order_prefix", "select case_id, count(*) as len, max(case when col > next_col then pos else 0 end) as prefix from withcol group by all")
def q20(spark, sf):
    return Q.order_prefix(Q.with_column_pos(uranks(spark, sf), ucols(spark, sf)))


@query("q18_concentration", """
with c as (select truth, case_id, count(distinct split_part(item, '_', 1)) as d, split_part(first(item order by pos), '_', 1) as t from uranks where pos <= 10 group by all)
select truth, count(*) as cases, m.top_service, m.top_share, avg(d) as mean_services from c join (select truth, first(t order by k desc, t) as top_service, max(k) / sum(k) as top_share
  from (select truth, t, count(*) as k from c group by all) group by all) m using (truth) group by all""", rnd="top_share mean_services")
def q18(spark, sf):
    return Q.concentration(uranks(spark, sf), service_from_col("item"), ["truth"])


@query("q19_presence", """
with m as (select case_id, component, metric_id, bool_or(ts < t0) as pre, bool_or(not ts < t0) as post from telemetry group by all), t as (select distinct case_id, 'svc' || (substr(case_id, 12, 2)::int % 13) as truth from telemetry)
select case_id, truth, bool_or(component = truth and pre) as in_normal, bool_or(component = truth and post) as in_abnormal, count(*) filter (where post and not pre) as only_abnormal,
  count(*) filter (where pre and not post) as only_normal from m join t using (case_id) group by all""")
def q19(spark, sf):
    x = X.telemetry(spark, sf)
    t = x.select("case_id", F.concat(F.lit("svc"), (F.substring("case_id", 12, 2).cast("int") % 13).cast("string")).alias("truth")).distinct()
    return Q.presence(x, t)


@query("q13_literal_audit", """
with n as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) as number from documents),
 r as (select unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) as number from conversations union select unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) from benchmark)
select number, count(distinct doc_id) as docs, count(*) as occurrences from n where number not in (select number from r) group by all""")
def q13(spark, sf):
    reg = Q.numbers_in(table(spark, sf, "conversations").select("conv_id", "text"), "conv_id", "text").select("number").unionByName(
        Q.numbers_in(table(spark, sf, "benchmark"), "item_id", "text").select("number"))
    return Q.literal_audit(table(spark, sf, "documents").select("doc_id", "text"), reg, "doc_id", "text")


@query("q14_registry_diff", """
with o as (select subsystem_id || '|' || method as name, round(avg(score), 2) as value from cs where method <> 'm_prio' group by all),
 n as (select subsystem_id || '|' || method as name, round(avg(score), 2) as value from alt_cs where subsystem_id not like '%3' group by all)
select name, o.value as old, n.value as new, case when o.value is null then 'added' when n.value is null then 'removed' else 'changed' end as state from o full join n using (name)
where o.value is null or n.value is null or o.value <> n.value""", rnd="old new")
def q14(spark, sf):
    reg = lambda d: d.groupBy(F.concat_ws("|", "subsystem_id", "method").alias("name")).agg(F.round(F.avg("score"), 2).alias("value"))
    return Q.registry_diff(reg(cs(spark, sf).filter("method <> 'm_prio'")), reg(alt_cs(spark, sf).filter(~F.col("subsystem_id").endswith("3"))))


LANGS = ["en", "de", "fr", "es"]


@query("q15_survey_counts", "select source, count(*) as items, " + ", ".join(f"count(*) filter (where lang = '{l}') as n_{l}" for l in LANGS) + " from documents where doc_id not in (select doc_id from labels where toxic = 1) group by all")
def q15(spark, sf):
    ex = table(spark, sf, "labels").filter("toxic = 1")
    return Q.survey_counts(table(spark, sf, "documents").select("doc_id", "source", "lang"), ex, "doc_id", "source", "lang", LANGS)


@query("q16_inclusion_gate", """select method, covered, families, case when covered = k then 'yes' else 'no' end as main, case when covered = k then 'covers all subsystems' else 'covers ' || covered || ' of ' || k || ' subsystems' end as reason
  from (select method, count(distinct subsystem_id) as covered, count(distinct family) as families from gappy group by all), (select count(distinct subsystem_id) as k from gappy)""")
def q16(spark, sf):
    return Q.inclusion_gate(gappy(spark, sf))


# ---- intervals where methods miss cases ----------------------------------------------------------------------------

cte("gcs", "select family, subsystem_id, case_id, method, avg(score) as score from gappy group by all")
cte("gdiffs", diffs_sql("gcs"))
cte("gdeltas", deltas_sql("gdiffs"))
draw_ctes("gdraws", vectors_sql("gcs", "subsystem_id"), "subsystem_id", REPS)
cte("greps", f"select family, a, b, p.subsystem_id, rep, d from ({pair_means_sql('gdraws', 'subsystem_id')}) p join (select distinct family, subsystem_id from gcs) using (subsystem_id)")


@query("i01_boot_ci_gaps", """select family, a, b, subsystem_id, n, delta, lo, hi from gdeltas join (select family, a, b, subsystem_id, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi
  from greps group by all) using (family, a, b, subsystem_id)""", rnd="delta lo hi")
def i01g(spark, sf):
    """Each method misses other cases; deltas and intervals are of the matched ones."""
    g = C.case_score(gappy(spark, sf))
    d = R.attach_ci(C.pair_deltas(C.pair_diffs(g)), R.pair_replicates(g, REPS))
    return d.select("family", "a", "b", "subsystem_id", "n", "delta", "lo", "hi")
