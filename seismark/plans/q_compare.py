"""Paired comparison queries (C01 to C36)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.operators import compare as C
from seismark.operators import resample as R
from seismark.plans import fixtures as X
from seismark.plans.registry import cte, query
from seismark.plans.sqltext import REPS, complete_draws, complete_pairs, deltas_sql, diffs_sql, layered, names, pool_sql, sg

FAULTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark, sf, name, build):
    """A table that several branches of a query (and later queries) read: computed once, kept by the executors."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = build().persist()
    return _KEPT[key]


def release(spark):
    """Drop what ``kept`` holds."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        _KEPT.pop(key).unpersist()


def cs(spark, sf):
    return C.case_score(X.case_scores(spark, sf))


def shared_cs(spark, sf):
    """Case scores for queries that read them in several branches."""
    return kept(spark, sf, "cs", lambda: cs(spark, sf))


def kinds(spark, sf):
    """Cases with equal scores counted, for queries that need no more than means and draws of cases: one pass over the cases."""
    return kept(spark, sf, "kinds", lambda: C.case_kinds(cs(spark, sf)))


def deltas(spark, sf):
    return C.pair_deltas(C.pair_diffs(kinds(spark, sf), [*C.CASE, "times"]), weight="times")


def mreps(spark, sf):
    return kept(spark, sf, "mreps", lambda: R.method_replicates(kinds(spark, sf), REPS, weight="times"))


def reps(spark, sf):
    return kept(spark, sf, "reps", lambda: R.pair_replicates(kinds(spark, sf), REPS, weight="times"))


def dci(spark, sf):
    return kept(spark, sf, "dci", lambda: R.attach_ci(deltas(spark, sf), reps(spark, sf)))


@query("c01_case_score_mean", "select family, subsystem_id, case_id, method, score from cs", rnd="score")
def c01(spark, sf):
    return cs(spark, sf)


@query("c01_case_score_seed1", "select family, subsystem_id, case_id, method, score from case_scores where seed is null or seed = 1", rnd="score")
def c01s(spark, sf):
    return C.case_score(X.case_scores(spark, sf), "seed1")


@query("c02_method_pairs", """select distinct x.family, x.method as a, y.method as b from
  (select distinct family, method from case_scores) x join (select distinct family, method from case_scores) y
  on x.family = y.family and x.method < y.method""")
def c02(spark, sf):
    return C.method_pairs(X.case_scores(spark, sf))


@query("c03_pair_diffs", "select * from diffs", rnd="ya yb d")
def c03(spark, sf):
    return C.pair_diffs(cs(spark, sf))


@query("c04_pair_deltas", "select * from deltas", rnd="acc_a acc_b delta var")
def c04(spark, sf):
    return deltas(spark, sf)


@query("c05_pool", "select * from pooled", rnd="pooled_cw pooled_se")
def c05(spark, sf):
    return C.pool(deltas(spark, sf))


def rules_sql(src: str, keys: str = "family, a, b") -> str:
    inner = "list_avg(list_slice(ds, {0} + 1, k - {0}))"
    return f"""
with g as (select {keys}, count(*) as k, avg(delta) as mean, median(delta) as median, sum(n * delta) / sum(n) as case_weighted,
             list(delta order by delta) as ds from {src} group by {keys}),
 r as (select {keys}, k, ds, 'mean' as rule, mean as pooled from g union all select {keys}, k, ds, 'median', median from g
   union all select {keys}, k, ds, 'case_weighted', case_weighted from g
   union all select {keys}, k, ds, 'drop_extremes', {inner.format('1')} from g
   union all select {keys}, k, ds, 'trimmed', {inner.format('cast(floor(k * 0.1) as bigint)')} from g)
select {keys}, k, rule, pooled, (select count(*) from (select unnest(ds) as v) where {sg('v')} * {sg('pooled')} < 0) as n_rev from r"""


@query("c06_pooling_rules", rules_sql("deltas"), rnd="pooled")
def c06(spark, sf):
    return C.pooling_rules(deltas(spark, sf))


@query("c07_reversals", "select * from revs", rnd="pooled_cw pooled_se")
def c07(spark, sf):
    return C.reversals(deltas(spark, sf))


def rev_ci(p: str) -> str:
    return f"(({p} > 1e-9 and hi < 0) or ({p} < -1e-9 and lo > 0))"


cte("revci", f"""select family, a, b, count(*) filter (where {rev_ci('pooled_cw')}) as n_rev_ci_cw, {names(rev_ci('pooled_cw'))} as rev_ci_cw,
  count(*) filter (where {rev_ci('pooled_se')}) as n_rev_ci_se, {names(rev_ci('pooled_se'))} as rev_ci_se from dcip group by family, a, b""")


@query("c08_reversals_ci", "select * from revci")
def c08(spark, sf):
    return C.reversals_ci(dci(spark, sf))


SPREAD = f"""select family, a, b, stddev_samp(delta) as sd_sub_delta, count(*) filter (where {sg('delta')} > 0) as n_pos,
  count(*) filter (where {sg('delta')} < 0) as n_neg from deltas group by family, a, b"""
cte("spreads", SPREAD)


@query("c09_spread", SPREAD, rnd="sd_sub_delta")
def c09(spark, sf):
    return C.spread(deltas(spark, sf))


cte("margins", """select family, a, b, k, pooled_se, abs(pooled_se) as abs_margin, sd_sub_delta, abs(pooled_se) < sd_sub_delta as margin_lt_sd,
  n_rev_se, n_rev_se > 0 as reverses from revs join spreads using (family, a, b)""")


@query("c10_margins", "select * from margins", rnd="pooled_se abs_margin sd_sub_delta")
def c10(spark, sf):
    return C.margins(deltas(spark, sf))


@query("c10_margin_dispersion", "select family, margin_lt_sd, count(*) as pairs, count(*) filter (where reverses) as reverse from margins group by all")
def c10d(spark, sf):
    return C.margin_dispersion(deltas(spark, sf), by=["family"])


cte("unit_table", "select family as tbl, subsystem_id as unit, method, round(acc, 2) as value from acc")


def unit_table(spark, sf):
    return C.accuracy(cs(spark, sf)).select(F.col("family").alias("tbl"), F.col("subsystem_id").alias("unit"), "method", F.round("acc", 2).alias("value"))


@query("c11_table_margins", f"""
with p as (select x.tbl, x.method as a, y.method as b, x.value - y.value as d from unit_table x join unit_table y
             on x.tbl = y.tbl and x.unit = y.unit and x.method < y.method),
 g as (select tbl, a, b, count(*) as k, avg(d) as pooled, stddev_samp(d) as sd_units, count(*) filter (where {sg('d')} > 0) as units_a_wins,
         count(*) filter (where {sg('d')} < 0) as units_b_wins from p group by all)
select tbl, a, b, k, pooled, abs(pooled) as abs_margin, sd_units, case when {sg('pooled')} > 0 then units_b_wins when {sg('pooled')} < 0 then units_a_wins else 0 end as n_rev,
  units_a_wins, units_b_wins from g""", rnd="pooled abs_margin sd_units")
def c11(spark, sf):
    return C.table_margins(unit_table(spark, sf))


@query("c11_adjacent_gaps", """
select tbl, method, mean, mean - lead(mean) over (partition by tbl order by round(mean, 9) desc, method) as gap_to_next
from (select tbl, method, avg(value) as mean from unit_table group by all)""", rnd="mean gap_to_next")
def c11g(spark, sf):
    return C.adjacent_gaps(unit_table(spark, sf))


# two "releases": even and odd families share applications by nation position (n_nationkey div 5)
APP = "cast(cast(split_part(subsystem_id, 'NATION_', 2) as bigint) // 5 as varchar)"
cte("rel", f"select family, a, b, {APP} as app, n, delta, lo, hi from dci where family in ('AFRICA', 'ASIA')")


def of_release(d, fam):
    app = F.floor(F.element_at(F.split("subsystem_id", "NATION_"), 2).cast("bigint") / 5).cast("string")
    return d.filter(F.col("family") == fam).withColumn("app", app)


CROSS = f"""select x.a, x.b, x.app, x.n as n_1, x.delta as delta_1, x.lo as lo_1, x.hi as hi_1, y.n as n_2, y.delta as delta_2, y.lo as lo_2, y.hi as hi_2,
  {sg('x.delta')} = {sg('y.delta')} as sign_agree, (x.lo > 0 and y.hi < 0) or (x.hi < 0 and y.lo > 0) as ci_opposite,
  abs(x.delta) - abs(y.delta) as abs_delta_diff from rel x join rel y on x.a = y.a and x.b = y.b and x.app = y.app
  where x.family = 'AFRICA' and y.family = 'ASIA'"""


@query("c12_cross_release", CROSS, rnd="delta_1 lo_1 hi_1 delta_2 lo_2 hi_2 abs_delta_diff")
def c12(spark, sf):
    d = dci(spark, sf)
    return C.cross_release(of_release(d, "AFRICA"), of_release(d, "ASIA"))


cte("cslay", f"select layer, family, subsystem_id, case_id, method, avg(score) as score from {layered('case_scores')} group by all")
cte("acclay", """select * from (select layer, family, subsystem_id, method, avg(score) as acc from cslay group by all)
  join (select layer, family, subsystem_id, count(distinct case_id) as n_cases from cslay group by all) using (layer, family, subsystem_id)""")


@query("c13_regret", """
with k as (select layer, family, count(distinct subsystem_id) as k from acclay group by all),
 per as (select layer, family, method, count(*) as ks, sum(acc * n_cases) / sum(n_cases) as cw, avg(acc) as se from acclay group by all),
 cmp as (select *, ks = k as complete from per join k using (layer, family)),
 ex as (select layer, family, count(*) filter (where complete) as methods_ranked,
          coalesce(string_agg(method, ';' order by method) filter (where not complete), '') as methods_excluded from cmp group by all),
 l as (select layer, family, method, 'case_weighted' as weighting, cw as pooled from cmp where complete
       union all select layer, family, method, 'system_equal', se from cmp where complete),
 r as (select *, row_number() over (partition by layer, family, weighting order by round(pooled, 9) desc, method) as r from l),
 top as (select layer, family, weighting, max(method) filter (where r = 1) as winner, max(pooled) filter (where r = 1) as winner_pooled,
           max(method) filter (where r = 2) as runner_up, max(pooled) filter (where r = 2) as runner_up_pooled from r group by all),
 best as (select layer, family, subsystem_id, n_cases, first(method order by round(acc, 9) desc, method) as best_method, max(acc) as best_acc
          from acclay group by all)
select layer, family, weighting, winner, winner_pooled, runner_up, runner_up_pooled, subsystem_id, best.n_cases, w.acc as winner_acc,
  best_method, best_acc, best_acc - w.acc as regret, methods_ranked, methods_excluded
from top join best using (layer, family) join acclay w using (layer, family, subsystem_id) join ex using (layer, family) where w.method = winner""",
       rnd="winner_pooled runner_up_pooled winner_acc best_acc regret")
def c13(spark, sf):
    x = C.case_score(C.with_layers(X.case_scores(spark, sf)), extra=["layer"])
    return C.regret(x, ["layer"])


@query("c14_small_sample", f"""
with x as (select * from dci, (select unnest([0, 600, 620]) as n_min) where n >= n_min),
 p as ({pool_sql('x', 'n_min, family, a, b')})
select n_min, family, a, b, k, pooled_se, count(*) filter (where {sg('delta')} * {sg('pooled_se')} < 0) as n_rev,
  count(*) filter (where {rev_ci('pooled_se')}) as n_rev_ci from x join p using (n_min, family, a, b) group by all""", rnd="pooled_se")
def c14(spark, sf):
    return C.small_sample(dci(spark, sf), (0, 600, 620))


@query("c15_accuracy", "select family, subsystem_id, method, acc from acc", rnd="acc")
def c15(spark, sf):
    return C.accuracy_table(cs(spark, sf))


@query("c15_accuracy_wide", """select family, subsystem_id, max(acc) filter (where method = 'm_cust') as m_cust,
  max(acc) filter (where method = 'm_price') as m_price, max(acc) filter (where method = 'm_prio') as m_prio,
  max(acc) filter (where method = 'm_seeded') as m_seeded from acc group by all""", rnd="m_cust m_price m_prio m_seeded")
def c15w(spark, sf):
    return C.accuracy_table(cs(spark, sf), ["m_cust", "m_price", "m_prio", "m_seeded"])


# alternative condition: the base rows of one fault class replaced by the contrast rows
cte("alt_scores", "select * exclude (role, valid_output) from case_scores where fault <> '1-URGENT' union all select * exclude (role, valid_output) from contrast")
cte("alt_cs", "select family, subsystem_id, case_id, method, avg(score) as score from alt_scores group by all")
cte("alt_diffs", diffs_sql("alt_cs"))
cte("alt_deltas", deltas_sql("alt_diffs"))
cte("alt_pooled", pool_sql("alt_deltas"))
complete_draws("altdraws", "alt_cs", "subsystem_id", REPS)
cte("alt_ci", f"""select a, b, p.subsystem_id, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from ({complete_pairs('altdraws', 'subsystem_id')}) p group by all""")


def cond_side(tag: str, d: str, p: str, ci: str) -> str:
    return (f"{d}.n as n_{tag}, {d}.acc_a as acc_a_{tag}, {d}.acc_b as acc_b_{tag}, {d}.delta as delta_{tag}, {ci}.lo as lo_{tag}, {ci}.hi as hi_{tag}, {p}.pooled_se as pooled_{tag}, "
            f"{sg(f'{d}.delta')} * {sg(f'{p}.pooled_se')} < 0 as rev_{tag}, ({p}.pooled_se > 1e-9 and {ci}.hi < 0) or ({p}.pooled_se < -1e-9 and {ci}.lo > 0) as rev_ci_{tag}")


cte("conds", f"""select *, {sg('delta_ref')} <> {sg('delta_alt')} as sign_change, rev_ref <> rev_alt as status_change, rev_ci_ref <> rev_ci_alt as ci_status_change from (
  select x.family, x.a, x.b, x.subsystem_id, {cond_side('ref', 'x', 'p', 'x')}, {cond_side('alt', 'y', 'q', 'z')}
  from dci x join pooled p using (family, a, b) join alt_deltas y using (family, a, b, subsystem_id) join alt_pooled q using (family, a, b) join alt_ci z using (a, b, subsystem_id))""")


def alt_cs(spark, sf):
    base = X.case_scores(spark, sf).filter("fault <> '1-URGENT'")
    return C.case_score(base.unionByName(X.contrast(spark, sf)))


def conds(spark, sf):
    alt = kept(spark, sf, "alt_cs", lambda: alt_cs(spark, sf))
    alt_ci = R.attach_ci(C.pair_deltas(C.pair_diffs(alt)), R.pair_replicates(alt, REPS))
    return C.compare_conditions(dci(spark, sf), alt_ci)


@query("c16_compare_conditions", "select * from conds", rnd="acc_a_ref acc_b_ref delta_ref lo_ref hi_ref pooled_ref acc_a_alt acc_b_alt delta_alt lo_alt hi_alt pooled_alt")
def c16(spark, sf):
    return conds(spark, sf)


@query("c17_kendall_tau", f"""
with alt as (select family, subsystem_id, method, avg(score) as acc from alt_cs group by all),
 j as (select acc.family, acc.subsystem_id, method, acc.acc as x, alt.acc as y from acc join alt using (subsystem_id, method)),
 t as (select family, subsystem_id, first(method order by round(x, 9) desc, method) as top_ref, first(method order by round(y, 9) desc, method) as top_alt from j group by all),
 s as (select u.family, u.subsystem_id, {sg('(u.x - v.x)')} as sx, {sg('(u.y - v.y)')} as sy from j u join j v
       on u.subsystem_id = v.subsystem_id and u.method < v.method)
select family, subsystem_id, sum(sx * sy)::double / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))), 0) as tau, top_ref, top_alt, top_ref = top_alt as same_top
from s join t using (family, subsystem_id) group by family, subsystem_id, top_ref, top_alt""", rnd="tau")
def c17(spark, sf):
    return C.kendall_tau(C.accuracy(cs(spark, sf)), C.accuracy(alt_cs(spark, sf)))


COVERAGE = """select family, subsystem_id, method, seed, count(*) as n, count(*) filter (where valid_output = 1) as n_valid,
  avg(valid_output::double) as coverage, avg(score) as acc_all, avg(score) filter (where valid_output = 1) as acc_valid_only from case_scores group by all"""


@query("c18_coverage", COVERAGE, rnd="coverage acc_all acc_valid_only")
def c18(spark, sf):
    return C.coverage(X.case_scores(spark, sf))


@query("c19_denominator_effect", f"""
with ps as (select family, subsystem_id, method, seed, avg(score) as s_all, case when sum(valid_output) > 0 then sum(score) / sum(valid_output) end as s_valid from case_scores group by all),
 m as (select family, subsystem_id, method, avg(s_all) as s_all, avg(s_valid) as s_valid from ps group by all),
 j as (select x.family, x.method as a, y.method as b, x.subsystem_id, x.s_all - y.s_all as delta_all, x.s_valid - y.s_valid as delta_valid from m x join m y
   on x.family = y.family and x.subsystem_id = y.subsystem_id and x.method < y.method where x.s_valid is not null and y.s_valid is not null),
 p as (select family, a, b, avg(delta_all) as pooled_all, avg(delta_valid) as pooled_valid from j group by all having count(*) >= 2)
select family, a, b, subsystem_id, delta_all, pooled_all, delta_valid, pooled_valid, {sg('delta_all')} <> {sg('delta_valid')} as sign_change,
  ({sg('delta_all')} * {sg('pooled_all')} < 0) <> ({sg('delta_valid')} * {sg('pooled_valid')} < 0) as status_change from j join p using (family, a, b)""",
       rnd="delta_all pooled_all delta_valid pooled_valid")
def c19(spark, sf):
    return C.denominator_effect(X.case_scores(spark, sf))


def csf(spark, sf):
    return C.case_score(X.case_scores(spark, sf), extra=["fault"])


cte("fdiffs", diffs_sql("csf", "family, subsystem_id, fault, case_id"))


@query("c20_stratified_deltas", f"""
with d as (select family, a, b, subsystem_id, fault, count(*) as n, avg(d) as delta from fdiffs group by all)
select *, max({sg('delta')}) over w > 0 and min({sg('delta')}) over w < 0 as sign_disagree from d window w as (partition by family, a, b, subsystem_id)""", rnd="delta")
def c20(spark, sf):
    return C.stratified_deltas(csf(spark, sf))


cte("common_faults", """select x.family, x.fault from (select family, fault, count(distinct subsystem_id) as h from csf group by all) x
  join (select family, count(distinct subsystem_id) as k from csf group by all) y on x.family = y.family and x.h = y.k""")


cte("csf_common", "select csf.*, concat_ws('@', subsystem_id, fault) as stratum from csf join common_faults using (family, fault)")
complete_draws("drawsf", "csf_common", "stratum", REPS, ratios=True)
cte("rwreps", f"""select family, a, b, subsystem_id, rep, avg(d) as d from ({complete_pairs('drawsf', 'stratum')})
  join (select distinct family, subsystem_id, stratum from csf_common) using (stratum) group by all""")


@query("c21_reweighted", f"""
with cell as (select family, a, b, subsystem_id, fault, avg(d) as cell, count(*) as n, sum(d) as s from fdiffs group by all),
 ref as (select family, a, b, subsystem_id, sum(s) / sum(n) as delta_ref, max(cell) > 0 and min(cell) < 0 as fault_sign_disagree from cell group by all),
 rw as (select family, a, b, subsystem_id, count(*) as classes, avg(cell) as delta_rw from cell join common_faults using (family, fault) group by all),
 ci as (select family, a, b, subsystem_id, quantile_cont(d, 0.025) as lo_rw, quantile_cont(d, 0.975) as hi_rw from rwreps group by all),
 j as (select *, avg(delta_ref) over w as pooled_ref, avg(delta_rw) over w as pooled_rw, count(*) over w as k from ref join rw using (family, a, b, subsystem_id) join ci using (family, a, b, subsystem_id)
   window w as (partition by family, a, b))
select * exclude (k), {sg('delta_ref')} * {sg('pooled_ref')} < 0 as rev_ref, {sg('delta_rw')} * {sg('pooled_rw')} < 0 as rev_rw,
  (pooled_rw > 1e-9 and hi_rw < 0) or (pooled_rw < -1e-9 and lo_rw > 0) as rev_ci_rw, {sg('delta_ref')} <> {sg('delta_rw')} as sign_change from j where k >= 2""",
       rnd="delta_ref delta_rw lo_rw hi_rw pooled_ref pooled_rw")
def c21(spark, sf):
    x = kept(spark, sf, "kinds_f", lambda: C.case_kinds(csf(spark, sf), ["fault"]))
    return C.reweighted_reversals(x, C.reweighted(x, "times"), R.strata_pair_replicates(C.common_faults(x), REPS, weight="times"), "times")


@query("c22_fault_composition", "select family, subsystem_id, " + ", ".join(
    f"count(distinct case_id) filter (where fault = '{f}') as \"{f}\"" for f in FAULTS) + " from case_scores group by all")
def c22(spark, sf):
    return C.fault_composition(csf(spark, sf), FAULTS)


@query("c23_cross_release_shared", f"""
with shared as (select fault from csf where family in ('AFRICA', 'ASIA') group by fault having count(distinct family) = 2),
 d as (select family, a, b, {APP} as app, d from fdiffs join shared using (fault) where family in ('AFRICA', 'ASIA')),
 g as (select family, a, b, app, count(*) as n, avg(d) as delta from d group by all)
select x.a, x.b, x.app, x.n as n_1, x.delta as delta_1, y.n as n_2, y.delta as delta_2, {sg('x.delta')} = {sg('y.delta')} as sign_agree
from g x join g y using (a, b, app) where x.family = 'AFRICA' and y.family = 'ASIA'""", rnd="delta_1 delta_2")
def c23(spark, sf):
    x = csf(spark, sf).filter(F.col("family").isin("AFRICA", "ASIA"))
    shared = C.common_values(x, "fault", "family")
    d = C.pair_deltas(C.pair_diffs(x.join(shared, "fault", "left_semi"))).withColumn("lo", F.col("delta")).withColumn("hi", F.col("delta"))
    return C.cross_release(of_release(d, "AFRICA"), of_release(d, "ASIA")).select("a", "b", "app", "n_1", "delta_1", "n_2", "delta_2", "sign_agree")


cte("views", """select 'pooled' as "view", method, count(*) as n, avg(score) as acc from cs group by all
  union all select 'only:' || family, method, count(*), avg(score) from cs group by all
  union all select 'drop:' || f.family, method, count(*), avg(score) from cs join (select distinct family from cs) f on cs.family <> f.family group by all""")
cte("vdeltas", """select x."view", x.method as a, y.method as b, x.acc - y.acc as delta from views x join views y on x."view" = y."view" and x.method < y.method""")


@query("c24_views", "select * from views", rnd="acc")
def c24(spark, sf):
    return C.views(cs(spark, sf))


@query("c24_view_deltas", "select * from vdeltas", rnd="delta")
def c24d(spark, sf):
    return C.view_deltas(C.views(cs(spark, sf)))


@query("c25_rank_flips", f"""select *, views_a > 0 and views_b > 0 as flips from (select a, b, count(*) filter (where {sg('delta')} > 0) as views_a,
  count(*) filter (where {sg('delta')} < 0) as views_b, count(*) filter (where {sg('delta')} = 0) as views_tie from vdeltas group by all)""")
def c25(spark, sf):
    return C.rank_flips(C.view_deltas(C.views(cs(spark, sf))))


@query("c26_headline", """select family, method, min(rk) as best_rank, max(rk) as worst_rank, max(rk) - min(rk) as rank_spread, min(acc) as min_acc, max(acc) as max_acc
  from (select *, rank() over (partition by family, subsystem_id order by round(acc, 9) desc) as rk from acc) group by all""", rnd="min_acc max_acc")
def c26(spark, sf):
    return C.headline(cs(spark, sf))


@query("c27_variance_decomposition", """
with f as (select a, b, family, count(*) as k, avg(delta) as m, var_pop(delta) as v from deltas group by all),
 g as (select *, sum(k * m) over w / sum(k) over w as gm from f window w as (partition by a, b)),
 s as (select a, b, sum(k * (m - gm) ** 2) as ss_between, sum(k * v) as ss_within from g group by all)
select *, ss_between + ss_within as ss_total, case when ss_between + ss_within > 1e-9 then ss_between / (ss_between + ss_within) end as share_between from s""",
       rnd="ss_between ss_within ss_total share_between")
def c27(spark, sf):
    return C.variance_decomposition(deltas(spark, sf))


cte("difficulty", """
select g.subsystem_id, n, classes, majority_share, entropy_bits, services, majority_share * classes as lift from
 (select subsystem_id, sum(c)::bigint as n, count(*) as classes, max(p) as majority_share, sum(-p * log2(p)) as entropy_bits from
   (select *, c / sum(c) over (partition by subsystem_id) as p from (select subsystem_id, fault, count(*) as c from case_scores group by all)) group by all) g
 join (select subsystem_id, count(distinct method) as services from case_scores group by all) s using (subsystem_id)""")


def difficulty(spark, sf):
    return C.difficulty(X.case_scores(spark, sf), "subsystem_id", "fault", "method")


@query("c28_difficulty", "select * from difficulty", rnd="majority_share entropy_bits lift")
def c28(spark, sf):
    return difficulty(spark, sf)


@query("c28_label_difficulty", """
with j as (select lang, source, quality || '/' || toxic as label from labels join documents using (doc_id)),
 p as (select *, c / sum(c) over (partition by lang) as p from (select lang, label, count(*) as c from j group by all))
select g.lang, n, classes, majority_share, entropy_bits, services, majority_share * classes as lift from
 (select lang, sum(c)::bigint as n, count(*) as classes, max(p) as majority_share, sum(-p * log2(p)) as entropy_bits from p group by all) g
 join (select lang, count(distinct source) as services from j group by all) s using (lang)""", rnd="majority_share entropy_bits lift")
def c28l(spark, sf):
    from seismark.plans.registry import table
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    j = j.select("lang", "source", F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"))
    return C.difficulty(j, "lang", "label", "source")


@query("c29_stability_lines", """
with o as (select family, case when b = 'm_price' then a else b end as method, subsystem_id, case when b = 'm_price' then delta else -delta end as gap,
   case when b = 'm_price' then lo else -hi end as lo, case when b = 'm_price' then hi else -lo end as hi from dci where a = 'm_price' or b = 'm_price')
select family, method, count(*) filter (where lo > 0) as wins, count(*) filter (where lo <= 0 and hi >= 0) as ties, count(*) filter (where hi < 0) as losses,
  first(subsystem_id order by round(gap, 9), subsystem_id) as worst_subsystem, min(gap) as worst_gap from o group by all""", rnd="worst_gap")
def c29(spark, sf):
    return C.stability_lines(dci(spark, sf), "m_price")


cte("vcs", """select 'mean' as variant, family, subsystem_id, case_id, method, avg(score) as score from case_scores group by all
  union all select 'seed' || k, family, subsystem_id, case_id, method, score from case_scores, (select unnest([0, 1, 2]) as k) where seed is null or seed = k""")
cte("vdiffs", diffs_sql("vcs", "variant, family, subsystem_id, case_id"))
cte("vd", deltas_sql("vdiffs", "variant, family, a, b, subsystem_id"))
cte("variants", f"""select variant, family, a, b, pooled_se, count(*) filter (where {sg('delta')} * {sg('pooled_se')} < 0) as n_rev_se
  from vd join ({pool_sql('vd', 'variant, family, a, b')}) using (variant, family, a, b) group by all""")


def variant_deltas(spark, sf):
    """The seed mean and each seed, from one scan: a row is sent to the variants it belongs to."""
    x = X.case_scores(spark, sf)
    all_v = F.array(*[F.lit(v) for v in ("mean", "seed0", "seed1", "seed2")])
    own = F.array(F.lit("mean"), F.concat(F.lit("seed"), F.col("seed").cast("string")))
    x = x.withColumn("variant", F.explode(F.when(F.col("seed").isNull(), all_v).otherwise(own)))
    return C.pair_deltas(C.pair_diffs(C.case_score(x, extra=["variant"]), ["variant", *C.CASE]), ["variant", *C.PAIR, "subsystem_id"])


def variants(spark, sf):
    return C.reversals(variant_deltas(spark, sf), ["variant", *C.PAIR]).select("variant", *C.PAIR, "pooled_se", "n_rev_se")


@query("c30_seed_effect", f"""
with r as (select distinct method from case_scores where seed is not null),
 x as (select vd.variant, vd.family, vd.a, vd.b, subsystem_id, {sg('delta')} as s, {sg('delta')} * {sg('pooled_se')} < 0 as r from vd join variants using (variant, family, a, b)
   where vd.a in (select method from r) or vd.b in (select method from r))
select k.family, k.a, k.b, k.subsystem_id, count(*) as seeds, bool_or(k.s <> m.s) as any_sign, bool_or(k.r <> m.r) as any_status
from x k join x m using (family, a, b, subsystem_id) where k.variant <> 'mean' and m.variant = 'mean' group by all""")
def c30(spark, sf):
    return C.seed_effect(variant_deltas(spark, sf), X.case_scores(spark, sf).filter("seed is not null"))


@query("c31_factor_summary", """select a, b, count(*) as comparisons, count(*) filter (where sign_change) as sign_changes, avg(sign_change::double) as sign_share,
  count(*) filter (where status_change) as status_changes from conds group by all""", rnd="sign_share")
def c31(spark, sf):
    return C.factor_summary(conds(spark, sf), ["a", "b"])


cte("loso", f"""select family, a, b, subsystem_id, (sum(delta) over w - delta) / (count(*) over w - 1) as pooled_train, delta as held_delta
  from deltas window w as (partition by family, a, b)""")


@query("c32_flip_diagnostics", f"""
with l as (select *, {sg('pooled_train')} * {sg('held_delta')} < 0 as reversal from loso),
 conc as (select subsystem_id, max(c) / sum(c) as top_share from (select subsystem_id, score, count(*) as c from case_scores group by all) group by all)
select family, a, b, l.subsystem_id, pooled_train, held_delta, majority_share, entropy_bits, top_share
from l left join difficulty d using (subsystem_id) left join conc using (subsystem_id) where reversal""",
       rnd="pooled_train held_delta majority_share entropy_bits top_share")
def c32(spark, sf):
    from seismark.operators.holdout import loso_pairs
    conc = X.case_scores(spark, sf).groupBy("subsystem_id", "score").count().groupBy("subsystem_id").agg(
        (F.max("count") / F.sum("count")).alias("top_share"))
    l = loso_pairs(deltas(spark, sf)).filter("rule = 'mean'")
    return C.flip_diagnostics(l, difficulty(spark, sf), conc).select(
        "family", "a", "b", "subsystem_id", "pooled_train", "held_delta", "majority_share", "entropy_bits", "top_share")


@query("c33_merge_alias", """select family, subsystem_id, case when method = 'm_prio' then 'm_price' else method end as method, max(acc) as acc, count(*) > 1 as overlap
  from acc group by family, subsystem_id, case when method = 'm_prio' then 'm_price' else method end""", rnd="acc")
def c33(spark, sf):
    return C.merge_alias(C.accuracy(cs(spark, sf)), "m_prio", "m_price")


@query("c35_reversal_summary", """select family, count(*) as pairs, count(*) filter (where n_rev_se > 0) as with_reversal,
  count(*) filter (where n_rev_ci_se > 0) as with_ci_reversal, sum(n_rev_se)::bigint as reversals from revs join revci using (family, a, b) group by all""")
def c35(spark, sf):
    d = dci(spark, sf)
    p = C.reversals(d).join(C.reversals_ci(d), C.PAIR)
    return C.reversal_summary(p, ["family"])


@query("c36_variant_pivot", "select family, a, b, " + ", ".join(f"max(pooled_se) filter (where variant = '{v}') as {v}" for v in ("mean", "seed0", "seed1", "seed2"))
       + " from variants group by all", rnd="mean seed0 seed1 seed2")
def c36(spark, sf):
    return C.variant_pivot(variants(spark, sf), ["mean", "seed0", "seed1", "seed2"])
