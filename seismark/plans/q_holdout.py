"""Held-out validation queries (H01 to H10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.operators import compare as C
from seismark.operators import holdout as H
from seismark.plans import fixtures as X
from seismark.plans.q_compare import cs, dci, deltas, kept, kinds
from seismark.plans.registry import cte, query
from seismark.plans.sqltext import sg


def judge(src: str, cols: str) -> str:
    s, h = sg("pooled_train"), sg("held_delta")
    return f"""select {cols}, case when {s} > 0 then a when {s} < 0 then b end as winner, {s} * {h} < 0 as reversal, {s} = 0 or {h} = 0 as tie,
      case when {s} * {h} < 0 then abs(held_delta) else 0 end as regret from ({src})"""


LOSO = """with x as (select family, a, b, subsystem_id, delta as held_delta, (sum(delta) over w - delta) / (count(*) over w - 1) as m,
   (sum(n * delta) over w - n * delta) / (sum(n) over w - n) as c from deltas window w as (partition by family, a, b))
 select family, a, b, subsystem_id, held_delta, 'mean' as rule, m as pooled_train from x union all select family, a, b, subsystem_id, held_delta, 'case_weighted', c from x"""
COLS = "family, a, b, subsystem_id, held_delta, rule, pooled_train"
cte("loso_pairs", judge(LOSO, COLS))


@query("h01_loso_pairs", "select * from loso_pairs", rnd="held_delta pooled_train regret")
def h01(spark, sf):
    return H.loso_pairs(deltas(spark, sf))


@query("h01_loso_summary", """select family, rule, count(*) as decisions, count(*) filter (where reversal) as reversals, count(*) filter (where tie) as ties,
  avg(regret) as mean_regret, max(regret) as max_regret from loso_pairs group by all""", rnd="mean_regret max_regret")
def h01s(spark, sf):
    return H.loso_summary(H.loso_pairs(deltas(spark, sf)))


cte("loso_rest", """select x.a, x.b, x.subsystem_id, x.delta as held_delta, y.delta, y.n from deltas x join deltas y on x.a = y.a and x.b = y.b and x.subsystem_id <> y.subsystem_id""")
POOLING = """with g as (select a, b, subsystem_id, held_delta, avg(delta) as m, median(delta) as md, sum(n * delta) / sum(n) as cw, list(delta order by delta) as ds from loso_rest group by all)
 select a, b, subsystem_id, held_delta, 'mean' as rule, m as pooled_train from g union all select a, b, subsystem_id, held_delta, 'median', md from g
 union all select a, b, subsystem_id, held_delta, 'case_weighted', cw from g union all select a, b, subsystem_id, held_delta, 'trimmed', list_avg(list_slice(ds, 2, len(ds) - 1)) from g"""


@query("h02_loso_pooling", judge(POOLING, "a, b, subsystem_id, held_delta, rule, pooled_train"), rnd="held_delta pooled_train regret")
def h02(spark, sf):
    return H.loso_pooling(deltas(spark, sf), ["a", "b"])


cte("accc", """select family, subsystem_id, method, acc, n from acc join (select family, method from acc group by family, method
  having count(*) = (select count(distinct s.subsystem_id) from acc s where s.family = acc.family)) using (family, method)""")


@query("h03_loso_family", """
with x as (select *, (sum(acc) over w - acc) / (count(*) over w - 1) as train, max(round(acc, 9)) over (partition by family, subsystem_id) as top
           from acc window w as (partition by family, method))
select family, subsystem_id as held_out, count(*) as n_methods, first(method order by round(train, 9) desc, method) as winner,
  first(acc order by round(train, 9) desc, method) as winner_acc, max(acc) as best_acc, string_agg(method, ';' order by method) filter (where round(acc, 9) = top) as best_methods,
  max(acc) - first(acc order by round(train, 9) desc, method) as regret from x group by all""", rnd="winner_acc best_acc regret")
def h03(spark, sf):
    return H.loso_family(C.accuracy(cs(spark, sf)))


@query("h04_suite_holdout", f"""
with t as (select f.family, d.a, d.b, avg(d.acc_a) - avg(d.acc_b) as m, (sum(d.n * d.acc_a) - sum(d.n * d.acc_b)) / sum(d.n) as c from deltas d
             join (select distinct family from deltas) f on d.family <> f.family group by all),
 h as (select family, a, b, avg(acc_a) - avg(acc_b) as m, (sum(n * acc_a) - sum(n * acc_b)) / sum(n) as c from deltas group by all),
 r as (select family, a, b, 'macro' as rule, t.m as train, h.m as held from t join h using (family, a, b)
       union all select family, a, b, 'case_weighted', t.c, h.c from t join h using (family, a, b)),
 s as (select r.family, r.a, r.b, rule, count(*) filter (where {sg('train')} * {sg('(acc_a - acc_b)')} < 0) as systems_missed,
         avg(case when {sg('train')} * {sg('(acc_a - acc_b)')} < 0 then abs(acc_a - acc_b) else 0 end) as system_regret from r join deltas using (family, a, b) group by all)
select family, a, b, rule, train, held, case when {sg('train')} > 0 then a when {sg('train')} < 0 then b else 'tie' end as selected, {sg('train')} * {sg('held')} < 0 as mis_selected,
  case when {sg('train')} * {sg('held')} < 0 then abs(held) else 0 end as family_regret, systems_missed, system_regret from r join s using (family, a, b, rule)""",
       rnd="train held family_regret system_regret")
def h04(spark, sf):
    return H.suite_holdout(deltas(spark, sf))


# training leaderboards: accuracy of each method on the other subsystems of the family
cte("board", """select h.family, h.subsystem_id as held_out, t.method, avg(t.acc) as se,
  row_number() over (partition by h.family, h.subsystem_id order by round(avg(t.acc), 9) desc, t.method) as rank
  from (select distinct family, subsystem_id from acc) h join acc t on h.family = t.family and h.subsystem_id <> t.subsystem_id group by h.family, h.subsystem_id, t.method""")
cte("heldci", """select family, subsystem_id as held_out, a, b, n as n_held, delta as d_held, lo as lo_held, hi as hi_held from dci
  union all select family, subsystem_id, b, a, n, -delta, -hi, -lo from dci""")


def decisions_sql(cond: str) -> str:
    return f"""select p.*, n_held, d_held, lo_held, hi_held from (
 select x.family, x.held_out, x.method as a, y.method as b, x.rank as rank_a, y.rank as rank_b, x.se as se_a, y.se as se_b, count(*) as k_train,
   avg(u.acc - v.acc) as m_se, sum(u.n * (u.acc - v.acc)) / sum(u.n) as m_cw, stddev_samp(u.acc - v.acc) as sd,
   case when stddev_samp(u.acc - v.acc) > 1e-12 then abs(avg(u.acc - v.acc)) / stddev_samp(u.acc - v.acc)
        when abs(avg(u.acc - v.acc)) > 1e-12 then 'infinity'::double else 0 end as t,
   count(*) filter (where u.acc - v.acc > 1e-12) as train_wins, count(*) filter (where abs(u.acc - v.acc) <= 1e-12) as train_ties,
   count(*) filter (where u.acc - v.acc < -1e-12) as train_losses
 from board x join board y on x.family = y.family and x.held_out = y.held_out and {cond}
   join acc u on u.family = x.family and u.method = x.method and u.subsystem_id <> x.held_out
   join acc v on v.family = y.family and v.method = y.method and v.subsystem_id = u.subsystem_id
 group by x.family, x.held_out, x.method, y.method, x.rank, y.rank, x.se, y.se) p join heldci using (family, held_out, a, b)"""


cte("dec_adj", decisions_sql("y.rank = x.rank + 1"))
cte("dec_all", decisions_sql("y.rank > x.rank"))
DEC_RND = "se_a se_b m_se m_cw sd t d_held lo_held hi_held"


def decisions(spark, sf, kind="adjacent"):
    acc = H.complete_accuracy(C.accuracy(kinds(spark, sf), weight="times"))
    return H.decisions(acc, dci(spark, sf), kind)


@query("h05_decisions_adjacent", "select * from dec_adj", rnd=DEC_RND)
def h05(spark, sf):
    return decisions(spark, sf)


@query("h05_decisions_all", "select * from dec_all", rnd=DEC_RND)
def h05a(spark, sf):
    return decisions(spark, sf, "all")


def outcomes_sql(src: str) -> str:
    d = {t: f"(case when abs({m}) <= 1e-12 then 0 when {m} > 0 then 1 else -1 end)" for t, m in (("rule", "m_se"), ("cw", "m_cw"))}
    parts = []
    for t, x in d.items():
        parts.append(f"""{x} as dir_{t}, case when {x} = 0 then 'none' when abs(d_held) < 1e-12 then 'tie' when {x} * d_held < 0 then 'error' else 'correct' end as out_{t},
          ({x} > 0 and hi_held < 0) or ({x} < 0 and lo_held > 0) as strict_{t}""")
    return f"select *, {', '.join(parts)} from {src}"


cte("outs", outcomes_sql("dec_all"))


@query("h06_outcomes", "select * from outs", rnd=DEC_RND)
def h06(spark, sf):
    return H.outcomes(decisions(spark, sf, "all"))


THRESHOLDS = [0.25 * i for i in range(13)]
PTS = "(select unnest([" + ", ".join(f"{{'threshold': '{c}', 'c': {c}::double}}" for c in THRESHOLDS) + ", {'threshold': 'allwin', 'c': null}], recursive := true))"
cte("curve_pts", f"""
select *, recommended / n_decisions as coverage, rule_errors / nullif(recommended, 0) as rule_error_rate, rule_strict_errors / nullif(recommended, 0) as rule_strict_error_rate, flagged_errors / nullif(flagged, 0) as flagged_error_rate from (
 select threshold, count(*) as n_decisions, count(*) filter (where ok) as recommended, count(*) filter (where ok and out_rule = 'error') as rule_errors,
  count(*) filter (where ok and out_rule = 'tie') as rule_ties, count(*) filter (where ok and strict_rule) as rule_strict_errors, count(*) filter (where not ok) as flagged,
  count(*) filter (where not ok and out_rule = 'error') as flagged_errors, count(*) filter (where not ok and out_rule = 'tie') as flagged_ties,
  count(*) filter (where not ok and strict_rule) as flagged_strict_errors, count(*) filter (where dir_rule <> 0 and strict_rule) as all_strict_errors, count(*) filter (where dir_rule <> 0) as n_directed,
  count(*) filter (where dir_rule <> 0 and out_rule = 'error') as all_errors
 from (select *, dir_rule <> 0 and case when c is null then train_wins = k_train else t >= c end as ok from outs cross join {PTS}) group by all)""")
CURVE_RND = "coverage rule_strict_error_rate rule_error_rate flagged_error_rate"


def curve(spark, sf):
    o = kept(spark, sf, "outcomes", lambda: H.outcomes(decisions(spark, sf, "all")))
    return o, H.curve(o, THRESHOLDS)


@query("h07_curve", "select * from curve_pts", rnd=CURVE_RND)
def h07(spark, sf):
    return curve(spark, sf)[1]


def top_of(dirn: str, m: str) -> str:
    return (f"select (out_{dirn} = 'error')::int as errors, (out_{dirn} = 'tie')::int as ties, strict_{dirn}::int as strict_errors, "
            f"row_number() over (order by round(abs({m}), 9) desc, family, held_out, a, b) as r from outs where dir_{dirn} <> 0")


cte("budget", f"with c as ({top_of('cw', 'm_cw')}), s as ({top_of('rule', 'm_se')}) select threshold, recommended, " + ", ".join(
    [f"(select count(*) from {t} where r <= recommended) as {n}_n" for t, n in (("c", "pooled_only"), ("s", "system_equal"))]
    + [f"coalesce((select sum({k}) from {t} where r <= recommended), 0)::bigint as {n}_{k}" for t, n in (("c", "pooled_only"), ("s", "system_equal")) for k in ("errors", "ties", "strict_errors")]) + " from curve_pts")


@query("h08_budget_baseline", "select * from budget")
def h08(spark, sf):
    return H.budget_baseline(*curve(spark, sf))


def lchoose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query("h09_random_baseline", f"""
select *, recommended * all_errors / nullif(n_directed, 0) as random_expected_errors, all_errors / nullif(n_directed, 0) as random_error_rate,
  recommended * all_strict_errors / nullif(n_directed, 0) as random_expected_strict_errors, case when n_directed > 0 and recommended > 0 then
  least(1.0::double, coalesce((select sum(exp({lchoose('all_errors::double', 'i')} + {lchoose('(n_directed - all_errors)::double', '(recommended - i)')} - {lchoose('n_directed::double', 'recommended')}))
    from (select unnest(range(greatest(0, recommended + all_errors - n_directed), rule_errors + 1)) as i)), 0)) end as p_random_le_rule from curve_pts""",
       rnd=CURVE_RND + " random_expected_errors random_error_rate random_expected_strict_errors p_random_le_rule")
def h09(spark, sf):
    return H.random_baseline(curve(spark, sf)[1])


@query("h10_verdict", """
select threshold, recommended, rule_errors, pooled_only_errors, system_equal_errors, identification, reduction,
  case when reduction then 'reduction' when identification then 'identification_only' else 'neither' end as verdict from (
 select *, coalesce(recommended > 0 and flagged > 0 and flagged_error_rate > rule_error_rate, false) as identification,
  coalesce(recommended > 0 and rule_error_rate < pooled_only_errors / recommended and rule_error_rate < system_equal_errors / recommended
    and rule_error_rate < all_errors / nullif(n_directed, 0), false) as reduction
 from curve_pts join budget using (threshold, recommended) where threshold = '1.0')""")
def h10(spark, sf):
    o, c = curve(spark, sf)
    return H.verdict(c, H.budget_baseline(o, c))


# train on one release (AFRICA) and hold out the subsystems of another (ASIA)
@query("h10_cross_decisions", f"""
with cov as (select family, method, count(*) as n from acc group by all), fam as (select family, count(distinct subsystem_id) as n from acc group by all),
 ok as (select method from cov join fam using (family, n) where family in ('AFRICA', 'ASIA') group by method having count(*) = 2),
 tr as (select method, avg(acc) as se, row_number() over (order by round(avg(acc), 9) desc, method) as rank from acc where family = 'AFRICA' and method in (select method from ok) group by method),
 p as (select x.method as a, y.method as b, x.rank as rank_a, x.se - y.se as m_se, stddev_samp(u.acc - v.acc) as sd from tr x join tr y on y.rank = x.rank + 1
   join acc u on u.family = 'AFRICA' and u.method = x.method join acc v on v.family = 'AFRICA' and v.method = y.method and v.subsystem_id = u.subsystem_id group by all)
select p.a, p.b, rank_a, m_se, sd, h.subsystem_id as held_out, h.acc - g.acc as d_held, {sg('m_se')} * {sg('(h.acc - g.acc)')} < 0 as error, {sg('m_se')} <> 0 and abs(m_se) >= sd as recommended
from p join acc h on h.family = 'ASIA' and h.method = p.a join acc g on g.family = 'ASIA' and g.method = p.b and g.subsystem_id = h.subsystem_id""", rnd="m_se sd d_held")
def h10x(spark, sf):
    acc = C.accuracy(cs(spark, sf)).filter(F.col("family").isin("AFRICA", "ASIA"))
    return H.cross_decisions(acc.filter("family = 'AFRICA'"), acc.filter("family = 'ASIA'"))
