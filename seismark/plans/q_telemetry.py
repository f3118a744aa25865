"""Telemetry preparation and detector queries (T01 to T14, D01 to D24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.operators import detect as D
from seismark.operators import telemetry as T
from seismark.plans import fixtures as X
from seismark.plans.q_compare import kept
from seismark.plans.registry import cte, query, table
from seismark.plans.sqltext import sg

HOUR = 3600
KEYS = ["case_id", "metric_id"]


def tele(spark, sf):
    return X.telemetry(spark, sf)


def comp_series(spark, sf):
    """Telemetry with one series per component."""
    return tele(spark, sf).withColumn("metric_id", F.col("component"))


def grid(spark, sf, seconds=HOUR):
    return kept(spark, sf, f"grid{seconds}", lambda: T.resample(comp_series(spark, sf), ["case_id"], "metric_id", seconds))


def filled(spark, sf):
    return kept(spark, sf, "filled", lambda: T.ffill_zero(grid(spark, sf), KEYS))


def register_grid(name: str, seconds: int) -> None:
    cte(f"{name}_cells", f"select case_id, component as metric_id, floor(epoch(ts) / {seconds})::bigint as step, avg(value) as value from telemetry group by all")
    cte(name, f"""select m.case_id, m.metric_id, g.step, c.value from (select distinct case_id, metric_id from {name}_cells) m
      join (select case_id, unnest(range(min(step), max(step) + 1)) as step from {name}_cells group by case_id) g on m.case_id = g.case_id
      left join {name}_cells c on c.case_id = m.case_id and c.metric_id = m.metric_id and c.step = g.step""")


register_grid("grid", HOUR)
register_grid("fine", 900)
cte("filled", "select case_id, metric_id, step, coalesce(last_value(value ignore nulls) over (partition by case_id, metric_id order by step), 0) as value from grid")


@query("t01_resample", "select * from grid", rnd="value")
def t01(spark, sf):
    return grid(spark, sf)


@query("t01_resample_5min_mean", """select event_type, to_timestamp(step * 300)::timestamp as start_ts, value from
  (select event_type, floor(epoch(ts) / 300)::bigint as step, avg(value) as value from events group by all)""", rnd="value")
def t01b(spark, sf):
    """Tumbling means without the empty cells: what a streaming run of the same windows emits."""
    ev = table(spark, sf, "events")
    return ev.groupBy("event_type", T.step_of("ts", 300).alias("step")).agg(F.avg("value").alias("value")).select(
        "event_type", T.step_start("step", 300).alias("start_ts"), "value")


cte("shortfilled", "select case_id, metric_id, step, last_value(value ignore nulls) over (partition by case_id, metric_id order by step rows between 2 preceding and current row) as value from grid")


@query("t02_ffill_limit", "select * from shortfilled", rnd="value")
def t02(spark, sf):
    return T.ffill_limit(grid(spark, sf), KEYS, 2)


cte("mq", """select case_id, metric_id, samples, null_share, coalesce(samples >= 20 and null_share < 0.5 and lo < hi, false) as keep from
  (select case_id, component as metric_id, count(*) as samples from telemetry group by all)
  join (select case_id, metric_id, avg((value is null)::int::double) as null_share, min(value) as lo, max(value) as hi from shortfilled group by all) using (case_id, metric_id)""")


@query("t03_metric_quality", "select * from mq", rnd="null_share")
def t03(spark, sf):
    return T.metric_quality(grid(spark, sf), comp_series(spark, sf), KEYS, 20, 0.5, 2)


@query("t03_prune_metrics", "select shortfilled.* from shortfilled join mq using (case_id, metric_id) where keep", rnd="value")
def t03p(spark, sf):
    return T.prune_metrics(grid(spark, sf), comp_series(spark, sf), KEYS, 20, 0.5, 2)


@query("t04_ffill_zero", "select * from filled", rnd="value")
def t04(spark, sf):
    return T.ffill_zero(grid(spark, sf), KEYS)


@query("t05_window_case", """
with t as (select distinct case_id, ts, t0 from telemetry),
 r as (select case_id, ts, -row_number() over (partition by case_id order by ts desc) as rel from t where ts < t0
       union all select case_id, ts, row_number() over (partition by case_id order by ts) - 1 from t where ts >= t0)
select telemetry.*, rel from telemetry join r using (case_id, ts) where rel between -100 and 99""", rnd="value")
def t05(spark, sf):
    return T.window_case(tele(spark, sf), "case_id", 100)


@query("t06_event_window", """
with t as (select distinct case_id, ts, t0 from telemetry), i as (select *, row_number() over (partition by case_id order by ts) - 1 as idx from t),
 n as (select case_id, first(idx order by abs(epoch_us(ts) - epoch_us(t0)), idx desc) as inc_at, max(idx) as last from i group by all),
 b as (select case_id, inc_at, greatest(0, inc_at - 300) as lo, least(last, inc_at + 60) as hi from n)
select telemetry.*, idx - inc_at as rel from telemetry join i using (case_id, ts) join b using (case_id) where idx between lo and hi and hi - lo + 1 >= 30""", rnd="value")
def t06(spark, sf):
    return T.event_window(tele(spark, sf), "case_id", 240, 60)


@query("t06_event_window_clean", """
with c as (select case_id, component as metric_id, t0, to_timestamp(floor(epoch(ts) / 1800)::bigint * 1800)::timestamp as ts, avg(value) as value from telemetry group by all),
 t as (select distinct case_id, ts, t0 from c), i as (select *, row_number() over (partition by case_id order by ts) - 1 as idx from t),
 n as (select case_id, first(idx order by abs(epoch_us(ts) - epoch_us(t0)), idx desc) as inc_at, max(idx) as last from i group by all),
 b as (select case_id, inc_at, greatest(0, inc_at - 60) as lo, least(last, inc_at + 12) as hi from n),
 w as (select c.*, idx - inc_at as rel from c join i using (case_id, ts) join b using (case_id) where idx between lo and hi and hi - lo + 1 >= 30),
 st as (select distinct case_id, ts, rel from w), ns as (select case_id, count(*) as steps from st group by all),
 k as (select case_id, metric_id from w join ns using (case_id) group by case_id, metric_id, steps having stddev_samp(value) > 1e-8 and 1 - count(value) / steps < 0.5),
 g as (select case_id from k group by all having count(*) >= 5)
select case_id, metric_id, st.ts, rel, coalesce(last_value(w.value ignore nulls) over (partition by case_id, metric_id order by rel), 0) as value
from k join g using (case_id) join st using (case_id) left join w using (case_id, metric_id, rel)""", rnd="value")
def t06_clean(spark, sf):
    """Half-hourly means of the components, cleaned inside the window."""
    step = T.step_of("ts", 1800)
    x = tele(spark, sf).groupBy("case_id", F.col("component").alias("metric_id"), "t0", step.alias("step")).agg(F.avg("value").alias("value"))
    x = x.select("case_id", "metric_id", "t0", T.step_start("step", 1800).alias("ts"), "value")
    return T.clean_window(T.event_window(x, "case_id", 48, 12), "case_id")


# the event side of every case against a baseline of the same case recorded "later"
@query("t07_align_baseline", """
with n as (select *, dense_rank() over (partition by case_id order by ts) - 1 as idx from telemetry where ts < t0),
 a as (select *, dense_rank() over (partition by case_id order by ts) - 1 as idx from telemetry where ts >= t0),
 s as (select case_id, max(idx) + 1 as n from n group by all),
 u as (select case_id, metric_id, (idx - n) * 300 as off, value from n join s using (case_id) union all select case_id, metric_id, idx * 300, value from a)
select * from u where (case_id, metric_id) in (select (case_id, metric_id) from n) and (case_id, metric_id) in (select (case_id, metric_id) from a)""", rnd="value")
def t07(spark, sf):
    x = tele(spark, sf).select("case_id", "metric_id", "ts", "value", "t0")
    return T.align_baseline(x.filter("ts < t0"), x.filter("ts >= t0"), "case_id")


@query("t08_smooth", "select *, avg(value) over (partition by case_id, metric_id order by step rows between 2 preceding and current row) as smooth from grid", rnd="value smooth")
def t08(spark, sf):
    return T.smooth(grid(spark, sf), KEYS)


@query("t09_counter_profile", """
with d as (select *, value - lag(value) over (partition by case_id, metric_id order by step) as dv from filled),
 m as (select case_id, metric_id, stddev_pop(value) = 0 as constant, coalesce(bool_and(dv >= -1e-9), true) as monotone from d group by all)
select case_id, count(*) as metrics, count(*) filter (where constant) as constant, count(*) filter (where monotone and not constant) as monotone,
  avg((monotone and not constant)::int::double) as monotone_share from m group by all""", rnd="monotone_share")
def t09(spark, sf):
    return T.counter_profile(filled(spark, sf), KEYS, ["case_id"])


@query("t10_table_shapes", """
with p as (select substr(case_id, 4, 7) || case when substr(case_id, 12, 2) < '16' then 'a' else 'b' end as kind, case_id, count(distinct metric_id) as cols, count(distinct ts) as rows from telemetry group by all),
 mc as (select kind, first(cols order by c desc, cols) as cols_mode from (select kind, cols, count(*) as c from p group by all) group by all),
 mr as (select kind, first(rows order by c desc, rows) as rows_mode from (select kind, rows, count(*) as c from p group by all) group by all)
select kind, count(*) as cases, min(cols) as cols_min, max(cols) as cols_max, cols_mode, min(rows) as rows_min, max(rows) as rows_max, rows_mode
from p join mc using (kind) join mr using (kind) group by kind, cols_mode, rows_mode""")
def t10(spark, sf):
    kind = F.concat(F.substring("case_id", 4, 7), F.when(F.substring("case_id", 12, 2) < "16", "a").otherwise("b"))
    return T.table_shapes(tele(spark, sf), kind, "case_id", "metric_id")


def dup_named(spark, sf):
    """Error readings play the part of a repeated time column."""
    x = tele(spark, sf)
    return x.withColumn("metric_id", F.when(F.col("metric_id").endswith("__error"), F.concat(F.lit("time."), F.substring("component", 4, 9))).otherwise(F.col("metric_id")))


cte("dupn", "select case_id, case when metric_id like '%\\_\\_error' escape '\\' then 'time.' || substr(component, 4) else metric_id end as metric_id, ts, value from telemetry")


@query("t11_drop_dup_time", "select * from dupn where not regexp_matches(metric_id, '^time\\.[0-9]+$')", rnd="value")
def t11(spark, sf):
    return T.drop_dup_time(dup_named(spark, sf)).select("case_id", "metric_id", "ts", "value")


@query("t11_dup_time_flags", """select case_id, bool_or(regexp_matches(metric_id, '^time\\.[0-9]+$')) as has_dup_time,
  count(*) filter (where regexp_matches(metric_id, '^time\\.[0-9]+$')) as dropped_rows from dupn group by all""")
def t11f(spark, sf):
    return T.dup_time_flags(dup_named(spark, sf), "case_id")


@query("t12_suffix_profile", """
with n as (select distinct event_type, 'svc' || user_id % 12 || '_' || event_type || '-' || 'q' || user_id % 7 as m from events),
 c as (select event_type, coalesce(list_last(string_split(m[instr(m, '_') + 1:], '-')), '?') as suffix, count(*) as metrics from n group by all)
select * from (select *, row_number() over (partition by event_type order by metrics desc, suffix) as rank from c) where rank <= 5""")
def t12(spark, sf):
    m = F.concat(F.lit("svc"), (F.col("user_id") % 12).cast("string"), F.lit("_"), F.col("event_type"), F.lit("-q"), (F.col("user_id") % 7).cast("string"))
    return T.suffix_profile(table(spark, sf, "events").select("event_type", m.alias("m")), ["event_type"], "m")


@query("t13_stratified_sample", """
select case_id, fault, round from (select *, row_number() over (partition by fault order by md5(case_id), case_id) as round from (select distinct case_id, fault from case_scores))
order by round, fault limit 103""")
def t13(spark, sf):
    x = X.case_scores(spark, sf).select("case_id", "fault").distinct()
    return T.stratified_sample(x, "fault", "case_id", 103)


@query("t14_nearest_median", """
with m as (select event_type, median(value) as median from events group by all)
select event_type, median, first(event_id order by round(abs(value - median), 9), value, event_id) as event_id,
  first(value order by round(abs(value - median), 9), value, event_id) as value from events join m using (event_type) group by all""", rnd="median value")
def t14(spark, sf):
    return T.nearest_median(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], "value", "event_id")


# ---- detectors ---------------------------------------------------------------------------------------------------

cte("side", """select case_id, component, metric_id, count(value) filter (where ts < t0) as n_base, avg(value) filter (where ts < t0) as mu,
  stddev_pop(value) filter (where ts < t0) as sd_pop, stddev_samp(value) filter (where ts < t0) as sd_samp,
  count(value) filter (where ts >= t0) as n_event, max(value) filter (where ts >= t0) as w_max, min(value) filter (where ts >= t0) as w_min from telemetry group by all""")
cte("zs", "select case_id, component, metric_id, coalesce(case when sd_pop > 0 then greatest(abs(w_max - mu), abs(w_min - mu)) / sd_pop end, 0) as z from side")


@query("d01_max_abs_z", "select * from zs", rnd="z")
def d01(spark, sf):
    return D.max_abs_z(tele(spark, sf))


cte("zrank", "select *, row_number() over (partition by case_id order by round(z, 9) desc, metric_id) as rank from zs")


@query("d02_rank_metrics", "select * from zrank", rnd="z")
def d02(spark, sf):
    return D.rank_metrics(D.max_abs_z(tele(spark, sf)))


@query("d03_alert_count", """select *, row_number() over (partition by case_id order by alerts desc, component, round(z, 9) desc, metric_id) as rank from
  (select *, count(*) filter (where z > 2) over (partition by case_id, component) as alerts from zs)""", rnd="z")
def d03(spark, sf):
    return D.alert_count(D.max_abs_z(tele(spark, sf)), 2.0)


cte("robust", """select case_id, component, metric_id, (w_max - q2) / case when q3 - q1 > 1e-12 then q3 - q1 else 1 end as z,
  greatest(abs(w_max - q2), abs(w_min - q2)) / case when q3 - q1 > 1e-12 then q3 - q1 else 1 end as za
  from side join (select case_id, component, metric_id, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3
    from telemetry where ts < t0 group by all) using (case_id, component, metric_id) where sd_samp > 1e-8 and n_base >= 5 and n_event >= 2""")


@query("d04_robust_rank", "select case_id, component, metric_id, z, row_number() over (partition by case_id order by round(z, 9) desc, metric_id) as rank from robust", rnd="z")
def d04(spark, sf):
    return D.rank_metrics(D.robust_scores(tele(spark, sf)))


cte("thr", """select case_id, component, metric_id, abs(peak - mu) / sd_samp as z, (peak - mu) / (abs(mu) + 1e-8) * 100 as pct from
  (select *, case when abs(w_max - mu) >= abs(w_min - mu) then w_max else w_min end as peak from side where n_base >= 10 and n_event >= 1 and sd_samp >= 1e-8)""")
cte("anoms", "select * from thr where z >= 1.5 and abs(pct) >= 5")
cte("comps", "select case_id, component, count(*) as n_anomalies, max(z) as max_z, max(abs(pct)) as max_pct from anoms group by all")
ZQ = 1.5  # the readings are spread wide, so a lower z leaves something to rank


def anomalies(spark, sf):
    return D.metric_anomalies(tele(spark, sf), ZQ)


def comps(spark, sf):
    return D.detect_components(anomalies(spark, sf))


@query("d05_metric_anomalies", "select * from anoms", rnd="z pct")
def d05(spark, sf):
    return anomalies(spark, sf)


@query("d05_detect_components", "select * from comps", rnd="max_z max_pct")
def d05c(spark, sf):
    return comps(spark, sf)


cte("thrank", "select *, row_number() over (partition by case_id order by round(max_pct, 9) desc, round(max_z, 9) desc, component) as rank from comps")


@query("d06_rank_threshold", "select * from thrank", rnd="max_z max_pct")
def d06(spark, sf):
    return D.rank_threshold(comps(spark, sf))


@query("d07_rank_by_z", """select *, row_number() over (partition by case_id order by round(max_z, 9) desc, component) as rank from comps
  where component in (select 'svc' || s_suppkey from supplier)""", rnd="max_z max_pct")
def d07(spark, sf):
    cand = table(spark, sf, "supplier").select(F.concat(F.lit("svc"), F.col("s_suppkey").cast("string")).alias("component"))
    return D.rank_by_z(comps(spark, sf), cand)


def family(col="component"):
    return F.concat(F.lit("fam"), (F.substring(col, 4, 9).cast("int") % 4).cast("string"))


cte("diverse", """select * from (select *, row_number() over (partition by case_id order by family_first desc, rank) as pick from
  (select *, row_number() over (partition by case_id, family_key order by rank) = 1 as family_first from
    (select *, 'fam' || (substr(component, 4)::int % 4) as family_key from thrank))) where pick <= 5""")


def picks(spark, sf):
    return D.pick_diverse(D.rank_threshold(comps(spark, sf)), family(), 5)


@query("d08_pick_diverse", "select * from diverse", rnd="max_z max_pct")
def d08(spark, sf):
    return picks(spark, sf)


# onsets on a 15-minute grid of component means; the event's step is known per case
FINE = 900
cte("fat", "select f.*, c.inc_at from fine f join (select distinct case_id, floor(epoch(t0) / 900)::bigint as inc_at from telemetry) c using (case_id)")


def fine(spark, sf):
    g = grid(spark, sf, FINE)
    event = tele(spark, sf).select("case_id", T.step_of("t0", FINE).alias("at")).distinct()
    return g.join(event, "case_id")


def wstats(name: str, lbs: list[int], base: int, min_base: int) -> None:
    tries = "[" + ", ".join(f"{{'pri': {i}, 'lb': {v}}}" for i, v in enumerate(lbs)) + "]"
    cte(name, f"""select case_id, metric_id, inc_at, arg_min(lb, pri) as lb, arg_min(mu, pri) as mu, arg_min(sd, pri) as sd from
     (select case_id, metric_id, inc_at, pri, lb, count(value) as n, avg(value) as mu, coalesce(stddev_samp(value), -1) as sd from fat join (select unnest({tries}, recursive := true))
        on step >= inc_at - lb - {base} and step < inc_at - lb group by all) where n >= {min_base} group by all""")


wstats("w_first", [60, 60, 30, 15], 60, 10)
wstats("w_strict", [30], 120, 20)
cte("crossed", """select case_id, metric_id, min(step) as onset from (select s.*, avg(value) over (partition by case_id, metric_id order by step rows between 2 preceding and current row) as sm
  from (select f.case_id, f.metric_id, f.step, f.value, w.mu, w.sd from fat f join w_first w using (case_id, metric_id) where w.sd >= 1e-8 and f.step >= w.inc_at - w.lb and f.step < w.inc_at + 2) s)
  where abs(sm - mu) / sd > 3 and abs((sm - mu) / (abs(mu) + 1e-8) * 100) > 5 group by all""")


@query("d10_onset_first_cross", "select * from crossed")
def d10(spark, sf):
    return D.onset_first_cross(fine(spark, sf))


cte("maxdiff", """
select case_id, metric_id, coalesce(by_diff, onset) as onset, by_diff is not null as from_diff from (
 select case_id, metric_id, case when nrows >= 20 and base >= 1e-8 and top >= 3 * base and (inc_at - place) * 15 <= 30 then place end as by_diff from (
  select *, case when n_pre >= 5 and sd_pre >= 1e-8 then sd_pre else sd_all end as base from (
   select case_id, metric_id, inc_at, count(*) as nrows, count(diff) filter (where pos < half) as n_pre, stddev_samp(diff) filter (where pos < half) as sd_pre, stddev_samp(diff) as sd_all,
     max(diff) as top, first(step order by round(diff, 9) desc, step) filter (where diff is not null) as place from (
    select *, abs(sm - lag(sm) over w) as diff, row_number() over w - 1 as pos, greatest(15, (inc_at - min(step) over (partition by case_id, metric_id)) // 2) as half from (
     select *, avg(value) over (partition by case_id, metric_id order by step rows between 2 preceding and current row) as sm from fat where step >= inc_at - 60 and step < inc_at + 5)
    window w as (partition by case_id, metric_id order by step)) group by case_id, metric_id, inc_at)))
 full join crossed using (case_id, metric_id) where coalesce(by_diff, onset) is not null""")


def onsets(spark, sf):
    g = fine(spark, sf)
    return D.onset_max_diff(g, D.onset_first_cross(g), step_minutes=15.0)  # the grid has a row each 15 minutes


@query("d11_onset_max_diff", "select * from maxdiff")
def d11(spark, sf):
    return onsets(spark, sf)


@query("d09_sibling_by_onset", """
with o as (select case_id, metric_id as component, onset from maxdiff),
 m as (select *, count(*) over (partition by case_id, family_key) as members, row_number() over (partition by case_id, family_key order by onset nulls last, round(max_pct, 9) desc, component) as nth
   from (select *, 'fam' || (substr(component, 4)::int % 4) as family_key from comps) left join o using (case_id, component)),
 p as (select *, row_number() over (partition by case_id, family_key order by pick) as nth from diverse)
select case_id, pick, p.component as picked, family_key, case when members - nth >= 1 then m.component else p.component end as chosen from p left join m using (case_id, family_key, nth)""")
def d09(spark, sf):
    o = onsets(spark, sf).select("case_id", F.col("metric_id").alias("component"), "onset")
    return D.sibling_by_onset(picks(spark, sf), comps(spark, sf), o, family())


@query("d12_peak_time", """
with s as (select case_id, metric_id, count(value) as n, avg(value) as mu from fat where step >= inc_at - 270 and step < inc_at - 30 group by all)
select case_id, metric_id, first(step order by round(abs(value - mu), 9) desc, step) as peak, max(round(abs(value - mu), 9)) as deviation
from fat join s using (case_id, metric_id) where n >= 10 and step >= inc_at - 30 and step <= inc_at + 30 and value is not null group by all""", rnd="deviation")
def d12(spark, sf):
    return D.peak_time(fine(spark, sf))


@query("d24_onset_strict", """
with x as (select f.case_id, f.metric_id, f.step, abs(value - mu) / sd as z, abs((value - mu) / (abs(mu) + 1e-8) * 100) as pct from fat f join w_strict w using (case_id, metric_id)
   where sd >= 1e-8 and f.step >= w.inc_at - w.lb and f.step < w.inc_at + 2 and value is not null),
 g as (select case_id, metric_id, min(step) filter (where z > 5 and pct > 20) as hard, max(z) as top, first(step order by round(z, 9) desc, step) as soft from x group by all)
select case_id, metric_id, coalesce(hard, case when top > 3 then soft end) as onset, hard is not null as strict from g where coalesce(hard, case when top > 3 then soft end) is not null""")
def d24(spark, sf):
    return D.onset_strict(fine(spark, sf))


# component series over gap-free hourly means; four components of three series each
def comp_grid(spark, sf):
    g = filled(spark, sf)
    return g.withColumn("component", F.concat(F.lit("c"), (F.substring("metric_id", 4, 9).cast("int") % 4).cast("string")))


cte("cgrid", "select case_id, 'c' || (substr(metric_id, 4)::int % 4) as component, metric_id, step, value from filled")
cte("cseries", """select case_id, component, step, max(abs(value - mu) / sd) as z from cgrid join
  (select case_id, component, metric_id, count(value) as n, avg(value) as mu, stddev_pop(value) as sd from cgrid group by all) using (case_id, component, metric_id)
  where n >= 5 and sd >= 1e-8 group by all""")


@query("d13_component_series", "select * from cseries", rnd="z")
def d13(spark, sf):
    return D.component_series(comp_grid(spark, sf))


def lagcorr_sql(src: str, thr: float, margin: float) -> str:
    return f"""with l as (select *, lag(z) over (partition by case_id, component order by step) as zp from {src}
   where case_id in (select case_id from {src} group by case_id having count(distinct step) >= 5 and count(distinct component) >= 2)),
 c as (select u.case_id, u.component as src, v.component as dst, case when stddev_pop(u.zp) >= 1e-8 and stddev_pop(v.z) >= 1e-8 then corr(u.zp, v.z) end as c
   from l u join l v on u.case_id = v.case_id and u.step = v.step and u.component <> v.component where u.zp is not null and v.zp is not null group by all)
select x.case_id, x.src, x.dst, x.c as weight from c x join c y on x.case_id = y.case_id and x.src = y.dst and x.dst = y.src
where round(x.c, 9) >= {thr} and round(x.c - coalesce(y.c, 0), 9) >= {margin}"""


cte("lagcorr", lagcorr_sql("cseries", 0.1, 0.05))
THR = 0.1  # independent readings correlate weakly; a lower threshold keeps edges to work with


def lagcorr(spark, sf):
    return D.lagcorr_graph(kept(spark, sf, "cseries", lambda: D.component_series(comp_grid(spark, sf))), THR)


@query("d14_lagcorr_graph", "select * from lagcorr", rnd="weight")
def d14(spark, sf):
    return lagcorr(spark, sf)


cte("fseries", """select case_id, component, step, max(abs(value - mu) / sd) as z from (select case_id, metric_id, component, floor(epoch(ts) / 3600)::bigint as step, avg(value) as value from telemetry group by all) join
  (select case_id, component, metric_id, count(value) as n, avg(value) as mu, stddev_pop(value) as sd from (select case_id, metric_id, component, floor(epoch(ts) / 3600)::bigint as step, avg(value) as value from telemetry group by all) group by all)
  using (case_id, component, metric_id) where n >= 5 and sd >= 1e-8 group by all""")


@query("d14_lagcorr_default", lagcorr_sql("fseries", 0.35, 0.05), rnd="weight")
def d14_default(spark, sf):
    """All components of a case at the default threshold; hours without a reading are missing steps."""
    step = T.step_of("ts", HOUR)
    x = tele(spark, sf).groupBy("case_id", "component", "metric_id", step.alias("step")).agg(F.avg("value").alias("value"))
    return D.lagcorr_graph(kept(spark, sf, "fseries", lambda: D.component_series(x)))


def ancestors_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = f" and e.{keys} = u.{keys}" if keys else ""
    ek = f"e.{keys}, " if keys else ""
    return f"""with recursive u as (select {k}dst as node, src as anc, 1 as d from {src} union select {ek}u.node, e.src, d + 1 from u join {src} e on e.dst = u.anc{on} where d < 3)
 select distinct {k}node, anc from u where node <> anc"""


@query("d15_ancestors", ancestors_sql("edges"))
def d15(spark, sf):
    return D.ancestors(X.edges(spark, sf), 3)


# anomalous components under the names of the component graph
cte("ccomps", """select case_id, component, count(*) as n_anomalies, max(z) as max_z, max(abs(pct)) as max_pct from
  (select case_id, 'c' || (substr(component, 4)::int % 4) as component, z, pct from anoms) group by all""")


def canoms(spark, sf):
    return anomalies(spark, sf).withColumn("component", F.concat(F.lit("c"), (F.substring("component", 4, 9).cast("int") % 4).cast("string")))


@query("d16_rank_causal", f"""
with anc as ({ancestors_sql('lagcorr', 'case_id')}),
 up as (select a.case_id, a.node as component, count(*) as upstream from anc a join ccomps c on a.case_id = c.case_id and a.anc = c.component group by all),
 x as (select c.*, coalesce(upstream, 0) as upstream, c.case_id in (select case_id from lagcorr) and count(*) over (partition by c.case_id) >= 2 as has_graph from ccomps c left join up using (case_id, component)),
 y as (select *, case when has_graph then n_anomalies / (1.0 + upstream)::double else 0 end as root_score from x)
select *, row_number() over (partition by case_id order by round(root_score, 9) desc, round(max_pct, 9) desc, round(max_z, 9) desc, component) as rank from y""", rnd="max_z max_pct root_score")
def d16(spark, sf):
    return D.rank_causal(D.detect_components(canoms(spark, sf)), lagcorr(spark, sf))


cte("mseries", "select case_id, metric_id as component, step, z from (select case_id, metric_id, step, abs(value - avg(value) over w) / nullif(stddev_pop(value) over w, 0) as z from filled window w as (partition by case_id, metric_id))")
cte("mgraph", lagcorr_sql("mseries", 0.1, 0.05))
cte("sanoms", "select case_id, 'c' || (substr(component, 4)::int % 4) as component, component as metric_id, max(pct) as pct from anoms group by all")


@query("d17_rank_causal_metric", f"""
with anc as ({ancestors_sql('mgraph', 'case_id')}),
 up as (select a.case_id, a.node as metric_id, count(*) as up from anc a join sanoms s on a.case_id = s.case_id and a.anc = s.metric_id where abs(s.pct) > 5 group by all),
 g as (select s.case_id, s.component, sum(1 / (1.0 + coalesce(up, 0))::double) as root_score, max(abs(pct)) as max_pct from sanoms s left join up using (case_id, metric_id) group by all)
select *, row_number() over (partition by case_id order by round(root_score, 9) desc, round(max_pct, 9) desc, component) as rank from g""", rnd="root_score max_pct")
def d17(spark, sf):
    g = comp_grid(spark, sf).withColumn("component", F.col("metric_id"))
    edges = D.lagcorr_graph(kept(spark, sf, "mseries", lambda: D.component_series(g)), THR)
    a = anomalies(spark, sf).groupBy("case_id", F.concat(F.lit("c"), (F.substring("component", 4, 9).cast("int") % 4).cast("string")).alias("c"), "component").agg(F.max("pct").alias("pct"))
    a = a.select("case_id", F.col("c").alias("component"), F.col("component").alias("metric_id"), "pct")
    return D.rank_causal_metric(a, edges)


@query("d18_graph_protocol", "select 'original' as protocol, src, dst from edges union all select 'reverse', dst, src from edges")
def d18(spark, sf):
    e = X.edges(spark, sf)
    return D.graph_protocol(e, "original").select(F.lit("original").alias("protocol"), "src", "dst").unionByName(
        D.graph_protocol(e, "reverse").select(F.lit("reverse").alias("protocol"), "src", "dst")).unionByName(
        D.graph_protocol(e, "none").select(F.lit("none").alias("protocol"), "src", "dst"))


def named_pairs(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("n"), (F.col("o_orderkey") % 41).cast("string")).alias("pred"), F.concat(F.lit("n"), (F.col("o_custkey") % 41).cast("string")).alias("truth")).distinct()


@query("d19_graph_distance", """
with recursive both_ways as (select src, dst from edges union select dst, src from edges),
 walk as (select distinct src as node, src as other, 0 as d from both_ways union select w.node, b.dst, d + 1 from walk w join both_ways b on b.src = w.other where d < (select count(distinct src) from both_ways)),
 dist as (select node, other, min(d) as dist from walk group by all)
select pred, truth, coalesce(dist, (select max(dist) + 1 from dist)) as dist, truth in (select node from dist) as in_graph
from (select distinct 'n' || o_orderkey % 41 as pred, 'n' || o_custkey % 41 as truth from orders) p left join dist on node = pred and other = truth""")
def d19(spark, sf):
    return D.graph_distance(named_pairs(spark, sf), X.edges(spark, sf))


cte("pool", """select case_id, metric_id, rank from (select case_id, metric_id, row_number() over (partition by case_id order by round(za, 9) desc, metric_id) as rank from crobust) where rank <= 9""")
cte("crobust", """select case_id, metric_id, greatest(abs(w_max - q2), abs(w_min - q2)) / case when q3 - q1 > 1e-12 then q3 - q1 else 1 end as za from
  (select case_id, component as metric_id, count(value) filter (where ts < t0) as n_base, stddev_samp(value) filter (where ts < t0) as sd, count(value) filter (where ts >= t0) as n_event,
     max(value) filter (where ts >= t0) as w_max, min(value) filter (where ts >= t0) as w_min, quantile_cont(value, 0.25) filter (where ts < t0) as q1,
     quantile_cont(value, 0.5) filter (where ts < t0) as q2, quantile_cont(value, 0.75) filter (where ts < t0) as q3 from telemetry group by all) where n_base >= 5 and n_event >= 2""")
cte("nearpairs", """select x.case_id, p.rank as i, q.rank as j from filled x join filled y on x.case_id = y.case_id and x.step = y.step join pool p on p.case_id = x.case_id and p.metric_id = x.metric_id
  join pool q on q.case_id = y.case_id and q.metric_id = y.metric_id and p.rank < q.rank group by all having round(abs(corr(x.value, y.value)), 9) >= 0.12""")
cte("greedy", """select case_id, 0 as r, []::bigint[] as kept from pool group by case_id having count(*) >= 3
  union all select g.case_id, r + 1, case when len(kept) < 3 and p.rank is not null and not exists (select 1 from nearpairs n where n.case_id = g.case_id and n.j = g.r + 1 and list_contains(g.kept, n.i))
    then list_append(kept, r + 1) else kept end from greedy g left join pool p on p.case_id = g.case_id and p.rank = g.r + 1 where r < 9""", recursive=True)


@query("d20_prefilter_topk", "select p.case_id, p.rank, p.metric_id from pool p join (select case_id, unnest(kept) as rank from greedy where r = 9 and len(kept) >= 3) using (case_id, rank)")
def d20(spark, sf):
    """The near-copy limit is low here because the series are independent."""
    s = D.robust_scores(comp_series(spark, sf), absolute=True, constant=True)
    return D.prefilter_topk(s, filled(spark, sf), 3, 0.12)


cte("acounts", "select case_id, count(*) filter (where z > 2) as anomalous, count(*) as metrics from zs group by all")


@query("d21_anomalous_counts", "select * from acounts")
def d21(spark, sf):
    return D.anomalous_counts(D.max_abs_z(tele(spark, sf)), 2.0)


@query("d21_count_profile", """select *, case when mean > 0 then sd / mean end as cv from
  (select substr(case_id, 13, 1) as system, count(*) as cases, avg(anomalous) as mean, stddev_pop(anomalous) as sd from acounts group by all)""", rnd="mean sd cv")
def d21p(spark, sf):
    return D.count_profile(D.anomalous_counts(D.max_abs_z(tele(spark, sf)), 2.0), F.substring("case_id", 13, 1))


@query("d22_sigma_rank", """
with x as (select case_id, component, metric_id, w_max > mu + 3 * sd_pop as alerted, case when sd_pop > 1e-9 then abs(w_max - mu) / sd_pop else 0 end as z from side where n_base >= 2 and n_event >= 1)
select *, row_number() over (partition by case_id order by alerts desc, component, alerted desc, round(z, 9) desc, metric_id) as rank
from (select *, count(*) filter (where alerted) over (partition by case_id, component) as alerts from x)""", rnd="z")
def d22(spark, sf):
    return D.sigma_rank(tele(spark, sf))


@query("d23_sweep_summary", """
with s as (select h as window_h, case_id, component, metric_id, count(value) filter (where ts < t0) as n_base, avg(value) filter (where ts < t0) as mu, stddev_samp(value) filter (where ts < t0) as sd,
   count(value) filter (where ts >= t0) as n_event, max(value) filter (where ts >= t0) as hi, min(value) filter (where ts >= t0) as lo
   from telemetry, (select unnest([6, 24]) as h) where ts < t0 or ts < t0 + to_hours(h) group by all),
 t as (select *, case when abs(hi - mu) >= abs(lo - mu) then hi else lo end as peak from s where n_base >= 10 and n_event >= 1 and sd >= 1e-8),
 y as (select window_h, z_min, pct_min, case_id, count(distinct component) as n from t, (select unnest([1.0, 1.5, 2.0])::double as z_min), (select unnest([5.0, 50.0])::double as pct_min)
   where abs(peak - mu) / sd >= z_min and abs((peak - mu) / (abs(mu) + 1e-8) * 100) >= pct_min group by all)
select z_min, pct_min, window_h, count(*) as cases, avg(n) as mean_components, min(n) as min_components, max(n) as max_components from y group by all""", rnd="z_min pct_min mean_components")
def d23(spark, sf):
    return D.sweep_summary(tele(spark, sf), [1.0, 1.5, 2.0], [5.0, 50.0], [6, 24])
