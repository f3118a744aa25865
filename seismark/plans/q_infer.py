"""Resampling, heterogeneity and interaction queries (I01 to I30 without the tolerance ones)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.functions.stats import T_975, chi2_sf
from seismark.operators import compare as C
from seismark.operators import infer as I
from seismark.operators import resample as R
from seismark.plans import fixtures as X
from seismark.plans.q_compare import cs, csf, dci, deltas, difficulty, kept, kinds, mreps, reps, shared_cs
from seismark.plans.registry import cte, query
from seismark.plans.sqltext import FAMILY_OF, REPS, chi2_sql, complete_draws, complete_means, h32, names, sg


@query("i01_boot_ci", "select family, a, b, subsystem_id, n, delta, lo, hi from dci", rnd="delta lo hi")
def i01(spark, sf):
    return dci(spark, sf).select("family", "a", "b", "subsystem_id", "n", "delta", "lo", "hi")


CUTS = R.POISSON1_CUTS
POISSON_REPS = 100
POIS = "(" + " + ".join(f"(h >= {c})::int" for c in CUTS) + ")"


@query("i01_boot_poisson", f"""
with w as (select family, subsystem_id, case_id, rep, {POIS} as w from (select family, subsystem_id, case_id, rep, {h32("'7'", 'rep', 'case_id')} as h
           from casesx cross join (select unnest(range({POISSON_REPS})) as rep)))
select w.family, w.subsystem_id, method, quantile_cont(score, 0.025) as lo, quantile_cont(score, 0.975) as hi from
 (select w.family, w.subsystem_id, rep, method, sum(w * score) / sum(w) as score from w join cs using (case_id) where w > 0
  group by w.family, w.subsystem_id, rep, method) w group by all""", rnd="lo hi")
def i01p(spark, sf):
    r = R.poisson_replicates(cs(spark, sf), POISSON_REPS)
    return R.percentile_ci(r, ["family", "subsystem_id", "method"], "score")


@query("i01_boot_histogram")
def i01h(spark, sf):
    """10,000 replicates per pair and subsystem from value counts; numpy draws, so rows only."""
    keys = [*C.PAIR, "subsystem_id"]
    h = kept(spark, sf, "histogram", lambda: R.value_histogram(C.pair_diffs(cs(spark, sf)), keys))
    return R.attach_ci(R.deltas_of_histogram(h, keys), R.histogram_replicates(h, keys, 10000))


cte("preps", "select family, a, b, rep, sum(n * d) / sum(n) as cw, avg(d) as se from reps join deltas using (family, a, b, subsystem_id) group by all")


@query("i02_pooled_ci", """select family, a, b, quantile_cont(cw, 0.025) as pooled_cw_lo, quantile_cont(cw, 0.975) as pooled_cw_hi,
  quantile_cont(se, 0.025) as pooled_se_lo, quantile_cont(se, 0.975) as pooled_se_hi from preps group by all""",
       rnd="pooled_cw_lo pooled_cw_hi pooled_se_lo pooled_se_hi")
def i02(spark, sf):
    return R.pooled_ci(deltas(spark, sf), reps(spark, sf))


@query("i03_centred_p", """select family, a, b, subsystem_id, avg(case when abs(d - delta) >= abs(delta) - 1e-9 then 1.0::double else 0.0::double end) as p
  from reps join deltas using (family, a, b, subsystem_id) group by all""", rnd="p")
def i03(spark, sf):
    return R.centred_p(reps(spark, sf), deltas(spark, sf), [*C.PAIR, "subsystem_id"])


cte("cross_p", """select family, a, b, subsystem_id, least(1.0::double, 2 * least(avg((d <= 1e-9)::int::double), avg((d >= -1e-9)::int::double))) as p from reps group by all""")


@query("i04_crossing_p", "select * from cross_p", rnd="p")
def i04(spark, sf):
    return R.crossing_p(reps(spark, sf), [*C.PAIR, "subsystem_id"])


complete_draws("draws5", "(select *, concat_ws('@', subsystem_id, fault) as cell5 from csf)", "cell5", REPS)
cte("strata", f"""select family, subsystem_id, rep, name as method, avg(mean) as score from ({complete_means("draws5", "cell5")})
  join (select distinct family, subsystem_id, concat_ws('@', subsystem_id, fault) as cell5 from csf) using (cell5) group by all""")


@query("i05_boot_strata", """select family, subsystem_id, method, quantile_cont(score, 0.025) as lo, quantile_cont(score, 0.975) as hi from strata group by all""", rnd="lo hi")
def i05(spark, sf):
    return R.percentile_ci(R.strata_replicates(kept(spark, sf, "csf", lambda: csf(spark, sf)), REPS), ["family", "subsystem_id", "method"], "score")


@query("i06_bonferroni")
def i06(spark, sf):
    """400,000 replicates, so that the tails of 0.05 / (2 m) hold hundreds of them; rows only, tests compare with numpy."""
    d = deltas(spark, sf)
    return R.bonferroni(kinds(spark, sf), d, C.pool(d), weight="times")


@query("i07_holm", """
select family, a, b, subsystem_id, p, max(step) over (partition by family, a, b order by r) as p_holm from
 (select *, least(1.0::double, p * (count(p) over (partition by family, a, b) - r + 1)) as step from
   (select *, row_number() over (partition by family, a, b order by p, subsystem_id) as r from cross_p))""", rnd="p p_holm")
def i07(spark, sf):
    return R.holm(R.crossing_p(reps(spark, sf), [*C.PAIR, "subsystem_id"]), C.PAIR, tie=["subsystem_id"])


@query("i08_both_signs", """select family, a, b, count(*) as reps, avg(both_::int::double) as share_both_signs from
  (select family, a, b, rep, max(d) > 1e-9 and min(d) < -1e-9 as both_ from reps group by all) group by all""", rnd="share_both_signs")
def i08(spark, sf):
    return R.both_signs(reps(spark, sf))


complete_draws("drawsb", "cs", "subsystem_id", REPS, seed=8)
cte("mreps2", f"select family, m.subsystem_id, rep, name as method, mean as score from ({complete_means('drawsb', 'subsystem_id')}) m join {FAMILY_OF} using (subsystem_id)")


@query("i09_win_probability", f"""
with j as (select x.family, x.method as a, y.method as b, x.subsystem_id, x.score - y.score as d from mreps x join mreps2 y
  on x.subsystem_id = y.subsystem_id and x.rep = y.rep and x.method < y.method)
select family, a, b, subsystem_id, avg(({sg('d')} = 1)::int::double) as p_a, avg(({sg('d')} = -1)::int::double) as p_b, avg(({sg('d')} = 0)::int::double) as p_tie,
  quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from j group by all""", rnd="p_a p_b p_tie lo hi")
def i09(spark, sf):
    x = shared_cs(spark, sf)
    return R.win_probability(R.method_replicates(x, REPS, 7), R.method_replicates(x, REPS, 8))


@query("i10_boot_regret", """
with x as (select *, (sum(score) over w - score) / (count(*) over w - 1) as rest from mreps window w as (partition by family, rep, method)),
 p as (select family, rep, subsystem_id, max(score) as best, first(score order by round(rest, 9) desc, method) as won from x group by all),
 g as (select family, rep, avg(best - won) as regret from p group by all)
select family, avg(regret) as mean_regret, quantile_cont(regret, 0.025) as lo, quantile_cont(regret, 0.975) as hi from g group by all""", rnd="mean_regret lo hi")
def i10(spark, sf):
    r = R.regret_replicates(mreps(spark, sf))
    return r.groupBy("family").agg(F.avg("regret").alias("mean_regret"), R.pctl("regret", 0.025).alias("lo"), R.pctl("regret", 0.975).alias("hi"))


@query("i28_focal_contrast", """
with c as (select a, b, rep, max(d) filter (where subsystem_id = 'ASIA::NATION_2') - avg(d) filter (where subsystem_id <> 'ASIA::NATION_2') as c from reps group by all)
select * from (select a, b, max(delta) filter (where subsystem_id = 'ASIA::NATION_2') - avg(delta) filter (where subsystem_id <> 'ASIA::NATION_2') as contrast from deltas group by all)
join (select a, b, quantile_cont(c, 0.025) as lo, quantile_cont(c, 0.975) as hi, avg((c <= 1e-9)::int::double) as p_le_0 from c group by all) using (a, b)""",
       rnd="contrast lo hi p_le_0")
def i28(spark, sf):
    return R.focal_contrast(reps(spark, sf), deltas(spark, sf), "ASIA::NATION_2")


@query("i30_ci_separation", f"""
select x.family, x.a, x.b, x.subsystem_id as s1, y.subsystem_id as s2, x.delta as delta_1, y.delta as delta_2 from dci x join dci y
  on x.family = y.family and x.a = y.a and x.b = y.b and x.subsystem_id < y.subsystem_id
where {sg('x.delta')} * {sg('y.delta')} < 0 and (x.lo > y.hi or x.hi < y.lo) and x.hi - x.lo <= 0.25 and y.hi - y.lo <= 0.25""", rnd="delta_1 delta_2")
def i30(spark, sf):
    return R.ci_separation(dci(spark, sf), 0.25)


# ---- heterogeneity -------------------------------------------------------------------------------------------

T_LIST = "[" + ", ".join(repr(v) for v in T_975) + "]"


def register_meta(name: str, src: str, keys: str) -> None:
    """Bisection for tau2 as a recursive expression with the same number of halvings."""
    on = " and ".join(f"i.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    ik = ", ".join(f"i.{k.strip()}" for k in keys.split(","))
    cte(f"{name}_ok", f"select {keys}, count(*) as k, count(*) >= 4 and min(var) > 0 as ok, var_samp(delta) as hi0 from {src} group by {keys}")
    cte(f"{name}_it", f"""select {keys}, k, 0 as step, 0.0::double as lo, hi0 as hi from {name}_ok where ok
  union all
  select {keys}, k, step + 1, case when q > k - 1 then mid else lo end, case when q > k - 1 then hi else mid end from
   (select {ik}, i.k, i.step, i.lo, i.hi, (i.lo + i.hi) / 2 as mid,
      sum(e.delta * e.delta / (e.var + (i.lo + i.hi) / 2)) - sum(e.delta / (e.var + (i.lo + i.hi) / 2)) ** 2 / sum(1 / (e.var + (i.lo + i.hi) / 2)) as q
    from {name}_it i join {src} e on {on} where i.step < 60 group by {ik}, i.k, i.step, i.lo, i.hi)""", recursive=True)
    cte(f"{name}_tau", f"select {keys}, (lo + hi) / 2 as tau2 from {name}_it where step = 60")
    cte(f"{name}_re", f"""select {keys}, tau2, sum(delta / (var + tau2)) / sum(1 / (var + tau2)) as re_delta, sum(delta / var) / sum(1 / var) as fe_delta,
      sum(delta * delta / var) - sum(delta / var) ** 2 / sum(1 / var) as q from {src} join {name}_tau using ({keys}) group by {keys}, tau2""")
    cte(f"{name}_se", f"""select {keys}, sqrt(sum((delta - re_delta) ** 2 / (var + tau2)) / sum(1 / (var + tau2)) / (count(*) - 1)) as re_se
      from {src} join {name}_re using ({keys}) group by {keys}""")
    cte(name, f"""select {keys}, k, q, case when q > 0 then greatest(0.0::double, (q - (k - 1)) / q) when q is not null then 0.0 end as i2, tau2, fe_delta, re_delta, re_se,
      re_delta - {T_LIST}[k - 1] * re_se as re_lo, re_delta + {T_LIST}[k - 1] * re_se as re_hi,
      re_delta - {T_LIST}[k - 2] * sqrt(tau2 + re_se ** 2) as pi_lo, re_delta + {T_LIST}[k - 2] * sqrt(tau2 + re_se ** 2) as pi_hi,
      re_delta - {T_LIST}[k - 2] * sqrt(tau2 + re_se ** 2) < 0 and re_delta + {T_LIST}[k - 2] * sqrt(tau2 + re_se ** 2) > 0 as pi_crosses_0
      from {name}_ok left join {name}_re using ({keys}) left join {name}_se using ({keys})""")


META_RND = "q i2 tau2 fe_delta re_delta re_se re_lo re_hi pi_lo pi_hi"
register_meta("meta_fam", "deltas", "family, a, b")
register_meta("meta_all", "deltas", "a, b")


@query("i15_meta", "select * from meta_fam", rnd=META_RND)
def i15(spark, sf):
    return I.meta(deltas(spark, sf))


@query("i15_meta_all_families", "select * from meta_all", rnd=META_RND)
def i15a(spark, sf):
    return I.meta(deltas(spark, sf), ["a", "b"])


@query("i16_tier", """select *, ['limited', 'moderate', 'substantial'][level] as tier from
 (select *, case when override then greatest(1, base_level - 1) else base_level end as level from
  (select *, case when i2 > 0.5 then 3 when i2 >= 0.25 then 2 when i2 is not null then 1 end as base_level, not (pi_lo <= 0 and pi_hi >= 0) as override from meta_fam))""", rnd=META_RND)
def i16(spark, sf):
    return I.tier(I.meta(deltas(spark, sf)))


cte("lofo_src", "select x.a, x.b, f.family as dropped, x.delta, x.var from deltas x join (select distinct family from deltas) f on x.family <> f.family")
register_meta("meta_lofo", "lofo_src", "a, b, dropped")


@query("i17_leave_family_out", f"""
select a, b, dropped, pooled, n_pos, n_neg, case when {sg('pooled')} > 0 then n_neg when {sg('pooled')} < 0 then n_pos else 0 end as n_rev, k, q, i2, tau2, fe_delta, re_delta, re_se, re_lo, re_hi,
  pi_lo, pi_hi, pi_crosses_0 from (select a, b, dropped, avg(delta) as pooled, count(*) filter (where {sg('delta')} > 0) as n_pos, count(*) filter (where {sg('delta')} < 0) as n_neg
  from lofo_src group by all) join meta_lofo using (a, b, dropped)""", rnd="pooled " + META_RND)
def i17(spark, sf):
    return I.leave_family_out(deltas(spark, sf))


cte("lk_src", """select x.a, x.b, s.s1, s.s2, x.subsystem_id, x.delta, x.var from deltas x join (select u.a, u.b, u.subsystem_id as s1, v.subsystem_id as s2 from deltas u join deltas v
  on u.a = v.a and u.b = v.b and u.subsystem_id < v.subsystem_id) s on x.a = s.a and x.b = s.b and x.subsystem_id <> s.s1 and x.subsystem_id <> s.s2""")
register_meta("meta_lk", "lk_src", "a, b, s1, s2")


@query("i18_leave_two_out", f"""
with t as (select *, (sum(delta) over w - delta) / (count(*) over w - 1) as train from lk_src window w as (partition by a, b, s1, s2)),
 g as (select a, b, s1, s2, max({sg('delta')}) > 0 and min({sg('delta')}) < 0 as both_signs, avg(({sg('train')} * {sg('delta')} < 0)::int::double) as mis_rate,
         avg(case when {sg('train')} * {sg('delta')} < 0 then abs(delta) else 0 end) as mean_regret from t group by all),
 j as (select g.*, coalesce(pi_crosses_0, false) as pc from g join meta_lk using (a, b, s1, s2))
select a, b, count(*) as n_drops, count(*) filter (where both_signs) as both_signs, count(*) filter (where pc) as pi_crosses_0, median(mis_rate) as mis_median, max(mis_rate) as mis_max,
  median(mean_regret) as regret_median, max(mean_regret) as regret_max from j group by all""", rnd="mis_median mis_max regret_median regret_max")
def i18(spark, sf):
    return I.leave_two_summary(I.leave_two_out(deltas(spark, sf), ["a", "b"]), ["a", "b"])


# ---- interaction -----------------------------------------------------------------------------------------------

def odds(b: str) -> str:
    t = "(c.ya + c.yb)"
    qa = f"({b} * (c.na + c.nb - {t}))"
    qb = f"(c.na * {b} + c.nb - {t} * (1 + {b}))"
    return f"((-{qb} + sqrt({qb} * {qb} + 4 * {qa} * {t})) / (2 * {qa}))"


def ylogp(y: str, p: str) -> str:
    return f"(case when {y} > 1e-12 then {y} * ln({p}) else 0 end)"


def binom(n: str, y: str, p: str) -> str:
    return f"({ylogp(y, p)} + {ylogp(f'({n} - {y})', f'(1 - {p})')})"


def register_lrt(name: str, src: str, keys: str) -> None:
    on = " and ".join(f"i.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    ik = ", ".join(f"i.{k.strip()}" for k in keys.split(","))
    ck = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    b = "exp((i.lo + i.hi) / 2)"
    cte(f"{name}_c", f"select {keys}, n::double as na, n * acc_a as ya, n::double as nb, n * acc_b as yb from {src}")
    cte(f"{name}_in", f"select * from {name}_c where ya + yb > 1e-9 and ya + yb < na + nb - 1e-9")
    cte(f"{name}_it", f"""select {keys}, 0 as step, -20.0::double as lo, 20.0::double as hi, sum(ya) as want from {name}_in group by {keys}
  union all
  select {keys}, step + 1, case when ex < want then mid else lo end, case when ex < want then hi else mid end, want from
   (select {ik}, i.step, i.lo, i.hi, (i.lo + i.hi) / 2 as mid, i.want, sum(c.na * {b} * {odds(b)} / (1 + {b} * {odds(b)})) as ex
    from {name}_it i join {name}_in c on {on} where i.step < 60 group by {ik}, i.step, i.lo, i.hi, i.want)""", recursive=True)
    cte(f"{name}_beta", f"select {keys}, (lo + hi) / 2 as beta from {name}_it where step = 60")
    o = odds("exp(i.beta)")
    cte(f"{name}_red", f"""select {ck}, i.beta, sum({binom('c.na', 'c.ya', f'(exp(i.beta) * {o} / (1 + exp(i.beta) * {o}))')} + {binom('c.nb', 'c.yb', f'({o} / (1 + {o}))')}) as llf_reduced
      from {name}_in c join {name}_beta i on {on} group by {ck}, i.beta""")
    cte(f"{name}_full", f"""select {keys}, count(*) - 1 as lrt_df, sum({binom('na', 'ya', '(ya / na)')} + {binom('nb', 'yb', '(yb / nb)')}) as llf_full, sum(na + nb) as nn, sum(ya + yb) as yy
      from {name}_c group by {keys}""")
    cte(name, f"""select {keys}, 2 * (llf_full - llf_reduced) as lrt, lrt_df, beta, llf_full, llf_reduced, {binom('nn', 'yy', '(yy / nn)')} as llf_null
      from {name}_full join {name}_red using ({keys})""")


register_lrt("lrt_fam", "deltas", "family, a, b")
register_lrt("lrt_all", "deltas", "a, b")


@query("i19_interaction_lrt", "select * from lrt_fam", rnd="lrt beta llf_full llf_reduced llf_null")
def i19(spark, sf):
    return I.interaction_lrt(deltas(spark, sf))


@query("i19_interaction_lrt_all", "select * from lrt_all", rnd="lrt beta llf_full llf_reduced llf_null")
def i19a(spark, sf):
    return I.interaction_lrt(deltas(spark, sf), ["a", "b"])


cte("lrt_p", f"select family, a, b, lrt, lrt_df, {chi2_sql('lrt', 'lrt_df')} as p from lrt_fam")


@query("i19_interaction_p", "select * from lrt_p", rnd="lrt p")
def i19p(spark, sf):
    return I.interaction_lrt(deltas(spark, sf)).select("family", "a", "b", "lrt", "lrt_df", chi2_sf("lrt", "lrt_df").alias("p"))


HOLM = """select family, a, b, p, max(step) over (partition by family order by r) as p_holm from (select *, least(1.0::double, p * (count(p) over (partition by family) - r + 1)) as step
  from (select *, row_number() over (partition by family order by p, a, b) as r from {src}))"""


@query("i07_holm_lrt", HOLM.format(src="lrt_p"), rnd="p p_holm")
def i07l(spark, sf):
    x = I.interaction_lrt(deltas(spark, sf)).select("family", "a", "b", chi2_sf("lrt", "lrt_df").alias("p"))
    return R.holm(x, ["family"], tie=["a", "b"])


@query("i15_q_p", f"select family, a, b, k, q, case when q is not null then {chi2_sql('q', '(k - 1)')} end as p from meta_fam", rnd="q p")
def i15p(spark, sf):
    return I.meta(deltas(spark, sf)).select("family", "a", "b", "k", "q", F.when(F.col("q").isNotNull(), chi2_sf("q", F.col("k") - 1)).alias("p"))


WALD = """
with g as (select family, a, b, subsystem_id, count(*) as n, avg(ya) as pa, avg(yb) as pb, var_pop(ya) as saa, var_pop(yb) as sbb, covar_pop(ya, yb) as sab from diffs group by all),
 x as (select family, a, b, pa * (1 - pa) > 1e-12 and pb * (1 - pb) > 1e-12 as ok, ln(pa / (1 - pa)) - ln(pb / (1 - pb)) as theta,
   (saa / (pa * (1 - pa)) ** 2 - 2 * sab / (pa * (1 - pa)) / (pb * (1 - pb)) + sbb / (pb * (1 - pb)) ** 2) / n as v from g)
select family, a, b, case when bool_and(ok) then sum(theta * theta / v) - sum(theta / v) ** 2 / sum(1 / v) end as wald, count(*) - 1 as wald_df, not bool_and(ok) as separation
from x group by all"""


@query("i20_interaction_wald", WALD, rnd="wald")
def i20(spark, sf):
    return I.interaction_wald(C.pair_diffs(cs(spark, sf)))


cte("wald_p", f"select family, a, b, wald, wald_df, {chi2_sql('wald', 'wald_df')} as p from ({WALD})")


@query("i20_wald_p", "select * from wald_p", rnd="wald p")
def i20p(spark, sf):
    return I.interaction_wald(C.pair_diffs(cs(spark, sf))).select("family", "a", "b", "wald", "wald_df", chi2_sf("wald", "wald_df").alias("p"))


def cells(spark, sf):
    return I.cells_of(cs(spark, sf))


def additive_ctes(name: str, src: str, slopes: bool = False, steps: int = 400) -> None:
    """Log-likelihood and sizes of logit(p) = system + method (+ slope of the method on cov) for each f, by Newton steps on one
    coordinate after the other. ``src``: (f, sys, method, n, y, cov)."""
    eta = "(a[c.i] + b[c.j] + sl[c.j] * c.x)"
    pr = f"(1 / (1 + exp(-{eta})))"

    def moved(old: str, size: str, at: str, x: str = "1") -> str:
        own = f"list_filter(cells, lambda c: c.{at} = t)"
        return (f"list_transform(range(1, {size} + 1), lambda t: {old}[t] + list_sum(list_transform({own}, lambda c: {x} * (c.y - c.n * {pr}))) "
                f"/ greatest(list_sum(list_transform({own}, lambda c: {x} * {x} * c.n * {pr} * (1 - {pr}))), 1e-12))")

    cte(f"{name}_in", f"""select f, list({{'i': i, 'j': j, 'y': y, 'n': n, 'x': x}} order by i, j) as cells, max(i) as si, max(j) as mj from (select f, y, n::double as n, cov - avg(cov) over (partition by f) as x,
      dense_rank() over (partition by f order by sys) as i, dense_rank() over (partition by f order by method) as j from ({src})) group by f""")
    cte(f"{name}_it", f"""select f, cells, si, mj, 0 as k, list_transform(range(si), lambda t: 0.0::double) as a, list_transform(range(mj), lambda t: 0.0::double) as b,
      list_transform(range(mj), lambda t: 0.0::double) as sl from {name}_in
      union all select f, cells, si, mj, k + 1, a, b, {moved('sl', 'mj', 'j', 'c.x') if slopes else 'sl'} as sl from
       (select f, cells, si, mj, k, a, {moved('b', 'mj', 'j')} as b, sl from (select f, cells, si, mj, k, {moved('a', 'si', 'i')} as a, b, sl from {name}_it where k < {steps}))""", recursive=True)
    cte(name, f"""select f, list_sum(list_transform(cells, lambda c: c.y * {eta} - c.n * ln(1 + exp({eta})))) as llf, si + mj - 1 as rank, len(cells) as n_cells,
      list_sum(list_transform(cells, lambda c: {binom('c.n', 'c.y', '(c.y / c.n)')})) as llf_full, mj from {name}_it where k = {steps}""")


CELLS_SQL = "select family, method, subsystem_id as sys, count(*)::double as n, sum(score) as y, 0.0::double as cov from cs group by all"
cte("glm_cells", CELLS_SQL)
additive_ctes("add_all", "select *, 'all' as f from glm_cells")
additive_ctes("add_fam", "select *, family as f from glm_cells")
cte("joint_rows", """select 'method_x_subsystem' as test, llf_full, llf as llf_reduced, 2 * (llf_full - llf) as lrt, (n_cells - rank)::bigint as lrt_df from add_all
  union all select 'method_x_family', x.llf, y.llf, 2 * (x.llf - y.llf), (x.rank - y.rank)::bigint from (select sum(llf) as llf, sum(rank) as rank from add_fam) x, add_all y""")


@query("i21_joint_interaction", f"select *, {chi2_sql('lrt', 'lrt_df')} as p from joint_rows", rnd="llf_full llf_reduced lrt p")
def i21(spark, sf):
    return I.joint_interaction(cells(spark, sf))


@query("i22_separation", "select family, a, b, bool_or(least(acc_a, acc_b) <= 1e-12 or greatest(acc_a, acc_b) >= 1 - 1e-12) as separation from deltas group by all")
def i22(spark, sf):
    return I.separation(deltas(spark, sf))


additive_ctes("add_dif", "select c.* replace (entropy_bits as cov), 'all' as f from glm_cells c join difficulty d on d.subsystem_id = c.sys")
additive_ctes("add_slo", "select c.* replace (entropy_bits as cov), 'all' as f from glm_cells c join difficulty d on d.subsystem_id = c.sys", slopes=True, steps=1500)
cte("nested", """select x.llf as llf_additive, y.llf as llf_slopes, x.llf_full, 2 * (y.llf - x.llf) as lrt_slopes, x.mj - 1 as df_slopes, 2 * (x.llf_full - y.llf) as lrt_left,
  x.n_cells - x.rank - (x.mj - 1) as df_left from add_dif x cross join add_slo y""")


@query("i23_difficulty_nested", f"select *, {chi2_sql('lrt_slopes', 'df_slopes')} as p_slopes, {chi2_sql('lrt_left', 'df_left')} as p_left from nested",
       rnd="llf_additive llf_slopes llf_full lrt_slopes lrt_left p_slopes p_left")
def i23(spark, sf):
    diff = difficulty(spark, sf).select(F.col("subsystem_id").alias("sys"), "entropy_bits")
    return I.difficulty_nested(cells(spark, sf), diff, "entropy_bits")


@query("i24_l2_interaction")
def i24(spark, sf):
    return I.l2_interaction(cells(spark, sf))


cte("kept_cells", """select c.* from glm_cells c left join (select method, sys from glm_cells where y / n <= 1e-12 or y / n >= 1 - 1e-12 order by n desc, method, sys limit 1) x using (method, sys)
  where x.method is null""")
additive_ctes("kept_all", "select *, 'all' as f from kept_cells")
additive_ctes("kept_fam", "select *, family as f from kept_cells")
cte("kept_rows", """select 'method_x_subsystem' as test, llf_full, llf as llf_reduced, 2 * (llf_full - llf) as lrt, (n_cells - rank)::bigint as lrt_df from kept_all
  union all select 'method_x_family', x.llf, y.llf, 2 * (x.llf - y.llf), (x.rank - y.rank)::bigint from (select sum(llf) as llf, sum(rank) as rank from kept_fam) x, kept_all y""")


@query("i25_drop_separating", f"select *, {chi2_sql('lrt', 'lrt_df')} as p from kept_rows", rnd="llf_full llf_reduced lrt p")
def i25(spark, sf):
    return I.joint_interaction(I.drop_separating(cells(spark, sf)))


@query("i26_mcfadden", """select family, a, b, llf_null, (llf_full - llf_null) / -llf_null as r2_full, (llf_reduced - llf_null) / -llf_null as r2_reduced from lrt_fam""",
       rnd="llf_null r2_full r2_reduced")
def i26(spark, sf):
    return I.mcfadden(I.interaction_lrt(deltas(spark, sf)))


@query("i27_permutation_test")
def i27(spark, sf):
    """2,000 shuffles of three methods at once; numpy draws, so rows only: tests compare with shuffled cases."""
    return I.permutation_test(I.permutation_lrt(shared_cs(spark, sf), ["m_cust", "m_price", "m_prio"]))


DROP = ["AFRICA::NATION_0", "ASIA::NATION_2"]
cte("dropped", "select * from deltas where subsystem_id not in ('AFRICA::NATION_0', 'ASIA::NATION_2')")
register_meta("meta_drop", "dropped", "family, a, b")
register_lrt("lrt_drop", "dropped", "family, a, b")


@query("i29_sensitivity", f"""
with o as (select family, a, b, m.k as k_old, p.pooled as pooled_old, m.i2 as i2_old, m.tau2 as tau2_old, l.lrt as lrt_old from meta_fam m join lrt_fam l using (family, a, b)
   join (select family, a, b, avg(delta) as pooled from deltas group by all) p using (family, a, b)),
 w as (select family, a, b, m.k as k_new, p.pooled as pooled_new, m.i2 as i2_new, m.tau2 as tau2_new, l.lrt as lrt_new from meta_drop m join lrt_drop l using (family, a, b)
   join (select family, a, b, avg(delta) as pooled from dropped group by all) p using (family, a, b))
select *, {sg('pooled_old')} = {sg('pooled_new')} as sign_kept from o join w using (family, a, b)""",
       rnd="pooled_old i2_old tau2_old lrt_old pooled_new i2_new tau2_new lrt_new")
def i29(spark, sf):
    return I.sensitivity(deltas(spark, sf), DROP)
