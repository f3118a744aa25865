"""SQL twins shared by several queries."""

from seismark.operators.draws import MIX_1, MIX_2, STEP
from seismark.plans.registry import cte


def sg(x: str) -> str:
    return f"(case when abs({x}) <= 1e-9 then 0 when {x} > 0 then 1 else -1 end)"


def names(cond: str) -> str:
    return f"coalesce(string_agg(subsystem_id, ';' order by subsystem_id) filter (where {cond}), '')"


REPS = 10_000


def layered(src: str) -> str:
    return (f"(select *, 'L2' as layer from {src} union all select *, 'L1' as layer from {src} where role = 'published')")


def diffs_sql(src: str, keys: str = "family, subsystem_id, case_id", extra: str = "") -> str:
    on = " and ".join(f"x.{k.strip()} is not distinct from y.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return (f"select {cols}, x.method as a, y.method as b, x.score as ya, y.score as yb, x.score - y.score as d{extra} "
            f"from {src} x join {src} y on {on} and x.method < y.method")


def deltas_sql(src: str, keys: str = "family, a, b, subsystem_id") -> str:
    return (f"select {keys}, count(*) as n, avg(ya) as acc_a, avg(yb) as acc_b, avg(d) as delta, var_samp(d) / count(*) as var "
            f"from {src} group by {keys}")


def pool_sql(src: str, keys: str = "family, a, b") -> str:
    return (f"select {keys}, count(*) as k, sum(n * delta) / sum(n) as pooled_cw, avg(delta) as pooled_se from {src} "
            f"group by {keys} having count(*) >= 2")


cte("cs", "select family, subsystem_id, case_id, method, avg(score) as score from case_scores group by all")
cte("csf", "select family, subsystem_id, fault, case_id, method, avg(score) as score from case_scores group by all")
cte("diffs", diffs_sql("cs"))
cte("deltas", deltas_sql("diffs"))
cte("pooled", pool_sql("deltas"))
cte("dp", "select * from deltas join pooled using (family, a, b)")
cte("revs", f"""select family, a, b, k, pooled_cw, pooled_se,
  count(*) filter (where {sg('delta')} * {sg('pooled_cw')} < 0) as n_rev_cw, {names(f"{sg('delta')} * {sg('pooled_cw')} < 0")} as rev_cw,
  count(*) filter (where {sg('delta')} * {sg('pooled_se')} < 0) as n_rev_se, {names(f"{sg('delta')} * {sg('pooled_se')} < 0")} as rev_se
  from dp group by family, a, b, k, pooled_cw, pooled_se""")
cte("acc", "select family, subsystem_id, method, avg(score) as acc, count(*) as n from cs group by all")
cte("sizes", "select family, subsystem_id, count(distinct case_id) as n_cases from cs group by all")


def h32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint"


def mixed(src: str, x: str, y: str) -> str:
    """``src`` with the hash ``draws.mix32`` of the expression x as column y. One step a subquery: DuckDB would repeat the
    expression of an alias that is used twice."""
    step = lambda inner, e, c: f"(select *, {e} as {c} from {inner})"
    out = step(src, x, f"{y}0")
    out = step(out, f"(xor({y}0, {y}0 >> 16) * {MIX_1}) % 4294967296", f"{y}1")
    out = step(out, f"(xor({y}1, {y}1 >> 15) * {MIX_2}) % 4294967296", f"{y}2")
    return f"(select * exclude ({y}0, {y}1, {y}2), xor({y}2, {y}2 >> 15) as {y} from {out})"


def draw_ctes(name: str, vectors: str, group: str, reps: int, seed: int = 7, height: int = 6, powers: int = 32, ratios: bool = False) -> None:
    """Multinomial draws of the cells of each group as ``name`` (group, rep, cell, n), level by level down the tree over the cells.

    ``vectors``: (group, v, c), the distinct score vectors and their counts; at most 2 ** height of them in a group, and
    fewer than 2 ** powers cases. The thresholds are those of ``draws.binomial_table``, over the same span of values: with ``ratios``
    by its arithmetic, else from lgamma, whose rounding moves some of them where powers are over 2 ** 12.
    """
    cte(f"{name}_c", f"select {group}, v, c, row_number() over (partition by {group} order by v) - 1 as cell from ({vectors})")
    cte(f"{name}_w", f"""select {group}, h, cell >> (h + 1) as i, {h32(f"'{seed}'", group)} as stream, coalesce(sum(c) filter (where (cell >> h) % 2 = 0), 0)::bigint as wl, sum(c)::bigint as w
      from {name}_c cross join (select unnest(range({height})) as h) group by all""")
    node = f"{group}, h, i, j"
    spans = f"""(select *, trunc(m * p)::bigint as mid, greatest(0, trunc(m * p - 9 * sd)::bigint - 40) as lo
          from (select *, sqrt(m * p * (1 - p)) as sd from (select *, unnest(range({powers})) as j, 1::bigint << j as m from (select {group}, h, i, wl / w as p from {name}_w where wl > 0 and wl < w))
            join (select {group}, sum(c) as total from {name}_c group by all) sizes using ({group}) where m <= total))"""
    if ratios:
        below = "case when part < total_y * (1 - 1e-12::double) then part / total_y else 1 end"
        values = f"""(select *, sum(y) over (partition by {node} order by x) as part, sum(y) over (partition by {node}) as total_y from (select *, product(case when x > mid then (m - x + 1) / x * (p / (1 - p)) when x < mid then (x + 1) / (m - x) * ((1 - p) / p) else 1 end)
          over (partition by {node}, x >= mid order by abs(x - mid)) as y from (select *, unnest(range(lo, least(m, trunc(m * p + 9 * sd)::bigint + 40) + 1)) as x from {spans})))"""
    else:
        below = f"""sum(exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + x * ln(p) + (m - x) * ln(1 - p)))
          over (partition by {node} order by x)"""
        values = f"(select *, unnest(range(lo, least(m - 1, trunc(m * p + 9 * sd)::bigint + 40) + 1)) as x from {spans})"
    cte(f"{name}_t", f"""select {node}, any_value(lo) + count(*) filter (where t <= 0) as base, coalesce(list(t order by x) filter (where t > 0 and t < 4294967296), []) as cuts
      from (select {node}, lo, x, floor(least(1.0::double, {below}) * 4294967296)::bigint as t from {values}) group by all""")
    before = f"{name}_top"
    cte(before, f"select {group}, rep, 0 as i, sum(c)::bigint as n from {name}_c cross join (select unnest(range({reps})) as rep) group by all")
    for h in range(height - 1, -1, -1):
        hashed = "bits"
        for x, y in ((f"(stream + ({h} * 64 + j) * {STEP}) % 4294967296", "a"), ("(a + i) % 4294967296", "b"), ("(b + rep) % 4294967296", "c"), ("(c + a) % 4294967296", "u")):
            hashed = mixed(hashed, x, y)
        cte(f"{name}_l{h}", f"""
          with node as (select l.{group}, rep, l.i, n, wl, w, stream from {before} l join {name}_w k on k.{group} = l.{group} and k.i = l.i where k.h = {h} and n > 0),
          bits as (select {group}, rep, i, stream, unnest(list_filter(range({powers}), lambda b: (n >> b) % 2 = 1)) as j from node where wl > 0 and wl < w),
          keyed as (select r.{group}, rep, r.i, u, base, cuts from {hashed} r join {name}_t t on t.{group} = r.{group} and t.i = r.i and t.j = r.j where t.h = {h}),
          lefts as (select {group}, rep, i, sum(base + len(list_filter(cuts, lambda t: t <= u)))::bigint as k from keyed group by all),
          both_ as (select {group}, rep, i, n, case when wl = w then n when wl = 0 then 0 else coalesce(k, 0) end as k from node left join lefts using ({group}, rep, i))
          select {group}, rep, 2 * i as i, k as n from both_ where k > 0 union all select {group}, rep, 2 * i + 1, n - k from both_ where n > k""")
        before = f"{name}_l{h}"
    cte(name, f"select {group}, rep, i as cell, n from {before}")


def vectors_sql(src: str, group: str, keys: str = "case_id", item: str = "method", value: str = "score") -> str:
    return (f"select {group}, v, count(*) as c from (select {group}, {keys}, list({{'name': {item}, 'v': {value}}} order by {item}) as v from {src} group by all) group by all")


def means_sql(name: str, group: str) -> str:
    """(group, rep, name, mean)"""
    return (f"select d.{group}, rep, e.name as name, sum(n * e.v) / sum(n) as mean from {name} d join (select {group}, cell, unnest(v) as e from {name}_c) using ({group}, cell) group by all")


def pair_means_sql(name: str, group: str) -> str:
    """(group, rep, a, b, d)"""
    return (f"select d.{group}, rep, a, b, sum(n * y) / sum(n) as d from {name} d join (select x.{group}, x.cell, x.e.name as a, y.e.name as b, x.e.v - y.e.v as y "
            f"from (select {group}, cell, unnest(v) as e from {name}_c) x join (select {group}, cell, unnest(v) as e from {name}_c) y on x.{group} = y.{group} and x.cell = y.cell and x.e.name < y.e.name) "
            f"using ({group}, cell) group by all")


#: The methods of the score tables; every case has a score of each, in this order in a vector.
METHODS = ["m_cust", "m_price", "m_prio", "m_seeded"]


def complete_draws(name: str, src: str, group: str, reps: int, seed: int = 7, ratios: bool = False) -> None:
    """``draw_ctes`` of a table without missing scores, and the drawn sums of each method as ``name``_s (group, rep, k, s1 ...)."""
    draw_ctes(name, vectors_sql(src, group), group, reps, seed, ratios=ratios)
    sums = ", ".join(f"sum(n * v[{i + 1}].v) as s{i + 1}" for i in range(len(METHODS)))
    cte(f"{name}_s", f"select d.{group}, rep, sum(n) as k, {sums} from {name} d join {name}_c c on c.{group} = d.{group} and c.cell = d.cell group by all")


def complete_means(name: str, group: str) -> str:
    """(group, rep, name, mean)"""
    each = ", ".join(f"{{'name': '{m}', 'mean': s{i + 1} / k}}" for i, m in enumerate(METHODS))
    return f"select {group}, rep, unnest([{each}], recursive := true) from {name}_s"


def complete_pairs(name: str, group: str) -> str:
    """(group, rep, a, b, d)"""
    each = ", ".join(f"{{'a': '{x}', 'b': '{y}', 'd': (s{i + 1} - s{j + 1}) / k}}" for i, x in enumerate(METHODS) for j, y in enumerate(METHODS) if i < j)
    return f"select {group}, rep, unnest([{each}], recursive := true) from {name}_s"


# bootstrap: multinomial draws of the joint score vectors, replicate means per method, replicate differences per pair
FAMILY_OF = "(select distinct family, subsystem_id from cs)"
complete_draws("draws", "cs", "subsystem_id", REPS)
cte("mreps", f"select family, m.subsystem_id, rep, name as method, mean as score from ({complete_means('draws', 'subsystem_id')}) m join {FAMILY_OF} using (subsystem_id)")
cte("reps", f"select family, a, b, p.subsystem_id, rep, d from ({complete_pairs('draws', 'subsystem_id')}) p join {FAMILY_OF} using (subsystem_id)")
cte("dci", """select deltas.*, lo, hi from deltas join (select family, a, b, subsystem_id, quantile_cont(d, 0.025) as lo,
  quantile_cont(d, 0.975) as hi from reps group by all) using (family, a, b, subsystem_id)""")
cte("dcip", "select * from dci join pooled using (family, a, b)")


def chi2_sql(x: str, k: str) -> str:
    """Upper tail of the chi-square distribution: Poisson-like sums in log space, and erfc by its series for odd k."""
    h = f"({x} / 2)"
    even = f"list_sum(list_transform(range({k} // 2), lambda i: exp(-{h} + i * ln({h}) - lgamma(i + 1))))"
    odd = f"coalesce(list_sum(list_transform(range(({k} - 1) // 2), lambda i: exp(-{h} + (i + 0.5) * ln({h}) - lgamma(i + 1.5)))), 0)"
    erf = f"list_sum(list_transform(range(200), lambda i: exp(-{h} + (i + 0.5) * ln({h}) - lgamma(i + 1.5))))"
    tail = f"case when {h} <= 40 then greatest(1 - {erf}, 0) else 0 end"
    return f"(case when {x} is null or {k} is null or {k} < 1 then null when {x} <= 0 then 1.0::double when {k} % 2 = 0 then least(1.0::double, {even}) else least(1.0::double, {tail} + {odd}) end)"
