"""Working tables derived from the given tables: run scores, telemetry, rankings, answers, edges, contrast.

Each has a DataFrame form and an SQL twin. Nothing is sampled: all rows of the inputs are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.plans.registry import cte, table
from seismark.session import spread, tasks_for

# (method, seed, role): one entry per run that every case is scored under
RUNS = [("m_cust", None, "published"), ("m_price", None, "published"), ("m_prio", None, "probe"),
        ("m_seeded", 0, "published"), ("m_seeded", 1, "published"), ("m_seeded", 2, "published")]


def case_scores(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    runs = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).cast("int").alias("seed"), F.lit(x).alias("role"))
                     for m, s, x in RUNS])
    sub = F.concat_ws("::", "r_name", "n_name")
    cases = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
        .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.col("r_name").alias("family"), sub.alias("subsystem_id"),
                F.concat(sub, F.lit("|"), F.col("o_orderkey").cast("string"), F.lit("#0")).alias("case_id"),
                F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("truth"))
    )
    # the rows of a case are made where it lies, so groupings by case need no shuffle and a task's groups do not grow with the table
    base = cases.repartition(tasks_for(o), "case_id").select("*", F.explode(runs).alias("run")).select("*", "run.*")
    pred = (
        F.when(F.col("method") == "m_cust", F.col("o_custkey") % 3)
        .when(F.col("method") == "m_price", F.floor("o_totalprice") % 3)
        .when(F.col("method") == "m_prio", F.substring("o_orderpriority", 1, 1).cast("bigint") % 3)
        .otherwise((F.col("o_custkey") * 7 + F.col("o_orderkey") + F.col("seed")) % 3)
    )
    valid = F.when((F.col("method") == "m_prio") & (F.col("o_orderkey") % 11 == 0), 0).otherwise(1)
    x = base.select(
        "family", "subsystem_id", "case_id",
        F.col("o_orderpriority").alias("fault"), "method", "seed", "role",
        valid.alias("valid_output"), pred.alias("pred"), "truth")
    hit = F.col("pred") == F.col("truth")
    near = F.col("pred") == (F.col("truth") + 1) % 3
    return x.select(
        "family", "subsystem_id", "case_id", "fault", "method", "seed", "role", "valid_output",
        F.when(F.col("valid_output") == 0, 0.0).when(hit, 1.0).when(near, 0.5).otherwise(0.0).alias("score"),
        F.when((F.col("valid_output") == 1) & hit, 1.0).otherwise(0.0).alias("score_strict"))


cte("case_scores", """
select r_name as family, concat(r_name,'::',n_name) as subsystem_id,
       concat(r_name,'::',n_name,'|',cast(o_orderkey as varchar),'#0') as case_id,
       o_orderpriority as fault, method, seed, role, valid_output,
       case when valid_output = 0 then cast(0 as double) when pred = truth then cast(1 as double)
            when pred = (truth + 1) % 3 then cast(1 as double) / 2 else cast(0 as double) end as score,
       case when valid_output = 1 and pred = truth then cast(1 as double) else cast(0 as double) end as score_strict
from (select o_orderkey, o_orderpriority, r_name, n_name, method, seed, role,
             case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as truth,
             case when method = 'm_prio' and o_orderkey % 11 = 0 then 0 else 1 end as valid_output,
             case method when 'm_cust' then o_custkey % 3
                         when 'm_price' then cast(floor(o_totalprice) as bigint) % 3
                         when 'm_prio' then cast(substr(o_orderpriority, 1, 1) as bigint) % 3
                         else (o_custkey * 7 + o_orderkey + seed) % 3 end as pred
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
           join region on n_regionkey = r_regionkey
           cross join (select 'm_cust' as method, cast(null as int) as seed, 'published' as role
                       union all select 'm_price', null, 'published' union all select 'm_prio', null, 'probe'
                       union all select 'm_seeded', 0, 'published' union all select 'm_seeded', 1, 'published'
                       union all select 'm_seeded', 2, 'published') m) x
""")


def contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one fault class scored under another condition."""
    x = case_scores(spark, sf).filter(F.col("fault") == "1-URGENT")
    return x.select("family", "subsystem_id", "case_id", "fault", "method", "seed",
                    F.lit("contrast_input").alias("role"), F.lit(1).alias("valid_output"),
                    (1.0 - F.col("score_strict")).alias("score"), (1.0 - F.col("score_strict")).alias("score_strict"))


cte("contrast", """
select family, subsystem_id, case_id, fault, method, seed, 'contrast_input' as role, 1 as valid_output,
       cast(1 as double) - score_strict as score, cast(1 as double) - score_strict as score_strict
from case_scores where fault = '1-URGENT'
""")


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """One case per day with the event at noon; 48 h before it and 24 h after it belong to the case.

    An event is assigned to at most four candidate days by arithmetic, so the range join is an equi join.
    """
    ev = table(spark, sf, "events").select("ts", "user_id", "event_type", "value")
    day = F.to_date("ts")
    days = ev.select(day.alias("d")).distinct()
    cand = F.explode(F.sequence(F.date_sub(day, 1), F.date_add(day, 2)))
    svc = F.concat(F.lit("svc"), (F.col("user_id") % 12).cast("string"))
    t0 = F.col("d").cast("timestamp_ntz") + F.expr("interval 12 hours")
    return (
        ev.select("ts", "value", svc.alias("component"),
                  F.concat_ws("__", svc, "event_type").alias("metric_id"), cand.alias("d"))
        .withColumn("t0", t0)
        .filter((F.col("ts") >= F.col("t0") - F.expr("interval 48 hours"))
                & (F.col("ts") < F.col("t0") + F.expr("interval 24 hours")))
        .join(days, "d")
        .select(F.concat(F.lit("day"), F.col("d").cast("string")).alias("case_id"),
                "component", "metric_id", "ts", "t0", "value")
    )


cte("telemetry", """
select concat('day', cast(d as varchar)) as case_id, concat('svc', cast(user_id % 12 as varchar)) as component,
       concat('svc', cast(user_id % 12 as varchar), '__', event_type) as metric_id, ts, t0, value
from events join (select distinct cast(ts as date) as d, cast(cast(ts as date) as timestamp) + interval 12 hours as t0
                  from events) c
  on ts >= t0 - interval 48 hours and ts < t0 + interval 24 hours
""")


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Long rankings (case_id, pos, item, truth); positions come from a per-order window (orders are short)."""
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.row_number().over(w).alias("pos"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("item"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string")).alias("truth"))


cte("rankings", """
select cast(l_orderkey as varchar) as case_id,
       row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_suppkey, l_linenumber) as pos,
       concat('s', cast(l_suppkey % 20 as varchar), '_', cast(l_linenumber as varchar)) as item,
       concat('s', cast(o_custkey % 20 as varchar)) as truth
from lineitem join orders on l_orderkey = o_orderkey
""")

_DATE = "cast(cast(o_orderdate as date) as {S})"


def _pred_sql(s: str, c: int, m: int) -> str:
    return (f"""concat('{{"root cause occurrence datetime": "', {_DATE.format(S=s)}, ' 00:0', cast(o_custkey % {c} as {s}), """
            f"""':00", "root cause component": "c', cast(o_custkey % {m} as {s}), '", "root cause reason": "r', """
            f"""cast(o_custkey % 4 as {s}), '"}}')""")


def _truth_sql(s: str, label: str, m: int) -> str:
    return (f"""concat('The {label} predicted root cause component is c', cast(o_orderkey % {m} as {s}), chr(10), """
            f"""'The {label} predicted root cause reason is r', cast(o_orderkey % 4 as {s}), chr(10), """
            f"""'The {label} root cause occurrence time is within 1 minutes (i.e., <=1min) of ', {_DATE.format(S=s)}, """
            f"""' 00:01:00', chr(10))""")


def _answers_columns(s: str) -> list[str]:
    """Column expressions that read the same in both engines; ``s`` is the string type."""
    pred = f"case when o_orderkey % 3 = 0 then concat({_pred_sql(s, 5, 6)}, {_pred_sql(s, 3, 5)}) else {_pred_sql(s, 5, 6)} end"
    truth = f"case when o_orderkey % 3 = 0 then concat({_truth_sql(s, '1-th', 6)}, {_truth_sql(s, '2-th', 5)}) else {_truth_sql(s, 'only', 6)} end"
    return [f"cast(o_orderkey as {s}) as case_id", f"{pred} as prediction", f"{truth} as scoring_points"]


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).selectExpr(*_answers_columns("string"))


cte("answers", "select " + ", ".join(_answers_columns("varchar")) + " from orders")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A call graph: every source keeps the three targets it sends most to."""
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem").filter("l_suppkey % 40 <> l_partkey % 40")
    src, dst = (F.concat(F.lit("n"), (F.col(c) % 40).cast("string")).alias(n) for c, n in (("l_suppkey", "src"), ("l_partkey", "dst")))
    q = li.groupBy(src, dst).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return q.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("q"), "dst"))).filter("r <= 3").select("src", "dst")


cte("edges", """
select src, dst from (select *, row_number() over (partition by src order by q desc, dst) as r from
  (select concat('n', cast(l_suppkey % 40 as varchar)) as src, concat('n', cast(l_partkey % 40 as varchar)) as dst, sum(l_quantity::bigint) as q
   from lineitem where l_suppkey % 40 <> l_partkey % 40 group by all)) where r <= 3
""")
