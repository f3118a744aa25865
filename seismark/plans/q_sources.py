"""Source and sink queries (S01 to S19); file operators run as round trips through a written table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.operators import telemetry as T
from seismark.plans import fixtures as X
from seismark.plans.q_compare import cs
from seismark.plans.registry import cte, query, table
from seismark.session import scratch_dir
from seismark.sources import files as S


@query("s01_read_case_scores", "select family, subsystem_id, case_id, fault, method, seed, role, valid_output, score, score_strict from case_scores where role = 'probe'", rnd="score score_strict")
def s01(spark, sf):
    path = scratch_dir(spark, "case_scores")
    x = X.case_scores(spark, sf)
    x.unionByName(X.contrast(spark, sf)).write.mode("overwrite").partitionBy("family").parquet(path)
    return S.read_case_scores(spark, path, ["probe"]).select(*x.columns)


cte("runs_of", """select cast(o_custkey % 7 as varchar) as run, case_id, pos, item, truth from rankings join orders on o_orderkey = case_id::bigint""")


def ranked_cases(spark, sf):
    r = X.rankings(spark, sf)
    return r.groupBy("case_id", "truth").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("r")).select(
        "case_id", "truth", F.transform("r", lambda v: v["item"]).alias("ranks"))


@query("s02_read_run_json", "select case_id as \"case\", truth as true_service, count(*) as n_ranks, first(item order by pos) as top1 from rankings group by all")
def s02(spark, sf):
    """Run files with about a thousand cases each are written, then read back to one row per case."""
    path = scratch_dir(spark, "runs_json")
    c = ranked_cases(spark, sf)
    case = F.struct(F.col("case_id").alias("case"), F.col("truth").alias("true_service"), "ranks", F.size("ranks").alias("n_ranks"), F.get("ranks", 0).alias("top1"))
    run = F.floor(F.col("case_id").cast("bigint") / 1000)
    c.groupBy(run.alias("run")).agg(F.count("*").alias("n"), F.collect_list(case).alias("cases")).write.mode("overwrite").partitionBy("run").json(path)
    return S.read_run_json(spark, path).select("case", "true_service", "n_ranks", "top1")


@query("s03_read_rank_runs", "select 'run' || (case_id::bigint // 500)::varchar as run, case_id, pos, item from rankings")
def s03(spark, sf):
    from pyspark.sql import Window as W
    c = ranked_cases(spark, sf).withColumn("run", F.concat(F.lit("run"), F.floor(F.col("case_id").cast("bigint") / 500).cast("string")))
    c = c.withColumn("idx", F.row_number().over(W.partitionBy("run").orderBy(F.col("case_id").cast("bigint"))) - 1)
    runs = c.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("idx", "ranks"))).alias("l")).select("run", F.transform("l", lambda v: v["ranks"]).alias("ranks"))
    return S.read_rank_runs(runs, c.select("run", "idx", "case_id"), ["run"])


@query("s04_read_case_csv", "select case_id, method, case when role = 'probe' then 'probe' else 'published' end as scenario_file, method as method_file, seed, score from case_scores", rnd="score")
def s04(spark, sf):
    root = scratch_dir(spark, "case_csv")
    x = X.case_scores(spark, sf).select("case_id", "seed", "score", "method", F.concat_ws("__", "method", "role").alias("file"))
    x.write.mode("overwrite").partitionBy("file").option("header", True).csv(root)
    return S.read_case_csv(spark, root, "case_id string, seed int, score double, method string").select("case_id", "method", "scenario_file", "method_file", "seed", "score")


@query("s05_union_telemetry", """select timestamp, cmdb_id, kpi_name, value, cmdb_id || '__' || kpi_name as metric_id from (select floor(epoch(ts))::bigint as timestamp, 'svc' || user_id % 12 as cmdb_id, event_type as kpi_name, value from events)""", rnd="value")
def s05(spark, sf):
    """Three files with drift: other column name, milliseconds, and one without the needed columns."""
    ev = table(spark, sf, "events")
    sec = ev["ts"].cast("timestamp").cast("bigint")
    base = ev.select("user_id", sec.alias("timestamp"), F.concat(F.lit("svc"), (F.col("user_id") % 12).cast("string")).alias("cmdb_id"), F.col("event_type").alias("kpi_name"), "value")
    a = base.filter("user_id % 2 = 0").drop("user_id")
    b = base.filter("user_id % 2 = 1").select((F.col("timestamp") * 1000 + 7).alias("timestamp"), "cmdb_id", F.col("kpi_name").alias("name"), F.col("value").cast("string").alias("value"))
    return S.union_telemetry([(a, "s"), (b, "ms"), (base.select("timestamp", "value"), "s")])


SVC_NAME = "case when n % 3 = 0 then 'svc' || n || '_latency-50' when n % 3 = 1 then 'svc' || n || '_latency-90' else 'svc' || n || '_cpu' end"
cte("wide_long", f"select case_id, floor(epoch(ts) / 3600)::bigint as hour, substr(component, 4)::int as n, avg(value) as value from telemetry group by all")


def name_of(n: int) -> str:
    return f"svc{n}_" + ("latency-50", "latency-90", "cpu")[n % 3]


def wide(spark, sf):
    t = X.telemetry(spark, sf)
    n = F.substring("component", 4, 9).cast("int")
    aggs = [F.avg(F.when(n == i, F.col("value"))).alias(name_of(i)) for i in range(12)]
    return t.groupBy("case_id", T.step_of("ts", 3600).alias("hour")).agg(*aggs)


@query("s06_load_metric_case", """
with h as (select distinct case_id, hour from wide_long), g as (select h.case_id, h.hour, n, w.value from h cross join (select unnest(range(12))::int as n) left join wide_long w using (case_id, hour, n))
select case_id, hour, 'svc' || n || case when n % 3 = 1 then '_latency' else '_cpu' end as metric_id, coalesce(last_value(value ignore nulls) over (partition by case_id, n order by hour), 0) as value from g where n % 3 <> 0""", rnd="value")
def s06(spark, sf):
    return S.load_metric_case(wide(spark, sf), "case_id", "hour")


@query("s16_metrics_long", "select case_id, hour, 'svc' || n as service_name, case n % 3 when 0 then 'latency-50' when 1 then 'latency-90' else 'cpu' end as metric, value from wide_long", rnd="value")
def s16(spark, sf):
    return S.metrics_long(wide(spark, sf), ["case_id", "hour"])


def spans(spark, sf):
    e = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.concat(F.lit("svc"), (F.col("user_id") % 12).cast("string")).alias("serviceName"), F.col("event_type").alias("methodName"), F.col("event_type").alias("operationName"), us.alias("startTime"),
                    (F.col("value") * 100).cast("bigint").alias("duration"), F.col("user_id").cast("string").alias("traceID"), F.col("event_id").cast("string").alias("spanID"),
                    F.when(F.col("event_id") > 0, (F.col("event_id") - 1).cast("string")).alias("parentSpanID"), F.when(F.col("event_type") == "error", "x").otherwise("200").alias("statusCode"))


SPAN_SQL = "select 'svc' || user_id % 12 as service_name, event_type as span_name, epoch_us(ts) as st, cast(trunc(value * 100) as bigint) as d, user_id::varchar as trace_id, event_id::varchar as span_id, event_id, ts, event_type from events"


@query("s07_read_spans", f"select service_name as \"serviceName\", span_name as \"methodName\", span_name as \"operationName\", st as \"startTime\", d as duration, trace_id as \"traceID\", 1705320000000000 as inject_us, st >= 1705320000000000 as after from ({SPAN_SQL})")
def s07(spark, sf):
    return S.read_spans(spans(spark, sf).withColumn("inject", F.lit(1705320000).cast("bigint")), "inject").withColumn("inject_us", F.col("inject_us").cast("bigint"))


@query("s17_trace_table", f"select ts as time, trace_id, span_id, case when event_id > 0 then (event_id - 1)::varchar end as parent_span_id, service_name, span_name, d * 1000 as duration, case when event_type <> 'error' then 200 end as status_code from ({SPAN_SQL})")
def s17(spark, sf):
    return S.trace_table(spans(spark, sf))


@query("s18_log_table", f"""
with l as (select conv_id * 1000 + turn as k, role, text as message, case when turn % 5 = 1 then 'connection Refused' end as error from conversations),
 m as (select k, role, message as raw, case when error is not null then message || ' ' || error else message end as message from l)
select make_timestamp(k * 1000000) as time, role as service_name, null::varchar as trace_id, null::varchar as span_id, message, nullif(regexp_extract(raw, '\\b({S.LOG_LEVELS})\\b', 1), '') as level, regexp_matches(message, '(?i)({S.ERROR_WORDS})') as has_error from m""")
def s18(spark, sf):
    c = table(spark, sf, "conversations")
    k = F.col("conv_id") * 1000 + F.col("turn")
    return S.log_table(c.select((k * 1000000000).alias("timestamp"), F.col("role").alias("container_name"), F.col("text").alias("message"), F.when(F.col("turn") % 5 == 1, "connection Refused").alias("error")))


@query("s08_parse_case_path", "select o_orderkey, 'ad_svc' || o_custkey % 9 as service, lower(split_part(o_orderpriority, '-', 2)) as fault, o_orderkey % 5 as repeat from orders")
def s08(spark, sf):
    o = table(spark, sf, "orders")
    path = F.concat(F.lit("/data/re/ad_svc"), (F.col("o_custkey") % 9).cast("string"), F.lit("_"), F.lower(F.substring_index("o_orderpriority", "-", -1)), F.lit("/"), (F.col("o_orderkey") % 5).cast("string"), F.lit("/data.csv"))
    return o.select("o_orderkey", path.alias("p")).select("o_orderkey", *S.parse_case_path("p"))


UNITS = ["u0", "u1", "u2"]


@query("s09_parse_published_table", """select replace(subsystem_id || '.' || method, ' ', '_') as method, unit, value from (select subsystem_id, method, round(acc, 2) as u0, round(acc / 2, 3) as u1, 0.25::double as u2 from acc)
  unpivot (value for unit in (u0, u1, u2))""", rnd="value")
def s09(spark, sf):
    """Accuracies printed as fixed-width lines between heading lines, then parsed back."""
    from seismark.operators.compare import accuracy
    a = accuracy(cs(spark, sf))
    line = F.format_string("  %-40s %8s  %8s    .25", F.replace(F.concat_ws(".", "subsystem_id", "method"), F.lit(" "), F.lit("_")), F.format_number(F.round("acc", 2), 2), F.format_number(F.round(F.col("acc") / 2, 3), 3))
    lines = a.select(F.explode(F.array(F.lit("Table 6: method u0 u1 u2"), line)).alias("value"))
    return S.parse_published_table(lines, UNITS)


@query("s10_load_sources", """select benchmark, system, case_id, method, correct from (select 'main' as benchmark, subsystem_id as system, case_id, method, score as correct from case_scores
  union all select 'alt', subsystem_id, case_id, method, score_strict from contrast)""", rnd="correct")
def s10(spark, sf):
    root = scratch_dir(spark, "sources")
    X.case_scores(spark, sf).write.mode("overwrite").parquet(f"{root}/main")
    X.contrast(spark, sf).withColumnRenamed("method", "algo").write.mode("overwrite").parquet(f"{root}/alt")
    return S.load_sources(spark, [("main", f"{root}/main", "score", {"subsystem_id": "system"}), ("alt", f"{root}/alt", "score_strict", {"subsystem_id": "system", "algo": "method"})])


@query("s11_write_by_date", "select 'sys' || user_id % 2 as system, cast(ts as date)::varchar as date, floor(epoch(ts))::bigint as timestamp, event_id, value from events", rnd="value")
def s11(spark, sf):
    path = scratch_dir(spark, "by_date")
    e = table(spark, sf, "events").select(F.concat(F.lit("sys"), (F.col("user_id") % 2).cast("string")).alias("system"), F.to_date("ts").cast("string").alias("date"),
                                          F.col("ts").cast("timestamp").cast("bigint").alias("timestamp"), "event_id", "value")
    S.write_by_date(e, path)
    return spark.read.parquet(path).select("system", F.col("date").cast("string").alias("date"), "timestamp", "event_id", "value")


@query("s12_write_result", "select 'csv' as fmt, family, subsystem_id, method, acc, n from acc union all select 'json', family, subsystem_id, method, acc, n from acc union all select 'parquet', family, subsystem_id, method, acc, n from acc", rnd="acc")
def s12(spark, sf):
    from seismark.operators.compare import accuracy
    root = scratch_dir(spark, "result")
    a = accuracy(cs(spark, sf))
    schema = "family string, subsystem_id string, method string, acc double, n bigint"
    out = None
    for fmt in ("csv", "json", "parquet"):
        S.write_result(a, f"{root}/{fmt}", fmt)
        r = spark.read.schema(schema).option("header", True).format(fmt).load(f"{root}/{fmt}").select(F.lit(fmt).alias("fmt"), "family", "subsystem_id", "method", "acc", "n")
        out = r if out is None else out.unionByName(r)
    return out


@query("s13_cascade_sources", """
with cov as (select cast(ts as date) as d, event_type, min(ts) as lo, max(ts) as hi, length(event_type) as p from events group by all),
 req as (select distinct cast(ts as date) as d, h as req_id, cast(cast(ts as date) as timestamp) + to_minutes(h * 12) as t from events, (select unnest(range(0, 120, 3)) as h))
select req.d as date, req_id, req.t, first(event_type order by p, event_type) filter (where lo <= req.t and req.t <= hi) as source, count(*) filter (where lo <= req.t and req.t <= hi) as covering
from req left join cov on req.d = cov.d group by all""")
def s13(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("source"), "ts")
    req = e.select("date").distinct().select("date", F.explode(F.sequence(F.lit(0), F.lit(117), F.lit(3))).alias("req_id"))
    req = req.withColumn("t", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("req_id") * 12))
    return S.cascade_sources(req, e, "date", F.length("source"))


@query("s14_keep_dates", "select event_id, cast(ts as date) as date from events where cast(ts as date) in (select cast(ts as date) from events where event_type = 'error' and user_id % 50 = 7)")
def s14(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.to_date("ts").alias("date"))
    q = e.filter("event_type = 'error' and user_id % 50 = 7")
    return S.keep_dates(e, S.dates_needed(q, F.col("date"))).select("event_id", "date")


@query("s15_table_fingerprint", """select count(*) as rows, cast(sum(('0x' || substr(md5(concat_ws('|', """ + ", ".join(
    f"coalesce({c}::varchar, '~')" for c in ["family", "subsystem_id", "case_id", "fault", "method", "seed", "role", "valid_output", "round(score * 1000000)::bigint", "round(score_strict * 1000000)::bigint"])
    + """)), 1, 15))::bigint) as varchar) as fingerprint from case_scores""")
def s15(spark, sf):
    """Scores enter in millionths, so that the text of a double does not matter."""
    x = X.case_scores(spark, sf).withColumns({c: F.round(F.col(c) * 1000000).cast("bigint") for c in ("score", "score_strict")})
    return S.table_fingerprint(x, ["family", "subsystem_id", "case_id", "fault", "method", "seed", "role", "valid_output", "score", "score_strict"])


@query("s19_validate_schema", """
with c as (select count(*) filter (where case_id is null) as a, count(*) filter (where seed is null) as b, count(*) filter (where score is null) as d from case_scores)
select 'case_id' as column_name, 'string' as expected, 'string' as actual, a as nulls, a = 0 as ok from c union all select 'seed', 'int', 'int', b, true from c
union all select 'score', 'float', 'double', d, false from c union all select 'window_min', 'int', 'missing', null, false from c""")
def s19(spark, sf):
    return S.validate_schema(X.case_scores(spark, sf), {"case_id": ("string", False), "seed": ("int", True), "score": ("float", False), "window_min": ("int", True)})
