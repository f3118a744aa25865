"""Readers and writers of run files, result tables and telemetry files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.schemas import CASE_SCORES, RUN_FILE, SPANS

# fixed values: roles that take part in the main comparison
MAIN_ROLES = ("published", "probe", "shipped_baseline")


def read_case_scores(spark: SparkSession, path: str, roles: Sequence[str] = MAIN_ROLES) -> DataFrame:
    """Per-case table from parquet or CSV; the role filter reaches the parquet scan."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True, schema=CASE_SCORES)
    else:
        df = spark.read.parquet(path)
    return df.filter(F.col("role").isin(*roles))


def read_run_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per case of nested run files, with the file it came from."""
    df = spark.read.schema(RUN_FILE).option("multiLine", True).json(list(paths) if not isinstance(paths, str) else paths)
    return df.select(F.col("_metadata.file_path").alias("source_file"), "n", "wall_s", F.explode("cases").alias("c")).select("source_file", "n", "wall_s", "c.*")


def read_rank_runs(runs: DataFrame, cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long rankings of runs that store only lists of lists; cases join by position.

    ``runs``: (run, ranks array<array<string>>); ``cases``: (keys..., idx, case_id), with ``run`` among the keys where
    each run has its own case list.
    """
    x = runs.select("run", F.posexplode("ranks").alias("idx", "list")).join(cases, [*keys, "idx"])
    return x.select("run", "case_id", F.posexplode("list").alias("pos", "item")).withColumn("pos", F.col("pos") + 1)


def read_case_csv(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Result CSVs of several scenarios; scenario and method come from the name ``method__scenario`` of the file, or of the
    folder (``file=method__scenario``) where a scenario has several files."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+__[^/.]+)(?:\.csv|/[^/]*)$", 1)
    df = spark.read.csv(glob, header=True, schema=schema)
    return df.select("*", F.substring_index(name, "__", 1).alias("method_file"), F.substring_index(name, "__", -1).alias("scenario_file"))


def telemetry_profile(df: DataFrame, unit: str = "s") -> DataFrame | None:
    """One raw file in the common layout (timestamp in seconds, cmdb_id, kpi_name, value), None if columns lack."""
    if "name" in df.columns and "kpi_name" not in df.columns:
        df = df.withColumnRenamed("name", "kpi_name")
    need = ["timestamp", "cmdb_id", "kpi_name", "value"]
    if not set(need) <= set(df.columns):
        return None
    ts = F.col("timestamp").cast("bigint")
    if unit == "ms":
        ts = F.floor(ts / 1000)
    return df.select(ts.alias("timestamp"), F.col("cmdb_id").cast("string").alias("cmdb_id"), F.col("kpi_name").cast("string").alias("kpi_name"),
                     F.col("value").try_cast("double").alias("value"))


def union_telemetry(frames: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Union of raw files with drifting columns and units; files without the needed columns are skipped."""
    out = None
    for df, unit in frames:
        x = telemetry_profile(df, unit)
        if x is not None:
            out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("no file has the telemetry columns")
    return out.withColumn("metric_id", F.concat_ws("__", "cmdb_id", "kpi_name"))


def read_telemetry(spark: SparkSession, files: Sequence[tuple[str, str]]) -> DataFrame:
    """``files``: (path of a CSV, unit of its timestamps)."""
    return union_telemetry([(spark.read.csv(p, header=True), u) for p, u in files])


def write_by_date(df: DataFrame, path: str, system: str = "system", date: str = "date") -> None:
    """Partitioned telemetry; rows are spread by hour of the date as well, so a heavy date is not one task."""
    hour = F.pmod(F.floor(F.col("timestamp") / 3600), F.lit(24))
    df.repartition(system, date, hour).write.mode("overwrite").partitionBy(system, date).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result table as parquet, CSV or JSON."""
    w = df.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "csv": lambda p: w.option("header", True).csv(p)}[fmt](path)


def load_sources(spark: SparkSession, specs: Sequence[tuple[str, str, str, dict[str, str]]]) -> DataFrame:
    """Several result folders under one schema. ``specs``: (label, path, accuracy column, renames)."""
    out = None
    for label, path, acc, renames in specs:
        x = spark.read.parquet(path)
        for a, b in renames.items():
            x = x.withColumnRenamed(a, b)
        x = x.select(F.lit(label).alias("benchmark"), "system", "case_id", "method", F.col(acc).cast("double").alias("correct"))
        out = x if out is None else out.unionByName(x)
    return out


# ---- shaping of what was read --------------------------------------------------------------------------------------

def unpivot_metrics(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], "metric_id", "value")


def load_metric_case(wide: DataFrame, case: str, time: str, drop_suffix: str = "_latency-50", rename: tuple[str, str] = ("_latency-90", "_latency")) -> DataFrame:
    """Wide metric table as a clean long one: columns with a suffix dropped, infinities and gaps filled forward over
    the rows, leading gaps zero, percentile columns renamed."""
    from seismark.functions.series import fill_forward

    keep = [c for c in wide.columns if not c.endswith(drop_suffix)]
    x = unpivot_metrics(wide.select(*keep), [case, time])
    v = F.col("value")
    x = x.withColumn("value", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))
    x = fill_forward(x, [case, "metric_id"], F.floor(F.col(time) / 64), time, "value", "_f")
    name = F.regexp_replace("metric_id", rename[0] + "$", rename[1])
    return x.select(case, time, name.alias("metric_id"), F.coalesce("_f", F.lit(0.0)).alias("value"))


def metrics_long(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Wide metrics as rows with service and metric split at the first underscore; empty values are left out."""
    x = unpivot_metrics(wide, ids).filter("value is not null")
    svc = F.substring_index("metric_id", "_", 1)
    return x.select(*ids, svc.alias("service_name"), F.expr("substring(metric_id, instr(metric_id, '_') + 1)").alias("metric"), "value")


def read_spans(df: DataFrame, inject_s: str) -> DataFrame:
    """Spans with the injection time in the microseconds that span start times use."""
    cols = [f.name for f in SPANS.fields]
    inj = F.col(inject_s) * 1000000
    return df.select(*cols, inj.alias("inject_us"), (F.col("startTime") >= inj).alias("after"))


def trace_table(df: DataFrame) -> DataFrame:
    """Typed traces: start as a time, duration in nanoseconds, a status code only where it is a number."""
    return df.select(F.timestamp_micros("startTime").cast("timestamp_ntz").alias("time"), F.col("traceID").cast("string").alias("trace_id"),
                     F.col("spanID").cast("string").alias("span_id"), F.col("parentSpanID").cast("string").alias("parent_span_id"),
                     F.col("serviceName").alias("service_name"), F.col("operationName").alias("span_name"), (F.col("duration") * 1000).alias("duration"),
                     F.col("statusCode").try_cast("bigint").alias("status_code"))


# fixed values: log levels and words that mark an error
LOG_LEVELS = "TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL"
ERROR_WORDS = "error|fail|exception|timeout|refused"


def log_table(df: DataFrame) -> DataFrame:
    """Typed logs (trace and span ids are not known and null): error text appended to the message, level from a column or the message, a flag for error words."""
    has = set(df.columns)
    msg = F.when(F.col("error").isNotNull(), F.concat_ws(" ", "message", "error")).otherwise(F.col("message")) if "error" in has else F.col("message")
    level = F.col("level") if "level" in has else F.nullif(F.regexp_extract("message", rf"\b({LOG_LEVELS})\b", 1), F.lit(""))
    opt = [F.col(c).cast("string").alias(f"attr_{c}") for c in ("req_path", "cluster_id", "log_template") if c in has]
    x = df.select(F.timestamp_micros(F.floor(F.col("timestamp") / 1000)).cast("timestamp_ntz").alias("time"), F.col("container_name").alias("service_name"),
                  F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("span_id"), msg.alias("message"), level.alias("level"), *opt)
    return x.withColumn("has_error", F.coalesce(F.col("message").rlike(f"(?i){ERROR_WORDS}"), F.lit(False)))


def validate_schema(df: DataFrame, expected: dict[str, tuple[str, bool]]) -> DataFrame:
    """One row per expected column: its type, whether nulls occur where they must not, and the verdict. One pass."""
    types = dict(df.dtypes)
    present = [c for c in expected if c in types]
    nulls = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in present])
    items = []
    for c, (want, nullable) in expected.items():
        n = F.col(f"n_{c}") if c in types else F.lit(None).cast("bigint")
        ok = F.lit(types.get(c) == want) & (F.lit(nullable) | F.coalesce(n == 0, F.lit(False)))
        items.append(F.struct(F.lit(c).alias("column_name"), F.lit(want).alias("expected"), F.lit(types.get(c, "missing")).alias("actual"), n.alias("nulls"), ok.alias("ok")))
    return nulls.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def parse_case_path(path: str | Column) -> list[Column]:
    """Service, fault and repeat from ``.../<service>_<fault>/<n>/<file>``; the last underscore divides."""
    p = F.col(path) if isinstance(path, str) else path
    pat = r"([^/]+)_([^/_]+)/([0-9]+)/?[^/]*$"
    return [F.regexp_extract(p, pat, 1).alias("service"), F.regexp_extract(p, pat, 2).alias("fault"), F.regexp_extract(p, pat, 3).try_cast("bigint").alias("repeat")]


def parse_published_table(lines: DataFrame, units: Sequence[str], text: str = "value") -> DataFrame:
    """Method x unit rows from fixed-width lines: a name followed by one number per unit; other lines are skipped."""
    name = F.regexp_extract(text, r"^\s*(\S+)\s", 1)
    nums = F.regexp_extract_all(F.expr(f"substring({text}, length(regexp_extract({text}, '^\\\\s*\\\\S+', 0)) + 1)"), F.lit(r"[0-9]*\.[0-9]+"), F.lit(0))
    x = lines.select(name.alias("method"), nums.alias("n")).filter((F.col("method") != "") & (F.size("n") == len(units)))
    return x.select("method", F.posexplode("n").alias("i", "v")).select("method", F.get(F.array(*[F.lit(u) for u in units]), F.col("i")).alias("unit"), F.col("v").cast("double").alias("value"))


def cascade_sources(requests: DataFrame, readings: DataFrame, key: str, priority: Column) -> DataFrame:
    """For each request the first source (by priority) whose readings of the same key span the requested time.

    ``requests``: (key, req_id, t); ``readings``: (key, source, ts). Coverage is aggregated first; the range test is a
    predicate on an equi join over the key.
    """
    cov = readings.groupBy(key, "source").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi")).withColumn("_p", priority)
    j = requests.join(cov, key, "left").withColumn("_in", (F.col("_lo") <= F.col("t")) & (F.col("t") <= F.col("_hi")))
    pick = F.min_by("source", F.when(F.col("_in"), F.struct("_p", "source")))
    return j.groupBy(key, "req_id", "t").agg(pick.alias("source"), F.count_if("_in").alias("covering"))


def dates_needed(queries: DataFrame, date: Column) -> DataFrame:
    return queries.select(date.alias("date")).filter("date is not null").distinct()


def keep_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of referenced dates; on a table partitioned by date this prunes partitions at run time."""
    return df.join(dates, "date", "left_semi")


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and an order-insensitive sum of 60-bit row hashes over the named columns."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).cast("string").alias("fingerprint"))
