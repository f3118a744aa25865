"""Free text of incident queries, answers and scoring points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: months, patterns of answers and of scoring points, answer format
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DATE_PATTERN = "(" + "|".join(MONTHS) + r")\s+(\d{1,2}),?\s*(\d{4})"
TIME_PATTERN = r"(?<!\d)(\d{1,2}):(\d{2})(?!\d)"
ANSWER_PATTERN = (r'\{\s*(?:"root cause occurrence datetime":\s*"(.*?)")?,?\s*(?:"root cause component":\s*"(.*?)")?,?\s*'
                  r'(?:"root cause reason":\s*"(.*?)")?\s*\}')
COMPONENT_TRUTH = r"The (?:\d+-th|only) predicted root cause component is ([^\n]+)"
REASON_TRUTH = r"The (?:\d+-th|only) predicted root cause reason is ([^\n]+)"
TIME_TRUTH = r"The (?:\d+-th|only) root cause occurrence time is within 1 minutes \(i.e., <=1min\) of ([^\n]+)"
ANSWER_FORMAT = '{"root cause occurrence datetime": "%s", "root cause component": "%s", "root cause reason": "%s"}'
UTC_OFFSET_HOURS = 8

# fixed values: reason named for a fault type, per system
_MARKET = {"cpu": "container CPU load", "memory": "container memory load", "disk_space": "node disk space consumption",
           "network": "container network latency", "db": "container CPU load", "tomcat_thread": "container CPU load",
           "tomcat_req": "container CPU load", "jvm": "container CPU load", "redis_ops": "container CPU load", "other": "container CPU load"}
REASONS = {
    "Telecom": {"cpu": "CPU fault", "memory": "CPU fault", "disk_io": "CPU fault", "disk_space": "CPU fault", "network": "network delay",
                "db": "db connection limit", "tomcat_thread": "CPU fault", "tomcat_req": "CPU fault", "jvm": "CPU fault",
                "redis_ops": "CPU fault", "other": "CPU fault"},
    "Bank": {"cpu": "high CPU usage", "memory": "high memory usage", "disk_io": "high disk I/O read usage", "disk_space": "high disk space usage",
             "network": "network latency", "db": "high memory usage", "tomcat_thread": "high CPU usage", "tomcat_req": "high CPU usage",
             "jvm": "JVM Out of Memory (OOM) Heap", "redis_ops": "high memory usage", "other": "high memory usage"},
    "Market_cloudbed-1": {**_MARKET, "disk_io": "node disk read I/O consumption"},
    "Market_cloudbed-2": {**_MARKET, "disk_io": "container read I/O load"},
}
NODE_REASONS = {
    "Market_cloudbed-1": {"cpu": "node CPU spike", "memory": "node memory consumption", "disk_io": "node disk read I/O consumption",
                          "disk_space": "node disk space consumption", "network": "node CPU spike"},
    "Market_cloudbed-2": {"cpu": "node CPU load", "memory": "node memory consumption", "disk_io": "node disk write I/O consumption",
                          "disk_space": "node disk space consumption", "network": "node CPU load"},
}
NODE_DEFAULT = {"Market_cloudbed-1": "node CPU spike", "Market_cloudbed-2": "node CPU load"}
DEFAULT_ANSWER = {"Bank": ("Tomcat01", "high memory usage"), "Telecom": ("docker_001", "CPU fault"),
                  "Market_cloudbed-1": ("node-1", "node CPU spike"), "Market_cloudbed-2": ("node-1", "node CPU load")}
# fixed values: counts from which a fault type decides, in order of precedence
TYPE_RULES = [("jvm", 2), ("memory", 2), ("db", 3), ("network", 1), ("cpu", 2), ("disk_space", 2), ("disk_io", 2), ("memory", 1), ("cpu", 1)]
# fixed values: fault class of a reason
REASON_CLASSES = {
    "cpu": ["high CPU usage", "high JVM CPU load", "CPU fault", "container CPU load", "node CPU load", "node CPU spike"],
    "memory": ["high memory usage", "JVM Out of Memory (OOM) Heap", "container memory load", "node memory consumption"],
    "disk": ["high disk I/O read usage", "high disk space usage", "container read I/O load", "container write I/O load",
             "node disk read I/O consumption", "node disk write I/O consumption", "node disk space consumption"],
    "network": ["network packet loss", "network latency", "network delay", "network loss", "container network packet corruption",
                "container network packet retransmission", "container network latency", "container packet loss"],
    "other": ["db connection limit", "db close", "container process termination"],
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a short fixed table, null without an entry."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def fault_class(reason: str | Column) -> Column:
    return lookup({r: c for c, rs in REASON_CLASSES.items() for r in rs}, _col(reason))


def _reason_of(system: Column, comp: Column, kind: Column) -> Column:
    flat = {f"{s}|{k}": r for s, t in REASONS.items() for k, r in t.items()}
    node = {f"{s}|{k}": r for s, t in NODE_REASONS.items() for k, r in t.items()}
    key = F.concat_ws("|", system, kind)
    is_node = system.startswith("Market") & comp.startswith("node-")
    dflt = lookup({s: v[1] for s, v in DEFAULT_ANSWER.items()}, system)
    return F.when(is_node, F.coalesce(lookup(node, key), lookup(NODE_DEFAULT, system))).otherwise(F.coalesce(lookup(flat, key), dflt))


def map_reason(counts: DataFrame) -> DataFrame:
    """Reason per (case_id, system, component) from (.., kind, n) counts by thresholds, then the most frequent type."""
    keys = ["case_id", "system", "component"]
    n = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    most = F.min_by("kind", F.when(F.col("kind") != "other", F.struct(-F.col("n"), F.col("kind"))))
    kind = None
    for k, least in TYPE_RULES:
        kind = F.when(n(k) >= least, k) if kind is None else kind.when(n(k) >= least, k)
    g = counts.groupBy(*keys).agg(F.coalesce(kind, most, F.lit("other")).alias("kind"))
    return g.select(*keys, "kind", _reason_of(F.col("system"), F.col("component"), F.col("kind")).alias("reason"))


def map_reason_vote(anoms: DataFrame) -> DataFrame:
    """Reason by majority over the three metrics with the largest |pct|; a tie goes to the larger |pct|.

    A heap metric over 10 percent decides for Bank; Market disk types are split by the words in the top three names.
    ``anoms``: (case_id, system, component, metric_id, kind, pct).
    """
    keys = ["case_id", "system", "component"]
    a = F.round(F.abs("pct"), 9)
    heap = F.col("metric_id").contains("HeapMemory") | F.col("metric_id").contains("JVM_Memory")
    x = anoms.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(a.desc(), "metric_id")))
    oom = anoms.groupBy(*keys).agg(F.bool_or(heap & (F.abs("pct") > 10)).alias("oom"))
    m = F.lower("metric_id")
    free = m.rlike(r"free|available|disk\.used|fs\.inodes|container_fs_usage")
    read = (m.contains("read") & m.contains("disk")) | m.contains("container_fs_read") | m.contains("system.io.")
    write = (m.contains("write") & m.contains("disk")) | m.contains("container_fs_write")
    top = x.filter("r <= 3")
    words = top.groupBy(*keys).agg(F.bool_or(free).alias("free"), F.bool_or(read).alias("read"), F.bool_or(write).alias("write"))
    v = top.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.max(a).alias("p"), F.min("r").alias("r"))
    first = v.groupBy(*keys).agg(F.min_by("kind", F.struct(-F.col("n"), F.col("r"))).alias("k1"),
                                 F.min_by("kind", F.when(F.col("kind") != "other", F.struct(-F.col("n"), F.col("r")))).alias("k2"))
    j = first.join(words, keys).join(oom, keys)
    s, c = F.col("system"), F.col("component")
    kind = F.when(F.col("k1") == "other", F.coalesce("k2", F.lit("other"))).otherwise(F.col("k1"))
    cb2, node = s.endswith("cloudbed-2"), s.startswith("Market") & c.startswith("node-")
    only_write = F.col("write") & ~F.col("read")
    disk = (F.when(F.col("free") & ~F.col("read") & ~F.col("write"), "node disk space consumption")
            .when(node & only_write, "node disk write I/O consumption").when(node, "node disk read I/O consumption")
            .when(cb2, "container read I/O load").otherwise("node disk read I/O consumption"))
    reason = (F.when((s == "Bank") & F.col("oom"), "JVM Out of Memory (OOM) Heap")
              .when(s.startswith("Market") & kind.isin("disk_io", "disk_space"), disk).otherwise(_reason_of(s, c, kind)))
    return j.select(*keys, kind.alias("kind"), reason.alias("reason"))


def parse_window(df: DataFrame, text: str) -> DataFrame:
    """Midpoint of the time range in a text: local time, UTC, and the date label; nulls without a date or two times.

    A range that ends before it starts runs over midnight.
    """
    c = F.col(text)
    times = F.regexp_extract_all(c, F.lit(TIME_PATTERN), F.lit(0))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(c, DATE_PATTERN, 1))
    day, year = (F.regexp_extract(c, DATE_PATTERN, i).try_cast("int") for i in (2, 3))
    minute = lambda i: (F.split(F.get(times, i), ":")[0].try_cast("int") * 60 + F.split(F.get(times, i), ":")[1].try_cast("int"))
    x = df.withColumn("_d", F.when((month > 0) & (F.size(times) >= 2), F.make_date(year, month.cast("int"), day)))
    x = x.withColumn("_m1", minute(0)).withColumn("_m2", minute(1))
    end = F.when(F.col("_m2") < F.col("_m1"), F.col("_m2") + 1440).otherwise(F.col("_m2"))
    half_s = ((F.col("_m1") + end) * 30).cast("bigint")
    base = F.unix_seconds(F.col("_d").cast("timestamp"))
    local = F.timestamp_seconds(base + half_s)
    x = x.withColumn("mid_local", local.cast("timestamp_ntz"))
    x = x.withColumn("mid_utc", F.timestamp_seconds(base + half_s - UTC_OFFSET_HOURS * 3600).cast("timestamp_ntz"))
    return x.withColumn("date_label", F.date_format("mid_local", "yyyy-MM-dd")).drop("_d", "_m1", "_m2")


def count_failures(text: str | Column) -> Column:
    """Largest ordinal in the scoring points, 1 without any."""
    ords = F.regexp_extract_all(_col(text), F.lit(r"(\d+)-th"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(ords, lambda v: v.cast("int"))), F.lit(1))


def parse_answers(text: str | Column) -> Column:
    """Array of (dt, component, reason) from concatenated answer objects; absent fields are empty."""
    c = _col(text)
    g = lambda i: F.regexp_extract_all(c, F.lit(ANSWER_PATTERN), F.lit(i))
    return F.transform(F.arrays_zip(g(1).alias("d"), g(2).alias("c"), g(3).alias("r")),
                       lambda z: F.struct(z["d"].alias("dt"), z["c"].alias("component"), z["r"].alias("reason")))


def parse_truth(text: str | Column) -> Column:
    c = _col(text)
    g = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    return F.struct(g(COMPONENT_TRUTH).alias("components"), g(REASON_TRUTH).alias("reasons"), g(TIME_TRUTH).alias("times"))


def first_field(text: str | Column, field: str) -> Column:
    """First component, datetime or reason named in an answer; null without one."""
    pattern = {"component": r'"root cause component":\s*"(.*?)"', "datetime": r'"root cause occurrence datetime":\s*"(.*?)"', "reason": r'"root cause reason":\s*"(.*?)"'}[field]
    return F.nullif(F.regexp_extract(_col(text), pattern, 1), F.lit(""))


def format_answer(dt: Column, component: Column, reason: Column) -> Column:
    return F.format_string(ANSWER_FORMAT, F.coalesce(dt, F.lit("")), component, reason)


def default_answer(system: Column, dt: Column, n: Column) -> Column:
    """The fixed answer of a system, repeated for each expected failure."""
    comp = lookup({s: v[0] for s, v in DEFAULT_ANSWER.items()}, system)
    reason = lookup({s: v[1] for s, v in DEFAULT_ANSWER.items()}, system)
    return F.repeat(format_answer(dt, comp, reason), n)


def build_answers(picks: DataFrame) -> DataFrame:
    """One answer text per case from ordered picks (case_id, pos, dt, component, reason, system, n_expected).

    Cases whose picks are null get the default answer of their system.
    """
    one = F.when(F.col("component").isNotNull(), F.struct("pos", format_answer(F.col("dt"), F.col("component"), F.col("reason")).alias("t")))
    g = picks.groupBy("case_id", "system", "n_expected").agg(F.array_sort(F.collect_list(one)).alias("a"), F.min("dt").alias("dt"))
    text = F.array_join(F.transform("a", lambda v: v["t"]), "")
    return g.select("case_id", F.when(F.size("a") > 0, text).otherwise(default_answer(F.col("system"), F.col("dt"), F.col("n_expected"))).alias("prediction"),
                    (F.size("a") == 0).alias("is_default"))


# ---- small score helpers -------------------------------------------------------------------------------------

def rescore(score: str | Column, rule: str) -> Column:
    s = _col(score)
    hit = {"strict": s == 1, "half": s >= 0.5}[rule]
    return F.when(hit, 1.0).otherwise(0.0)


def difficulty_bucket(task: str | Column) -> Column:
    """Easy up to task 3, middle up to 6, hard above; tasks are named task_<number>."""
    n = F.substring_index(_col(task), "_", -1).cast("int")
    return F.when(n <= 3, "easy").when(n <= 6, "middle").otherwise("hard")


def difficulty_report(df: DataFrame) -> DataFrame:
    """Accuracy per difficulty bucket and in total. ``df``: (task, score)."""
    x = df.withColumn("bucket", difficulty_bucket("task"))
    full = (F.col("score") == 1).cast("double")
    return (x.groupingSets([["bucket"], []], F.col("bucket"))
            .agg(F.count("*").alias("n"), F.count_if(F.col("score") == 1).alias("passed"), F.avg(full).alias("accuracy"))
            .withColumn("bucket", F.coalesce("bucket", F.lit("total"))))


def regret_class(pp: str | Column) -> Column:
    """Size class of a regret in percentage points."""
    p = _col(pp)
    return F.when(p >= 10, "large").when(p >= 2, "moderate").otherwise("near_tie_or_mild")
