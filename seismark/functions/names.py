"""Metric, component and method names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: metric-kind suffixes that end a service name, tried in this order
KIND_SUFFIXES = ["_cpu", "_mem", "_latency", "_load", "_error", "_duration", "_rps", "_lat_90", "_latency-90", "_loss",
                 "_disk", "_delay", "_workload"]
# fixed values: data-store suffixes folded into the application service
STORE_SUFFIXES = ["-db", "-rb"]
# fixed values: resource-type suffixes of cloud node labels
RESOURCE_SUFFIXES = ["-function", "-table", "-stage", "-queue", "-statemachine"]
# fixed values: keyword lists per fault type, first match wins
KIND_PATTERNS = [
    ("cpu", ["system.cpu.", "system.load", "container_cpu", ".cpu."]),
    ("memory", ["container_memory_failures", "container_memory_usage", "container_memory_max", "container_memory_rss",
                "container_memory_cache", "container_memory_swap", "container_memory_mapped", "container_memory_working",
                "system.mem.", ".mem.", "system.swap"]),
    ("disk_io", ["system.io.", "container_fs_read", "container_fs_write", "system.disk.read", "system.disk.write", "container_blkio"]),
    ("disk_space", ["system.disk.free", "system.disk.used", "system.disk.pct", "system.fs.inodes", "container_fs_usage"]),
    ("network", ["system.net.", "container_network", ".tcp.", ".udp."]),
    ("cpu", ["cpu_used", "cpu_free", "proc_used", "proc_user", "sys_cpu", "system_cpu"]),
    ("memory", ["mem_", "memory", "swap_", "pga_", "sga_"]),
    ("disk_io", ["read_per_sec", "write_per_sec", "seqread", "sctread", "physical_read", "logic_read", "dfparawrite", "lfparawrite", "lfsync", "redo_"]),
    ("disk_space", ["new_tbs_free", "new_tbs_used", "tbs_used"]),
    ("network", ["tnsping", "icmp_ping", "incoming_network", "outgoing_network", "received_packets", "sent_packets", "send_total",
                 "receive_total", "network_traffic", "ping_result"]),
    ("db", ["sess_active", "sess_connect", "session_pct", "login_per", "exec_per", "tps_per", "call_per", "logon"]),
]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_service(name: str | Column) -> Column:
    """Service of a metric name: known kind suffix off; else the part before ``_`` (numbers kept, store suffix off)."""
    c = _col(name)
    head = F.substring_index(c, "_", 1)
    rest = F.when(head.rlike("^[0-9]"), head).otherwise(F.regexp_replace(head, "(?:" + "|".join(STORE_SUFFIXES) + ")$", ""))
    out = None
    for s in KIND_SUFFIXES:
        cut = F.substring(c, F.lit(1), F.length(c) - len(s))
        out = F.when(c.endswith(s), cut) if out is None else out.when(c.endswith(s), cut)
    return out.when(c.contains("_"), rest).otherwise(c)


def service_from_col(name: str | Column) -> Column:
    return F.replace(F.substring_index(_col(name), "_", 1), F.lit("-db"), F.lit(""))


def node_of(name: str | Column) -> Column:
    return F.substring_index(_col(name), "__", 1)


def clean(name: str | Column) -> Column:
    return F.replace(F.replace(F.replace(_col(name), F.lit(" "), F.lit("_")), F.lit("::"), F.lit("-")), F.lit("/"), F.lit("-"))


def flatten_header(*levels: str | Column) -> Column:
    """One name from several header levels."""
    return F.concat_ws("__", *[clean(x) for x in levels])


def canonical_node(name: str | Column) -> Column:
    return F.regexp_replace(F.lower(clean(name)), "(?:" + "|".join(RESOURCE_SUFFIXES) + ")+$", "")


def replica_base(comp: str | Column) -> Column:
    """Name without a replica number and the trailing 2 of a second instance."""
    return F.regexp_replace(F.regexp_replace(_col(comp), "-[0-9]+$", ""), "2$", "")


def map_candidate(comps: DataFrame, candidates: DataFrame) -> DataFrame:
    """(component, mapped): the name itself and its replica base where they are candidates; else the part before a dot.

    ``candidates`` has one column ``name``. The three forms are rows, so this is one equi join.
    """
    forms = F.array(F.struct(F.lit(1).alias("pri"), F.col("component").alias("name")),
                    F.struct(F.lit(2).alias("pri"), replica_base("component").alias("name")),
                    F.struct(F.lit(3).alias("pri"), F.substring_index("component", ".", 1).alias("name")))
    x = comps.select("component", F.explode(forms).alias("f")).select("component", "f.*").distinct().join(candidates, "name")
    x = x.filter((F.col("pri") != 2) | (F.col("name") != F.col("component")))
    best = F.min("pri").over(W.partitionBy("component"))
    return x.withColumn("best", best).filter((F.col("pri") < 3) | (F.col("best") == 3)).select("component", F.col("name").alias("mapped"))


def family_key(system: str | Column, comp: str | Column) -> Column:
    """Replica family under the naming scheme of a system; null where a name has no replica number."""
    s, c = _col(system), _col(comp)
    def grab(pattern):
        return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))

    return (F.when(s == "Bank", grab("^([A-Za-z]+?)[0-9]+$")).when(s == "Telecom", grab("^([a-z]+)_[0-9]+$"))
            .when(s.startswith("Market"), grab("^([A-Za-z][A-Za-z0-9]*?)-[0-9]+$")))


def classify_metric(name: str | Column) -> Column:
    """Fault type of a metric: keyword lists on the part after the component, 'other' without a match."""
    c = _col(name)
    kpi = F.lower(F.when(c.contains("__"), F.regexp_extract(c, "(?s)__(.*)$", 1)).otherwise(c))
    out = None
    for kind, words in KIND_PATTERNS:
        hit = kpi.rlike("|".join(w.replace(".", "\\.") for w in words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def repair_names(names: DataFrame, order: str = "pos", key: tuple[str, ...] = ()) -> DataFrame:
    """New column names with exactly one underscore; later columns that collide get ``-dupN``.

    ``names``: (key..., pos, name). A header is as wide as its table, so the window is short.
    """
    c = F.col("name")
    compact = lambda x: F.replace(x, F.lit("_"), F.lit("-"))
    new = F.when(c.contains("__"), F.concat(compact(F.substring_index(c, "__", 1)), F.lit("_"), compact(F.regexp_extract(c, "(?s)__(.*)$", 1)))).otherwise(c)
    x = names.withColumn("_new", new)
    dup = F.row_number().over(W.partitionBy(*key, "_new").orderBy(order)) - 1
    return x.withColumn("_d", dup).withColumn("new_name", F.when(F.col("_d") > 0, F.concat(F.col("_new"), F.lit("-dup"), F.col("_d").cast("string"))).otherwise(F.col("_new"))).drop("_new", "_d")


def pick_sli(targets: DataFrame, cols: DataFrame, default: str) -> DataFrame:
    """Column to watch per case: the exact name, else the first with the same service prefix, else a default.

    ``targets``: (case_id, target); ``cols``: (case_id, name, pos).
    """
    svc = F.substring_index("name", "_", 1) == F.substring_index("target", "_", 1)
    j = targets.join(cols, "case_id", "left")
    pri = F.when(F.col("name") == F.col("target"), 0).when(svc, 1)
    best = F.min_by("name", F.when(pri.isNotNull(), F.struct(pri, F.col("pos"))))
    return j.groupBy("case_id", "target").agg(F.coalesce(best, F.lit(default)).alias("sli"))


# fixed values: spellings of one method under its canonical name
METHOD_ALIASES = {"zbase": "zbase_univ", "z_family": "zbase_univ", "epsilon_diagnosis": "e_diagnosis"}


def canon_method(name: str | Column, aliases: dict[str, str] | None = None) -> Column:
    c = F.trim(_col(name))
    table = aliases if aliases is not None else METHOD_ALIASES
    if not table:
        return c
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.element_at(m, c), c)
