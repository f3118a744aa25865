"""Explicit schemas of the tables the package reads and writes."""

from pyspark.sql import types as T

CASE_SCORES = T.StructType([
    T.StructField("family", T.StringType()),
    T.StructField("release", T.StringType()),
    T.StructField("subsystem", T.StringType()),
    T.StructField("subsystem_id", T.StringType()),
    T.StructField("case", T.StringType()),
    T.StructField("q_idx", T.IntegerType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("fault", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("impl_source", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("input_repr", T.StringType()),
    T.StructField("window_min", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("score_strict", T.DoubleType()),
    T.StructField("valid_output", T.IntegerType()),
    T.StructField("source_file", T.StringType()),
])

RUN_FILE = T.StructType([
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("n", T.LongType()),
    T.StructField("acc1", T.DoubleType()),
    T.StructField("coverage", T.DoubleType()),
    T.StructField("wall_s", T.DoubleType()),
    T.StructField("cases", T.ArrayType(T.StructType([
        T.StructField("case", T.StringType()),
        T.StructField("true_service", T.StringType()),
        T.StructField("fault", T.StringType()),
        T.StructField("ranks", T.ArrayType(T.StringType())),
        T.StructField("n_ranks", T.LongType()),
        T.StructField("top1", T.StringType()),
        T.StructField("acc1", T.DoubleType()),
        T.StructField("acc3", T.DoubleType()),
        T.StructField("acc5", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]))),
])

TELEMETRY = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("cmdb_id", T.StringType()),
    T.StructField("kpi_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

SPANS = T.StructType([
    T.StructField("serviceName", T.StringType()),
    T.StructField("methodName", T.StringType()),
    T.StructField("operationName", T.StringType()),
    T.StructField("startTime", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("traceID", T.StringType()),
])
