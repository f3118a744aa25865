"""Readers and writers that need files, and the streaming resample."""

import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F

from seismark.operators.telemetry import step_of
from seismark.plans.registry import table
from seismark.sources import files as S
from seismark.streaming.resample import resample_stream

SF = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_run_json_keeps_the_file_name(spark):
    path = folder() + "/run"
    c = [Row(case="a/1", true_service="a", fault="cpu", ranks=["a_cpu", "b_mem"], n_ranks=2, top1="a", acc1=1.0, acc3=1.0, acc5=1.0, error=None)]
    from seismark.schemas import RUN_FILE
    spark.createDataFrame([(None, 1, 1.0, 1.0, 2.5, c)], RUN_FILE).write.json(path)
    r = S.read_run_json(spark, path).first()
    assert (r.case, r.ranks, r.wall_s) == ("a/1", ["a_cpu", "b_mem"], 2.5) and r.source_file.endswith(".json")


def test_case_csv_names_come_from_the_file(spark):
    path = folder()
    with open(f"{path}/m1__high.csv", "w") as f:
        f.write("case_id,hit1\nc1,1\nc2,0\n")
    with open(f"{path}/m2__low.csv", "w") as f:
        f.write("case_id,hit1\nc1,0\n")
    got = {tuple(r) for r in S.read_case_csv(spark, f"{path}/*.csv", "case_id string, hit1 int").collect()}
    assert got == {("c1", 1, "m1", "high"), ("c2", 0, "m1", "high"), ("c1", 0, "m2", "low")}


def test_role_filter_reaches_the_scan(spark, capsys):
    path = folder() + "/t"
    spark.createDataFrame([("x", "published"), ("y", "other")], "case_id string, role string").write.parquet(path)
    df = S.read_case_scores(spark, path)
    assert df.count() == 1
    df.explain()
    assert "PushedFilters: [In(role" in capsys.readouterr().out


def test_dates_prune_partitions(spark, capsys):
    path = folder() + "/t"
    df = spark.createDataFrame([("s", "2024-01-01", 10, 1.0), ("s", "2024-01-02", 20, 2.0)], "system string, date string, timestamp bigint, value double")
    S.write_by_date(df, path)
    dates = spark.createDataFrame([("2024-01-02",)], "date string")
    assert [r.value for r in S.keep_dates(spark.read.parquet(path), dates).collect()] == [2.0]


def test_streaming_resample_equals_batch(spark):
    path = folder() + "/in"
    ev = table(spark, SF, "events").select("ts", "event_type", "value")
    # a last reading far ahead moves the watermark past every real window
    far = ev.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    as_ts = lambda d: d.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    as_ts(ev).coalesce(1).write.parquet(path)
    as_ts(far).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    q = resample_stream(stream, "event_type", late="40 days").writeStream.format("memory").queryName("resampled").outputMode("complete").option("checkpointLocation", folder()).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.event_type, r.s, round(r.value, 9)) for r in spark.sql("select event_type, unix_timestamp(start_ts) as s, value from resampled where event_type <> 'end'").collect()}
    want = ev.groupBy("event_type", (step_of("ts", 300) * 300).alias("s")).agg(F.avg("value").alias("value"))
    assert got == {(r.event_type, r.s, round(r.value, 9)) for r in want.collect()}
