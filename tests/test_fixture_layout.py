"""Case scores lie by case, in tasks of bounded size."""

from pyspark.sql import functions as F
from seismark.operators import compare as C
from seismark.plans import fixtures as X
from seismark.session import tasks_for

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark.range(1000), 100) == max(10, cores) and tasks_for(spark.range(0), 100) == cores


def test_groupings_by_case_need_no_shuffle(spark):
    d = C.pair_diffs(C.case_score(X.case_scores(spark, SF)))
    plan = d._jdf.queryExecution().executedPlan().toString()
    by_case = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "case_id" in line]
    assert len(by_case) == 1 and "REPARTITION_BY_NUM" in by_case[0]
    assert d.groupBy(F.spark_partition_id()).count().count() <= tasks_for(spark.read.parquet(f"{SF}/orders.parquet"))
