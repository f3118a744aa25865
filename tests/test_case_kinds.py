"""Deltas, accuracies and replicates from counted kinds of equal cases against the same from the cases themselves."""

from pyspark.sql import functions as F
from seismark.operators import compare as C
from seismark.operators import resample as R

COLS = "family string, subsystem_id string, case_id string, method string, score double"


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())


def scores(spark):
    """Two subsystems: few different scores, a method that misses cases, a pair with the same difference in all cases."""
    data = [("f", f"s{i % 2}", f"c{i}", m, v) for i in range(60) for m, v in (("m1", (i % 5) / 4), ("m2", (i % 5) / 4 + 0.25), ("m3", (i % 4) / 3)) if m != "m3" or i % 7]
    return spark.createDataFrame(data + [("f", "s2", "c99", "m1", 0.5), ("f", "s2", "c99", "m2", 0.25)], COLS)


def test_kinds_count_all_cases(spark):
    cs = scores(spark)
    kinds = C.case_kinds(cs)
    assert kinds.count() < cs.count()
    assert kinds.agg(F.sum("times")).first()[0] == cs.count()


def test_kinds_give_the_results_of_cases(spark):
    cs = scores(spark)
    kinds = C.case_kinds(cs).cache()
    got = C.pair_deltas(C.pair_diffs(kinds, [*C.CASE, "times"]), weight="times")
    assert rows(got) == rows(C.pair_deltas(C.pair_diffs(cs)))
    assert {r["var"] for r in got.filter("a = 'm1' and b = 'm2' and n > 1").collect()} == {0.0}
    assert rows(C.accuracy(kinds, weight="times")) == rows(C.accuracy(cs))
    assert rows(R.pair_replicates(kinds, 50, weight="times")) == rows(R.pair_replicates(cs, 50))
    assert rows(R.method_replicates(kinds, 50, weight="times")) == rows(R.method_replicates(cs, 50))
    d = C.pair_deltas(C.pair_diffs(cs))
    assert rows(R.bonferroni(kinds, d, C.pool(d), 200, weight="times")) == rows(R.bonferroni(cs, d, C.pool(d), 200))


def test_kinds_of_faults_give_the_reweighted_reversals_of_cases(spark):
    cs = scores(spark).filter("method != 'm3' and subsystem_id != 's2'").withColumn("fault", F.when(F.hash("case_id") % 3 == 0, "x").otherwise("y"))
    kinds = C.case_kinds(cs, ["fault"]).cache()
    assert kinds.count() < cs.count() and kinds.agg(F.sum("times")).first()[0] == cs.count()
    assert rows(C.reweighted(kinds, "times")) == rows(C.reweighted(cs))
    assert rows(R.strata_pair_replicates(kinds, 50, weight="times")) == rows(R.strata_pair_replicates(cs, 50))
    reps = R.strata_pair_replicates(cs, 50)
    assert rows(C.reweighted_reversals(kinds, C.reweighted(cs), reps, "times")) == rows(C.reweighted_reversals(cs, C.reweighted(cs), reps))
