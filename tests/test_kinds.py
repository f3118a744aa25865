"""Tolerance curves from kinds of equal cases against the same from the cases themselves."""

from pyspark.sql import functions as F
from seismark.operators import compare as C
from seismark.operators import infer as I
from seismark.operators import ranking as K
from seismark.operators import resample as R
from seismark.plans import q_text as Q

SF = "/root/testdata/sf0.001"


def case_diffs(spark):
    return C.pair_diffs(Q.tol_scores(spark, SF), ["system", "case_id", "tol"]).select("a", "b", "system", "case_id", "tol", "d")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_profiles_score_as_answers(spark):
    truth = lambda c, t: f"The only predicted root cause component is {c}\nThe only root cause occurrence time is within 1 minutes (i.e., <=1min) of {t}\n"
    said = lambda c, t: f'{{"root cause occurrence datetime": "{t}", "root cause component": "{c}", "root cause reason": "r"}}'
    at = "2024-01-01 00:0{}:00"
    data = [("1", said("c1", at.format(1)), truth("c1", at.format(3))), ("2", "", truth("c1", at.format(3))), ("3", said("c1", "no time"), truth("c1", at.format(3))),
            ("4", said("c1", at.format(1)) * 2, truth("c1", at.format(3))), ("5", said("c1", at.format(1)), ""), ("6", said("c2", at.format(3)), truth("c1", at.format(3)))]
    df = spark.createDataFrame(data, "case_id string, prediction string, scoring_points string")
    want = K.score_answer(K.with_tolerances(K.parse_slots(df), [0, 120]), F.col("tol")).select("case_id", "tol", "score")
    kinds = K.answer_profiles(df, {"m": F.col("prediction")}).select("case_id", F.explode("profiles").alias("profile"))
    assert rows(K.score_profiles(K.with_tolerances(kinds, [0, 120]), F.col("tol")).select("case_id", "tol", "score")) == rows(want)


def test_kinds_give_the_results_of_cases(spark):
    d = case_diffs(spark)
    assert rows(Q.i14k(spark, SF)) == rows(I.influence_top_k(d))
    assert rows(Q.i14s(spark, SF)) == rows(I.influence_subsample(d))
    scores = Q.tol_scores(spark, SF)
    got = R.tolerance_replicates(Q.kind_scores(spark, SF), 20, weight="n")
    assert rows(got) == rows(R.tolerance_replicates(scores, 20))


def test_kinds_are_fewer_than_scores(spark):
    assert Q.kind_scores(spark, SF).count() < Q.tol_scores(spark, SF).count()
    assert Q.tol_kinds(spark, SF).agg(F.sum("n")).first()[0] == Q.case_profiles(spark, SF).count()
