import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.functions import stats as S


def _frame(spark, y, p):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "item long, y double, p double")


def _points(spark, y, p):
    df = S.average_rank(S.average_rank(_frame(spark, y, p), "y", "ry"), "p", "rp")
    return df.agg(S.pearson("p", "y").alias("PC"), S.pearson("rp", "ry").alias("SROCC"), S.mae("p", "y").alias("MAE"), S.rmse("p", "y").alias("RMSE")).first()


def test_perfect_prediction(spark):
    assert tuple(_points(spark, [1, 4, 7, 9], [1, 4, 7, 9])) == pytest.approx((1, 1, 0, 0))


def test_constant_prediction_has_no_correlation(spark):
    assert _points(spark, [2, 5, 8, 3], [4.5] * 4)["PC"] == 0.0


def test_monotone_prediction_has_full_rank_correlation(spark):
    r = _points(spark, [1, 2, 3, 4], [math.exp(v) for v in (1, 2, 3, 4)])
    assert r["SROCC"] == pytest.approx(1) and r["PC"] < 1


def test_errors(spark):
    r = _points(spark, [0, 0, 0, 0], [0, 0, 0, 4])
    assert (r["MAE"], r["RMSE"]) == (1, 2)


def test_ties_share_their_mean_rank(spark):
    ranked = S.average_rank(_frame(spark, [3, 1, 3, 2, 3], [0] * 5), "y", "r").orderBy("item").collect()
    assert [r["r"] for r in ranked] == [3, 0, 3, 1, 3]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=40))
def test_ranks_by_ranges_are_ranks(spark, values):
    ranked = S.average_rank(_frame(spark, values, values), "y", "r").orderBy("item").collect()
    assert [r["r"] for r in ranked] == [sum(w < v for w in values) + (values.count(v) - 1) / 2 for v in values]


def _measures(spark, p, a):
    df = spark.createDataFrame([(p, a)], "p array<double>, a array<double>")
    m = S.distribution_measures(S.normalised("p"), S.normalised("a"))
    return df.select(*[v.alias(k) for k, v in m.items()]).first().asDict()


def test_equal_distributions(spark):
    m = _measures(spark, [1.0, 1.0, 1.0], [3.0, 3.0, 3.0])
    assert (m["KL"], m["Chebyshev"]) == pytest.approx((0, 0), abs=1e-9)
    assert (m["Cosine"], m["Intersection"]) == pytest.approx((1, 1))


def test_opposed_distributions(spark):
    m = _measures(spark, [0.25, 0.75], [0.75, 0.25])
    assert m == pytest.approx({"Chebyshev": 0.5, "Clark": math.sqrt(0.5), "Canberra": 1, "KL": 0.5 * math.log(3), "Cosine": 0.6, "Intersection": 0.5}, abs=1e-9)


def test_empty_histogram_is_uniform(spark):
    df = spark.createDataFrame([([0, 0, 0],)], "c array<int>")
    assert df.select(S.normalised("c")).first()[0] == pytest.approx([1 / 3] * 3)


def test_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert df.where(S.not_finite("x")).count() == 3


def test_softmax_and_expectation(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "x array<double>").select(S.softmax("x").alias("s"))
    assert df.select(S.expectation("s")).first()[0] == pytest.approx(1.5)
    assert df.select(F.aggregate("s", F.lit(0.0), lambda a, x: a + x)).first()[0] == pytest.approx(1)
