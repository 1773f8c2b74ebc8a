"""Features are expanded a bounded number of rows at a time, and the sums are those of all rows."""

import numpy as np
import pytest

from plumbline.operators import predictors as P


def test_expanded_rows_are_bounded(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1_500, 3)), rng.normal(size=1_500)
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(1_500)]
    df = spark.createDataFrame(rows, "item long, f array<double>, y double").coalesce(1)

    def expand(part):
        assert len(part) <= 512
        return P.products(part)

    xx, xy, mean, centre, n = P.gram(df, "f", "y", 3, expand)
    wide = P.products(x) - P.products(x).mean(0)
    assert n == 1_500 and mean == pytest.approx(P.products(x).mean(0)) and centre == pytest.approx(y.mean())
    assert xx == pytest.approx(wide.T @ wide) and xy == pytest.approx(wide.T @ (y - y.mean()))
    model = P.ridge_fit(df, "f", "y", 3, 1.0, expand)
    got = [r["p"] for r in df.select("item", P.predictor(model, expand)("f").alias("p")).orderBy("item").collect()]
    assert got == pytest.approx(P.products(x) @ model[0] + model[1])
