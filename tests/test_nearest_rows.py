"""The k nearest rows through a matrix product are those by differences, far from the origin and with many ties too."""

import numpy as np
import pytest

from plumbline.operators import predictors as P


@pytest.mark.parametrize("shift,scale,k", [(0.0, 1.0, 5), (1e4, 1e-2, 5), (0.0, 1e-7, 3), (0.0, 0.0, 4), (3.0, 1.0, 90)])
def test_nearest_rows(shift, scale, k):
    rng = np.random.default_rng(8)
    rows = shift + scale * np.round(rng.normal(size=(80, 6)), 1)
    rows[40:60] = rows[:20]
    x = np.concatenate([rows[:7], shift + scale * np.round(rng.normal(size=(9, 6)), 1)])
    place = rng.permutation(80)
    i, j, d = P._k_nearest(x, rows, place, k)
    for q in range(len(x)):
        far = np.round(P._distances(x[q : q + 1], rows)[0], 9)
        want = np.lexsort((place, far))[:k]
        assert j[i == q].tolist() == want.tolist() and d[i == q].tolist() == far[want].tolist()


def test_rows_that_cannot_be_near_are_not_compared(monkeypatch):
    """Differences are taken for the k nearest and their ties, not for every pair."""
    rng = np.random.default_rng(8)
    x, rows, taken = rng.normal(size=(50, 8)), rng.normal(size=(400, 8)), []
    round_ = np.round
    monkeypatch.setattr(P.np, "round", lambda v, places: taken.append(np.size(v)) or round_(v, places))
    P._k_nearest(x, rows, np.arange(400), 5)
    assert sum(taken) == 50 * 5
