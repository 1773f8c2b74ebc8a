"""Kernel methods through the features that a bounded number of basis rows span.

The features of a row are its kernel values with the basis, turned so that their
products are the kernel itself on the span of the basis. A basis of all different
rows, where there are no more than its size, makes that exact; beyond, it is the
Nystroem approximation. Nothing else depends on the number of rows: every fit is
sums over rows, so tasks return numbers of the basis' size squared, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from plumbline.operators.predictors import array_sums

#: Rows of the basis at most.
BASIS = 2_000
#: Rows whose kernel values a task holds at once.
ROWS = 2_048


@dataclass
class Kernel:
    """exp(-gamma * distance^2) with some basis rows, and what turns these values into features."""

    basis: np.ndarray
    turn: np.ndarray
    gamma: float

    def features(self, x: np.ndarray) -> np.ndarray:
        b = self.basis
        distance = (x**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * x @ b.T
        return np.exp(-self.gamma * np.maximum(distance, 0)) @ self.turn


def fitted_kernel(train: DataFrame, gamma: float, basis: int = BASIS) -> Kernel:
    """The basis are different feature rows, the first by a hash: the same ones on every run."""
    some = train.select(F.transform("features", lambda v: v.cast("double")).alias("features")).distinct()
    rows = some.orderBy(F.xxhash64("features"), "features").limit(basis).collect()  # so many rows at most
    if not rows:
        raise ValueError("no training rows")
    x = np.array([r[0] for r in rows], float)
    distance = (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
    values, vectors = np.linalg.eigh(np.exp(-gamma * np.maximum(distance, 0)))
    kept = values > 1e-10 * values[-1]
    return Kernel(x, vectors[:, kept] / np.sqrt(values[kept]), gamma)


@dataclass
class KernelModel:
    """A linear function of a kernel's features; ``gap`` is the duality gap over the objective where the fit has one."""

    kernel: Kernel
    weights: np.ndarray
    intercept: float
    gap: float | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.features(x) @ self.weights + self.intercept

    def column(self):
        """The model as a vectorised function of a feature column."""

        @F.pandas_udf("double")
        def predict(features):
            import pandas as pd

            x = np.array(features.tolist(), float).reshape(len(features), -1)
            return pd.Series(self(x) if len(x) else [], dtype=float)

        return predict


def _blocks(x: np.ndarray, *more: np.ndarray):
    for i in range(0, len(x), ROWS):
        yield x[i : i + ROWS], *[m[i : i + ROWS] for m in more]


def kernel_ridge(train: DataFrame, *, gamma: float, alpha: float, basis: int = BASIS) -> KernelModel:
    """Least squares with a penalty on the function's norm, around the mean label."""
    kernel = fitted_kernel(train, gamma, basis)
    total, n = train.agg(F.sum(F.col("label").cast("double")), F.count("label")).first()
    mean = total / n

    def products(x, y):
        out = 0.0
        for a, b in _blocks(x, y):
            f = kernel.features(a)
            out = out + f.T @ np.column_stack([f, b - mean])
        return out

    width = kernel.turn.shape[1]
    sums = array_sums(train, ["features", "label"], products).reshape(width, -1)
    return KernelModel(kernel, np.linalg.solve(sums[:, :-1] + alpha * np.eye(width), sums[:, -1]), mean)


#: Parts of a step that are tried beside all of it.
SHORTER = (0.25, 0.06, 0.015, 0.004)


def support_vector_regression(train: DataFrame, *, gamma: float, c: float = 10.0, epsilon: float = 0.1, basis: int = 1_000, tolerance: float = 1e-3, passes: int = 100) -> KernelModel:
    """The function of least norm / 2 + c * (errors beyond ``epsilon``, added up), with an intercept that costs nothing.

    The error's corners are rounded over a width ``mu``, so the sum is smooth, and a
    Newton step needs one pass: the gradient, and the products of rows weighted by
    how much the error bends there. ``mu`` shrinks until the rounding is no more than
    ``tolerance`` of the objective; on the way it is enough to be near the least, at
    its end the least is found. The slope at a row is its dual variable, which never
    exceeds c; all of them together are feasible, so the last pass says how far the
    function can be from the best at most, the duality gap. No row has a state that
    would have to be kept from pass to pass.
    """
    # every pass reads the rows, however much it takes to make their features
    rows = train.select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _support_vectors(rows, gamma, c, epsilon, basis, tolerance, passes)
    finally:
        rows.unpersist()


def _support_vectors(train: DataFrame, gamma: float, c: float, epsilon: float, basis: int, tolerance: float, passes: int) -> KernelModel:
    kernel = fitted_kernel(train, gamma, basis)
    m = kernel.turn.shape[1]
    total, n, spread = train.agg(F.sum(F.col("label").cast("double")), F.count("label"), F.stddev_pop(F.col("label").cast("double"))).first()
    free = np.r_[np.ones(m), 0.0]  # the intercept has no part in the norm

    def sums_at(w, mu, step):
        """value, gradient, curvature, objective and dual at w + step, and the values of shorter steps."""
        tried = np.column_stack([w + t * step for t in (1.0, *SHORTER)])

        def block(x, y):
            values, hard, dual, slope, bend = np.zeros(tried.shape[1]), 0.0, 0.0, np.zeros(m + 1), np.zeros((m + 1, m + 1))
            for a, b in _blocks(x, y):
                f = np.column_stack([kernel.features(a), np.ones(len(a))])
                every = b[:, None] - f @ tried
                values += mu * (np.logaddexp(0, (every - epsilon) / mu) + np.logaddexp(0, (-every - epsilon) / mu)).sum(0)
                r = every[:, 0]
                hard += np.maximum(np.abs(r) - epsilon, 0).sum()
                up, down = (1 / (1 + np.exp(-np.clip((s * r - epsilon) / mu, -500, 500))) for s in (1, -1))
                beta = c * (up - down)
                dual += (beta * b - epsilon * np.abs(beta)).sum()
                slope += f.T @ beta
                bend += (f * (up * (1 - up) + down * (1 - down))[:, None]).T @ f
            return np.concatenate([values, [hard, dual], slope, bend.ravel()])

        got = array_sums(train, ["features", "label"], block)
        k = tried.shape[1]
        norms = ((tried * free[:, None]) ** 2).sum(0) / 2
        beta = got[k + 2 : k + m + 3]
        bend = np.diag(free) + c / mu * got[k + m + 3 :].reshape(m + 1, -1)
        primal = norms[0] + c * got[k]
        # what the dual variables' sum is from zero would be paid for by the intercept
        lower = got[k + 1] - float(beta[:-1] @ beta[:-1]) / 2 - abs(float(beta[-1])) * max(abs(tried[-1, 0]), 1.0)
        return norms + c * got[:k], free * tried[:, 0] - beta, bend, primal, lower

    mu, w, still = max(spread or 0.0, 1e-3), np.r_[np.zeros(m), total / n], np.zeros(m + 1)
    done, best = 0, (np.inf, w)
    while done < passes:
        values, slope, bend, primal, lower = sums_at(w, mu, still)
        done += 1
        last = 2 * c * n * mu <= tolerance * primal
        while done < passes:
            step = -np.linalg.lstsq(bend + 1e-9 * np.eye(m + 1), slope, rcond=None)[0]
            gain = -float(step @ slope)
            if gain < (1e-9 * primal if last else 0.02 * c * n * mu):
                break
            ahead = sums_at(w, mu, step)
            done += 1
            t = 1.0
            if ahead[0][0] > values[0] - 1e-4 * gain:
                i = int(ahead[0].argmin())
                if i == 0 or ahead[0][i] >= values[0]:
                    break
                t = (1.0, *SHORTER)[i]
                ahead = sums_at(w + t * step, mu, still)
                done += 1
            w = w + t * step
            values, slope, bend, primal, lower = ahead
        gap = max(primal - lower, 0.0) / max(abs(primal), 1e-12)
        best = min(best, (gap, w), key=lambda b: b[0])
        if last and gap <= tolerance or mu < 1e-9:
            break
        mu /= 4
    gap, w = best
    return KernelModel(kernel, w[:-1], float(w[-1]), gap)
