"""Whitening of embeddings by merged moments.

A partition sums up its vectors as a count, the sums of the dimensions and the
scatter around its own mean; two such triples become one by Chan's formula,

    M = Ma + Mb + d d' * na * nb / (na + nb),  d = mean_b - mean_a,

in a tree over the partitions (``treeReduce``), so products are only ever made of
centred numbers and what reaches the driver is one triple of d * d numbers. Sums are
whole numbers, and the difference of means is taken from them exactly. The driver
has the eigenvectors; a second pass over the fit list merges the moments of the
whitened vectors the same way and says how far their covariance is from the
identity.

The fit list is each different vector once: a distinct whose partial step leaves one
row of a vector that many rows share in each task, before anything is shuffled. It
is written to the shared folder, as both passes read it. The rows are whitened where
they are, with the model as a broadcast of (16 + 2) * d numbers.

Defined cases: rows whose vector is null or has entries that are null or not finite
take no part, nor do those of another length than most have (the greater length if
two are as frequent); repeated rows are each whitened but fitted once; ids may be null or
repeat. A component whose eigenvalue is not told from zero by double precision
(below d * 2^-50 of the largest) is left out, so a table whose vectors are all equal,
or empty, gives no rows. The sum of squares ``deviation`` is exact as a decimal, or
null beyond 38 digits. A finite entry too large for a long is an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.runtime import materialise
from plumbline.llm.vectors import lattice, matrix, usable

COMPONENTS = 16
#: Entries of a matrix up to which it is held at once.
BLOCK = 1 << 20


@dataclass
class Moments:
    """Count, sums and centred scatter of some vectors; sums are exact if they are of whole numbers."""

    n: int
    sums: list
    scatter: np.ndarray

    def mean(self) -> np.ndarray:
        return np.array([float(s / self.n) for s in self.sums])


def moments(x: np.ndarray) -> Moments:
    """Of the rows of a matrix, taken relative to its first row: whole numbers stay exact until they are divided by their count."""
    apart = x - x[0]
    centre = apart.mean(0)
    sums = [a + len(x) * b for a, b in zip(apart.sum(0).tolist(), x[0].tolist())]
    centred = apart - centre
    return Moments(len(x), sums, centred.T @ centred)


def merged(a: Moments | None, b: Moments) -> Moments:
    """Chan's formula for two sets of vectors."""
    if a is None:
        return b
    # with whole numbers the products are exact, so only the quotient is rounded
    d = np.array([float((sb * a.n - sa * b.n) / (a.n * b.n)) for sa, sb in zip(a.sums, b.sums)])
    return Moments(a.n + b.n, [sa + sb for sa, sb in zip(a.sums, b.sums)], a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / (a.n + b.n)))


def gathered(vectors: DataFrame, width: int, transform=None) -> Moments:
    """The moments of a column of vectors, after ``transform`` if there is one: one triple for each partition, then a tree."""
    whole = transform is None

    def local(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column(0), width)
            step = max(1, BLOCK // max(1, width))
            for i in range(0, len(x), step):
                part = x[i : i + step]
                total = merged(total, moments(transform(part) if transform else part))
        if total is not None:
            sums = pa.array([[str(s) for s in total.sums]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([total.n], pa.int64()), sums, pa.array([total.scatter.tobytes()], pa.binary())], names=["n", "sums", "scatter"])

    read = lambda r: Moments(r[0], [int(s) if whole else float(s) for s in r[1]], np.frombuffer(r[2]).reshape(len(r[1]), -1))
    return vectors.mapInArrow(local, "n long, sums array<string>, scatter binary").rdd.map(read).treeReduce(merged)


@dataclass
class Whitening:
    """n, sums S and principal axes of the fit list; ``values`` are the eigenvalues, ``vectors`` the columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the difference taken before it is rounded."""
        if abs(x).max(initial=0) < (1 << 62) // self.n // 2 and max(map(abs, self.sums)) < 1 << 61:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return np.array([[float((self.n * v - s) / self.n) for v, s in zip(row, self.sums)] for row in x.tolist()]).reshape(x.shape)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)^2, exactly."""
        if abs(x).max(initial=0) < (1 << 62) // self.n // 2 and max(map(abs, self.sums)) < 1 << 61:
            d = self.n * x - np.array(self.sums, np.int64)
            if len(d) and int(abs(d).max()) ** 2 * max(1, d.shape[1]) < 1 << 63:
                return (d * d).sum(1).tolist()
            return [sum(v * v for v in row) for row in d.tolist()]
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a column of vectors of whole numbers, each different one counted once; None without rows or variance."""
    column = vectors.columns[0]
    once = materialise(vectors.distinct(), "different-vectors").select(column)
    if not width or not once.limit(1).count():
        return None
    found = gathered(once, width)
    covariance = found.scatter / found.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:components] > max(values[0], 0) * width * 2.0**-50).sum())
    if not kept:
        return None
    values, axes = values[:kept].copy(), axes[:, :kept]
    # either sign is an eigenvector's: that which makes its largest entry positive
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(kept)])
    model = Whitening(found.n, found.sums, values, axes, float(np.trace(covariance)))
    again = gathered(once, width, model)
    model.identity_error = float(np.abs(again.scatter / again.n - np.eye(kept)).max())
    return model


def whiten(rows: DataFrame, vector: str, *, scale: int, shift: int = 0, components: int = COMPONENTS) -> DataFrame:
    """The id of every usable row (the first column) with deviation, whitened and what the fit says of itself.

    ``rows`` has an id and a vector. Vectors become whole numbers, floor(scale *
    c) + shift, and ``whitened`` has up to ``components`` numbers; explained has
    the share of the variance of each, n the size of the fit list.
    """
    name = next(c for c in rows.columns if c != vector)
    sound, width = usable(rows.select(name, vector), vector)
    whole = sound.select(F.col(name).alias("id"), lattice(vector, scale, shift).alias("x"))
    schema = "id long, deviation decimal(38,0), whitened array<double>"
    model = fit(whole.select("x"), width, components)
    if model is None:
        out = rows.sparkSession.createDataFrame([], schema)
        n, explained, error = 0, [], 0.0
    else:
        shipped = rows.sparkSession.sparkContext.broadcast(model)
        n, explained, error = model.n, (model.values / model.trace).tolist(), model.identity_error

        def apply(batches):
            of = shipped.value
            for batch in batches:
                x = matrix(batch.column(1), width)
                z = of(x)
                exact = [Decimal(v) if v < 10**38 else None for v in of.deviation(x)]
                ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=["id", "deviation", "whitened"])

        out = whole.select(F.col("id").cast("long"), "x").mapInArrow(apply, schema)
    literal = F.array(*[F.lit(v) for v in explained]).cast("array<double>")
    return out.select(F.col("id").alias(name), F.lit(n).cast("long").alias("n"), "deviation", "whitened", literal.alias("explained"), F.lit(error).alias("identity_error"))
