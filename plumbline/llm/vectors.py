"""Rows of vectors that can be computed with, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.runtime import unused

#: Beyond this a number times its scale is no long with room to add.
LARGEST = float(1 << 60)


def lattice(vector: str, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift of every component as longs; a finite one too large for that is an error."""
    fits = lambda c: F.abs(c.cast("double") * scale) < LARGEST
    return F.transform(vector, lambda c: F.when(fits(c), F.floor(c.cast("double") * scale) + shift).otherwise(F.raise_error(F.lit("a vector's component is too large for a long")).cast("long")))


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def usable(rows: DataFrame, vector: str, width: int | None = None) -> tuple[DataFrame, int]:
    """The rows whose vectors are finite and of one length: ``width``, or the length that most have, the greater one of equals."""
    sound = rows.where(finite(vector))
    if width is None:
        most = sound.groupBy(F.size(vector).alias(name := unused("size", rows.columns))).count().orderBy(F.desc("count"), F.desc(name)).first()
        width = most[0] if most else 0
    return sound.where(F.size(vector) == width), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column, all of one width, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
