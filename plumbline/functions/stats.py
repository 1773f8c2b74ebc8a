"""Aggregates and array expressions for scoring predictions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-12
#: Measures for which less is better; for the others more is.
LOWER_IS_BETTER = ("MAE", "RMSE", "Chebyshev", "Clark", "Canberra", "KL")


def lower_is_better(metric: str) -> bool:
    return metric in LOWER_IS_BETTER


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pearson(p: Column | str, y: Column | str) -> Column:
    """Correlation; 0 where either side is constant."""
    p, y = _c(p), _c(y)
    scale = F.nullif(F.stddev_pop(p) * F.stddev_pop(y), F.lit(0.0))
    return F.coalesce(F.covar_pop(p, y) / scale, F.lit(0.0))


def mae(p: Column | str, y: Column | str) -> Column:
    return F.avg(F.abs(_c(p) - _c(y)))


def rmse(p: Column | str, y: Column | str) -> Column:
    d = _c(p) - _c(y)
    return F.sqrt(F.avg(d * d))


def clip(x: Column | str, low: float, high: float) -> Column:
    """The value, held within the scale's ends."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _c(x)))


def not_finite(x: Column | str) -> Column:
    x = _c(x)
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def with_range_part(df: DataFrame, keys: list[str], out: str = "__part") -> DataFrame:
    """Add the number of the range that a row's keys fall in; ranges follow the order of the keys, of any sortable types.

    The bounds are keys of the table: the least by a hash among each of some buckets
    of hashes, which is a sample that depends on nothing but the different keys there
    are. They are an aggregate within the query, one broadcast row, so nothing runs
    before the query does, and a lost task sees the same ranges again. A range is
    found by two short scans, of the coarse bounds and of the fine ones between.
    """
    parts = min(4096, max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    side = ceil(sqrt(parts))
    h = F.xxhash64(*keys)
    least = df.groupBy(F.pmod(h, F.lit(16 * parts)).alias("__bucket")).agg(F.min(F.struct(h.alias("__h"), F.struct(*keys).alias("__key"))).alias("m"))
    found = least.agg(F.sort_array(F.collect_list("m.__key")).alias("__all"))
    at = lambda place: F.get("__all", F.floor(place * F.size("__all") / (side * side)).cast("int"))
    steps = F.sequence(F.lit(1), F.lit(side - 1))
    coarse = F.transform(steps, lambda i: at(i * side))
    fine = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda j: F.transform(steps, lambda i: at(j * side + i)))
    bounds = found.select(coarse.alias("__coarse"), fine.alias("__fine"))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col("__key")))
    placed = df.withColumn("__key", F.struct(*keys)).crossJoin(F.broadcast(bounds)).withColumn("__c", below(F.col("__coarse")))
    return placed.withColumn(out, F.col("__c") * side + below(F.get("__fine", F.col("__c")))).drop("__key", "__coarse", "__fine", "__c")


def _offsets(sums: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """What comes before each range part, of its group: a few rows for each group."""
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "__part", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__o"))


def row_index(df: DataFrame, order: list[str], out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add the 0-based place of each row in the order of some columns, within its group if there is one.

    Rows are dealt to ranges of (group, order); each range is numbered by itself and
    moved by the counts of the ranges before it, so no task sorts a whole table or group.
    """
    df = with_range_part(df, [*by, *order])
    sums = df.groupBy(*by, "__part").agg(F.count("*").alias("__s"))
    within = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    placed = df.withColumn("__within", within)
    same = reduce(lambda x, c: x & placed[c].eqNullSafe(F.col(f"__g_{c}")), by, placed["__part"] == F.col("__p"))
    offsets = _offsets(sums, by).select(F.col("__part").alias("__p"), "__o", *[F.col(c).alias(f"__g_{c}") for c in by])
    return placed.join(offsets, same).withColumn(out, F.col("__o") + F.col("__within") - 1).drop("__part", "__o", "__p", "__within", *[f"__g_{c}" for c in by])


def average_ranks(df: DataFrame, values: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Add the 0-based rank of each value (column: new column), within its group if there is one; equal values share the mean of their ranks.

    All columns are ranked as one table of (group, column, value): counts of
    different values are placed, not rows, and the values are first dealt to ranges
    with known bounds, so no window spans a table or a group.
    """
    names = list(values)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__col"), F.col(c).alias("__v")) for i, c in enumerate(names)])).alias("__x")
    long = df.select(*by, each).select(*by, "__x.__col", "__x.__v")
    group = (*by, "__col")
    counts = with_range_part(long.groupBy(*group, "__v").agg(F.count("*").alias("__n")), [*group, "__v"])
    before = Window.partitionBy(*group, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sums = counts.groupBy(*group, "__part").agg(F.sum("__n").alias("__s"))
    ranked = ranked.join(_offsets(sums, group), [*group, "__part"])
    ranked = ranked.select(*group, "__v", (F.col("__before") + F.col("__o") + (F.col("__n") - 1) / 2).alias("__r"))
    for i, c in enumerate(names):
        df = df.join(ranked.where(F.col("__col") == i).select(*by, F.col("__v").alias(c), F.col("__r").alias(values[c])), [*by, c])
    return df


def average_rank(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``average_ranks`` of one column."""
    return average_ranks(df, {value: out}, by)


def normalised(counts: Column | str, *, strict: bool = False) -> Column:
    """Shares of an array of counts; an empty histogram is uniform, or an error if ``strict``, as what measures compare must be."""
    c = _c(counts)
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    if strict:
        total = F.when(total > 0, total).otherwise(F.raise_error(F.lit("a distribution has no positive total")).cast("double"))
        return F.transform(c, lambda x: x / total)
    return F.transform(c, lambda x: F.when(total > 0, x / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0) / F.size(c)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def distribution_measures(p: Column | str, a: Column | str) -> dict[str, Column]:
    """Per row: predicted shares ``p`` against actual shares ``a``."""
    p, a = _c(p), _c(a)
    ratio = lambda x, y: F.abs(x - y) / (x + y + EPS)
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return {
        "Chebyshev": F.array_max(F.zip_with(p, a, lambda x, y: F.abs(x - y))),
        "Clark": F.sqrt(_sum(F.zip_with(p, a, lambda x, y: ratio(x, y) * ratio(x, y)))),
        "Canberra": _sum(F.zip_with(p, a, ratio)),
        "KL": _sum(F.zip_with(p, a, lambda x, y: y * F.log((y + EPS) / (x + EPS)))),
        "Cosine": _sum(F.zip_with(p, a, lambda x, y: x * y)) / (norm(p) * norm(a) + EPS),
        "Intersection": _sum(F.zip_with(p, a, lambda x, y: F.least(x, y))),
    }


def expectation(shares: Column | str, low: float = 1.0) -> Column:
    """Mean of a distribution over the bins low, low + 1, ..."""
    return _sum(F.transform(_c(shares), lambda x, i: x * (F.lit(float(low)) + i)))


def softmax(x: Column | str) -> Column:
    x = _c(x)
    top = F.array_max(x)
    total = _sum(F.transform(x, lambda v: F.exp(v - top)))
    return F.transform(x, lambda v: F.exp(v - top) / total)


def log_softmax(x: Column | str) -> Column:
    x = _c(x)
    top = F.array_max(x)
    total = F.log(_sum(F.transform(x, lambda v: F.exp(v - top))))
    return F.transform(x, lambda v: v - top - total)


def counts_of(shares: Column | str, n: Column | str) -> Column:
    """Counts again, from shares and the number of ratings; without a number the shares stay as they are."""
    n = _c(n)
    return F.transform(_c(shares), lambda x: x * F.coalesce(n.cast("double"), F.lit(1.0)))


def smooth_l1(p: Column | str, y: Column | str) -> Column:
    d = F.abs(_c(p) - _c(y))
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def heteroscedastic(e: Column | str, y: Column | str, log_variance: Column | str) -> Column:
    d, v = _c(e) - _c(y), _c(log_variance)
    return F.exp(-v) * d * d + v


def multinomial_nll(counts: Column | str, shares: Column | str, mean_n: Column | None = None) -> Column:
    """-sum of count * ln(share); over the mean number of ratings, if that is given, so that it does not grow with it."""
    nll = -_sum(F.zip_with(_c(counts), _c(shares), lambda c, s: c * F.log(s + EPS)))
    return nll if mean_n is None else nll / mean_n
