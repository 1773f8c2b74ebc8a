"""Rated items, their labels and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.stats import not_finite, row_index
from plumbline.sources.spec import ItemSpec


def explode_ratings(items: DataFrame, item: str, ratings: str) -> DataFrame:
    """item, rater, score from a nested array of {rater_id, score}."""
    one = F.explode(ratings).alias("x")
    return items.select(F.col(item).alias("item"), one).select("item", F.col("x.rater_id").alias("rater"), F.col("x.score").alias("score"))


def label_stats(ratings: DataFrame) -> DataFrame:
    """item, n, label, sd (sample; 0 for one rating), se from (item, rater, score)."""
    out = ratings.groupBy("item").agg(F.count("*").alias("n"), F.avg("score").alias("label"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"))
    return out.withColumn("se", F.col("sd") / F.sqrt(F.col("n")))


def histogram_stats(items: DataFrame, counts: str, low: float = 1.0) -> DataFrame:
    """The same from an array of counts for each bin; no ratings: sd 0, se null."""
    add = lambda a, x: a + x
    c = F.transform(counts, lambda x: x.cast("double"))
    n = F.aggregate(c, F.lit(0.0), add)
    mean = F.aggregate(F.transform(c, lambda x, i: x * (i + low)), F.lit(0.0), add) / F.greatest(n, F.lit(1.0))
    out = items.withColumn("n", n.cast("long")).withColumn("label", mean)
    spread = F.aggregate(F.transform(c, lambda x, i: x * (i + low - F.col("label")) * (i + low - F.col("label"))), F.lit(0.0), add)
    sd = F.when(F.col("n") > 1, F.sqrt(spread / F.nullif(F.col("n") - 1, F.lit(0)))).otherwise(0.0)
    return out.withColumn("sd", sd).withColumn("se", F.col("sd") / F.sqrt(F.nullif(F.col("n"), F.lit(0)).cast("double")))


def histogram(ratings: DataFrame, spec: ItemSpec) -> DataFrame:
    """item, counts: one entry for each bin of the scale."""
    low = int(spec.score_range[0])
    return ratings.groupBy("item").agg(F.array(*[F.count(F.when(F.col("score") == low + k, 1)) for k in range(spec.n_bins)]).alias("counts"))


def build_items(table: DataFrame, spec: ItemSpec) -> DataFrame:
    """item, label, carried metadata that exists; a missing or non-finite label is an error, a missing id is made."""
    table = identified(table, "item", spec.item)
    if spec.label not in table.columns:
        raise ValueError(f"no column {spec.label!r}; available: {', '.join(sorted(table.columns))}")
    if bad := table.where(not_finite(spec.label)).count():
        raise ValueError(f"{bad} labels in {spec.label!r} are not finite")
    carried = [c for c in spec.metadata if c in table.columns]
    optional = [c for c in (spec.histogram, spec.ratings, spec.landmarks) if c and c in table.columns]
    return table.select(F.col(spec.item).alias("item"), F.col(spec.label).cast("double").alias("label"), *optional, *carried)


#: Files up to which their offsets are a broadcast, some 200 bytes each.
FILES_AT_HAND = 100_000


def identified(table: DataFrame, prefix: str, column: str = "item") -> DataFrame:
    """A table of files with an id for each row, ``prefix_0`` and on: by the files' names, then by the place in the file.

    Places are the reader's own, so a row has the same id on every read, however the
    files are split, and no row is shuffled: only the files' counts are added up. A
    table that has the column keeps it.
    """
    if column in table.columns:
        return table
    files = table.inputFiles()
    if not files:
        raise ValueError(f"no column {column!r}, and the table is not read from files whose order could give ids")
    placed = table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = placed.groupBy("__file").agg(F.count("*").alias("__n"))
    # one row for each file
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    starts = F.broadcast(starts) if len(files) <= FILES_AT_HAND else starts
    ids = F.concat(F.lit(prefix + "_"), (F.col("__start") + F.col("__at")).cast("string"))
    return placed.join(starts, "__file").withColumn(column, ids).drop("__file", "__at", "__start")


def check_capabilities(items: DataFrame, required: tuple[str, ...], spec: ItemSpec) -> None:
    """Refuse, with the missing column's name, what the data cannot support."""
    of = {"distributions": spec.histogram, "ratings": spec.ratings, "landmarks": spec.landmarks}
    for need in required:
        columns = spec.metadata if need == "attributes" else (of[need],)
        if not any(c and c in items.columns for c in columns):
            raise ValueError(f"needs {need}: column {' or '.join(map(str, columns))} is missing")


def union_splits(splits: list[DataFrame]) -> DataFrame:
    """The rows of several splits as one table, before folds are dealt; columns go by name, a missing one is null."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def fold_count(items: DataFrame, fold: str = "fold") -> int:
    """How many folds there are, the greatest number and one; a number that is null or below 0 is an error."""
    n, low, missing = items.agg(F.max(fold) + 1, F.min(fold), F.sum(F.col(fold).isNull().cast("int"))).first()
    if n is None or missing or low < 0:
        raise ValueError(f"{fold!r} must hold a number from 0 for every item")
    return int(n)


def cv_roles(items: DataFrame, n: int | None = None, fold: str = "fold") -> DataFrame:
    """Every item once for each k: fold k is test, k + 1 (mod n) validation, the rest training.

    A generator, not a join: n copies of the narrow row, where the row is. Without
    ``n`` the folds are counted; with it, a fold outside of 0 to n - 1 is an error
    where its row is read.
    """
    n = fold_count(items, fold) if n is None else n
    if n < 3:
        raise ValueError("cross-validation needs three folds at least")
    at = F.col(fold)
    at = F.when((at >= 0) & (at < n), at).otherwise(F.raise_error(F.concat(F.lit(f"fold must be in 0..{n - 1}, got "), F.coalesce(at.cast("string"), F.lit("null")))).cast("int"))
    k = F.explode(F.array(*[F.lit(i) for i in range(n)])).alias("k")
    role = F.when(at == F.col("k"), "test").when(F.col(fold) == (F.col("k") + 1) % n, "val").otherwise("train")
    return items.select("*", k).withColumn("role", role)


def with_landmarks(items: DataFrame, landmarks: list[DataFrame], column: str = "landmarks") -> DataFrame:
    """Items with their landmarks, pooled from several tables of (item, landmarks); null for items that have none.

    Of tables that both have an item the later one's landmarks stay; where one table
    has an item twice, the greater ones do, so that they do not depend on the order
    of its rows.
    """
    parts = [t.where(F.col(column).isNotNull()).select("item", F.lit(i).alias("__order"), column) for i, t in enumerate(landmarks)]
    pooled = reduce(DataFrame.unionByName, parts)
    one = pooled.groupBy("item").agg(F.max(F.struct("__order", column))[column].alias(column))
    return items.drop(column).join(one, "item", "left")


def holdout_roles(items: DataFrame, split: str, names: tuple[str, str, str]) -> DataFrame:
    role = F.lit(None).cast("string")
    for name, value in zip(("train", "val", "test"), names):
        role = F.when(F.col(split) == value, name).otherwise(role)
    return items.withColumn("role", role).where("role is not null")


def split_sizes(roles: DataFrame, *by: str) -> DataFrame:
    return roles.groupBy(*by, "role").agg(F.count("*").alias("n"))


def broken_groups(roles: DataFrame, group: str) -> DataFrame:
    """Groups whose items are in more than one role; must be empty for a sound split."""
    return roles.groupBy(group).agg(F.countDistinct("role").alias("n_roles")).where("n_roles > 1")


def permuted_labels(items: DataFrame, seed: str) -> DataFrame:
    """item, label, shuffled: labels dealt to other items by the order of a seeded hash."""
    h = F.md5(F.concat(F.lit(seed + "|"), F.col("item").cast("string")))
    by_item = row_index(items.select("item", "label"), ["item"], "at")
    by_hash = row_index(items.select("item", F.col("label").alias("shuffled"), h.alias("h")), ["h", "item"], "at")
    return by_item.join(by_hash.select("shuffled", "at"), "at").select("item", "label", "shuffled")


def attribute_codes(items: DataFrame, columns: list[str], cap: int) -> DataFrame:
    """key, code: by first appearance among the training items, later than ``cap`` or unseen is 0.

    The lookup is made from training rows only. Only the first ``cap`` keys have
    a number, so only they are put in order.
    """
    key = F.concat_ws("/", *columns).alias("key")
    seen = items.select(key, "item").groupBy("key").agg(F.min("item").alias("first"))
    numbered = seen.orderBy("first").limit(cap).withColumn("code", F.row_number().over(Window.orderBy("first")) - 1)
    return seen.select("key").join(F.broadcast(numbered.select("key", "code")), "key", "left").withColumn("code", F.coalesce("code", F.lit(0)))


def encoded(items: DataFrame, codes: DataFrame, columns: list[str], out: str = "code") -> DataFrame:
    """Items with the code of their attributes; what the training items did not show is 0."""
    df = items.withColumn("key", F.concat_ws("/", *columns))
    return df.join(codes.withColumnRenamed("code", out), "key", "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("key")
