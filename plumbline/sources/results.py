"""Result files in and out: JSON scans, prediction tables, provenance."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from datetime import UTC, datetime
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession, functions as F

METRICS = ("PC", "SROCC", "MAE", "RMSE", "n", "Chebyshev", "Clark", "Canberra", "KL", "Cosine", "Intersection")
_SCHEMA = (
    "method string, era string, metrics struct<" + ", ".join(f"{m}: {'bigint' if m == 'n' else 'double'}" for m in METRICS) + ">, seconds double, dataset string, config string,"
    " label string, protocol string, fold int, seed int, score_range array<double>, sizes struct<train: bigint, val: bigint, test: bigint>,"
    " environment struct<timestamp: string, git_commit: string, git_tree_dirty: boolean, reproducible_from_commit: boolean, python: string, platform: string, device: string>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) is not None and len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)) > 0


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The result objects of a folder; other JSON is skipped, a missing folder is empty."""
    if not _exists(spark, f"{folder}/*.json"):
        return spark.createDataFrame([], _SCHEMA)
    runs = spark.read.schema(_SCHEMA).option("multiLine", True).json(f"{folder}/*.json")
    return runs.where("metrics is not null and method is not null").withColumn("era", F.coalesce("era", F.lit("unknown")))


def read_folds(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of ``fold*/`` folders, with the folder's number as ``fold``."""
    if not _exists(spark, f"{folder}/fold*/*.json"):
        return spark.createDataFrame([], _SCHEMA)
    runs = spark.read.schema(_SCHEMA).option("multiLine", True).json(f"{folder}/fold*/*.json")
    runs = runs.withColumn("fold", F.regexp_extract(F.col("_metadata.file_path"), r"fold(\d+)/[^/]*$", 1).cast("int"))
    return runs.where("metrics is not null and method is not null")


def save_run(result: dict, folder: str) -> str:
    """One run as a JSON file named after its method; its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{result['method']}.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(result, f, indent=1)
    return path


def _finite_scores(predictions: DataFrame) -> DataFrame:
    bad = F.isnull("score") | F.isnan("score") | (F.abs("score") == float("inf"))
    return predictions.withColumn("score", F.when(bad, F.raise_error(F.lit("a prediction is not finite")).cast("double")).otherwise(F.col("score")))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions keyed by item; a score that is null or not finite is an error."""
    _finite_scores(predictions).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str, items: DataFrame) -> DataFrame:
    """Predictions joined to their items by key; files that lack an item, have another or repeat one are stale, which is an error."""
    found = spark.read.parquet(path)
    _check_fresh(found, items, path)
    return items.join(found, "item")


def _check_fresh(found: DataFrame, items: DataFrame, where: str, *by: str) -> None:
    """One pass over the keys of both sides: every item has one prediction (in its own part, of ``by``) and there are no others."""
    keys = ["item", *by]
    both = found.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("i")).unionByName(items.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("i")))
    each = both.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("i").alias("i"))
    # a row of null keys is no one's
    repeated, surplus, missing = each.agg(F.count_if(F.col("p") > 1), F.count_if(F.col("i") == 0), F.count_if(F.col("p") == 0)).first()
    for n, what in ((repeated, "items have several predictions"), (surplus, "predictions are of other items"), (missing, "items have no prediction")):
        if n:
            raise ValueError(f"{n} {what} in {where}: it is stale")


#: The fold of predictions that belong to none.
NO_FOLD = -1


def store_predictions(predictions: DataFrame, folder: str, *, protocol: str, method: str, fold: int | None = None) -> None:
    """Put a run's predictions into the store, in place of an earlier run's of the same protocol, fold and method; others stay."""
    more = {"distribution": "array<double>", "uncertainty": "double"}
    columns = [F.col(c) if c in predictions.columns else F.lit(None).cast(t).alias(c) for c, t in more.items()]
    parts = [F.lit(protocol).alias("protocol"), F.lit(NO_FOLD if fold is None else fold).alias("fold"), F.lit(method).alias("method")]
    rows = _finite_scores(predictions).select("item", "score", *columns, *parts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("protocol", "fold", "method").parquet(folder)


def stored_protocols(spark: SparkSession, folder: str, method: str) -> set[str]:
    """The protocols of which the store has predictions of a method."""
    if not _exists(spark, folder):
        return set()
    return {r[0] for r in spark.read.parquet(folder).where(F.col("method") == method).select("protocol").distinct().collect()}


def stored_predictions(spark: SparkSession, folder: str, items: DataFrame, *, protocol: str, method: str, fold: str | None = None) -> DataFrame:
    """A method's stored predictions with their items' columns; only its own parts are read.

    With ``fold``, a column of the items, the predictions of all folds are pooled,
    each item's from the fold in which it was tested. Parts that do not fit the items
    are an error.
    """
    if not _exists(spark, folder):
        raise ValueError(f"no predictions in {folder}")
    found = spark.read.parquet(folder).where((F.col("protocol") == protocol) & (F.col("method") == method))
    where = f"{folder}, {protocol}, {method}"
    if fold is None:
        found = found.where(F.col("fold") == NO_FOLD).drop("protocol", "fold", "method")
        _check_fresh(found, items, where)
        return items.join(found, "item")
    found = found.where(F.col("fold") != NO_FOLD).drop("protocol", "method").withColumnRenamed("fold", "__fold")
    _check_fresh(found, items.withColumn("__fold", F.col(fold).cast("int")), where, "__fold")
    return items.join(found.drop("__fold"), "item")


def _version(name: str) -> str | None:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return None


#: What results are made of: changes elsewhere in the tree do not make them irreproducible.
CODE = ("plumbline", "bench.py", "corpus_pipeline.py", "__spark_entry__.py")


def environment(spark: SparkSession, folder: str = ".", code: tuple[str, ...] = CODE) -> dict[str, object]:
    """Where and with what a run was made; the tree is dirty if the code has changes that are not committed."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True).stdout.strip()
        except (OSError, subprocess.CalledProcessError):
            return None

    dirty = git("status", "--porcelain", "--", *code)
    return {
        "timestamp": datetime.now(UTC).isoformat(timespec="seconds"),
        "git_commit": git("rev-parse", "HEAD"),
        "git_tree_dirty": None if dirty is None else bool(dirty),
        "reproducible_from_commit": dirty == "",
        "python": platform.python_version(),
        "platform": platform.platform(),
        "device": f"cpu, {spark.sparkContext.master}",
        "spark": spark.version,
        "packages": {name: _version(name) for name in ("pyspark", "pyarrow", "numpy", "pandas")},
        "cpus": os.cpu_count(),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
