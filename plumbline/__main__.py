"""Command line: ``python -m plumbline list | run | predict | subgroups | report``.

list [--era ERA] [--markdown]
run --items FILE [FILE ...] (--method NAME ... | --era ERA | --all) [--protocol roles|holdout|cv] [--fold K] [--landmarks FILE ...]
    [--label COLUMN] [--spec FILE] [--seed N] [--epochs N] [--skip-slow] [--keep-going] [--out FOLDER] [--models FOLDER]
predict --models FOLDER --method NAME --items FILE [FILE ...] --out FOLDER [--spec FILE] [--label COLUMN]
subgroups FOLDER --items FILE [FILE ...] --method NAME --by COLUMN [COLUMN ...] [--spec FILE] [--label COLUMN] [--resamples N] [--seed N]
report FOLDER [--brief] [--check FILE | --update FILE] [--full FILE] [--methods FILE]

``run --out`` leaves results as JSON files and predictions as a store in FOLDER/predictions, which
``subgroups`` reads: those of all folds, and those of the holdout if there are any. With ``--check``
or ``--update``, ``--full`` and ``--methods`` name further files: one for the whole report where the
first has only the brief one, one for the list of methods.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

#: What a file holds that ``report --update`` keeps up to date.
MARKS = ("<!-- plumbline report -->", "<!-- end of plumbline report -->")


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline", description="Evaluate predictors of rated items.")
    commands = parser.add_subparsers(dest="command", required=True)
    listing = commands.add_parser("list")
    listing.add_argument("--era")
    listing.add_argument("--markdown", action="store_true")
    run = commands.add_parser("run")
    run.add_argument("--items", required=True, nargs="+", help="Parquet tables; several are splits of one set")
    run.add_argument("--landmarks", nargs="+", help="Parquet tables of item and landmarks; a later one wins")
    which = run.add_mutually_exclusive_group(required=True)
    which.add_argument("--method", nargs="+")
    which.add_argument("--era")
    which.add_argument("--all", action="store_true")
    run.add_argument("--protocol", choices=("roles", "holdout", "cv"), default="roles", help="a column role, a column split, or folds")
    run.add_argument("--fold", type=int)
    run.add_argument("--seed", type=int, default=0, help="of what methods draw, and of the leak check")
    run.add_argument("--epochs", type=int, help="in place of the schedules' own")
    run.add_argument("--skip-slow", action="store_true", help="leave out methods that train a network")
    run.add_argument("--keep-going", action="store_true")
    run.add_argument("--out")
    run.add_argument("--models", help="a folder for the fitted methods")
    predict = commands.add_parser("predict")
    predict.add_argument("--models", required=True)
    predict.add_argument("--method", required=True)
    predict.add_argument("--items", required=True, nargs="+")
    predict.add_argument("--landmarks", nargs="+")
    predict.add_argument("--out", required=True)
    groups = commands.add_parser("subgroups")
    groups.add_argument("folder")
    groups.add_argument("--items", required=True, nargs="+")
    groups.add_argument("--method", required=True)
    groups.add_argument("--by", required=True, nargs="+")
    groups.add_argument("--resamples", type=int, default=10_000)
    groups.add_argument("--seed", type=int, default=0)
    for command in (run, predict, groups):
        command.add_argument("--label")
        command.add_argument("--spec")
    report = commands.add_parser("report")
    report.add_argument("folder")
    report.add_argument("--brief", action="store_true")
    act = report.add_mutually_exclusive_group()
    act.add_argument("--check")
    act.add_argument("--update")
    report.add_argument("--full")
    report.add_argument("--methods")
    return parser


def _tables(spark, given, spec):
    """The given tables as one, with ids where they have none and the landmarks of further tables."""
    import os

    from plumbline.operators import protocol as R

    each = [R.identified(spark.read.parquet(p), os.path.splitext(os.path.basename(p.rstrip("/")))[0], spec.item) for p in given.items]
    table = R.union_splits(each)
    if getattr(given, "landmarks", None):
        found = [t.select(t[spec.item].alias("item"), t[spec.landmarks].alias("landmarks")) for t in map(spark.read.parquet, given.landmarks)]
        table = R.with_landmarks(table.withColumnRenamed(spec.item, "item").drop(spec.landmarks), found)
        table = table.withColumnRenamed("item", spec.item).withColumnRenamed("landmarks", spec.landmarks)
    return table


def _items(table, spec, *more):
    """The items of a table, with ``more`` columns where it has them."""
    from plumbline.operators import protocol as R

    kept = [c for c in more if c in table.columns and c not in spec.metadata]
    return R.build_items(table, dataclasses.replace(spec, metadata=(*spec.metadata, *kept)))


def _roles(spark, given, spec):
    """The items of a protocol with their roles, from tables that may be splits."""
    from pyspark.sql import functions as F

    from plumbline.operators import protocol as R

    table = _tables(spark, given, spec)
    if given.protocol == "roles":
        return table.withColumnRenamed(spec.item, "item").withColumn("label", F.col(spec.label).cast("double"))
    items = _items(table, spec, "split" if given.protocol == "holdout" else spec.fold, "features", "features_flipped")
    if given.protocol == "holdout":
        return R.holdout_roles(items, "split", spec.splits)
    n = R.fold_count(items, spec.fold)
    if given.fold is None or not 0 <= given.fold < n:
        raise ValueError(f"--fold must be in 0..{n - 1}, got {given.fold}")
    return R.cv_roles(items, n, spec.fold).where(F.col("k") == given.fold).drop("k")


def main(args: list[str] | None = None) -> int:
    given = _arguments().parse_args(args)

    from plumbline.operators import methods
    from plumbline.operators import report as T

    if given.command == "list":
        known = methods.entries(given.era)
        print(T.methods_text(known) if given.markdown else "\n".join(f"{e.era:10} {e.name:16} {', '.join(e.requires)}" for e in known))
        return 0

    from pyspark.sql import SparkSession

    from plumbline.plans.catalogue import era_order
    from plumbline.sources import results
    from plumbline.sources.spec import ItemSpec

    spark = SparkSession.builder.getOrCreate()
    if given.command != "report":
        spec = ItemSpec.from_yaml(given.spec) if given.spec else ItemSpec()
        spec = dataclasses.replace(spec, label=given.label) if given.label else spec
    if given.command == "predict":
        from plumbline.sources import models

        rows = _tables(spark, given, spec).withColumnRenamed(spec.item, "item")
        results.write_predictions(models.load_model(spark, given.method, spec, given.models).predict(rows), given.out)
        return 0
    if given.command == "subgroups":
        print(_subgroups(spark, given, spec))
        return 0
    if given.command == "run":
        names = given.method or [e.name for e in methods.entries(given.era) if not (given.skip_slow and e.trainable)]
        fold = given.fold if given.protocol == "cv" else None

        def keep(name, method, predictions):
            if given.out:
                results.store_predictions(predictions, f"{given.out}/predictions", protocol=given.protocol, method=name, fold=fold)
            if given.models:
                from plumbline.sources import models

                models.save_model(spark, name, method, spec, given.models if fold is None else f"{given.models}/fold{fold}")

        options = {n: {"epochs": given.epochs} for n in names if given.epochs and n in methods.schedule_names()}
        done, failed = methods.sweep(names, _roles(spark, given, spec), spec, seed=given.seed, options=options, keep=keep)
        facts = {"protocol": given.protocol, "fold": given.fold, "seed": given.seed, "label": spec.label, "score_range": list(spec.score_range), "dataset": ", ".join(given.items)}
        for r in done:
            print(json.dumps(r))
            if given.out:
                folder = f"{given.out}/cv/fold{given.fold}" if given.protocol == "cv" else given.out
                results.save_run(r | facts | {"environment": results.environment(spark)}, folder)
        for name, why in failed.items():
            print(f"{name}: {why}", file=sys.stderr)
        return int(bool(failed) and not given.keep_going)
    runs, folds, eras = results.read_runs(spark, given.folder), results.read_folds(spark, f"{given.folder}/cv"), era_order(spark)
    texts = {given.check or given.update: T.report_text(runs, folds, eras, brief=given.brief)}
    if given.full:
        texts[given.full] = T.report_text(runs, folds, eras)
    if given.methods:
        texts[given.methods] = T.methods_text(methods.entries())
    if given.check:
        stale = T.stale_files(texts)
        for path in stale:
            print(f"{path} is stale: bring it up to date with --update", file=sys.stderr)
        return int(bool(stale))
    if given.update:
        for path, text in texts.items():
            T.update_file(path, *MARKS, text)
        return 0
    print("\n\n".join(texts.values()))
    return 0


def _subgroups(spark, given, spec) -> str:
    """The tables of a method's groups, over the pooled predictions of all folds and over the holdout's."""
    from pyspark.sql import functions as F

    from plumbline.operators import protocol as R
    from plumbline.operators import report as T
    from plumbline.sources import results

    items = _items(_tables(spark, given, spec), spec, "split", spec.fold, *given.by)
    store, parts = f"{given.folder}/predictions", []
    protocols = results.stored_protocols(spark, store, given.method)
    if "cv" in protocols:
        pooled = results.stored_predictions(spark, store, items, protocol="cv", method=given.method, fold=spec.fold)
        parts.append(T.subgroups_text(pooled, given.by, resamples=given.resamples, seed=given.seed))
    if "holdout" in protocols:
        test = R.holdout_roles(items, "split", spec.splits).where(F.col("role") == "test")
        parts.append(T.small_groups_text(results.stored_predictions(spark, store, test, protocol="holdout", method=given.method), given.by))
    if not parts:
        raise ValueError(f"no predictions of {given.method} in {store}: run it with --out {given.folder}")
    return "\n\n".join(parts)


if __name__ == "__main__":
    sys.exit(main())
