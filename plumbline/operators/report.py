"""Result tables, and the text made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.stats import lower_is_better, row_index
from plumbline.operators import inference as I

POINT = ("PC", "SROCC", "MAE", "RMSE")
DISTRIBUTION = ("Chebyshev", "Clark", "Canberra", "KL", "Cosine", "Intersection")


def leaderboard(runs: DataFrame, eras: DataFrame) -> DataFrame:
    """Runs ranked by PC within their era, eras in their order; without PC last, unknown eras at the end."""
    ordered = runs.join(F.broadcast(eras), "era", "left").withColumn("era_order", F.coalesce("era_order", F.lit(99)))
    return ordered.withColumn("rank", F.row_number().over(Window.partitionBy("era").orderBy(F.col("PC").desc_nulls_last(), "method")))


def fold_summary(runs: DataFrame) -> DataFrame:
    """method, folds, mean and population deviation over folds of each point metric."""
    out = [F.count("*").alias("folds")]
    for m in POINT:
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_sd")]
    return runs.groupBy("method").agg(*out)


def chart_data(holdout: DataFrame, summary: DataFrame) -> DataFrame:
    """method, PC, sd, protocol: cross-validation where there is one, else holdout."""
    cv = summary.select("method", F.col("PC_mean").alias("cv"), F.col("PC_sd").alias("sd"))
    both = holdout.where("PC is not null").select("method", "PC").join(cv, "method", "left")
    return both.select("method", F.coalesce("cv", "PC").alias("PC"), F.coalesce("sd", F.lit(0.0)).alias("sd"), F.when(F.col("cv").isNotNull(), "cv").otherwise("holdout").alias("protocol"))


def shown(x: Column | str, places: int = 4) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull(), "--").otherwise(F.format_string(f"%.{places}f", x))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n over ``bins`` equal widths from the least to the greatest value."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return df.join(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of rows that are already few: a report's."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows])


def leaderboard_text(runs: DataFrame, eras: DataFrame) -> str:
    """The ranked table; with a column of seconds where runs have them."""
    timed = "seconds" in runs.columns
    cells = [shown(m).alias(m) for m in POINT] + ([shown("seconds", 1).alias("seconds")] if timed else [])
    table = leaderboard(runs, eras).orderBy("era_order", "era", "rank").select("method", "era", *cells)
    return markdown([r.asDict() for r in table.collect()], table.columns)


def fold_summary_text(runs: DataFrame) -> str:
    cells = [F.when(F.col(f"{m}_mean").isNull(), "--").otherwise(F.concat(shown(f"{m}_mean"), F.lit(" ± "), shown(f"{m}_sd"))).alias(m) for m in POINT]
    table = fold_summary(runs).orderBy(F.coalesce("PC_mean", F.lit(0.0)).desc(), "method").select("method", *cells)
    return markdown([r.asDict() for r in table.collect()], ["method", *POINT])


def provenance(runs: DataFrame) -> DataFrame:
    """The configurations that runs come from, and how many from each: never just the first run's."""
    return runs.groupBy("dataset", "config", "label", "protocol", F.col("environment.git_commit").alias("git_commit")).agg(F.count("*").alias("runs"), F.sort_array(F.collect_set("method")).alias("methods"))


def provenance_text(runs: DataFrame) -> str:
    """One line for each configuration."""
    known = lambda v: "unknown" if v is None else v
    rows = provenance(runs).orderBy(F.desc("runs"), "dataset", "config", "label", "protocol", "git_commit").collect()
    return "\n".join(f"- {r['runs']} runs on {known(r['dataset'])}, configuration {known(r['config'])}, label {known(r['label'])}, {known(r['protocol'])}, at commit {str(known(r['git_commit']))[:12]}" for r in rows)


def _flat(runs: DataFrame, *more: str) -> DataFrame:
    return runs.select("method", "era", *more, *[F.col(f"metrics.{m}").alias(m) for m in POINT])


def report_text(runs: DataFrame, folds: DataFrame, eras: DataFrame, *, brief: bool = False) -> str:
    """The report's sections: where runs come from and their ranking, then cross-validation if there are folds; ``brief``: the latter alone."""
    parts = []
    if not brief:
        parts += ["## Holdout", provenance_text(runs) or "No runs.", leaderboard_text(_flat(runs, "seconds"), eras)]
    n = folds.groupBy("method").count().agg(F.max("count")).first()[0]
    if n:
        parts += [f"## Cross-validation, {n} folds", fold_summary_text(_flat(folds))]
    elif brief:
        parts.append("No cross-validation results.")
    return "\n\n".join(parts)


def methods_text(entries) -> str:
    """The registered methods, a table for each era, with a link to what describes them."""
    parts, eras = [], dict.fromkeys(e.era for e in entries)
    for era in eras:
        rows = [{"method": e.name, "source": (f"[{e.reference}]({e.paper})" if e.paper else e.reference) or "--", "needs": ", ".join(e.requires) or "--", "notes": e.notes or "--"} for e in entries if e.era == era]
        parts += [f"## {era}", markdown(rows, ["method", "source", "needs", "notes"])]
    return "\n\n".join(parts)


def replace_block(text: str, start: str, end: str, body: str) -> str:
    """The text with new lines between the first ``start`` and the first ``end`` after it."""
    opened = text.find(start)
    inside = opened + len(start)
    closed = text.find(end, inside) if opened >= 0 else -1
    if closed < 0:
        raise ValueError(f"no block from {start} to {end}")
    return "\n".join([text[:inside], "", body.strip("\n"), text[closed:]])


def update_file(path: str, start: str, end: str, body: str) -> bool:
    """Bring a file's block up to date; whether that changed the file."""
    with open(path, encoding="utf-8") as f:
        old = f.read()
    new = replace_block(old, start, end, body)
    if new != old:
        with open(path, "w", encoding="utf-8") as f:
            f.write(new)
    return new != old


def is_stale(text: str, body: str) -> bool:
    return body not in text


def stale_files(texts: dict[str, str]) -> list[str]:
    """The files that do not hold their text, or are not there."""
    stale = []
    for path, body in texts.items():
        try:
            with open(path, encoding="utf-8") as f:
                if is_stale(f.read(), body):
                    stale.append(path)
        except FileNotFoundError:
            stale.append(path)
    return stale


def best_by_metric(runs: DataFrame) -> DataFrame:
    """metric, lower_is_better, method, value: the best run by each metric's own direction; ties by name."""
    known = [m for m in (*POINT, *DISTRIBUTION) if m in runs.columns]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(lower_is_better(m)).alias("lower_is_better"), F.col(m).alias("value")) for m in known])).alias("x")
    long = runs.select("method", each).select("method", "x.*").where("value is not null")
    key = F.struct(F.when(F.col("lower_is_better"), F.col("value")).otherwise(-F.col("value")).alias("k"), "method", "value")
    return long.groupBy("metric", "lower_is_better").agg(F.min(key).alias("m")).select("metric", "lower_is_better", "m.method", "m.value")


def subgroups_text(scored: DataFrame, by: list[str], *, resamples: int, seed: int) -> str:
    """Each grouping's table with intervals, and the gap between its best and worst group; ``scored`` has item, label, score."""
    rows = scored.select("item", F.col("label").alias("y"), F.col("score").alias("p"), *by).persist()
    parts = [f"## Out of fold, {rows.count()} items"]
    try:
        for column in by:
            named = rows.where(F.col(column).isNotNull())
            table = I.subgroup_table(named, column, resamples=resamples, seed=f"{seed}|{column}").orderBy("place")
            cells = [F.col("group"), F.col("n")] + [x for m in ("PC", "MAE") for x in (shown(m).alias(m), F.concat_ws(" to ", shown(f"{m}_lo"), shown(f"{m}_hi")).alias(f"{m} interval"))] + [shown("RMSE").alias("RMSE")]
            shown_rows = [r.asDict() for r in table.select(*cells).collect()]  # a row for each group
            parts += [f"### {column}", markdown(shown_rows, list(shown_rows[0]))]
            ends = {r["metric"]: r for r in I.extremes(I.subgroup_metrics(named, column)).collect()}  # three rows
            numbered = row_index(named.select(F.col(column).alias("group"), "item", "y", "p"), ["item"], "at", ("group",))
            drawn = I.group_resamples(numbered.select("group", "at", "y", "p"), resamples=resamples, seed=f"{seed}|gap|{column}")
            for metric in ("PC", "MAE"):
                best, worst = ends[metric]["best"], ends[metric]["worst"]
                if best == worst:
                    continue
                two = {r["group"]: r[metric] for r in I.subgroup_metrics(named.where(F.col(column).isin(best, worst)), column).collect()}
                gap = I.subgroup_gap(drawn.where(F.col("group").isin(best, worst)), best, worst, metric).first()
                verdict = "excludes zero" if gap["excludes_zero"] else "includes zero"
                parts.append(f"- largest gap of {metric}: {best} less {worst} is {two[best] - two[worst]:+.4f}, interval {gap['lo']:+.4f} to {gap['hi']:+.4f}, which {verdict}")
    finally:
        rows.unpersist()
    return "\n\n".join(parts)


def small_groups_text(scored: DataFrame, by: list[str], least: int = 3) -> str:
    """Point metrics of the groups of a held-out split that have so many items at least, and of all."""
    rows = scored.select("item", F.col("label").alias("y"), F.col("score").alias("p"), *by)
    cells = ["group", "n", *[shown(m).alias(m) for m in ("PC", "MAE", "RMSE")]]
    parts = [f"## Held out, {rows.count()} items"]
    for column in by:
        table = I.subgroup_metrics(rows, column, least=least).where("group is not null").orderBy("group").unionByName(I.subgroup_metrics(rows.withColumn("__all", F.lit("all")), "__all"))
        parts += [f"### {column}", markdown([r.asDict() for r in table.select(*cells).collect()], ["group", "n", "PC", "MAE", "RMSE"])]
    return "\n\n".join(parts)
