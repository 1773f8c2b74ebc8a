"""Predictors, and the transforms of labels and features that they need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.stats import clip, row_index


def group_mean(roles: DataFrame, group: str) -> DataFrame:
    """k, group, p: the mean training label of each group in each fold."""
    return roles.where("role = 'train'").groupBy("k", group).agg(F.avg("label").alias("p"))


def mean_baseline(roles: DataFrame) -> DataFrame:
    return roles.where("role = 'train'").groupBy("k").agg(F.avg("label").alias("p"))


def class_weights(labels: DataFrame, label: str, bins: int) -> DataFrame:
    """bin, n, weight: n / count, divided by its mean over the bins in use; rounding is half to even."""
    b = clip(F.rint(label) - 1, 0, bins - 1).cast("int")
    counts = labels.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), (F.sum("n") * F.avg(1.0 / F.col("n"))).alias("mean"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("total") / F.col("n") / F.col("mean")).alias("weight"))


def precision_weights(stats: DataFrame) -> DataFrame:
    """item, weight: 1 / (population variance / n + median(se)^2), divided by the mean."""
    var = F.col("sd") * F.col("sd") * (F.col("n") - 1) / F.col("n")
    floor = stats.agg(F.percentile("se", F.lit(0.5)).alias("m"))
    raw = stats.join(F.broadcast(floor)).select("item", (1.0 / (var / F.col("n") + F.col("m") * F.col("m"))).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("item", (F.col("raw") / F.col("mean")).alias("weight"))


def rater_effects(ratings: DataFrame, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rater, n, offset) and (item, quality) of score = quality + offset, by alternating means.

    The least-squares form of the additive fit; offsets are recentred so that
    their count-weighted mean is 0. Ratings are first summed by (item, rater):
    each pass then joins sums, not ratings.
    """
    pairs = ratings.groupBy("item", "rater").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
    offsets = None
    for _ in range(passes):
        if offsets is None:
            quality = pairs.groupBy("item").agg((F.sum("s") / F.sum("c")).alias("quality"))
        else:
            quality = pairs.join(offsets, "rater").groupBy("item").agg((F.sum(F.col("s") - F.col("c") * F.col("offset")) / F.sum("c")).alias("quality"))
        raw = pairs.join(quality, "item").groupBy("rater").agg((F.sum(F.col("s") - F.col("c") * F.col("quality")) / F.sum("c")).alias("raw"), F.sum("c").alias("n"))
        centre = raw.agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("centre"))
        offsets = raw.join(F.broadcast(centre)).select("rater", "n", (F.col("raw") - F.col("centre")).alias("offset"))
    quality = pairs.join(offsets, "rater").groupBy("item").agg((F.sum(F.col("s") - F.col("c") * F.col("offset")) / F.sum("c")).alias("quality"))
    return offsets, quality


def margin_ranking(items: DataFrame, batch: str, *, gap: float = 0.1, margin: float = 0.1) -> DataFrame:
    """batch, pairs, loss over the pairs of a batch whose labels are more than ``gap`` apart.

    Pairs stay within their batch, whose size is the caller's parameter.
    """
    a = items.select(F.col(batch).alias("batch"), F.col("item").alias("i"), F.col("p").alias("pi"), F.col("y").alias("yi"))
    b = items.select(F.col(batch).alias("batch"), F.col("item").alias("j"), F.col("p").alias("pj"), F.col("y").alias("yj"))
    pairs = a.join(b, "batch").where((F.col("i") < F.col("j")) & (F.abs(F.col("yi") - F.col("yj")) > gap))
    loss = F.greatest(F.lit(0.0), -F.signum(F.col("yi") - F.col("yj")) * (F.col("pi") - F.col("pj")) + margin)
    return pairs.groupBy("batch").agg(F.count("*").alias("pairs"), F.avg(loss).alias("loss"))


def points(flat: Column | str, n: int) -> Column:
    """An array of (x, y) from 2n numbers in a row."""
    c = F.col(flat) if isinstance(flat, str) else flat
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.get(c, 2 * i).cast("double").alias("x"), F.get(c, 2 * i + 1).cast("double").alias("y")))


def _d(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def normalised_points(p: str, left: list[int], right: list[int]) -> Column:
    """Centred on the mean point and divided by the distance of two eye centres.

    Where that is below 1e-6, by the standard deviation of all coordinates, or 1.
    """
    c = F.col(p)
    n = F.size(c)
    mean = lambda k, ids: sum((c[i][k] for i in ids[1:]), c[ids[0]][k]) / len(ids)
    total = lambda k: F.aggregate(F.transform(c, lambda q: q[k]), F.lit(0.0), lambda s, v: s + v)
    mx, my = total("x") / n, total("y") / n
    m = (mx + my) / 2
    eyes = _d(F.struct(mean("x", left).alias("x"), mean("y", left).alias("y")), F.struct(mean("x", right).alias("x"), mean("y", right).alias("y")))
    spread = F.sqrt(F.aggregate(F.transform(c, lambda q: (q["x"] - m) * (q["x"] - m) + (q["y"] - m) * (q["y"] - m)), F.lit(0.0), lambda s, v: s + v) / (2 * n))
    scale = F.when(eyes >= 1e-6, eyes).when(spread >= 1e-6, spread).otherwise(1.0)
    return F.transform(c, lambda q: F.struct(((q["x"] - mx) / scale).alias("x"), ((q["y"] - my) / scale).alias("y")))


def pair_distances(p: str, keys: list[int]) -> Column:
    """The distance of every two of the key points; the pairs are a literal, so the plan is the same for any number."""
    c = F.col(p)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for a, i in enumerate(keys) for j in keys[a + 1 :]])
    return F.transform(pairs, lambda q: _d(F.get(c, q["i"]), F.get(c, q["j"])))


def symmetry(p: str, mirrored: list[tuple[int, int]], midline: list[int]) -> Column:
    """How far each mirrored pair is from being at equal distances from the midline."""
    c = F.col(p)
    mid = sum((c[i]["x"] for i in midline[1:]), c[midline[0]]["x"]) / len(midline)
    return F.array(*[F.abs(F.abs(c[i]["x"] - mid) - F.abs(c[j]["x"] - mid)) for i, j in mirrored])


def proportions(distances: str, references: int) -> Column:
    """Every distance over each of the first ``references`` distances taken at even strides."""
    d = F.col(distances)
    stride = F.greatest(F.lit(1), F.floor(F.size(d) / references).cast("int"))
    refs = F.slice(F.filter(d, lambda x, i: i % stride == 0), 1, references)
    return F.flatten(F.transform(d, lambda x: F.transform(refs, lambda r: x / (r + 1e-8))))


def long_features(df: DataFrame, item: str, features: str) -> DataFrame:
    return df.select(F.col(item).alias("item"), F.posexplode(features).alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def scales(train: DataFrame) -> DataFrame:
    """feature, mean, sd (population; below 1e-8 it counts as 1) from long features."""
    s = F.stddev_pop("value")
    return train.groupBy("feature").agg(F.avg("value").alias("mean"), F.when(s < 1e-8, 1.0).otherwise(s).alias("sd"))


def standardised(long: DataFrame, scale: DataFrame) -> DataFrame:
    return long.join(scale, "feature").select("item", "feature", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))


def select_features(long: DataFrame, labels: DataFrame, top: int) -> DataFrame:
    """feature, r, rank of the ``top`` features by |correlation| with the label; ties by feature."""
    r = long.join(labels, "item").groupBy("feature").agg(F.round(F.coalesce(F.covar_pop("value", "label") / F.nullif(F.stddev_pop("value") * F.stddev_pop("label"), F.lit(0.0)), F.lit(0.0)), 9).alias("r"))
    return r.orderBy(F.abs("r").desc(), "feature").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.abs("r").desc(), "feature")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


#: Rows of a cell on average, and the most cells; rows of either side that meet in one task.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 500, 256, 8_192


def _nearest_cell(pivots: np.ndarray):
    """The nearest pivot of a feature column's rows, and the distance."""

    @F.pandas_udf("cell int, d double")
    def assign(features):
        import pandas as pd

        x = np.array(features.tolist(), float).reshape(len(features), pivots.shape[1])
        d = _distances(x, pivots)
        cell = d.argmin(1) if len(x) else np.empty(0, int)
        return pd.DataFrame({"cell": cell.astype("int32"), "d": d[np.arange(len(x)), cell]})

    return assign


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of a to every row of b, from differences: equal rows are at 0 exactly."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _k_nearest(x: np.ndarray, rows: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of rows, distance to 9 places) of the k nearest of each row of x, ties by ``place``.

    Squared distances from one matrix product, each off by ``slack`` at most, say which rows can be among
    the k nearest; the distances of these alone are taken from differences.
    """
    centre = rows.mean(0)
    a, b = x - centre, rows - centre
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    about = aa[:, None] + bb - 2 * (a @ b.T)
    if len(rows) > k:
        top = np.partition(about, k - 1)[:, k - 1]
        slack = 1e-12 * (aa + bb.max() + 1) + 4e-9 * np.sqrt(np.maximum(top, 0) + 1e-9)
        i, j = np.nonzero(~(about > (top + 2 * slack)[:, None]))
    else:
        i, j = (v.ravel() for v in np.indices(about.shape))
    d = np.empty(len(i))
    for first in range(0, len(i), 1 << 16):
        e = x[i[first : first + (1 << 16)]] - rows[j[first : first + (1 << 16)]]
        d[first : first + (1 << 16)] = np.round(np.sqrt(np.einsum("ij,ij->i", e, e)), 9)
    order = np.lexsort((place[j], d, i))
    i, j, d = i[order], j[order], d[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], d[kept]


def _open_cells(pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int):
    """The cells that may hold one of the k nearest of a row: no other comes nearer than k rows surely do."""

    @F.pandas_udf("array<int>")
    def choose(features):
        import pandas as pd

        x = np.array(features.tolist(), float).reshape(len(features), pivots.shape[1])
        d, found = _distances(x, pivots), []
        for row in d:
            far = row + radii
            order = np.argsort(far)
            enough = np.flatnonzero(np.cumsum(sizes[order]) >= k)
            reach = far[order[enough[0]]] if len(enough) else np.inf
            found.append(np.flatnonzero((sizes > 0) & (row - radii <= reach + 1e-6 * (1 + row.max()))).astype("int32"))
        return pd.Series(found, dtype=object)

    return choose


def nearest(train: DataFrame, queries: DataFrame, k: int, *, cells: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """item, t, label, d, r: the k nearest training rows t of every query row, exactly, by distance (to 9 places), then by t.

    Some training rows, by the order of a hash, are pivots; a training row belongs to
    the cell of its nearest one. How far a cell's rows are from its pivot bounds the
    distance of a query to any of them from both sides, so a query visits only cells
    that may hold a neighbour. Cells and their visitors are dealt out in blocks of
    about ``block_rows`` rows; both sides meet by key, and what reaches the driver are
    the pivots, and a count and a radius of each. Each meeting leaves k rows of a query.
    """
    side = train.select(F.col("item").alias("t"), F.col("label").cast("double").alias("label"), F.transform("features", lambda v: v.cast("double")).alias("features"))
    asked = queries.select("item", F.transform("features", lambda v: v.cast("double")).alias("features"))
    n = side.count()
    if not n:
        raise ValueError("no training rows")
    most = max(1, min(MOST_CELLS, n // CELL_ROWS)) if cells is None else cells
    pivots = np.array([r[0] for r in side.select("features").distinct().orderBy(F.xxhash64("features"), "features").limit(most).collect()], float)
    placed = side.withColumn("at", _nearest_cell(pivots)("features")).select("t", "label", "features", F.col("at.cell").alias("cell"), F.col("at.d").alias("d"))
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()}
    sizes = np.array([stats[c]["n"] if c in stats else 0 for c in range(len(pivots))])
    radii = np.array([stats[c]["radius"] if c in stats else 0.0 for c in range(len(pivots))])
    visits = asked.select("item", "features", F.explode(_open_cells(pivots, sizes, radii, k)("features")).alias("cell"))
    visitors = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    blocks = lambda counts: F.array(*[F.lit(int(-(-counts.get(c, 0) // block_rows) or 1)) for c in range(len(pivots))])
    own, theirs = F.get(blocks(dict(enumerate(sizes.tolist()))), F.col("cell")), F.get(blocks(visitors), F.col("cell"))
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = visits.select("item", "features", "cell", F.pmod(F.xxhash64("item"), theirs).cast("int").alias("q")).select("*", every(own).alias("s"))
    right = placed.select("t", "label", "features", "cell", F.pmod(F.xxhash64("t"), own).cast("int").alias("s")).select("*", every(theirs).alias("q"))
    kinds = dict(asked.dtypes)["item"], dict(side.dtypes)["t"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        queries, names, labels = a.column("item").combine_chunks(), b.column("t").combine_chunks(), b.column("label").to_numpy()
        at, which, how_far = [], [], []
        if len(queries) and len(names):
            place = np.argsort(pc.sort_indices(names).to_numpy())  # the places of ids in their order, whatever their type
            x, rows = (_matrix(t.column("features").combine_chunks()) for t in (a, b))
            for first in range(0, len(x), 512):
                for found, new in zip((at, which, how_far), _k_nearest(x[first : first + 512], rows, place, k)):
                    found.append(new + first if found is at else new)
        at, which, how_far = (np.concatenate(v) if v else np.empty(0, t) for v, t in ((at, int), (which, int), (how_far, float)))
        return pa.table({"item": queries.take(pa.array(at)), "t": names.take(pa.array(which)), "label": pa.array(labels[which]), "d": pa.array(how_far)})

    keys = ["cell", "q", "s"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"item {kinds[0]}, t {kinds[1]}, label double, d double")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("d", "t"))).where(F.col("r") <= k)


def knn_regression(train: DataFrame, test: DataFrame, k: int, **sizes) -> DataFrame:
    """item, p: the 1/distance-weighted mean label of the k nearest; exact matches alone count if any."""
    near = nearest(train, test, k, **sizes)
    exact = F.max(F.when(F.col("d") == 0, 1).otherwise(0))
    inverse = 1.0 / F.nullif(F.col("d"), F.lit(0.0))
    return near.groupBy("item").agg(F.when(exact == 1, F.avg(F.when(F.col("d") == 0, F.col("label")))).otherwise(F.sum(F.col("label") * inverse) / F.sum(inverse)).alias("p"))


_CELLS = 1 << 17


def array_sums(df: DataFrame, columns: list[str], block, *, raw: bool = False) -> np.ndarray | None:
    """``block`` of every batch (matrices of array columns, vectors of others; as they are if ``raw``), added up; None without rows.

    A task adds up its batches and returns its sum in pieces of ``_CELLS`` numbers;
    the pieces of all tasks meet by their place and are added where they meet.
    """
    arrays = [t.startswith("array") for _, t in df.select(*columns).dtypes]

    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                given = batch.columns if raw else [_matrix(c) if is_array else c.to_numpy(zero_copy_only=False).astype(float) for c, is_array in zip(batch.columns, arrays)]
                got = block(*given)
                total = got if total is None else total + got
        pieces = [] if total is None else [total.ravel()[i : i + _CELLS].tobytes() for i in range(0, total.size, _CELLS)]
        for i, piece in enumerate(pieces):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece], pa.binary())], names=["place", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(v)
                total[place] = x if place not in total else total[place] + x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["place", "v"])

    schema = "place int, v binary"
    rows = df.select(*columns).mapInArrow(sums, schema).repartition("place").mapInArrow(add, schema).collect()  # as many numbers as the sum has
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(rows)]) if rows else None


#: Rows that are expanded at once.
EXPANDED_ROWS = 512


def _slices(x: np.ndarray, *more: np.ndarray):
    for i in range(0, len(x), EXPANDED_ROWS):
        yield tuple(v[i : i + EXPANDED_ROWS] for v in (x, *more))


def gram(df: DataFrame, features: str, label: str, width: int, expand=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Centred X'X and X'y, means of both, and the number of rows, in two passes: the second subtracts the first's means, so nothing cancels.

    Features are expanded some rows at a time, so memory does not depend on how many rows a batch has.
    """
    expand = expand or (lambda x: x)
    first = array_sums(df, [features, label], lambda x, y: np.concatenate([sum(expand(part).sum(0) for (part,) in _slices(x)), [y.sum(), len(y)]]))
    if first is None:
        raise ValueError("no training rows")
    n = int(first[-1])
    mean, centre = first[:-2] / n, first[-2] / n

    def products(x, y):
        total = np.zeros((len(mean), len(mean) + 1))
        for part, labels in _slices(x, y):
            part = expand(part) - mean
            total[:, :-1] += part.T @ part
            total[:, -1] += part.T @ (labels - centre)
        return total

    both = array_sums(df, [features, label], products).reshape(len(mean), -1)
    return both[:, :-1], both[:, -1], mean, float(centre), n


def column_stats(df: DataFrame, features: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, population deviation (below 1e-8 it counts as 1) and correlation with the label of every feature."""
    first = array_sums(df, [features, label], lambda x, y: np.concatenate([x.sum(0), [y.sum(), len(y)]]))
    if first is None:
        raise ValueError("no training rows")
    mean, centre, n = first[:-2] / first[-1], first[-2] / first[-1], first[-1]

    def spread(x, y):
        x, y = x - mean, y - centre
        return np.concatenate([(x * x).sum(0), x.T @ y, [y @ y]])

    got = array_sums(df, [features, label], spread)
    w = len(mean)
    sd = np.sqrt(got[:w] / n)
    sd[sd < 1e-8] = 1.0
    return mean, sd, got[w : 2 * w] / (np.sqrt(got[:w] * got[-1]) + 1e-12)


def ridge_fit(df: DataFrame, features: str, label: str, width: int, alpha: float, expand=None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on standardised features; the intercept is not penalised."""
    xx, xy, mean, centre, n = gram(df, features, label, width, expand)
    sd = np.sqrt(np.diag(xx) / n)
    sd[sd < 1e-8] = 1
    b = np.linalg.solve(xx / np.outer(sd, sd) + alpha * np.eye(len(sd)), xy / sd)
    return b / sd, centre - float((b / sd) @ mean)


def bayesian_ridge_fit(df: DataFrame, features: str, label: str, width: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Ridge whose penalty follows from the evidence; iterates on the Gram matrix only."""
    c, v, mean, centre, n = gram(df, features, label, width)
    s = float(df.agg(F.sum((F.col(label) - centre) * (F.col(label) - centre))).first()[0])
    values, vectors = np.linalg.eigh(c)
    values, turned = np.maximum(values, 0), vectors.T @ v
    noise, prior = n / max(s, 1e-12), 1.0
    for _ in range(rounds):
        w = turned / (values + prior / noise)
        used = float((noise * values / (prior + noise * values)).sum())
        error = max(s - 2 * w @ turned + w @ (values * w), 1e-12)
        new = (used + 2e-6) / (w @ w + 2e-6), (n - used + 2e-6) / (error + 2e-6)
        done = abs(new[0] - prior) < 1e-6 * prior and abs(new[1] - noise) < 1e-6 * noise
        prior, noise = new
        if done:
            break
    b = vectors @ (turned / (values + prior / noise))
    return b, centre - float(b @ mean)


def linear(features: str, coefficients: np.ndarray, intercept: float) -> Column:
    w = F.array(*[F.lit(float(c)) for c in coefficients])
    return F.aggregate(F.zip_with(features, w, lambda x, c: x.cast("double") * c), F.lit(float(intercept)), lambda s, x: s + x)


def products(x: np.ndarray) -> np.ndarray:
    """The features, and the products of two, without a constant."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([x, x[:, i] * x[:, j]], 1)


def predictor(model: tuple[np.ndarray, float], expand=None):
    """A linear model of many numbers as a vectorised function of the feature column."""
    b, c = model

    @F.pandas_udf("double")
    def predict(features):
        import pandas as pd

        x = np.array(features.tolist(), float).reshape(len(features), -1)
        return pd.Series(np.concatenate([(expand(part) if expand else part) @ b + c for (part,) in _slices(x)] or [np.empty(0)]))

    return predict


def ensemble_ranks(predictions: DataFrame, members: list[str], train_labels: DataFrame) -> DataFrame:
    """item, mean_rank, p: mean ordinal rank of the members, turned into a training-label quantile.

    Columns of ``predictions``: item, member, score; of ``train_labels``: label.
    """
    have = {r[0] for r in predictions.select("member").distinct().collect()}
    if missing := sorted(set(members) - have):
        raise ValueError(f"missing members: {', '.join(missing)}")
    own = predictions.where(F.col("member").isin(members))
    ranked = row_index(own, ["score", "item"], "r", ("member",))
    mean = ranked.groupBy("item").agg(F.avg("r").alias("mean_rank"))
    placed = row_index(mean, ["mean_rank", "item"], "at")
    labels = row_index(train_labels.select("label"), ["label"], "i")
    sizes = mean.agg(F.count("*").alias("m")).join(F.broadcast(train_labels.agg(F.count("*").alias("n"))))
    at = (F.col("at") + 0.5) / F.col("m") * (F.col("n") - 1)
    placed = placed.join(F.broadcast(sizes)).select("item", "mean_rank", F.floor(at).alias("lo"), (at - F.floor(at)).alias("part"), F.least(F.floor(at) + 1, F.col("n") - 1).alias("hi"))
    low, high = labels.select(F.col("i").alias("lo"), F.col("label").alias("a")), labels.select(F.col("i").alias("hi"), F.col("label").alias("b"))
    return placed.join(low, "lo").join(high, "hi").select("item", "mean_rank", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("p"))


def flip_mean(views: DataFrame) -> DataFrame:
    """One score for each item from its views."""
    return views.groupBy("item").agg(F.avg("score").alias("score"))


def relative_rates(spark, method: str) -> list[float]:
    """A method's learning rate in each epoch over that of its first; its greatest where it warms up."""
    from plumbline.plans.catalogue import schedule, setups

    schedule(method)
    rates = [r["lr"] for r in learning_rates(setups(spark).where(F.col("method") == method)).orderBy("epoch").collect()]  # an epoch each
    return [r / max(rates) for r in rates]


def learning_rates(setups: DataFrame) -> DataFrame:
    """method, epoch, lr over each setup's epochs: cosine, step, warm-up cosine, warm-up linear."""
    each = setups.where("schedule is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    t, n = F.col("epoch").cast("double"), F.col("epochs").cast("double")
    warm = F.greatest(F.lit(1.0), F.floor(n / 10))
    rest = F.greatest(F.lit(1.0), n - warm)
    cosine = lambda x: 0.5 * (1 + F.cos(F.lit(np.pi) * x))
    rate = (
        F.when(F.col("schedule") == "cosine", cosine(t / n))
        .when(F.col("schedule").startswith("step"), F.pow(F.lit(0.1), F.floor(t / F.greatest(F.lit(1.0), F.floor(n / 4)))))
        .when(t < warm, (t + 1) / warm)
        .when(F.col("schedule") == "warmup_cosine", cosine(F.least(F.lit(1.0), (t - warm) / rest)))
        .otherwise(F.greatest(F.lit(0.0), (n - t) / rest))
    )
    return each.select("method", "epoch", (F.col("lr") * rate).alias("lr"))
