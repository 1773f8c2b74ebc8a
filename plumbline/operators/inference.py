"""Bootstrap intervals, paired differences, subgroups.

A draw is a hash of (seed, resample, position), so resamples are the same in any
order, on any cluster and in SQL. Tasks make the draws of a resample in numpy and
count how often each item is drawn. The items are packed into blocks of ``BLOCK``
places; the counts of a resample within a block, half a byte a place before
compression, meet the block by key, and the sums over the blocks are added up, so
what is shuffled is in proportion to the draws. Only the few items of a small table
are a broadcast that the counts meet where they are made. No row stands for a draw
or for an item drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.hashed import leading_48_bits
from plumbline.functions.stats import mae, pearson, rmse, row_index

#: Items up to which they are broadcast to the draws: so few that their counts, were they shuffled, would be some MB.
AT_HAND = 4_096
#: Places of a block of items (even), and the resamples that meet a block at once.
BLOCK, MEET = 1 << 18, 256
#: Draws that a task makes at once, and how many times that it counts together before they are shuffled.
DRAWS, TOGETHER = 1 << 21, 4
_SUMS, _ENDS = ("sp", "sy", "spp", "syy", "spy", "ae", "ee"), ("p_lo", "p_hi", "y_lo", "y_hi")
_KEPT = ("w", "sp", "sy", "spp", "syy", "spy", "MAE", "RMSE", "p_varies", "y_varies")


def moment_pearson(m: str = "") -> Column:
    """Correlation from weighted sums; 0 where a side is constant."""
    c = lambda k: F.col(m + k)
    vp = c("spp") - c("sp") * c("sp") / c("w")
    vy = c("syy") - c("sy") * c("sy") / c("w")
    # what is left of a constant after cancellation is not variance
    flat = (vp <= 1e-9 * F.abs(c("spp"))) | (vy <= 1e-9 * F.abs(c("syy")))
    scale = F.sqrt(F.greatest(vp, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return F.when(flat, F.lit(0.0)).otherwise((c("spy") - c("sp") * c("sy") / c("w")) / F.nullif(scale, F.lit(0.0)))


class _Items:
    """Labels and predictions of some items, and the sums over those drawn."""

    def __init__(self, table: np.ndarray):
        y, parts = table[0], []
        for x in table[1:]:
            e = x - y
            parts += [x, y, x * x, y * y, x * y, np.abs(e), e * e]
        self.table, self.n = table, table.shape[1]
        self.features = np.stack(parts, 1)
        self.odd = np.flatnonzero(~np.isfinite(self.features).all(1))
        if len(self.odd):  # count only where they are drawn
            self.odd_features = self.features[self.odd]
            self.features[self.odd] = 0

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Of each row of counts: how many there are, then for each prediction ``_SUMS`` and ``_ENDS``."""
        sums = counts.astype(float) @ self.features
        for i in range(len(counts) if len(self.odd) else 0):
            times = counts[i, self.odd]
            sums[i] += (times[times > 0, None] * self.odd_features[times > 0]).sum(0)
        ends = [[self._ends(row, values) for values in self.table] for row in counts]
        out, k = [counts.sum(1).astype(float)[:, None]], len(_SUMS)
        for p in range(1, len(self.table)):
            out += [sums[:, k * p - k : k * p], np.array([[*e[p], *e[0]] for e in ends])]
        return np.concatenate(out, 1)

    def _ends(self, counts: np.ndarray, values: np.ndarray) -> tuple[float, float]:
        """The least and greatest value drawn, or those of the first few if they differ already: what matters is whether any do."""
        few = values[:1024][counts[:1024] > 0]
        if not len(self.odd) and len(few) and few.min() < few.max():
            return few.min(), few.max()
        drawn = values[counts > 0]
        return (drawn.min(), drawn.max()) if len(drawn) else (np.inf, -np.inf)


def _same(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, list[int]]]:
    """The resamples ``b`` of a batch that have the same keys."""
    found: dict[tuple, list[int]] = {}
    for *key, b in zip(*[batch.column(k).to_pylist() for k in (*keys, "b")]):
        found.setdefault(tuple(key), []).append(b)
    yield from found.items()


def _places(texts: list[str], n: int, first: int, last: int) -> np.ndarray:
    """The places 0 to n - 1 that draws first to ``last`` - 1 of some resamples fall on, a row for each."""
    drawn, n = leading_48_bits([t.encode() for t in texts], first, last), np.uint64(n)
    return (drawn - drawn // n * n).view(np.int64)


def _summed(group, resamples: list[int], sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([group] * len(resamples), pa.string()), pa.array(resamples, pa.int64()), *[pa.array(c) for c in sums.T.copy()]]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def _sum_names(columns: list[str]) -> list[str]:
    return ["w"] + [f"{c}_{k}" for c in columns for k in (*_SUMS, *_ENDS)]


def _sum_schema(columns: list[str]) -> str:
    return "c0 string, c1 long, " + ", ".join(f"c{i} double" for i in range(2, 2 + len(_sum_names(columns))))


def _sums_at_hand(numbered: DataFrame, tasks: DataFrame, columns: list[str], text) -> DataFrame:
    """A row of sums for each row of ``tasks`` (group, n, b): its draws meet the items, a broadcast of checked size."""
    got = numbered.select("group", "at", "y", *columns).toArrow()
    code = got["group"].combine_chunks().dictionary_encode(null_encoding="encode")
    names, code = code.dictionary.to_pylist(), code.indices.to_numpy()
    values = np.stack([got[c].cast(pa.float64()).to_numpy() for c in ("y", *columns)])[:, np.lexsort((got["at"].to_numpy(), code))]
    ends = np.cumsum(np.bincount(code, minlength=len(names)))
    shipped = numbered.sparkSession.sparkContext.broadcast({g: values[:, i:j].copy() for g, i, j in zip(names, [0, *ends], ends)})

    def run(batches):
        known: dict[str, _Items] = {}
        for batch in batches:
            for (group,), resamples in _same(batch, "group"):
                if group not in known:
                    known[group] = _Items(shipped.value[group])
                items, n = known[group], known[group].n
                step = max(1, DRAWS // n)
                for i in range(0, len(resamples), step):
                    some = resamples[i : i + step]
                    drawn = _places([text(group, b) for b in some], n, 0, n)
                    yield _summed(group, some, items.sums(np.stack([np.bincount(row, minlength=n) for row in drawn])))

    return tasks.mapInArrow(run, _sum_schema(columns)).toDF("group", "b", *_sum_names(columns))


def _packed(at: np.ndarray, block: int) -> tuple[bool, bytes]:
    """Places within a block: as counts, or as they are if they are few."""
    if len(at) * 8 >= block:
        return _packed_counts(np.bincount(at, minlength=block))
    return False, at.astype(np.uint32).tobytes()


def _packed_counts(counts: np.ndarray) -> tuple[bool, bytes]:
    """The counts of a block's places, an even number: as half a byte each, without their redundancy, or as places if those are few or one is too frequent."""
    if counts.sum() * 8 >= len(counts) and counts.max() < 16:
        counts = counts.astype(np.uint8)
        coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
        return True, coder.compress((counts[::2] | counts[1::2] << 4).tobytes()) + coder.flush()
    return False, np.repeat(np.arange(len(counts), dtype=np.uint32), counts).tobytes()


def _split_counts(counts: np.ndarray, block: int) -> Iterator[tuple[int, bool, bytes]]:
    """The blocks of an even number of counts, packed; the last block may be short."""
    for k in range(-(-len(counts) // block)):
        if (part := counts[k * block : k * block + block]).any():
            yield k, *_packed_counts(part)


def _packed_blocks(at: np.ndarray, n: int, block: int) -> Iterator[tuple[int, bool, bytes]]:
    """The blocks that some of n places fall in, packed; places are sorted only where they are few among n."""
    even = n + n % 2
    if n <= 4 * len(at):
        yield from _split_counts(np.bincount(at, minlength=even), block)
    else:
        edges = np.arange(0, n + block, block)
        at = np.sort(at)
        ends = np.searchsorted(at, edges)
        for k in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            yield k, *_packed(at[ends[k] : ends[k + 1]] - edges[k], min(block, even - k * block))


def _counts(dense: bool, packed: bytes, n: int) -> np.ndarray:
    """The counts of a block's n places again."""
    if not dense:
        return np.bincount(np.frombuffer(packed, np.uint32), minlength=n)
    pairs, counts = np.frombuffer(zlib.decompress(packed, -15), np.uint8), np.zeros(n + n % 2, np.uint8)
    counts[: 2 * len(pairs) : 2], counts[1 : 2 * len(pairs) : 2] = pairs & 15, pairs >> 4
    return counts[:n]


def _sums_in_blocks(numbered: DataFrame, tasks: DataFrame, columns: list[str], text, resamples: int) -> DataFrame:
    """The same for items of any number: counts of draws meet blocks of items."""
    block, draws, meet_at_once = BLOCK, DRAWS, MEET
    parts = tasks.select("group", "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / (TOGETHER * draws)))).alias("part"))
    together = TOGETHER * draws

    def packed_blocks(texts: list[str], n: int, first: int, last: int):
        """For each text the blocks of its draws; of more than a task makes at once there is one text."""
        if last - first <= draws:
            return [_packed_blocks(at, n, block) for at in _places(texts, n, first, last)]
        pieces = (_places(texts, n, i, min(i + draws, last))[0] for i in range(first, last, draws))
        if n > 4 * (last - first):
            return [_packed_blocks(np.concatenate(list(pieces)), n, block)]
        counts = np.zeros(n + n % 2, np.int64)
        for at in pieces:
            counts += np.bincount(at, minlength=len(counts))
        return [_split_counts(counts, block)]

    def deal(batches):
        for batch in batches:
            for (group, n, part), every in _same(batch, "group", "n", "part"):
                first, last = part * together, min(n, part * together + together)
                step = max(1, draws // (last - first))
                for i in range(0, len(every), step):
                    some, rows = every[i : i + step], []
                    for b, blocks in zip(some, packed_blocks([text(group, b) for b in some], n, first, last)):
                        rows += [(group, k, b // meet_at_once, b, *packed) for k, *packed in blocks]
                    columns = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["group", "block", "q", "b", "dense", "counts"])

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table["at"].to_numpy())
        values = np.stack([table[c].cast(pa.float64()).to_numpy()[order] for c in ("y", *columns)])
        return pa.table({"group": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "items": pa.array([values.tobytes()], pa.binary())})

    def meet(drawn: pa.Table, packed: pa.Table) -> pa.Table:
        items = _Items(np.frombuffer(packed["items"][0].as_py()).reshape(1 + len(columns), -1)) if packed.num_rows and drawn.num_rows else None
        found = [_summed(None, [], np.empty((0, len(_sum_names(columns)))))]
        rows = list(zip(drawn["b"].to_pylist(), drawn["dense"].to_pylist())) if items else []
        step = max(1, draws // items.n) if items else 1
        for i in range(0, len(rows), step):
            counts = np.stack([_counts(dense, drawn["counts"][i + k].as_py(), items.n) for k, (_, dense) in enumerate(rows[i : i + step])])
            found.append(_summed(drawn["group"][0].as_py(), [b for b, _ in rows[i : i + step]], items.sums(counts)))
        return pa.Table.from_batches(found)

    spark = numbered.sparkSession
    drawn = parts.repartition(4 * _tasks(spark)).mapInArrow(deal, "group string, block long, q long, b long, dense boolean, counts binary")
    placed = numbered.select("group", "at", "y", *columns).withColumn("block", F.floor(F.col("at") / block))
    blocks = placed.groupBy("group", "block").applyInArrow(pack, "group string, block long, items binary")
    blocks = blocks.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((resamples - 1) // meet_at_once).cast("long"))))
    keys = ["group", "block", "q"]
    met = drawn.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(meet, _sum_schema(columns)).toDF("group", "b", *_sum_names(columns))
    over = lambda c: F.min if c.endswith("_lo") else F.max if c.endswith("_hi") else F.sum
    return met.groupBy("group", "b").agg(*[over(c)(c).alias(c) for c in _sum_names(columns)])


def _moments(numbered: DataFrame, tasks: DataFrame, columns: list[str], text, n: int, resamples: int) -> DataFrame:
    """group, b and for each of some predictions ``_KEPT``; ``tasks``: group, n, b; ``n``: of all groups."""
    if n <= AT_HAND:
        found = _sums_at_hand(numbered, tasks.repartition(4 * _tasks(numbered.sparkSession)), columns, text)
    else:
        found = _sums_in_blocks(numbered, tasks, columns, text, resamples)
    out = []
    for c in columns:
        of = lambda k, c=c: F.col(f"{c}_{k}")
        whole = [F.col("w"), *[of(k) for k in _SUMS[:5]], of("ae") / F.col("w"), F.sqrt(of("ee") / F.col("w")), of("p_hi") > of("p_lo"), of("y_hi") > of("y_lo")]
        out += [v.alias(f"{c}_{k}") for k, v in zip(_KEPT, whole)]
    return found.select("group", "b", *out)


def resampled(numbered: DataFrame, predictions: list[str], *, n: int, resamples: int, seed: str) -> DataFrame:
    """b and the correlation of each prediction with ``y`` in each resample, all from the same draws."""
    spark = numbered.sparkSession
    tasks = spark.range(resamples if n else 0).select(F.lit("").alias("group"), F.lit(n).cast("long").alias("n"), F.col("id").alias("b"))
    by_b = _moments(numbered.withColumn("group", F.lit("")), tasks, predictions, lambda _, b: f"{seed}|{b}|", n, resamples)
    return by_b.select("b", *[moment_pearson(f"{p}_").alias(p) for p in predictions])


def _tasks(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def interval(column: str, level: float = 0.95) -> tuple[Column, Column]:
    """Linear-interpolated percentiles; exact, as resamples are few."""
    tail = (1 - level) / 2
    return F.percentile(column, F.lit(tail)), F.percentile(column, F.lit(1 - tail))


def bootstrap_ci(numbered: DataFrame, *, n: int, resamples: int, seed: str) -> DataFrame:
    lo, hi = interval("p")
    return resampled(numbered, ["p"], n=n, resamples=resamples, seed=seed).agg(lo.alias("lo"), hi.alias("hi"))


def paired_bootstrap(numbered: DataFrame, *, n: int, resamples: int, seed: str) -> DataFrame:
    """Observed difference of two predictions' correlations, its interval and p-value."""
    both = resampled(numbered, ["a", "b2"], n=n, resamples=resamples, seed=seed).withColumn("d", F.col("a") - F.col("b2"))
    lo, hi = interval("d")
    below, above = F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("d") >= 0, 1.0).otherwise(0.0))
    stats = both.agg(lo.alias("lo"), hi.alias("hi"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))
    observed = numbered.agg((pearson("a", "y") - pearson("b2", "y")).alias("difference"))
    return observed.join(F.broadcast(stats))


def group_resamples(numbered: DataFrame, *, resamples: int, seed: str) -> DataFrame:
    """group, b, PC, MAE, RMSE and both sides' variance of every resample of every group."""
    sizes = numbered.groupBy("group").agg(F.count("*").alias("n"))
    tasks = sizes.select("group", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))).alias("b"))
    found = _moments(numbered, tasks, ["p"], lambda group, b: f"{seed}|{group}|{b}|", sizes.agg(F.sum("n")).first()[0] or 0, resamples)
    return found.toDF("group", "b", *_KEPT).select("group", "b", moment_pearson().alias("PC"), "MAE", "RMSE", "p_varies", "y_varies")


def subgroup_intervals(resamples: DataFrame) -> DataFrame:
    """group and the interval of each metric; resamples without variance are left out."""
    out = []
    for m in ("PC", "MAE", "RMSE"):
        lo, hi = interval(m)
        out += [lo.alias(f"{m}_lo"), hi.alias(f"{m}_hi")]
    return resamples.where("p_varies and y_varies").groupBy("group").agg(*out)


def subgroup_gap(resamples: DataFrame, first: str, second: str, metric: str = "PC") -> DataFrame:
    """Interval of a metric of the first group less that of the second, drawn independently; only constant labels are left out."""
    of = lambda g: F.max(F.when(F.col("group") == g, F.col(metric)))
    lo, hi = interval("d")
    both = resamples.where(F.col("group").isin(first, second) & F.col("y_varies")).groupBy("b").agg(of(first).alias("x"), of(second).alias("z"))
    gap = both.select((F.col("x") - F.col("z")).alias("d")).agg(lo.alias("lo"), hi.alias("hi"))
    return gap.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def subgroup_metrics(scored: DataFrame, dimension: str, *, least: int = 1) -> DataFrame:
    return scored.groupBy(F.col(dimension).alias("group")).agg(F.count("*").alias("n"), pearson("p", "y").alias("PC"), mae("p", "y").alias("MAE"), rmse("p", "y").alias("RMSE")).where(F.col("n") >= least)


def with_total(scored: DataFrame, dimension: str) -> DataFrame:
    """The groups and a row ``all`` in one grouping-sets aggregation."""
    sets = scored.groupingSets([[F.col(dimension)], []], F.col(dimension))
    return sets.agg(F.count("*").alias("n"), pearson("p", "y").alias("PC"), mae("p", "y").alias("MAE"), rmse("p", "y").alias("RMSE")).withColumn("group", F.coalesce(dimension, F.lit("all"))).drop(dimension)


def extremes(groups: DataFrame) -> DataFrame:
    """metric, best, worst: PC higher is better, the errors lower; ties by name.

    Min and max of (value, name) structs combine map-side; nothing is sorted.
    """
    long = groups.select("group", F.explode(F.create_map(F.lit("PC"), -F.col("PC"), F.lit("MAE"), F.col("MAE"), F.lit("RMSE"), F.col("RMSE"))).alias("metric", "v"))
    return long.groupBy("metric").agg(F.min(F.struct("v", "group"))["group"].alias("best"), F.max(F.struct("v", "group"))["group"].alias("worst"))


def dimensions(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Several grouping columns as rows (dimension, value), so one aggregation serves all."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns])).alias("d")
    return scored.select("*", pairs).select("*", "d.dimension", "d.value").drop("d")


def subgroup_table(scored: DataFrame, dimension: str, *, resamples: int, seed: str, least: int = 1) -> DataFrame:
    """Each group's size, metrics and intervals, largest PC first by ``place``, and a last row ``all`` for everything.

    ``scored`` has item, p, y and the grouping column.
    """
    both = F.explode(F.array(F.struct(F.lit(False).alias("total"), F.col(dimension).alias("name")), F.struct(F.lit(True).alias("total"), F.lit("all").alias("name")))).alias("g")
    long = scored.select("item", "p", "y", both).select("item", "p", "y", F.col("g.total").alias("total"), F.when(F.col("g.total"), "all").otherwise(F.concat(F.lit("="), "g.name")).alias("group"))
    metrics = long.groupBy("total", "group").agg(F.count("*").alias("n"), pearson("p", "y").alias("PC"), mae("p", "y").alias("MAE"), rmse("p", "y").alias("RMSE")).where(F.col("total") | (F.col("n") >= least))
    numbered = row_index(long.join(metrics.select("group"), "group", "left_semi"), ["item"], "at", ("group",))
    intervals = subgroup_intervals(group_resamples(numbered.select("group", "at", "p", "y"), resamples=resamples, seed=seed))
    joined = metrics.join(intervals, "group", "left").withColumn("group", F.when(F.col("total"), F.col("group")).otherwise(F.substring("group", 2, 1 << 20)))
    # one row for each group
    return joined.withColumn("place", F.row_number().over(Window.orderBy("total", F.desc("PC"), F.desc("group")))).drop("total")


def leak_check(predict, test: DataFrame, shuffled: DataFrame) -> bool:
    """Whether predictions stay the same when the test labels are dealt anew."""
    a = predict(test).select("item", F.col("score").alias("a"))
    b = predict(shuffled).select("item", F.col("score").alias("b"))
    return not a.join(b, "item").where(F.abs(F.col("a") - F.col("b")) > 1e-8 + 1e-5 * F.abs(F.col("b"))).limit(1).count()


def running_best(log: DataFrame, *, min_delta: float = 1e-4, patience: int = 5) -> DataFrame:
    """run, best_epoch, best, stopped_at by the early-stopping rule, from run, epoch, val.

    The rule is sequential; each run's log, bounded by its epochs, is folded as an array.
    """
    logs = log.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("epoch", "val"))).alias("l"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(0).alias("bad"), F.lit(-1).alias("stop"))

    def step(s, x):
        better, over = x["val"] < s["best"] - min_delta, s["stop"] >= 0
        new = F.struct(x["val"].cast("double").alias("best"), x["epoch"].cast("int").alias("best_epoch"), F.lit(0).alias("bad"), F.lit(-1).alias("stop"))
        worse = F.struct(s["best"].alias("best"), s["best_epoch"].alias("best_epoch"), (s["bad"] + 1).alias("bad"), F.when(s["bad"] + 1 >= patience, x["epoch"].cast("int")).otherwise(-1).alias("stop"))
        return F.when(over, s).when(better, new).otherwise(worse)

    return logs.select("run", F.aggregate("l", start, step).alias("r")).select("run", "r.best_epoch", "r.best", F.col("r.stop").alias("stopped_at"))
