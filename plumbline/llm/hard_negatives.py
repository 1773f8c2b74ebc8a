"""Hard negatives by a vector-approximation file.

Every dimension is cut into ``CELLS`` cells, and a row keeps one byte a dimension,
its cell, beside its vector. For an anchor, a table says for each dimension and cell
the least and the greatest product that a component in that cell can have with the
anchor's; summing a row's entries bounds its score from below and above. Rows are
scored exactly only where the bounds leave a place in an answer open:

positives: among an anchor's own label, rows whose upper bound reaches the k-th
    greatest lower bound (or the k-th best score so far) are scored;
negatives: each positive opens a window of scores; rows of other labels whose bounds
    touch the window, and reach the k-th best of those surely inside (or found so
    far), are scored.

Nothing is approximate in the result: bounds hold for every row, whatever the cells.
Cells end at quantiles of a sample of at most ``SAMPLE`` rows, taken by the order of
a hash; the ends of the outer ones come from all rows.

Anchors come in blocks of about ``ANCHORS``, the queries stated, each a broadcast of
bounded size; a block is two passes over the file, one for positives and one for
negatives, and the file is as many partitions as there are cores or more. A task
keeps only the best k of an anchor or window, so a pass shuffles k rows of three
numbers for each anchor and task, and no pair is ever a row. Blocks take no part in
each other's passes, so a lost executor costs a task of one pass.

Defined cases: rows with a null id or label, or whose vector is null, has components
that are null or not finite, or another length than most have (the greater length of
equals), take no part. Rows alike in id, label and vector are one; rows that share an
id only are rows of their own, and ties go by id, then by a hash of the row. An
anchor is no positive of itself. Without positives an anchor gives no rows; a window
of a negative positive score is empty. Scores must fit a long: components too large
for that are an error. An empty table gives an empty one; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.runtime import materialise
from plumbline.llm.vectors import lattice, matrix, usable

SCALE, CELLS, SAMPLE, SAMPLE_SEED = 256, 16, 20_000, 97
#: Anchors of a block on average, those whose tables are held at once, and rows that meet them at once.
ANCHORS, AT_ONCE, ROWS = 8_192, 128, 4_096
POSITIVES, NEGATIVES = 5, 3
#: Rows of a partition of the file at least.
PART = 2_048


class Cells:
    """The ends of every dimension's cells; both ends of a cell belong to it."""

    def __init__(self, sample: np.ndarray, cells: int):
        inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="inverted_cdf").astype(np.int64)
        #: A component is in cell c if c of the bounds are below it.
        self.bounds = np.sort(inner, axis=0)

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for bound in self.bounds:
            out += x > bound
        return out

    def close(self, least: np.ndarray, greatest: np.ndarray) -> None:
        """Set the cells' ends from those of all rows."""
        self.low = np.maximum(np.vstack([least, self.bounds + 1]), least)
        self.high = np.minimum(np.vstack([self.bounds, greatest]), greatest)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """For each dimension and cell, the least products with each of the anchors, then the greatest."""
        a, b = self.low.T[:, :, None] * anchors.T[:, None, :], self.high.T[:, :, None] * anchors.T[:, None, :]
        return np.concatenate([np.minimum(a, b), np.maximum(a, b)], axis=2)


def bounded(tables: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, a row for each anchor and a column for each coded row."""
    total = tables[0][codes[:, 0]]
    for d in range(1, codes.shape[1]):
        total += tables[d][codes[:, d]]
    half = total.shape[1] // 2
    return np.ascontiguousarray(total[:, :half].T), np.ascontiguousarray(total[:, half:].T)


class Best:
    """The k best of what has been offered: greatest score first, then smallest id, then hash."""

    def __init__(self, k: int):
        self.k, self.score, self.key = k, np.empty(0, np.int64), np.empty((0, 2), np.int64)

    def floor(self) -> int | None:
        """The score that a further row must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else None

    def offer(self, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.concatenate([self.score, score]), np.concatenate([self.key, key])
        at = np.lexsort((key[:, 1], key[:, 0], -score))[: self.k]
        self.score, self.key = score[at], key[at]


def _reach(best: Best, sure: np.ndarray) -> int | None:
    """What an upper bound must reach, by the rows found and the lower bounds of rows that surely count."""
    known = best.floor()
    if len(sure) >= best.k:
        least = int(np.partition(sure, len(sure) - best.k)[len(sure) - best.k])
        return least if known is None else max(known, least)
    return known


class _File:
    """The vector-approximation file: vec_id, row, label, x and the cells of every usable row."""

    def __init__(self, rows: DataFrame, scale: int, cells: int, sample: int):
        spark = rows.sparkSession
        rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where("vec_id is not null and label is not null")
        sound, self.width = usable(rows, "embedding")
        whole = sound.select("vec_id", "label", lattice("embedding", scale).alias("x")).withColumn("row", F.xxhash64("vec_id", "label", "x"))
        # rows alike meet by their hash and id; everything else about them is the same
        whole = whole.groupBy("vec_id", "row", "label").agg(F.first("x").alias("x"))
        plain = materialise(whole, "vectors")
        n = plain.count()
        self.n = n
        if not n or not self.width:
            self.n = 0
            return
        some = plain.select("x", F.xxhash64("row", F.lit(SAMPLE_SEED)).alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).select("x").toArrow()
        self.cells = Cells(matrix(some.column("x").combine_chunks(), self.width).astype(np.int64), cells)
        shipped, width = spark.sparkContext.broadcast(self.cells), self.width

        def encode(batches):
            for batch in batches:
                code = shipped.value.of(matrix(batch.column("x"), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary())], names=[*batch.schema.names, "code"])

        parts = min(max(1, n // PART), spark.sparkContext.defaultParallelism)
        wide = plain.repartition(parts, "vec_id") if plain.rdd.getNumPartitions() < parts else plain
        self.rows = materialise(wide.select("vec_id", "row", "label", "x").mapInArrow(encode, "vec_id long, row long, label long, x array<long>, code binary"), "approximations")

        def ends(batches):
            least = greatest = None
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(0), width)
                    low, high = x.min(0), x.max(0)
                    least, greatest = (low, high) if least is None else (np.minimum(least, low), np.maximum(greatest, high))
            if least is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(least), pa.array(greatest)], names=["d", "low", "high"])

        got = self.rows.select("x").mapInArrow(ends, "d int, low long, high long").groupBy("d").agg(F.min("low"), F.max("high")).orderBy("d").collect()  # a row a dimension
        self.cells.close(np.array([r[1] for r in got]), np.array([r[2] for r in got]))
        top = max(abs(int(v)) for r in got for v in r[1:])
        if top * top * self.width >= 1 << 62:
            raise ValueError("scores of these vectors do not fit a long")


class _Anchors:
    """A block of anchors, in the order of their labels."""

    def __init__(self, rows: list, width: int):
        rows = sorted(rows, key=lambda r: (r["label"], r["vec_id"], r["row"]))
        self.id = np.array([r["vec_id"] for r in rows], np.int64)
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.x = np.array([r["x"] for r in rows], np.int64).reshape(-1, width)


_FOUND = "a int, w int, score long, vec_id long, row long"


def _found(best: dict) -> pa.RecordBatch:
    """A task's best rows: a for the anchor, w for its window."""
    rows = [(a, w, s, k[0], k[1]) for (a, w), b in best.items() for s, k in zip(b.score.tolist(), b.key.tolist())]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["a", "w", "score", "vec_id", "row"])


def _chunks(batches, width: int):
    """label, key, x and codes of a task's rows, so many at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, width)
            key = np.column_stack([part.column("vec_id").to_numpy(), part.column("row").to_numpy()])
            yield part.column("label").to_numpy(), key, matrix(part.column("x"), width), codes


def _positives(file: _File, block, k: int) -> DataFrame:
    """The best k of their own label for every anchor of a block, from each task."""
    shipped, cells, width = block, file.rows.sparkSession.sparkContext.broadcast(file.cells), file.width

    def search(batches):
        anchors, best = shipped.value, {}
        for label, key, x, codes in _chunks(batches, width):
            for own in np.unique(label).tolist():
                lo, hi = np.searchsorted(anchors.label, [own, own + 1])
                at = np.flatnonzero(label == own)
                for first in range(lo, hi, AT_ONCE):
                    some = range(first, min(first + AT_ONCE, hi))
                    low, high = bounded(cells.value.tables(anchors.x[some.start : some.stop]), codes[at])
                    for i, a in enumerate(some):
                        mine = best.setdefault((a, 0), Best(k))
                        other = (key[at, 0] != anchors.id[a]) | (key[at, 1] != anchors.row[a])
                        reach = _reach(mine, low[i][other])
                        pick = at[other & (high[i] >= reach)] if reach is not None else at[other]
                        if len(pick):
                            mine.offer(x[pick] @ anchors.x[a], key[pick])
        yield _found(best)

    return file.rows.mapInArrow(search, _FOUND)


def _negatives(file: _File, block, windows, k: int) -> DataFrame:
    """The best k of other labels in every window of a block's anchors, from each task; ``windows`` has the ends of each by anchor."""
    shipped, cells, width = block, file.rows.sparkSession.sparkContext.broadcast(file.cells), file.width

    def search(batches):
        anchors, open_, best = shipped.value, windows.value, {}
        order = sorted(open_)
        for label, key, x, codes in _chunks(batches, width):
            for first in range(0, len(order), AT_ONCE):
                some = order[first : first + AT_ONCE]
                low, high = bounded(cells.value.tables(anchors.x[some]), codes)
                for i, a in enumerate(some):
                    other = np.flatnonzero(label != anchors.label[a])
                    lo, hi, scored = low[i][other], high[i][other], {}
                    for w, (start, end) in enumerate(open_[a]):
                        if start > end:
                            continue
                        mine = best.setdefault((a, w), Best(k))
                        may = (hi >= start) & (lo <= end)
                        reach = _reach(mine, lo[may & (lo >= start) & (hi <= end)])
                        pick = other[may & (hi >= reach)] if reach is not None else other[may]
                        if len(pick):
                            score = x[pick] @ anchors.x[a]
                            inside = (score >= start) & (score <= end)
                            mine.offer(score[inside], key[pick[inside]])
        yield _found(best)

    return file.rows.mapInArrow(search, _FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of every anchor and window, of what the tasks found; k rows of a task at most are one group's."""
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors, *, scale: int = SCALE, low: int = 50, high: int = 95, positives: int = POSITIVES, negatives: int = NEGATIVES, cells: int = CELLS, sample: int = SAMPLE, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vec_id, label, embedding.

    ``anchors`` is a condition on vec_id and label. A negative's score is between
    ``low`` and ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    file = _File(rows, scale, cells, sample)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    chosen = file.rows.where(anchors).select("vec_id", "row", "label", "x", F.xxhash64("row", F.lit(1)).alias("h")) if file.n else None
    count = chosen.count() if file.n else 0
    out = []
    blocks = -(-count // block)
    for b in range(blocks):
        own = _Anchors(chosen.where(F.pmod("h", F.lit(blocks)) == b).collect(), file.width)  # a block
        shipped = spark.sparkContext.broadcast(own)
        best = _merged(_positives(file, shipped, positives), positives).collect()  # k rows an anchor of the block
        windows, named = {}, []
        for r in sorted(best, key=lambda r: (r["a"], r["rank"])):
            s = r["score"]
            # low * s <= 100 * score <= high * s, in whole numbers
            windows.setdefault(r["a"], []).append((-(-low * s // 100), high * s // 100))
            named.append((r["a"], len(windows[r["a"]]) - 1, int(own.id[r["a"]]), r["vec_id"], s))
        found = _merged(_negatives(file, shipped, spark.sparkContext.broadcast(windows), negatives), negatives)
        names = F.broadcast(spark.createDataFrame(named, "a int, w int, anchor_id long, positive_id long, positive_score long"))
        of_block = found.join(names, ["a", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(materialise(of_block, "hard-negatives"))
    if not out:
        return spark.createDataFrame([], schema)
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
