"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens; how many pieces there
are of each length is all the optimiser sees, a histogram of ``capacity`` bins
whatever the corpus. A configuration is a multiset of lengths that fits into one
sequence. The program "fewest configurations that cover the histogram" is solved
by multiplicative weights: each length has a price that falls as it is covered,
the next configuration is the most valuable one at these prices (a knapsack,
priced by dynamic programming over the capacity), and it is taken in proportion.
The fractional solution is rounded down to whole configurations, the prices are
found anew for what is left, and the last rest is placed by best fit, on counts
of equal sequences, so that its cost follows from the lengths, not the pieces.
The prices are a dual solution as well: what all pieces are worth over what one
sequence can be worth is a lower bound of the number of sequences.

Distribution: one map-side pass cuts the texts and numbers the pieces of each
length within their task; the written piece table fixes that numbering. Counts
by (task, length) turn it into a rank within the length, and a small table of
rank intervals places each rank in its sequence, by binary search: its size
depends on the capacity only (a few for each length and configuration), so it is
broadcast. Texts are never shuffled and no length is gathered in one task.

Defined cases: a null text counts as empty and is one piece, the end token;
repeated rows are separate documents; null ids stay null; an empty table gives
an empty result; extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.runtime import materialise
from plumbline.llm.subword import Encoder, uncollected

CAPACITY = 2048
END_ID = 0
#: Multiplicative-weights steps, configurations in each, and rounds of rounding.
STEPS, SEEDS, ROUNDS = 60, 24, 3
#: How much of a length a round may place.
SHARE = 0.6
_built: dict[str, Encoder] = {}
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def cut_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, numbered by (task, length, nth), written to the shared folder."""

    def cut(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), Counter()
        if tokenizer_path not in _built:
            _built[tokenizer_path] = Encoder(tokenizer_path)
        encoder, end = _built[tokenizer_path], END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            with uncollected():
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids_many([t or "" for t in batch.column(1).to_pylist()])):
                    ids = memoryview(ids + end)
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                        seen[length] += 1
            types = [pa.int64(), pa.int32()] + [pa.int64()] * 5
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return materialise(docs.select("doc_id", "text").mapInArrow(cut, _PIECE), "pieces")


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the greatest value of a multiset that fits, and an item of it (or -1)."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := fits[c]:
            worth = prices[:k] + value[c - lengths[:k]]
            i = int(worth.argmax())
            if worth[i] > value[c]:
                value[c], taken[c] = worth[i], i
    return value, taken


def _configuration(first: int, lengths: np.ndarray, taken: np.ndarray, capacity: int) -> list[int]:
    """The most valuable configuration that has the given item: item indices, with repeats."""
    out, c = [first], capacity - int(lengths[first])
    while c > 0:
        i = int(taken[c])
        if i < 0:
            c -= 1
        else:
            out.append(i)
            c -= int(lengths[i])
    return out


def _weights_round(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[Counter, float]:
    """A fractional cover of the demand, configurations and how often each is taken, and a lower bound of any cover.

    One knapsack table prices the best configuration around every item, so each
    step takes those around the SEEDS items that lag behind most.
    """
    covered = np.zeros(len(lengths))
    each = float(lengths @ demand) / capacity / (STEPS * SEEDS)
    taken: Counter = Counter()
    rate, bound = np.log(len(lengths) + 1.0), 0.0
    for _ in range(STEPS):
        # the price of a length: its size, raised or lowered as it lags behind or runs ahead
        lag = covered / demand - covered @ lengths / (demand @ lengths)
        prices = lengths * np.exp(-np.clip(rate * lag, -8, 8))
        value, table = _knapsack(lengths, prices, capacity)
        bound = max(bound, float(prices @ demand) / value[capacity])
        for seed in np.argsort(lag - lengths / capacity, kind="stable")[:SEEDS].tolist():
            items = _configuration(seed, lengths, table, capacity)
            np.add.at(covered, items, each)
            taken[tuple(sorted(items))] += each
    return taken, bound


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Longest first, each into the fullest sequence that still has room: configurations and how often each is made.

    Sequences with equal contents are counted, not listed. Of those with the same
    room each takes all it can of a length before the next one does.
    """
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    occupied = np.zeros(capacity + 1, bool)

    def put(items: tuple[int, ...], times: int) -> None:
        if times:
            r = capacity - sum(items)
            room[r].append([items, times])
            occupied[r] = True

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            open_ = np.flatnonzero(occupied[length:])
            if len(open_):
                r = length + int(open_[0])
                items, times = room[r].pop()
                occupied[r] = bool(room[r])
            else:
                r, items, times = capacity, (), left
            fit = r // length
            full = min(times, left // fit)
            put(items + (length,) * fit, full)
            left, times = left - full * fit, times - full
            if left and times:  # fewer than one takes
                put(items + (length,) * left, 1)
                left, times = 0, times - 1
            if items:
                put(items, times)
    out: Counter = Counter()
    for group in room:
        for items, times in group:
            out[items] += times
    return out


def plan_with_bound(histogram: dict[int, int], *, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Configurations (lengths, longest first) and how many sequences have each, and the least number of sequences there could be.

    Together they hold every length exactly as often as the histogram says.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: Counter = Counter()
    whole = left.pop(capacity, 0)
    if whole:
        plan[(capacity,)] = whole
    bound = 0.0
    if left:
        lengths, demand = np.array(sorted(left)), np.array([left[n] for n in sorted(left)], float)
        for prices in (lengths.astype(float), (2 * lengths > capacity).astype(float)):
            if prices.any():
                bound = max(bound, float(prices @ demand) / _knapsack(lengths, prices, capacity)[0][capacity])
    for number in range(ROUNDS):
        if sum(left.values()) < 256:
            break
        lengths = np.array(sorted(left))
        demand = np.array([left[n] for n in lengths.tolist()], float)
        # whole configurations only, none beyond its share: what is left keeps the histogram's shape
        share = {n: int(SHARE * c) for n, c in left.items()}
        taken, least = _weights_round(lengths, demand, capacity)
        bound = bound if number else max(bound, least)
        for items, times in sorted(taken.items(), key=lambda x: -x[1]):
            need = Counter(lengths[list(items)].tolist())
            most = min([max(1, int(times)), *(share[n] // c for n, c in need.items())])
            if most > 0 and sum(n * c for n, c in need.items()) == capacity:
                plan[tuple(sorted(need.elements(), reverse=True))] += most
                for n, c in need.items():
                    left[n] -= most * c
                    share[n] -= most * c
        left = {n: c for n, c in left.items() if c > 0}
    plan.update(best_fit(left, capacity))
    return list(plan.items()), whole + ceil(bound * (1 - 1e-12) - 1e-9)


def plan_sequences(histogram: dict[int, int], *, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    return plan_with_bound(histogram, capacity=capacity)[0]


def _intervals(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, per sequence, offset) of every place."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for items, times in plan:
        offset = 0
        for n, per in sorted(Counter(items).items(), reverse=True):
            rows.append((n, rank[n], rank[n] + per * times, sequence, per, offset))
            rank[n] += per * times
            offset += n * per
        sequence += times
    return rows


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = cut_documents(docs, tokenizer_path, capacity=capacity)
    counts = pieces.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = sorted(_intervals(plan_sequences(histogram, capacity=capacity)))
    places = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 6))
    ranked = pieces.join(firsts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches):
        table = places.value
        starts = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(starts, length << 48 | rank, "right") - 1
            k, per = rank - table[at, 1], table[at, 4]
            found = [pa.array(table[at, 3] + k // per), pa.array(table[at, 5] + k % per * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
