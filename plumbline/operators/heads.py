"""Linear heads on frozen features, fitted by one L-BFGS whose sums Spark adds up.

A head is a matrix: outputs = [features, 1] @ head, on standardised features. What
differs between heads is their loss, a function of the outputs, labels and rating
counts that returns a sum and its derivative by the outputs. An epoch is one pass
over the training and validation rows: tasks return the loss and gradient at a few
step lengths, and the validation error there, so a line search costs no further
pass. Rows are dealt to batches once, by the hash of their item, as pairs are only
compared within a batch; batches are cached and nothing is shuffled after that but
the sums.

The best epoch by validation error is kept, and the log of epochs can be read by
``running_best``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from plumbline.operators.predictors import array_sums, column_stats
from plumbline.operators.protocol import histogram_stats

#: Lengths of a step that an epoch tries, in the direction found; gradients that are remembered.
STEPS, MEMORY = (1.0, 0.5, 0.2, 0.05, 0.01), 10
GAP, MARGIN = 0.1, 0.1
#: Batches whose pairs are laid out at once.
AT_ONCE = 256


@dataclass
class Rows:
    """Some batches: features with a last column of ones, labels, counts (a row without any has zeros) and the batches' sizes."""

    x: np.ndarray
    y: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray


@dataclass
class Constants:
    """What a loss divides by, and its weights: made from the training rows before the first epoch."""

    n: float = 1.0
    rated: float = 1.0
    pairs: float = 1.0
    mean_n: float = 1.0
    floor: float = 0.0
    mean_weight: float = 1.0
    mean_y: float = 0.0
    classes: np.ndarray = field(default_factory=lambda: np.ones(1))
    class_total: float = 1.0


def softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares, and their logarithms."""
    z = z - z.max(1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    return np.exp(log_p), log_p


def classes_of(y: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The bin that a label rounds to, half to even."""
    return np.clip(np.rint(y) - bins[0], 0, len(bins) - 1).astype(int)


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Batches as rows of one matrix: the places of their items, and which cells have one."""
    width = int(sizes.max(initial=0))
    starts = np.cumsum(sizes) - sizes
    place = starts[:, None] + np.arange(width)[None]
    there = np.arange(width)[None] < sizes[:, None]
    return np.where(there, place, 0), there


def pair_counts(y: np.ndarray, sizes: np.ndarray) -> int:
    """Pairs within batches whose labels are more than ``GAP`` apart."""
    place, there = _layout(sizes)
    total = 0
    for i in range(0, len(sizes), AT_ONCE):
        v, ok = y[place[i : i + AT_ONCE]], there[i : i + AT_ONCE]
        total += int(((v[:, :, None] - v[:, None, :] > GAP) & ok[:, :, None] & ok[:, None, :]).sum())
    return total


def ranking(p: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray]:
    """The margin ranking loss summed over the pairs of batches, and its derivative by p."""
    place, there = _layout(sizes)
    loss, slope = 0.0, np.zeros(len(p))
    for i in range(0, len(sizes), AT_ONCE):
        at, ok = place[i : i + AT_ONCE], there[i : i + AT_ONCE]
        v, s = y[at], p[at]
        short = MARGIN - (s[:, :, None] - s[:, None, :])
        # the first of a pair is the one that should be higher
        open_ = (v[:, :, None] - v[:, None, :] > GAP) & ok[:, :, None] & ok[:, None, :] & (short > 0)
        loss += float(short[open_].sum())
        slope[at[ok]] += (open_.sum(1) - open_.sum(2))[ok]
    return loss, slope


def _divergence(p, log_p, counts, divisor) -> tuple[float, np.ndarray]:
    """KL of rated rows' shares to the predicted ones."""
    n = counts.sum(1)
    rated = n > 0
    target = counts / np.where(rated, n, 1)[:, None]
    inner = np.where(target > 0, target * (np.log(np.where(target > 0, target, 1)) - log_p), 0.0)
    return float(inner.sum()) / divisor, np.where(rated[:, None], p - target, 0.0) / divisor


def _through_expectation(p: np.ndarray, bins: np.ndarray, e: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The derivative by logits of what has ``slope`` by their expectation."""
    return slope[:, None] * p * (bins - e[:, None])


class Loss:
    """``__call__(outputs, rows, constants, bins)`` gives loss and derivative; ``width(bins)`` the number of outputs."""

    pairs = False
    distribution = slice(0, 0)

    def width(self, bins: int) -> int:
        return bins

    def score(self, o: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return softmax(o[:, self.distribution])[0] @ bins

    def start(self, head: np.ndarray, mean: float) -> None:
        """Set what outputs begin with; logits begin alike."""


class Distribution(Loss):
    """KL to the label distribution; where no training row has one, the absolute error of the expectation."""

    distribution = slice(None)

    def __call__(self, o, rows, k, bins):
        p, log_p = softmax(o)
        if k.rated:
            return _divergence(p, log_p, rows.counts, k.rated)
        e = p @ bins
        return float(np.abs(e - rows.y).sum()) / k.n, _through_expectation(p, bins, e, np.sign(e - rows.y) / k.n)


class Classes(Loss):
    """Cross-entropy to the rounded label with inverse-frequency weights."""

    distribution = slice(None)

    def __call__(self, o, rows, k, bins):
        p, log_p = softmax(o)
        c = classes_of(rows.y, bins)
        w, at = k.classes[c] / k.class_total, np.arange(len(c))
        slope = w[:, None] * p
        slope[at, c] -= w
        return float(-(w * log_p[at, c]).sum()), slope


class Absolute(Loss):
    """The absolute error of one output; with ``ranked``, so much of the margin ranking loss beside it."""

    def __init__(self, ranked: float = 0.0):
        self.ranked, self.pairs = ranked, ranked > 0

    def width(self, bins):
        return 1

    def score(self, o, bins):
        return o[:, 0]

    def start(self, head, mean):
        head[-1, 0] = mean

    def __call__(self, o, rows, k, bins):
        d = o[:, 0] - rows.y
        loss, slope = float(np.abs(d).sum()) / k.n, np.sign(d) / k.n
        if self.ranked and k.pairs:
            more, by = ranking(o[:, 0], rows.y, rows.sizes)
            loss, slope = loss + self.ranked * more / k.pairs, slope + self.ranked * by / k.pairs
        return loss, slope[:, None]


class Combined(Loss):
    """Twice the absolute error, and the distance to the expectation of class logits, which are fitted before and stay.

    Outputs are the score and the logits; only the score's column moves.
    """

    distribution = slice(1, None)

    def width(self, bins):
        return 1 + bins

    def score(self, o, bins):
        return o[:, 0]

    def __call__(self, o, rows, k, bins):
        e = softmax(o[:, 1:])[0] @ bins
        d, far = o[:, 0] - rows.y, o[:, 0] - e
        slope = np.zeros_like(o)
        slope[:, 0] = (2 * np.sign(d) + np.sign(far)) / k.n
        return float((2 * np.abs(d) + np.abs(far)).sum()) / k.n, slope


class Uncertain(Loss):
    """A distribution with an error bar: heteroscedastic error of its expectation, KL where there are ratings, half the margin ranking loss."""

    pairs = True
    distribution = slice(0, -1)

    def width(self, bins):
        return bins + 1

    def __call__(self, o, rows, k, bins):
        p, log_p = softmax(o[:, :-1])
        e, v = p @ bins, o[:, -1]
        d, precision = e - rows.y, np.exp(-o[:, -1])
        loss, by_e = float((precision * d * d + v).sum()) / k.n, 2 * precision * d / k.n
        slope = np.zeros_like(o)
        slope[:, -1] = (1 - precision * d * d) / k.n
        if k.rated:
            more, slope[:, :-1] = _divergence(p, log_p, rows.counts, k.rated)
            loss += more
        if k.pairs:
            more, by = ranking(e, rows.y, rows.sizes)
            loss, by_e = loss + 0.5 * more / k.pairs, by_e + 0.5 * by / k.pairs
        slope[:, :-1] += _through_expectation(p, bins, e, by_e)
        return loss, slope


class Reliable(Loss):
    """The multinomial likelihood of the counts over their mean number (or KL), and the expectation's absolute error weighted by the label's precision (or evenly)."""

    distribution = slice(None)

    def __init__(self, weighted: bool = True, likelihood: bool = True):
        self.weighted, self.likelihood = weighted, likelihood

    @staticmethod
    def weights(counts: np.ndarray, bins: np.ndarray, floor: float) -> np.ndarray:
        """1 / (population variance / n + floor) of each row; a row without ratings counts as one of no spread."""
        n = np.maximum(counts.sum(1), 1.0)
        shares = counts / n[:, None]
        mean = shares @ bins
        var = (shares * (bins - mean[:, None]) ** 2).sum(1)
        return 1.0 / np.maximum(var / n + floor, 1e-12)

    def __call__(self, o, rows, k, bins):
        p, log_p = softmax(o)
        if self.likelihood:
            by = k.mean_n * k.n
            loss, slope = float(-(rows.counts * log_p).sum()) / by, (rows.counts.sum(1)[:, None] * p - rows.counts) / by
        else:
            loss, slope = _divergence(p, log_p, rows.counts, k.n)
        w = self.weights(rows.counts, bins, k.floor) / k.mean_weight if self.weighted else np.ones(len(o))
        e = p @ bins
        return loss + float((w * np.abs(e - rows.y)).sum()) / k.n, slope + _through_expectation(p, bins, e, w * np.sign(e - rows.y) / k.n)


def batches(rows: DataFrame, histogram: str | None, bins: int, size: int, seed: int = 0) -> DataFrame:
    """Rows of (val, x, y, c, n): batches of about ``size`` items, flat; a missing histogram is zeros."""
    given = F.transform(histogram, lambda v: v.cast("double")) if histogram and histogram in rows.columns else F.lit(None).cast("array<double>")
    counts = F.coalesce(given, F.array_repeat(F.lit(0.0), bins))
    kept = rows.select("val", "item", F.transform("features", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"), counts.alias("c"))
    n = {r["val"]: r["n"] for r in kept.groupBy("val").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = max([-(-v // size) for v in n.values()] or [1])
    grouped = kept.groupBy("val", F.pmod(F.xxhash64(F.col("item").cast("string"), F.lit(seed)), F.lit(parts)).alias("batch")).agg(F.collect_list(F.struct("x", "y", "c")).alias("r"))
    return grouped.select("val", F.flatten("r.x").alias("x"), F.col("r.y").alias("y"), F.flatten("r.c").alias("c"))


def _rows(x: pa.Array, y: pa.Array, c: pa.Array, mean: np.ndarray, sd: np.ndarray, bins: int) -> Rows:
    flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
    labels = flat(y)
    z = (flat(x).reshape(len(labels), len(mean)) - mean) / sd
    return Rows(np.column_stack([z, np.ones(len(labels))]), labels, flat(c).reshape(-1, bins), np.asarray(y.value_lengths()))


@dataclass
class Head:
    """A fitted head and how it came about."""

    weights: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    log: list[tuple[int, float, float]] = field(default_factory=list)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd @ self.weights[:-1] + self.weights[-1]


def _direction(gradient: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two-loop recursion over remembered steps and changes of the gradient."""
    q, used = gradient.ravel().copy(), []
    for s, g in reversed(memory):
        a = (s @ q) / (s @ g)
        q -= a * g
        used.append(a)
    if memory:
        s, g = memory[-1]
        q *= (s @ g) / (g @ g)
    else:
        q /= max(1.0, float(np.linalg.norm(q)))
    for (s, g), a in zip(memory, reversed(used)):
        q += (a - (g @ q) / (s @ g)) * s
    return -q.reshape(gradient.shape)


def minimise(evaluate: Callable, head: np.ndarray, *, epochs: int, patience: int, min_delta: float, rates: list[float] | None = None):
    """The head of the best epoch and the log (epoch, loss, validation error).

    ``evaluate(heads)`` returns for each head its loss, gradient and validation
    error. ``rates`` are a schedule's, relative to its first: steps shrink by them.
    """
    loss, gradient, error = evaluate([head])[0]
    best, kept, waited, memory, log = (error, head, 0, [], [(0, loss, error)])
    for epoch in range(1, epochs + 1):
        rate = rates[min(epoch - 1, len(rates) - 1)] if rates else 1.0
        if rate <= 0:
            break
        way = _direction(gradient, memory)
        if float((way * gradient).sum()) >= 0:
            memory, way = [], -gradient / max(1.0, float(np.linalg.norm(gradient)))
        tried = [head + rate * t * way for t in STEPS]
        found = evaluate(tried)
        i = min(range(len(tried)), key=lambda i: found[i][0])
        if found[i][0] >= loss - 1e-12 * max(1.0, abs(loss)):
            if not memory:
                break
            memory = []  # the remembered curvature misleads; go down the gradient next
            continue
        s, g = (tried[i] - head).ravel(), (found[i][1] - gradient).ravel()
        if s @ g > 1e-10 * np.linalg.norm(s) * np.linalg.norm(g):
            memory = [*memory[-MEMORY + 1 :], (s, g)]
        head, (loss, gradient, error) = tried[i], found[i]
        log.append((epoch, loss, error))
        if error < best - min_delta:
            best, kept, waited = error, head, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return kept, log


def fit_head(
    train: DataFrame, val: DataFrame, loss: Loss, bins: np.ndarray, *, histogram: str | None = None, batch: int = 32, epochs: int = 40,
    patience: int = 5, min_delta: float = 1e-4, decay: float = 1e-4, rates: list[float] | None = None, seed: int = 0,
) -> Head:
    """A head on the arrays ``features``; both tables have item, label and maybe ``histogram``. Without validation rows the training error chooses."""
    mean, sd, _ = column_stats(train, "features", "label")
    columns = ["item", "features", "label"] + ([histogram] if histogram and histogram in train.columns else [])
    own = train.select(*columns, F.lit(0).alias("val"))
    other = val.select(*[c if c in val.columns else F.lit(None).alias(c) for c in columns], F.lit(1).alias("val"))
    data = batches(own.unionByName(other), histogram, len(bins), batch, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        constants = _constants(data, own, histogram, mean, sd, bins, loss)
        width = loss.width(len(bins))

        def evaluate_with(loss):
            def evaluate(heads):
                size = heads[0].size

                def block(flag, x, y, c):
                    out, flags = np.zeros((len(heads), size + 3)), flag.to_numpy()
                    for is_val in (0, 1):
                        some = pa.array(flags == is_val)
                        r = _rows(x.filter(some), y.filter(some), c.filter(some), mean, sd, len(bins))
                        if not len(r.y):
                            continue
                        for i, h in enumerate(heads):
                            o = r.x @ h
                            if not is_val:
                                value, slope = loss(o, r, constants, bins)
                                out[i, 0] += value
                                out[i, 3:] += (r.x.T @ slope).ravel()
                                continue
                            out[i, 1] += np.abs(np.clip(loss.score(o, bins), bins[0], bins[-1]) - r.y).sum()
                            out[i, 2] += len(r.y)
                    return out

                sums = array_sums(data, ["val", "x", "y", "c"], block, raw=True).reshape(len(heads), -1)
                out = []
                for h, s in zip(heads, sums):
                    shrunk = h.copy()
                    shrunk[-1] = 0
                    value, slope = s[0] + decay / 2 * float((shrunk**2).sum()), s[3:].reshape(h.shape) + decay * shrunk
                    out.append((value, slope, s[1] / s[2] if s[2] else value))
                return out

            return evaluate

        options = {"patience": patience, "min_delta": min_delta, "rates": rates}
        if isinstance(loss, Combined):
            logits, log = minimise(evaluate_with(Classes()), np.zeros((len(mean) + 1, len(bins))), epochs=epochs, **options)
            start = np.column_stack([np.zeros(len(logits)), logits])
            start[-1, 0] = constants.mean_y
            return _only_first(evaluate_with(loss), start, mean, sd, log, epochs, options)
        start = np.zeros((len(mean) + 1, width))
        loss.start(start, constants.mean_y)
        head, log = minimise(evaluate_with(loss), start, epochs=epochs, **options)
        return Head(head, mean, sd, log)
    finally:
        data.unpersist()


def _only_first(evaluate, start: np.ndarray, mean, sd, log, epochs: int, options: dict) -> Head:
    """Minimise over the first column, the others fixed."""
    rest = start[:, 1:]

    def first(columns):
        return [(value, slope[:, :1], error) for value, slope, error in evaluate([np.column_stack([c, rest]) for c in columns])]

    column, more = minimise(first, start[:, :1], epochs=epochs, **options)
    return Head(np.column_stack([column, rest]), mean, sd, log + more)


def _constants(data: DataFrame, train: DataFrame, histogram, mean, sd, bins: np.ndarray, loss: Loss) -> Constants:
    """One pass over the training batches; the floor of variances is the squared median of the labels' standard errors."""
    k, size = Constants(), len(bins)
    if isinstance(loss, Reliable):
        if histogram not in train.columns:
            raise ValueError("this loss needs the counts of ratings")
        se = histogram_stats(train.select(histogram), histogram, float(bins[0])).agg(F.percentile("se", F.lit(0.5))).first()[0]
        k.floor = float(se or 0.0) ** 2

    def block(flag, x, y, c):
        some = pa.array(flag.to_numpy() == 0)
        r = _rows(x.filter(some), y.filter(some), c.filter(some), mean, sd, size)
        n = r.counts.sum(1)
        pairs = pair_counts(r.y, r.sizes) if loss.pairs else 0
        weight = Reliable.weights(r.counts, bins, k.floor).sum() if isinstance(loss, Reliable) else 0.0
        return np.concatenate([[len(r.y), (n > 0).sum(), pairs, n.sum(), weight, r.y.sum()], np.bincount(classes_of(r.y, bins), minlength=size)])

    got = array_sums(data, ["val", "x", "y", "c"], block, raw=True)
    if got is None or not got[0]:
        raise ValueError("no training rows")
    k.n, k.rated, k.pairs, k.mean_n, k.mean_weight, k.mean_y = got[0], got[1], got[2], max(got[3] / got[0], 1e-12), got[4] / got[0], got[5] / got[0]
    counts = got[6:]
    raw = np.where(counts > 0, k.n / np.maximum(counts, 1), 0.0)
    k.classes = raw / raw[counts > 0].mean()
    k.class_total = float((k.classes * counts).sum())
    return k


def outputs(head: Head):
    """The head as a vectorised function of the feature column: an array of outputs."""

    @F.pandas_udf("array<double>")
    def apply(features):
        import pandas as pd

        x = np.array(features.tolist(), float).reshape(len(features), -1)
        return pd.Series(list(head.outputs(x))) if len(x) else pd.Series([], dtype=object)

    return apply
