"""Registered methods, and a run of one: fit, predict, check, score.

A method is fitted on training and validation rows and predicts rows without a
label, so test labels cannot reach it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.stats import average_ranks, clip, distribution_measures, expectation, mae, normalised, pearson, rmse, softmax
from plumbline.operators import heads as H
from plumbline.operators import kernels as K
from plumbline.operators import predictors as P
from plumbline.operators.inference import leak_check
from plumbline.operators.protocol import check_capabilities, explode_ratings, permuted_labels, split_sizes
from plumbline.plans.catalogue import ERAS, schedule
from plumbline.sources.spec import ItemSpec


@dataclass(frozen=True)
class Entry:
    name: str
    era: str
    requires: tuple[str, ...]
    factory: Callable
    reference: str = ""
    paper: str = ""
    trainable: bool = False
    notes: str = ""


_entries: dict[str, Entry] = {}


def register(name: str, era: str, requires: tuple[str, ...] = (), **facts):
    def add(factory):
        if name in _entries:
            raise ValueError(f"{name!r} is registered already")
        if era not in ERAS:
            raise ValueError(f"unknown era {era!r}; known: {', '.join(ERAS)}")
        _entries[name] = Entry(name, era, requires, factory, **facts)
        return factory

    return add


def entries(era: str | None = None) -> list[Entry]:
    """All methods, or those of an era, in the eras' order."""
    return sorted((e for e in _entries.values() if era in (None, e.era)), key=lambda e: (ERAS.index(e.era), e.name))


def schedule_names() -> set[str]:
    """The methods that are fitted in epochs."""
    return {e.name for e in _entries.values() if e.trainable}


def create(name: str, **options):
    """A new method of that name."""
    return get(name).factory(**options)


def get(name: str) -> Entry:
    if name not in _entries:
        near = [n for n in sorted(_entries) if name.lower() in n or n in name.lower()]
        raise KeyError(f"no method {name!r}" + (f"; did you mean {', '.join(near)}?" if near else f"; known: {', '.join(sorted(_entries))}"))
    return _entries[name]


class Method:
    """``fit(train, val, spec)``, then ``predict(rows)`` with item and score, and maybe a distribution.

    What an object holds after ``fit`` is the model: numbers, strings, arrays, tuples
    of them, the dataclasses of fitted parts, and tables. ``sources.models`` saves it.
    """

    seed = 0

    def fit(self, train: DataFrame, val: DataFrame, spec: ItemSpec) -> None:
        raise NotImplementedError

    def predict(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError


@register("mean-baseline", "baseline")
class MeanBaseline(Method):
    def fit(self, train, val, spec):
        self.mean = float(train.agg(F.avg("label")).first()[0])

    def predict(self, rows):
        return rows.select("item", F.lit(self.mean).alias("score"))


class _Features(Method):
    """Methods on an array column ``features``; scores are held to the scale."""

    def fit(self, train, val, spec):
        if "features" not in train.columns:
            raise ValueError("needs an array column features, which some network has made")
        self.ends = spec.score_range
        self.width = int(train.agg(F.max(F.size("features"))).first()[0] or 0)
        if self.width <= 0:
            raise ValueError("no training row has features")
        self._fit(train.select("item", "features", "label"))

    def predict(self, rows):
        return self._predict(rows.select("item", "features")).select("item", clip("score", *self.ends).alias("score"))


#: Key points of a face of 68, its mirrored pairs, its midline and its eyes.
KEY_POINTS = [0, 4, 8, 12, 16, 19, 24, 27, 30, 33, 36, 39, 42, 45, 48, 51, 54, 57, 62]
MIRRORED = [(0, 16), (4, 12), (19, 24), (36, 45), (39, 42), (48, 54), (31, 35)]
MIDLINE, LEFT_EYE, RIGHT_EYE = [27, 28, 29, 30], list(range(36, 42)), list(range(42, 48))
POINTS, REFERENCES = 68, 12


class _Geometric(Method):
    """Shallow models on the geometry of landmarks: features, standardised, the best by correlation, a model.

    ``landmarks`` is an array of 136 numbers, or of 68 arrays or structs of x and
    y. Where rows bring an array ``features`` it stands in for the geometry. A row
    without landmarks has zeros, whatever the others have.
    """

    best = 0

    def _geometry(self, points: str):
        raise NotImplementedError

    def _rows(self, rows: DataFrame, *more: str) -> DataFrame:
        if "features" not in rows.columns:
            kind = dict(rows.dtypes)[self.column]
            flat = F.col(self.column)
            if kind.startswith("array<array"):
                flat = F.flatten(flat)
            elif kind.startswith("array<struct"):
                flat = F.flatten(F.transform(flat, lambda p: F.array(p["x"], p["y"])))
            given = F.when(F.size(flat) == 2 * POINTS, P.points(flat, POINTS))
            rows = rows.withColumn("points", given).withColumn("face", P.normalised_points("points", LEFT_EYE, RIGHT_EYE))
            rows = self._geometry(rows.withColumn("distances", P.pair_distances("face", KEY_POINTS)))
            rows = rows.withColumn("features", F.when(F.col("points").isNotNull(), F.col("features")))
        values = F.transform("features", lambda x: x.cast("double"))
        if self.width:
            values = F.coalesce(values, F.array_repeat(F.lit(0.0), self.width))
        return rows.select("item", values.alias("features"), *more)

    def fit(self, train, val, spec):
        self.ends, self.column, self.width = spec.score_range, spec.landmarks, 0
        self.width = self._rows(train).agg(F.max(F.size("features"))).first()[0] or 0
        if self.width <= 0:
            raise ValueError("no training row has landmarks")
        rows = self._rows(train, "label")
        self.mean, self.sd, r = P.column_stats(rows, "features", "label")
        self.keep = np.argsort(-np.round(np.abs(r), 9), kind="stable")[: self.best].tolist()
        self._fit(self._chosen(rows))

    def _chosen(self, rows: DataFrame) -> DataFrame:
        """Only the features kept, standardised by the training rows."""
        kept = F.array(*[(F.get("features", F.lit(i)) - float(self.mean[i])) / float(self.sd[i]) for i in self.keep])
        return rows.withColumn("features", kept)

    def predict(self, rows):
        return self._predict(self._chosen(self._rows(rows))).select("item", clip("score", *self.ends).alias("score"))


@register("eisenthal2006", "classical", ("landmarks",), paper="https://doi.org/10.1162/089976606774841602", reference="Eisenthal, Dror and Ruppin 2006, Neural Computation 18(1)")
class NeighboursAndRidge(_Geometric):
    """Distances and symmetry; the mean of 15 nearest neighbours, weighted by 1/distance, and of ridge with penalty 10."""

    best = 60

    def _geometry(self, rows):
        return rows.withColumn("features", F.concat("distances", P.symmetry("face", MIRRORED, MIDLINE)))

    def _fit(self, train):
        # the training rows are the model: they stay cached as long as it is used
        self.train = train.persist()
        self.model = P.ridge_fit(self.train, "features", "label", len(self.keep), 10.0)

    def _predict(self, rows):
        near = P.knn_regression(self.train, rows, 15)
        return rows.join(near, "item").select("item", ((F.col("p") + P.linear("features", *self.model)) / 2).alias("score"))


@register("kagian2008", "classical", ("landmarks",), paper="https://www.sciencedirect.com/science/article/pii/S0042698907005032", reference="Kagian et al. 2008, Vision Research 48(2)")
class SupportVectors(_Geometric):
    """Distances; support-vector regression, cost 10 and band 0.1, with a kernel of the width that the number of features gives."""

    best = 100

    def _geometry(self, rows):
        return rows.withColumn("features", F.col("distances"))

    def _fit(self, train):
        self.model = K.support_vector_regression(train, gamma=1 / len(self.keep), c=10.0, epsilon=0.1)

    def _predict(self, rows):
        return rows.select("item", self.model.column()("features").alias("score"))


@register("fan2012", "classical", ("landmarks",), paper="https://doi.org/10.1016/j.patcog.2011.11.024", reference="Fan et al. 2012, Pattern Recognition 45(6)")
class PolynomialRidge(_Geometric):
    """Proportions; ridge with penalty 100 on those kept and the products of two."""

    best = 80

    def _geometry(self, rows):
        return rows.withColumn("features", P.proportions("distances", REFERENCES))

    def _fit(self, train):
        self.model = P.ridge_fit(train, "features", "label", len(self.keep), 100.0, P.products)

    def _predict(self, rows):
        return rows.select("item", P.predictor(self.model, P.products)("features").alias("score"))


class _Standardised(_Features):
    """Models on features that are standardised by the training rows."""

    def _fit(self, train):
        self.mean, self.sd, _ = P.column_stats(train, "features", "label")
        self._fit_scaled(self._scaled(train))

    def _scaled(self, rows: DataFrame) -> DataFrame:
        scale = F.arrays_zip(F.array(*[F.lit(float(m)) for m in self.mean]), F.array(*[F.lit(float(s)) for s in self.sd]))
        return rows.withColumn("features", F.zip_with("features", scale, lambda x, s: (x.cast("double") - s["0"]) / s["1"]))


@register("transfbp", "deep", (), notes="on features that some frozen network has made")
class BayesianRidge(_Standardised):
    """Ridge whose penalty follows from the evidence."""

    def _fit_scaled(self, train):
        self.model = P.bayesian_ridge_fit(train, "features", "label", self.width)

    def _predict(self, rows):
        return self._scaled(rows).select("item", P.linear("features", *self.model).alias("score"))


@register("gan2014", "deep", (), notes="support-vector regression on features that some frozen network has made")
class DeepSupportVectors(_Standardised):
    """Support-vector regression with cost 10 and band 0.1."""

    def _fit_scaled(self, train):
        self.model = K.support_vector_regression(train, gamma=1 / self.width, c=10.0, epsilon=0.1)

    def _predict(self, rows):
        return self._scaled(rows).select("item", self.model.column()("features").alias("score"))


_LINEAR = "a linear head on features that some frozen network has made"


class _Head(_Features):
    """A linear head with its loss, as long and in such batches as the method's schedule says.

    Where rows bring ``features_flipped``, a second view, the score is the mean of both.
    """

    name, loss, patience = "", H.Loss(), 5

    def __init__(self, epochs: int | None = None):
        self.epochs = epochs

    def fit(self, train, val, spec):
        self.bins = np.arange(spec.n_bins) + float(spec.score_range[0])
        self.ends, setup = spec.score_range, schedule(self.name)
        if "features" not in train.columns:
            raise ValueError("needs an array column features, which some network has made")
        rates = P.relative_rates(train.sparkSession, self.name)
        self.head = H.fit_head(
            train, val, self.loss, self.bins, histogram=spec.histogram, batch=setup["batch"], epochs=self.epochs or setup["epochs"],
            patience=self.patience, decay=setup["decay"], rates=rates, seed=self.seed,
        )

    def _score(self, o: str) -> Column:
        return expectation(self._shares(o), self.bins[0])

    def _shares(self, o: str) -> Column | None:
        at = range(self.head.weights.shape[1])[self.loss.distribution]
        return softmax(F.slice(o, at.start + 1, len(at))) if len(at) else None

    def predict(self, rows):
        of = H.outputs(self.head)
        views = [v for v in ("features", "features_flipped") if v in rows.columns]
        found = rows.select("item", *[of(v).alias(f"o{i}") for i, v in enumerate(views)])
        score = sum((self._score(f"o{i}") for i in range(1, len(views))), self._score("o0")) / len(views)
        out = [F.col("item"), clip(score, *self.ends).alias("score")]
        if self._shares("o0") is not None:
            out.append(self._shares("o0").alias("distribution"))
        return found.select(*out, *self._more())

    def _more(self) -> list[Column]:
        return []


@register("ldl-ren2017", "deep", ("distributions",), paper="https://www.ijcai.org/proceedings/2017/369", reference="Ren and Geng 2017, IJCAI", trainable=True, notes=_LINEAR)
class LabelDistribution(_Head):
    name, loss = "ldl-ren2017", H.Distribution()


@register("comboloss", "deep", (), paper="https://arxiv.org/abs/2010.10721", reference="Xu and Xiang 2020", trainable=True, notes=_LINEAR)
class CombinedLoss(_Head):
    name, loss = "comboloss", H.Combined()

    def _score(self, o):
        return F.get(o, F.lit(0))


@register("r3cnn", "deep", (), paper="https://doi.org/10.1109/TAFFC.2019.2933523", reference="Lin, Liang and Jin 2019", trainable=True, notes=_LINEAR)
class RankedRegression(_Head):
    name, loss = "r3cnn", H.Absolute(ranked=0.5)

    def _score(self, o):
        return F.get(o, F.lit(0))


@register("uol", "deep", (), paper="https://arxiv.org/abs/2409.00603", reference="Liang et al. 2024", trainable=True, notes=_LINEAR)
class UncertainOrder(_Head):
    """Its predictions also have ``uncertainty``, the standard deviation that it gives a score."""

    name, loss = "uol", H.Uncertain()

    def _more(self):
        return [F.exp(F.element_at("o0", -1) / 2).alias("uncertainty")]


@register("rw-ldl", "deep", ("distributions",), trainable=True, notes=_LINEAR)
class ReliabilityWeighted(_Head):
    name, loss = "rw-ldl", H.Reliable()


@register("rw-ldl-noweight", "deep", ("distributions",), trainable=True, notes=_LINEAR + "; every item weighs the same")
class ReliabilityUnweighted(_Head):
    name, loss = "rw-ldl-noweight", H.Reliable(weighted=False)


@register("rw-ldl-kl", "deep", ("distributions",), trainable=True, notes=_LINEAR + "; KL in place of the likelihood")
class ReliabilityDivergence(_Head):
    name, loss = "rw-ldl-kl", H.Reliable(likelihood=False)


@register("dinov2-linear", "foundation", (), paper="https://arxiv.org/abs/2304.07193", reference="Oquab et al. 2024", trainable=True, notes=_LINEAR)
class AbsoluteHead(_Head):
    name, loss = "dinov2-linear", H.Absolute()

    def _score(self, o):
        return F.get(o, F.lit(0))


@register("rater-dinov2", "foundation", ("ratings",), notes="rater effects and ridge on features that some frozen network has made")
class RaterRidge(_Features):
    """Ridge with penalty 1 on the quality that the training items have once their raters' offsets are taken off."""

    def fit(self, train, val, spec):
        quality = P.rater_effects(explode_ratings(train, "item", spec.ratings))[1]
        known = train.drop("label").join(quality.select("item", F.col("quality").alias("label")), "item")
        super().fit(known, val, spec)

    def _fit(self, train):
        self.model = P.ridge_fit(train, "features", "label", self.width, 1.0)

    def _predict(self, rows):
        return rows.select("item", P.linear("features", *self.model).alias("score"))


def evaluate(scored: DataFrame) -> dict[str, float | int]:
    """Point metrics of y and p; distribution measures too where there are both ``actual`` and ``predicted``."""
    count, bad = scored.agg(F.count("*"), F.sum(F.when(F.col("p").isNull() | F.isnan("p") | (F.abs("p") == float("inf")), 1).otherwise(0))).first()
    if not count:
        raise ValueError("nothing to score")
    if bad:
        raise ValueError(f"{bad} predictions are not finite")
    ranked = average_ranks(scored, {"p": "rp", "y": "ry"})
    out = [pearson("p", "y").alias("PC"), pearson("rp", "ry").alias("SROCC"), mae("p", "y").alias("MAE"), rmse("p", "y").alias("RMSE"), F.count("*").alias("n")]
    if {"actual", "predicted"} <= set(scored.columns):
        out += [F.avg(v).alias(k) for k, v in distribution_measures("predicted", "actual").items()]
    return ranked.agg(*out).first().asDict()


def run(name: str, roles: DataFrame, spec: ItemSpec, *, seed: int = 0, options: dict | None = None, keep: Callable | None = None) -> dict:
    """Fit and score one method on rows with a ``role``; the leak check stays outside the timed part.

    ``seed`` decides what a method draws and how the check deals the labels anew;
    ``keep(method, predictions)`` may store either before they are let go.
    """
    entry = get(name)
    check_capabilities(roles, entry.requires, spec)
    part = {r: roles.where(F.col("role") == r).drop("role") for r in ("train", "val", "test")}
    method, began = entry.factory(**(options or {})), time.time()
    method.seed = seed
    method.fit(part["train"], part["val"], spec)
    found = method.predict(part["test"].drop("label")).persist()
    predicted = found.count()
    seconds = time.time() - began
    dealt = permuted_labels(part["test"].select("item", "label"), f"{name}|{seed}").select("item", F.col("shuffled").alias("label"))
    shuffled = part["test"].drop("label").join(dealt, "item")
    if not leak_check(lambda rows: method.predict(rows), part["test"], shuffled):
        raise ValueError(f"{name} reads the test labels")
    test, given = [F.col("item"), F.col("label").alias("y")], [F.col("item"), F.col("score").alias("p")]
    if spec.histogram in part["test"].columns and "distribution" in found.columns:
        # items without ratings have no distribution to be compared with
        rated = F.exists(spec.histogram, lambda x: x > 0)
        test.append(F.when(rated, normalised(F.transform(spec.histogram, lambda x: x.cast("double")))).alias("actual"))
        given.append(F.col("distribution").alias("predicted"))
    scored = part["test"].select(*test).join(found.select(*given), "item")
    sizes = {r["role"]: r["n"] for r in split_sizes(roles).collect()}
    try:
        metrics = evaluate(scored)
        if not predicted == metrics["n"] == sizes.get("test"):
            raise ValueError(f"{name} gives {predicted} predictions for {sizes.get('test')} items")
        if keep:
            keep(method, found)
    finally:
        found.unpersist()
    return {"method": name, "era": entry.era, "metrics": metrics, "seconds": round(seconds, 1), "sizes": sizes}


def sweep(names: list[str], roles: DataFrame, spec: ItemSpec, **more) -> tuple[list[dict], dict[str, str]]:
    """Results, and what went wrong with the methods that failed; one failure does not stop the rest.

    ``options`` has those of some methods by name; ``keep`` is called with the name first.
    """
    done, failed = [], {}
    for name in names:
        try:
            own = {**more, "options": (more.get("options") or {}).get(name), "keep": partial(more["keep"], name) if more.get("keep") else None}
            done.append(run(name, roles, spec, **own))
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed
