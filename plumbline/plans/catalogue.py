"""The methods and their schedules, as stated facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ERAS = ("baseline", "classical", "deep", "foundation")

# Method, era, source, optimiser, learning rate, weight decay, batch, epochs (60 at most), backbone, schedule.
METHODS = [
    ("aanet", "deep", "paper", "sgd", 0.1, 0.0001, 32, 40, "resnet18", "warmup_linear"),
    ("cnn-resnet18", "deep", "paper", "sgd", 0.01, 0.0001, 32, 40, "resnet18", "cosine"),
    ("cnn-resnext50", "deep", "paper", "sgd", 0.01, 0.0001, 32, 40, "resnext50", "cosine"),
    ("comboloss", "deep", "paper", "sgd", 0.01, 0.001, 64, 60, "resnext50", "step_50"),
    ("dinov2-linear", "foundation", "adapted", "adamw", 0.001, 0.0001, 32, 40, "facebook/dinov2-base", "cosine"),
    ("dinov2-partial", "foundation", "adapted", "adamw", 1e-05, 0.0001, 16, 30, "facebook/dinov2-base", "cosine"),
    ("eisenthal2006", "classical", "adapted", None, None, None, None, None, None, None),
    ("fan2012", "classical", "adapted", None, None, None, None, None, None, None),
    ("fpem", "deep", "paper", "adamw", 5e-05, 0.0001, 32, 50, "resnet18", "warmup_cosine"),
    ("gan2014", "deep", "adapted", "adamw", 0.0001, 0.0001, 32, 20, "resnet18", "cosine"),
    ("kagian2008", "classical", "adapted", None, None, None, None, None, None, None),
    ("ldl-ren2017", "deep", "adapted", "adamw", 0.0001, 0.0001, 32, 30, "resnet18", "cosine"),
    ("mean-baseline", "baseline", "default", None, None, None, None, None, None, None),
    ("pi-cnn", "deep", "adapted", "sgd", 0.01, 0.0001, 32, 40, "resnet18", "cosine"),
    ("r3cnn", "deep", "adapted", "sgd", 0.01, 0.0001, 32, 40, "resnet18", "cosine"),
    ("rater-dinov2", "foundation", "adapted", "adamw", 1e-05, 0.0001, 16, 30, "facebook/dinov2-base", "cosine"),
    ("rw-ldl", "deep", "default", "adamw", 0.0001, 0.0001, 32, 30, "resnet18", "cosine"),
    ("rw-ldl-kl", "deep", "default", "adamw", 0.0001, 0.0001, 32, 30, "resnet18", "cosine"),
    ("rw-ldl-noweight", "deep", "default", "adamw", 0.0001, 0.0001, 32, 30, "resnet18", "cosine"),
    ("transfbp", "deep", None, None, None, None, None, None, None, None),
    ("uol", "deep", "paper", "adamw", 0.0001, 0.0001, 32, 60, "vgg16", "cosine"),
    ("vit-fbp", "foundation", "adapted", "adamw", 3e-05, 0.0001, 16, 25, "vit_b_16", "cosine"),
    ("xattn-vit", "foundation", "adapted", "adamw", 3e-05, 0.05, 16, 25, "vit_b_16", "cosine"),
]
_FIELDS = "method string, era string, source string, optimiser string, lr double, decay double, batch int, epochs int, backbone string, schedule string"


def setups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHODS, _FIELDS)


def schedule(method: str) -> dict:
    """The fields of a method's schedule; a method without one is an error."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    for row in METHODS:
        if row[0] == method and row[2] is not None:
            return dict(zip(names, row))
    raise KeyError(f"no schedule for {method!r}")


def era_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, i) for i, e in enumerate(ERAS)], "era string, era_order int")


def values_sql() -> str:
    """The same table as a SQL VALUES list."""
    show = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    rows = ", ".join("(" + ", ".join(map(show, m)) + ")" for m in METHODS)
    return f"(values {rows}) as m(method, era, source, optimiser, lr, decay, batch, epochs, backbone, schedule)"
