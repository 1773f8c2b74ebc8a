"""A store of fitted methods: Parquet parts and a description, readable in another session.

A method's folder has ``arrays`` (its numbers, in parts of bounded size), a folder for
each table that belongs to the model, and ``about``: the method, the specification's
fingerprint, the library's version and how the parts go together. ``about`` is
written last, so a folder without it is no model.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import __version__
from plumbline.operators import heads, kernels, methods
from plumbline.sources.spec import ItemSpec

#: What may be a part of a model beside numbers, strings, arrays and tables.
PARTS = {c.__name__: c for c in (heads.Head, kernels.Kernel, kernels.KernelModel)}
#: Numbers of an array in one row.
CELLS = 1 << 16


def fingerprint(spec: ItemSpec) -> str:
    """A hash of what the specification says about labels and columns."""
    return hashlib.sha256(json.dumps(dataclasses.asdict(spec), sort_keys=True, default=list).encode()).hexdigest()


class _Writer:
    def __init__(self):
        self.arrays: list[np.ndarray] = []
        self.tables: list[DataFrame] = []

    def encoded(self, v):
        if isinstance(v, DataFrame):
            self.tables.append(v)
            return {"table": len(self.tables) - 1}
        if isinstance(v, np.ndarray):
            self.arrays.append(np.asarray(v, float))
            return {"array": len(self.arrays) - 1, "shape": list(v.shape)}
        if isinstance(v, np.generic):
            v = v.item()
        if v is None or isinstance(v, bool | int | float | str):
            return {"value": v}
        if isinstance(v, list | tuple):
            return {"tuple" if isinstance(v, tuple) else "list": [self.encoded(x) for x in v]}
        if type(v).__name__ in PARTS and dataclasses.is_dataclass(v):
            return {"part": type(v).__name__, "fields": {f.name: self.encoded(getattr(v, f.name)) for f in dataclasses.fields(v)}}
        raise TypeError(f"a {type(v).__name__} is no part of a model that can be saved")


def _decoded(e: dict, arrays: dict[int, np.ndarray], table):
    if "table" in e:
        return table(e["table"])
    if "array" in e:
        return arrays.get(e["array"], np.empty(0)).reshape(e["shape"])
    if "part" in e:
        return PARTS[e["part"]](**{k: _decoded(v, arrays, table) for k, v in e["fields"].items()})
    if "value" in e:
        return e["value"]
    made = [_decoded(x, arrays, table) for x in e.get("tuple", e.get("list"))]
    return tuple(made) if "tuple" in e else made


def save_model(spark: SparkSession, name: str, method: methods.Method, spec: ItemSpec, folder: str) -> str:
    """Write a fitted method; what was there of that name is replaced. Its path."""
    path, writer = f"{folder.rstrip('/')}/{name}", _Writer()
    state = {k: writer.encoded(v) for k, v in vars(method).items()}
    if not state:
        raise ValueError(f"{name} has not been fitted")
    parts = [(i, p, [float(x) for x in a.ravel()[p * CELLS : (p + 1) * CELLS]]) for i, a in enumerate(writer.arrays) for p in range(max(1, -(-a.size // CELLS)))]
    about = {"method": name, "specification": fingerprint(spec), "version": __version__, "spark": spark.version, "tables": len(writer.tables), "state": state}
    spark.createDataFrame([], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")  # from here on until the end there is no model
    for i, t in enumerate(writer.tables):
        t.write.mode("overwrite").parquet(f"{path}/table{i}")
    spark.createDataFrame(parts, "array int, part int, cells array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return path


def load_model(spark: SparkSession, name: str, spec: ItemSpec, folder: str) -> methods.Method:
    """The method as it was saved; one that was fitted under another specification is refused."""
    path = f"{folder.rstrip('/')}/{name}"
    lines = [r[0] for r in spark.read.text(f"{path}/about").collect()]  # one
    if len(lines) != 1:
        raise ValueError(f"{path} has no complete model")
    about = json.loads(lines[0])
    if about["method"] != name:
        raise ValueError(f"{path} has a model of {about['method']}, not of {name}")
    if about["specification"] != fingerprint(spec):
        raise ValueError(f"{path} was fitted under another specification")
    arrays: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{path}/arrays").collect(), key=lambda r: (r["array"], r["part"])):  # the model's own numbers
        arrays.setdefault(r["array"], []).extend(r["cells"])
    whole = {i: np.array(v, float) for i, v in arrays.items()}
    method = methods.create(name)
    for k, e in about["state"].items():
        setattr(method, k, _decoded(e, whole, lambda i: spark.read.parquet(f"{path}/table{i}")))
    return method


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """method, version, specification of every model of a folder."""
    about = spark.read.text(f"{folder.rstrip('/')}/*/about")
    fields = [F.get_json_object("value", f"$.{k}").alias(k) for k in ("method", "version", "specification")]
    return about.select(*fields)
