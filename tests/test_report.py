import json

import pytest

from plumbline.operators import report as T
from plumbline.plans import catalogue
from plumbline.sources import results as F


def _write(folder, name, **values):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(values, indent=1))


def test_run_files(spark, tmp_path):
    """Folders of folds; what is not a run is passed over, and a metric that no fold has stays empty."""
    found = {"near": (0.25, 0.75), "far": (0.5, 0.5)}
    for method, values in found.items():
        for k, v in enumerate(values):
            _write(tmp_path / f"fold{10 * k}", method, method=method, era="classical", metrics={"PC": v, "RMSE": 2.0})
    _write(tmp_path / "fold0", "notes", text="no metrics")
    (tmp_path / "fold0" / "broken.txt").write_text("not JSON")
    runs = F.read_folds(spark, str(tmp_path))
    assert sorted((r["method"], r["fold"], r["metrics"]["PC"]) for r in runs.collect()) == [("far", 0, 0.5), ("far", 10, 0.5), ("near", 0, 0.25), ("near", 10, 0.75)]
    flat = runs.select("method", "fold", *[f"metrics.{m}" for m in T.POINT])
    # equal means stand in the methods' order
    assert T.fold_summary_text(flat).splitlines()[2:] == ["| far | 0.5000 ± 0.0000 | -- | -- | 2.0000 ± 0.0000 |", "| near | 0.5000 ± 0.2500 | -- | -- | 2.0000 ± 0.0000 |"]


def test_missing_folder_is_empty(spark, tmp_path):
    assert F.read_runs(spark, str(tmp_path / "none")).count() == 0
    assert F.read_folds(spark, str(tmp_path / "none")).count() == 0


def test_leaderboard_order(spark):
    """Eras in their order, PC falling within one, ties by name, no PC after any, unknown eras at the end."""
    rows = [("z", "foundation", -0.2), ("b", "foundation", 0.4), ("a", "foundation", 0.4), ("gone", "foundation", None), ("q", "elsewhere", 0.99), ("m", "classical", 0.01), ("gone2", "classical", None)]
    runs = spark.createDataFrame([(*r, 0.0, 0.0, 0.0, 12.34) for r in rows], "method string, era string, PC double, SROCC double, MAE double, RMSE double, seconds double")
    lines = T.leaderboard_text(runs, catalogue.era_order(spark)).splitlines()
    assert lines[0].endswith("| RMSE | seconds |")
    assert [line.split(" | ")[0].strip("| ") for line in lines[2:]] == ["m", "gone2", "a", "b", "z", "gone", "q"]
    assert lines[3] == "| gone2 | classical | -- | 0.0000 | 0.0000 | 0.0000 | 12.3 |"


def test_blocks(tmp_path):
    doc, marks = "# Title\n[[\nfirst\n]]\nbetween [[ and ]] after\n", ("[[", "]]")
    new = T.replace_block(doc, *marks, "| 1 | \\2 |\n")
    assert new == "# Title\n[[\n\n| 1 | \\2 |\n]]\nbetween [[ and ]] after\n"
    assert T.is_stale(doc, "| 1 |") and not T.is_stale(new, "| 1 |")
    for text in ("nothing", "]] before [[", "[[ open"):
        with pytest.raises(ValueError, match="no block"):
            T.replace_block(text, *marks, "x")
    path = tmp_path / "doc.md"
    path.write_text(doc)
    assert T.update_file(str(path), *marks, "x") and not T.update_file(str(path), *marks, "x")
    assert path.read_text().startswith("# Title\n[[\n\nx\n]]")


def test_report_sections(spark, tmp_path):
    """Every configuration has its line, folds are counted over all methods, and a brief report has the folds alone."""
    for name, commit, pc in (("one", "a" * 40, 0.5), ("two", "a" * 40, 0.25), ("three", None, 0.75)):
        _write(tmp_path, name, method=name, era="deep", metrics={"PC": pc}, seconds=1.0, dataset="d", config="c", label="y", protocol="holdout", environment={"git_commit": commit})
    eras = catalogue.era_order(spark)
    empty = F.read_folds(spark, str(tmp_path / "cv"))
    text = T.report_text(F.read_runs(spark, str(tmp_path)), empty, eras)
    assert "- 2 runs on d, configuration c, label y, holdout, at commit aaaaaaaaaaaa" in text and "- 1 runs on d, configuration c, label y, holdout, at commit unknown" in text
    assert "Cross" not in text and T.report_text(F.read_runs(spark, str(tmp_path)), empty, eras, brief=True) == "No cross-validation results."
    for k in range(3):
        _write(tmp_path / "cv" / f"fold{k}", "one", method="one", era="deep", metrics={"PC": 0.5})
    _write(tmp_path / "cv" / "fold0", "two", method="two", era="deep", metrics={"PC": 0.5})
    folds = F.read_folds(spark, str(tmp_path / "cv"))
    brief = T.report_text(F.read_runs(spark, str(tmp_path)), folds, eras, brief=True)
    assert brief.startswith("## Cross-validation, 3 folds") and "Holdout" not in brief
    assert brief in T.report_text(F.read_runs(spark, str(tmp_path)), folds, eras)


def test_methods_text():
    from plumbline.operators import methods

    text = T.methods_text(methods.entries())
    assert text.index("## baseline") < text.index("## classical") < text.index("## deep")
    assert "| fan2012 | [Fan et al. 2012, Pattern Recognition 45(6)](https://doi.org/10.1016/j.patcog.2011.11.024) | landmarks | -- |" in text
    assert "eisenthal2006" not in T.methods_text(methods.entries("baseline"))


def test_predictions_by_key(spark, tmp_path):
    items = spark.createDataFrame([(1,), (2,)], "item int")
    F.write_predictions(spark.createDataFrame([(2, 0.5), (1, 0.25)], "item int, score double"), str(tmp_path / "p"))
    assert {r["item"]: r["score"] for r in F.read_predictions(spark, str(tmp_path / "p"), items).collect()} == {1: 0.25, 2: 0.5}
    with pytest.raises(ValueError, match="stale"):
        F.read_predictions(spark, str(tmp_path / "p"), spark.createDataFrame([(3,)], "item int"))
    with pytest.raises(ValueError, match="other items"):
        F.read_predictions(spark, str(tmp_path / "p"), items.where("item = 1"))
    twice = spark.createDataFrame([(2, 0.5), (1, 0.25), (1, 0.5)], "item int, score double")
    F.write_predictions(twice, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="several"):
        F.read_predictions(spark, str(tmp_path / "r"), items)
    with pytest.raises(Exception, match="not finite"):
        F.write_predictions(spark.createDataFrame([(1, float("nan"))], "item int, score double"), str(tmp_path / "q"))


def test_catalogue():
    assert len({m[0] for m in catalogue.METHODS}) == 23
    assert {m[1] for m in catalogue.METHODS} == set(catalogue.ERAS)


def test_environment(spark):
    found = F.environment(spark)
    assert found["spark"] == found["packages"]["pyspark"] == spark.version
    assert set(found) >= {"timestamp", "git_commit", "git_tree_dirty", "reproducible_from_commit", "python", "platform", "cpus"}
