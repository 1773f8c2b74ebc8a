import numpy as np
import pytest

from plumbline.__main__ import main
from plumbline.operators import methods
from plumbline.sources.spec import ItemSpec


@pytest.fixture(scope="module")
def roles(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 4))
    y = np.clip(5 + x @ [1.0, -0.5, 0.2, 0.0] + rng.normal(size=90) * 0.2, 1, 10)
    counts = [np.bincount(np.clip(np.rint(y[i] + [-1, 0, 0, 1]), 1, 10).astype(int) - 1, minlength=10).tolist() if i != 8 else [0] * 10 for i in range(90)]
    rows = [(f"i{i}", x[i].tolist(), float(y[i]), "test" if i % 3 == 0 else "val" if i % 3 == 1 and i < 30 else "train", [0.0], [(j, float(y[i]) + j - 1) for j in range(3) if (i + j) % 4], counts[i], i) for i in range(90)]
    return spark.createDataFrame(rows, "item string, features array<double>, label double, role string, landmarks array<double>, ratings array<struct<rater_id: int, score: double>>, counts array<int>, number int").persist()


def test_every_method_runs_and_learns(roles):
    options = {n: {"epochs": 6} for n in methods.schedule_names()}
    done, failed = methods.sweep([e.name for e in methods.entries()], roles, ItemSpec(), options=options)
    assert not failed, failed
    by = {r["method"]: r["metrics"] for r in done}
    assert len(by) == 15 and {n for n, m in by.items() if "KL" in m} == {"ldl-ren2017", "comboloss", "uol", "rw-ldl", "rw-ldl-noweight", "rw-ldl-kl"}
    assert by["mean-baseline"]["PC"] == 0 and by["mean-baseline"]["n"] == 30
    assert all(m["PC"] > 0.7 for name, m in by.items() if name != "mean-baseline")


def test_rater_offsets_are_taken_off(roles):
    """Raters are a point apart and each item lacks another one of them: the fit is nearer to the labels than the items' means allow."""
    (found,), failed = methods.sweep(["rater-dinov2"], roles, ItemSpec())
    assert not failed and found["metrics"]["MAE"] < 0.3
    assert "ratings" in methods.sweep(["rater-dinov2"], roles.drop("ratings"), ItemSpec())[1]["rater-dinov2"]


def test_refusals(roles):
    done, failed = methods.sweep(["fan2012", "mean-baseline"], roles.drop("landmarks"), ItemSpec())
    assert [r["method"] for r in done] == ["mean-baseline"] and "landmarks" in failed["fan2012"]
    with pytest.raises(KeyError, match="did you mean fan2012"):
        methods.get("fan")
    with pytest.raises(ValueError, match="already"):
        methods.register("fan2012", "classical")(object)
    with pytest.raises(ValueError, match="unknown era"):
        methods.register("new", "future")(object)


def test_scores_must_be_finite(spark):
    with pytest.raises(ValueError, match="1 predictions"):
        methods.evaluate(spark.createDataFrame([(1.0, float("nan")), (1.0, 2.0)], "y double, p double"))
    with pytest.raises(ValueError, match="nothing"):
        methods.evaluate(spark.createDataFrame([], "y double, p double"))


def test_distributions_count_where_both_are_there(spark):
    df = spark.createDataFrame([(2.0, 2.5, [0.5, 0.5], [0.5, 0.5]), (3.0, 2.0, [0.2, 0.8], [0.2, 0.8])], "y double, p double, actual array<double>, predicted array<double>")
    found = methods.evaluate(df)
    assert found["n"] == 2 and found["KL"] == pytest.approx(0, abs=1e-9)
    assert "KL" not in methods.evaluate(df.drop("actual"))


def test_command_line(spark, roles, tmp_path, capsys):
    assert main(["list"]) == 0 and "mean-baseline" in capsys.readouterr().out
    roles.write.parquet(str(tmp_path / "items"))
    assert main(["run", "--items", str(tmp_path / "items"), "--method", "mean-baseline", "none", "--out", str(tmp_path / "runs")]) == 1
    capsys.readouterr()
    assert main(["report", str(tmp_path / "runs")]) == 0
    text = capsys.readouterr().out
    assert "| mean-baseline | baseline | 0.0000 |" in text
    (tmp_path / "doc.md").write_text(text)
    assert main(["report", str(tmp_path / "runs"), "--check", str(tmp_path / "doc.md")]) == 0
    (tmp_path / "doc.md").write_text("stale")
    assert main(["report", str(tmp_path / "runs"), "--check", str(tmp_path / "doc.md")]) == 1
    from plumbline.__main__ import MARKS

    (tmp_path / "doc.md").write_text("\n".join(["before", *MARKS, "after"]))
    assert main(["report", str(tmp_path / "runs"), "--update", str(tmp_path / "doc.md")]) == 0
    assert main(["report", str(tmp_path / "runs"), "--check", str(tmp_path / "doc.md")]) == 0
    assert (tmp_path / "doc.md").read_text().startswith("before") and (tmp_path / "doc.md").read_text().endswith("after")


def test_command_line_protocols(spark, roles, tmp_path, capsys):
    """Raw items: splits of one set, a label of another name, holdout or a fold; a fold that does not exist is refused."""
    raw = roles.drop("role").withColumnRenamed("label", "beauty").selectExpr("*", "number % 4 as fold", "case when number % 3 = 0 then 'test' when number % 3 = 1 then 'val' else 'train' end as split")
    for k in range(2):
        raw.where(f"number % 2 = {k}").write.parquet(str(tmp_path / f"part{k}"))
    files = [str(tmp_path / "part0"), str(tmp_path / "part1")]
    common = ["run", "--items", *files, "--method", "mean-baseline", "--label", "beauty", "--out", str(tmp_path / "runs")]
    assert main([*common, "--protocol", "holdout"]) == 0
    assert '"n": 30' in capsys.readouterr().out
    for k in range(4):
        assert main([*common, "--protocol", "cv", "--fold", str(k)]) == 0
    with pytest.raises(ValueError, match="0..3, got 4"):
        main([*common, "--protocol", "cv", "--fold", "4"])
    capsys.readouterr()
    assert main(["report", str(tmp_path / "runs")]) == 0
    text = capsys.readouterr().out
    assert "## Cross-validation, 4 folds" in text and "label beauty, holdout" in text
    assert main(["run", "--items", *files, "--era", "classical", "--skip-slow", "--label", "beauty", "--protocol", "cv", "--fold", "0", "--keep-going"]) == 0
    assert capsys.readouterr().out.count('"method"') == 3
    assert main(["list", "--markdown", "--era", "classical"]) == 0 and "kagian2008" in capsys.readouterr().out


def test_methods_on_landmarks(spark):
    """Faces of 68 points, whose label is a distance; a face without landmarks gets a score too, and test labels stay out."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(68, 2)) * 3
    faces = base + rng.normal(size=(120, 68, 2)) * 0.05
    wide = rng.normal(size=120)
    faces[:, 48, 0] -= wide * 0.4
    label = np.clip(5 + wide, 1, 10)
    rows = [(i, [[float(a) for a in p] for p in faces[i]] if i != 3 else None, float(label[i]), "test" if i % 3 == 0 else "train") for i in range(120)]
    items = spark.createDataFrame(rows, "item int, landmarks array<array<double>>, label double, role string").persist()
    done, failed = methods.sweep(["eisenthal2006", "kagian2008", "fan2012"], items, ItemSpec())
    assert not failed and [r["metrics"]["n"] for r in done] == [40] * 3
    assert all(r["metrics"]["PC"] > 0.7 for r in done), done
    flat = items.selectExpr("item", "flatten(landmarks) as landmarks", "label", "role")
    again = methods.run("kagian2008", flat, ItemSpec())["metrics"]
    assert again["PC"] == pytest.approx(done[1]["metrics"]["PC"], abs=1e-6)
    with pytest.raises(ValueError, match="no training row"):
        methods.run("fan2012", items.withColumn("landmarks", items.landmarks.cast("string")).selectExpr("item", "cast(null as array<double>) as landmarks", "label", "role"), ItemSpec())
    assert type(methods.create("fan2012")).__name__ == "PolynomialRidge"
