"""Heads, kernels, neighbours and the stores of models and predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.operators import heads as H
from plumbline.operators import kernels as K
from plumbline.operators import methods
from plumbline.operators import predictors as P
from plumbline.sources import models, results
from plumbline.sources.spec import ItemSpec

BINS = np.arange(1.0, 11.0)
LOSSES = [H.Distribution(), H.Classes(), H.Absolute(), H.Absolute(ranked=0.5), H.Combined(), H.Uncertain(), H.Reliable(), H.Reliable(weighted=False), H.Reliable(likelihood=False)]


def _batch(seed, rated=True):
    rng = np.random.default_rng(seed)
    sizes = np.array([5, 1, 9, 7])
    n = sizes.sum()
    counts = rng.integers(0, 5, (n, 10)).astype(float)
    counts[3] = 0
    counts *= rated
    y = np.round(rng.uniform(1, 10, n), 1)
    rows = H.Rows(rng.normal(size=(n, 4)), y, counts, sizes)
    k = H.Constants(n=n, rated=float((counts.sum(1) > 0).sum()), pairs=H.pair_counts(y, sizes), mean_n=7.0, floor=0.05, mean_weight=3.0, mean_y=5.0, classes=rng.uniform(0.5, 2, 10), class_total=20.0)
    return rows, k, rng


@pytest.mark.parametrize("loss", LOSSES, ids=lambda x: type(x).__name__)
@pytest.mark.parametrize("rated", [True, False])
def test_gradients_against_differences(loss, rated):
    rows, k, rng = _batch(1, rated)
    o = rng.normal(size=(len(rows.y), loss.width(10))) + 0.3
    value, slope = loss(o, rows, k, BINS)
    columns = [0] if isinstance(loss, H.Combined) else range(o.shape[1])  # the logits of the combined loss stay
    for i in range(len(o)):
        for j in columns:
            up, down = o.copy(), o.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            numeric = (loss(up, rows, k, BINS)[0] - loss(down, rows, k, BINS)[0]) / 2e-6
            assert slope[i, j] == pytest.approx(numeric, abs=2e-6)
    assert np.isfinite(value)


def test_ranking_is_the_sum_over_pairs():
    rows, k, rng = _batch(2)
    p = rng.normal(size=len(rows.y))
    loss, pairs, start = 0.0, 0, 0
    for size in rows.sizes:
        for i in range(start, start + size):
            for j in range(i + 1, start + size):
                if abs(gap := rows.y[i] - rows.y[j]) > 0.1:
                    pairs += 1
                    loss += max(0.0, -np.sign(gap) * (p[i] - p[j]) + 0.1)
        start += size
    assert H.pair_counts(rows.y, rows.sizes) == pairs and H.ranking(p, rows.y, rows.sizes)[0] == pytest.approx(loss)


def test_losses_are_what_they_say():
    rows, k, rng = _batch(3)
    o = rng.normal(size=(len(rows.y), 10))
    p, log_p = H.softmax(o)
    shares = rows.counts / np.maximum(rows.counts.sum(1), 1)[:, None]
    rated = rows.counts.sum(1) > 0
    kl = np.where(shares > 0, shares * (np.log(np.where(shares > 0, shares, 1)) - log_p), 0).sum(1)
    assert H.Distribution()(o, rows, k, BINS)[0] == pytest.approx(kl[rated].mean())
    c = H.classes_of(rows.y, BINS)
    assert c.tolist() == [round(v) - 1 for v in rows.y]
    w = k.classes[c]
    assert H.Classes()(o, rows, k, BINS)[0] == pytest.approx(-(w * log_p[np.arange(len(c)), c]).sum() / 20.0)
    e = p @ BINS
    flat = H.Reliable(weighted=False)(o, rows, k, BINS)[0]
    assert flat == pytest.approx((-(rows.counts * log_p).sum(1) / 7.0).mean() + np.abs(e - rows.y).mean())


def test_minimise_finds_the_least_and_keeps_the_best_epoch():
    target = np.array([[1.0], [-2.0], [0.5]])
    scale = np.array([[1.0], [30.0], [5.0]])

    def evaluate(heads):
        return [(float((scale * (h - target) ** 2).sum()), 2 * scale * (h - target), float(np.abs(h - target).sum())) for h in heads]

    head, log = H.minimise(evaluate, np.zeros((3, 1)), epochs=60, patience=60, min_delta=0.0)
    assert np.allclose(head, target, atol=1e-3) and [r[0] for r in log] == sorted({r[0] for r in log})
    rising = lambda heads: [(v, g, 1.0 + np.abs(h).sum()) for (v, g, _), h in zip(evaluate(heads), heads)]
    head, log = H.minimise(rising, np.zeros((3, 1)), epochs=60, patience=3, min_delta=1e-4)
    assert not head.any() and len(log) == 4  # nothing after the start is better by validation; three more epochs were tried


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 3)) * [1, 5, 0.2] + [0, 3, 0]
    y = np.clip(5.5 + x @ [1.2, -0.2, 2.0] + rng.normal(size=160) * 0.1, 1, 10)
    counts = [np.bincount(np.clip(np.rint(v + rng.normal(size=8) * 0.7), 1, 10).astype(int) - 1, minlength=10).tolist() for v in y]
    rows = [(f"i{i}", x[i].tolist(), float(y[i]), counts[i], i) for i in range(160)]
    return spark.createDataFrame(rows, "item string, features array<double>, label double, counts array<int>, n int").persist()


def test_a_distributed_fit_is_the_fit_of_all_rows(rated):
    """The same head from any partitioning, and near the least of its loss by a local search."""
    train, val = rated.where("n % 4 <> 0"), rated.where("n % 4 = 0")
    a = H.fit_head(train, val, H.Distribution(), BINS, histogram="counts", epochs=25)
    b = H.fit_head(train.repartition(7), val, H.Distribution(), BINS, histogram="counts", epochs=25)
    assert np.allclose(a.weights, b.weights, atol=1e-5) and len(a.log) > 5
    losses = [r[1] for r in a.log]
    assert losses == sorted(losses, reverse=True)
    rows = train.toPandas()
    x = np.column_stack([(np.array(rows.features.tolist()) - a.mean) / a.sd, np.ones(len(rows))])
    whole = H.Rows(x, rows.label.to_numpy(), np.array(rows.counts.tolist(), float), np.array([len(rows)]))
    k = H.Constants(n=len(rows), rated=len(rows))
    own = H.Distribution()(x @ a.weights, whole, k, BINS)[0] + 1e-4 / 2 * float((a.weights[:-1] ** 2).sum())
    assert min(abs(own - v) for v in losses) < 1e-9 and own < 0.6 * losses[0]


def test_heads_emit_distributions_and_uncertainty(spark, rated):
    method = methods.create("uol", epochs=10)
    method.fit(rated.where("n % 4 > 1"), rated.where("n % 4 = 1"), ItemSpec())
    found = method.predict(rated.where("n % 4 = 0").drop("label")).collect()
    assert all(sum(r["distribution"]) == pytest.approx(1) and len(r["distribution"]) == 10 and r["uncertainty"] > 0 for r in found)
    plain = methods.create("dinov2-linear", epochs=10)
    plain.fit(rated.where("n % 4 > 1"), rated.where("n % 4 = 1"), ItemSpec())
    two = rated.where("n % 4 = 0").withColumn("features_flipped", F.transform("features", lambda v: v * 0.9))
    one = {r["item"]: r["score"] for r in plain.predict(two.drop("features_flipped")).collect()}
    other = {r["item"]: r["score"] for r in plain.predict(two.select("item", F.col("features_flipped").alias("features"))).collect()}
    both = {r["item"]: r["score"] for r in plain.predict(two).collect()}
    assert all(both[i] == pytest.approx((one[i] + other[i]) / 2) for i in both if 1 < min(one[i], other[i]) and max(one[i], other[i]) < 10)
    with pytest.raises(KeyError, match="no schedule for 'transfbp'"):
        P.relative_rates(spark, "transfbp")
    with pytest.raises(ValueError, match="counts of ratings"):
        H.fit_head(rated.drop("counts"), rated.drop("counts"), H.Reliable(), BINS, histogram="counts", epochs=2)


def _dual(kernel, y, c, epsilon, rounds=4000):
    """The dual of support-vector regression by exact steps on pairs, which keep the sum at zero."""
    n = len(y)
    b = np.zeros(n)
    for _ in range(rounds):
        g = y - kernel @ b
        # the steepest feasible pair, up for one and down for another
        up = np.where(b < c, g - epsilon * np.where(b >= 0, 1, -1), -np.inf)
        down = np.where(b > -c, g - epsilon * np.where(b > 0, 1, -1), np.inf)
        i, j = int(up.argmax()), int(down.argmin())
        if up[i] - down[j] < 1e-7:
            break
        curve = kernel[i, i] + kernel[j, j] - 2 * kernel[i, j]
        step = (up[i] - down[j]) / max(curve, 1e-12)
        limits = [c - b[i], b[j] + c, step]
        if b[i] < 0:
            limits.append(-b[i])
        if b[j] > 0:
            limits.append(b[j])
        step = min(limits)
        b[i] += step
        b[j] -= step
    return float(b @ y - epsilon * np.abs(b).sum() - b @ kernel @ b / 2), b


def test_support_vectors_against_a_quadratic_program(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, 2))
    y = np.sin(2 * x[:, 0]) + 0.3 * x[:, 1] + rng.normal(size=70) * 0.3 + 4
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "features array<double>, label double").repartition(5).persist()
    model = K.support_vector_regression(df, gamma=0.5, c=2.0, epsilon=0.1)
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    best, b = _dual(kernel, y, 2.0, 0.1)
    r = y - model(x)
    primal = float(model.weights @ model.weights) / 2 + 2.0 * np.maximum(np.abs(r) - 0.1, 0).sum()
    assert best <= primal * (1 + 1e-7) and primal == pytest.approx(best, rel=3e-4)
    assert (primal - best) / primal <= model.gap + 1e-7 and model.gap <= 1e-3
    shift = np.median((y - kernel @ b)[(np.abs(b) > 1e-6) & (np.abs(b) < 2 - 1e-6)] - 0.1 * np.sign(b[(np.abs(b) > 1e-6) & (np.abs(b) < 2 - 1e-6)]))
    assert np.abs(model(x) - (kernel @ b + shift)).max() < 0.02
    found = [r[0] for r in df.select(model.column()("features")).collect()]
    assert sorted(found) == pytest.approx(sorted(model(x)))


def test_one_kernel_method_at_every_size(spark):
    """All rows as the basis: exact; some of them: near it, and no other method."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1]
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(400)], "features array<double>, label double").persist()
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    exact = kernel @ np.linalg.solve(kernel + 0.1 * np.eye(400), y - y.mean()) + y.mean()
    p = {m: K.kernel_ridge(df, gamma=0.5, alpha=0.1, basis=m)(x) for m in (400, 60)}
    assert np.abs(p[400] - exact).max() < 1e-3
    assert np.abs(p[60] - exact).mean() < 0.02
    a, b = (K.support_vector_regression(df, gamma=0.5, basis=m)(x) for m in (400, 60))
    assert np.abs(a - b).mean() < 0.05 and np.corrcoef(a, y)[0, 1] > 0.99
    with pytest.raises(ValueError, match="no training rows"):
        K.kernel_ridge(df.limit(0), gamma=1.0, alpha=1.0)


@pytest.mark.parametrize("cells,block", [(1, 8192), (6, 8192), (6, 11)])
def test_neighbours_against_all_pairs(spark, cells, block):
    """String ids, ties, copies of a row; any cells and blocks give what comparing all rows does."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(150, 3)) + 4 * rng.integers(0, 4, 150)[:, None], 1)
    x[100:120] = x[80:100]
    rows = [(f"n{i}", x[i].tolist(), float(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "item string, features array<double>, label double").repartition(4)
    train, test = df.where("label >= 40"), df.where("label < 40")
    found = P.nearest(train, test, 7, cells=cells, block_rows=block)
    got = {i: [] for i in range(40)}
    for r in sorted(found.collect(), key=lambda r: r["r"]):
        got[int(r["item"][1:])].append((r["t"], r["d"]))
    for q in range(40):
        d = [(round(float(np.sqrt(((x[q] - x[t]) ** 2).sum())), 9), f"n{t}") for t in range(40, 150)]
        assert [(t, v) for v, t in sorted(d)[:7]] == got[q]
    few = P.nearest(train.limit(3), test, 7, cells=cells, block_rows=block)
    assert few.count() == 3 * 40
    with pytest.raises(ValueError, match="no training rows"):
        P.nearest(train.limit(0), test, 3)


def _landmarked(spark):
    rng = np.random.default_rng(4)
    faces = rng.normal(size=(68, 2)) * 3 + rng.normal(size=(60, 68, 2)) * 0.3
    wide = rng.normal(size=60)
    faces[:, 48, 0] -= wide * 0.4
    return spark.createDataFrame([(f"i{i}", faces[i].ravel().tolist(), float(np.clip(5 + wide[i], 1, 10)), i) for i in range(60)], "item string, landmarks array<double>, label double, n int")


def test_saved_models_predict_the_same(spark, rated, tmp_path):
    """Every registered method, fitted, saved and read again; a foreign specification or half a model is refused."""
    ratings = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.struct(j.alias("rater_id"), (F.col("label") + j / 10).alias("score")))
    tables = {True: _landmarked(spark).persist(), False: rated.withColumn("ratings", ratings).persist()}
    spec = ItemSpec()
    for entry in methods.entries():
        rows = tables["landmarks" in entry.requires]
        method = entry.factory(**({"epochs": 2} if entry.trainable else {}))
        method.fit(rows.where("n % 3 > 0"), rows.where("n % 6 = 0"), spec)
        models.save_model(spark, entry.name, method, spec, str(tmp_path))
        again = models.load_model(spark.newSession(), entry.name, spec, str(tmp_path))
        scores = lambda m, rows=rows: {r["item"]: r["score"] for r in m.predict(rows.where("n % 3 = 0").drop("label")).collect()}
        assert scores(again) == pytest.approx(scores(method)), entry.name
    listed = models.saved(spark, str(tmp_path)).collect()
    assert sorted(r["method"] for r in listed) == sorted(e.name for e in methods.entries())
    with pytest.raises(ValueError, match="another specification"):
        models.load_model(spark, "mean-baseline", ItemSpec(score_range=(1.0, 5.0)), str(tmp_path))
    spark.createDataFrame([], "about string").write.mode("overwrite").text(str(tmp_path / "fan2012" / "about"))
    with pytest.raises(ValueError, match="no complete model"):
        models.load_model(spark, "fan2012", spec, str(tmp_path))
    with pytest.raises(ValueError, match="has not been fitted"):
        models.save_model(spark, "mean-baseline", methods.create("mean-baseline"), spec, str(tmp_path))


def test_store_of_predictions(spark, tmp_path):
    """Parts replace their own only, are pooled by fold, and are refused where they do not fit the items."""
    items = spark.createDataFrame([(f"i{i}", i % 3, float(i)) for i in range(9)], "item string, fold int, label double")
    store = str(tmp_path / "predictions")
    put = lambda k, method="m", shift=0.0: results.store_predictions(items.where(f"fold = {k}").select("item", (F.col("label") + shift).alias("score")), store, protocol="cv", method=method, fold=k)
    for k in range(3):
        put(k)
    put(0, "other", 5.0)
    put(1, shift=1.0)
    pooled = results.stored_predictions(spark, store, items, protocol="cv", method="m", fold="fold")
    assert {r["item"]: r["score"] for r in pooled.collect()} == {f"i{i}": i + (i % 3 == 1) for i in range(9)}
    assert results.stored_protocols(spark, store, "m") == {"cv"} and results.stored_protocols(spark, store + "x", "m") == set()
    with pytest.raises(ValueError, match="6 items have no prediction"):
        results.stored_predictions(spark, store, items, protocol="cv", method="other", fold="fold")
    moved = items.withColumn("fold", F.when(F.col("item") == "i0", 2).otherwise(F.col("fold")))
    with pytest.raises(ValueError, match="1 predictions are of other items"):
        results.stored_predictions(spark, store, moved, protocol="cv", method="m", fold="fold")
    results.store_predictions(items.select("item", F.col("label").alias("score")), store, protocol="holdout", method="m")
    assert results.stored_predictions(spark, store, items, protocol="holdout", method="m").count() == 9
    with pytest.raises(Exception, match="not finite"):
        results.store_predictions(items.select("item", F.lit(float("nan")).alias("score")), store, protocol="holdout", method="m")


def test_runs_leave_predictions_and_models_that_commands_read(spark, rated, tmp_path, capsys):
    """A table without ids, all folds and a holdout, then subgroups of the pooled predictions, and predictions by a saved model."""
    people = rated.drop("item").selectExpr("features", "label", "counts", "n % 3 as fold", "case when n % 5 = 0 then 'test' when n % 5 = 1 then 'val' else 'train' end as split", "case when n % 2 = 0 then 'a' else 'b' end as sex", "concat('e', n % 4) as origin")
    path, out = str(tmp_path / "people.parquet"), str(tmp_path / "runs")
    people.coalesce(2).write.parquet(path)
    (tmp_path / "spec.yaml").write_text("metadata: [sex, origin]\n")
    common = ["--items", path, "--spec", str(tmp_path / "spec.yaml")]
    run = ["run", *common, "--epochs", "2", "--seed", "5", "--out", out, "--models", str(tmp_path / "models")]
    for k in range(3):
        assert main([*run, "--method", "transfbp", "--protocol", "cv", "--fold", str(k)]) == 0
    assert main([*run, "--method", "transfbp", "ldl-ren2017", "--protocol", "holdout"]) == 0
    said = capsys.readouterr().out
    assert said.count('"KL"') == 1
    groups = ["subgroups", out, *common, "--method", "transfbp", "--by", "sex", "origin", "--resamples", "50"]
    assert main(groups) == 0
    text = capsys.readouterr().out
    assert "## Out of fold, 160 items" in text and "## Held out, 32 items" in text and "### origin" in text
    assert text.count("largest gap of PC") == 2 and "| all | 160 |" in text
    assert main([*groups, "--seed", "1"]) == 0 and capsys.readouterr().out != text
    with pytest.raises(ValueError, match="no predictions of fan2012"):
        main(["subgroups", out, *common, "--method", "fan2012", "--by", "sex"])
    assert main(["predict", *common, "--models", str(tmp_path / "models"), "--method", "transfbp", "--out", str(tmp_path / "scores")]) == 0
    found = spark.read.parquet(str(tmp_path / "scores"))
    assert found.count() == 160 and found.where("item like 'people_%'").count() == 160
    saved = spark.read.parquet(out + "/predictions").where("protocol = 'holdout' and method = 'transfbp'")
    assert found.join(saved.select("item", F.col("score").alias("s")), "item").where("abs(score - s) < 1e-9").count() == 32


def test_report_targets(spark, rated, tmp_path, capsys):
    rated.selectExpr("item", "label", "case when n % 2 = 0 then 'test' else 'train' end as role").write.parquet(str(tmp_path / "items"))
    assert main(["run", "--items", str(tmp_path / "items"), "--method", "mean-baseline", "--out", str(tmp_path / "runs")]) == 0
    from plumbline.__main__ import MARKS

    files = [str(tmp_path / n) for n in ("README.md", "RESULTS.md", "METHODS.md")]
    for f in files:
        with open(f, "w") as out:
            out.write("\n".join(MARKS))
    targets = ["report", str(tmp_path / "runs"), "--brief", "--full", files[1], "--methods", files[2]]
    assert main([*targets, "--check", files[0]]) == 1
    assert capsys.readouterr().err.count("is stale") == 3
    assert main([*targets, "--update", files[0]]) == 0 and main([*targets, "--check", files[0]]) == 0
    with open(files[2], "w") as out:
        out.write("changed")
    assert main([*targets, "--check", files[0]]) == 1
    assert main([*targets, "--check", str(tmp_path / "missing.md")]) == 1
