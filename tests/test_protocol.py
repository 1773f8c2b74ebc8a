import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import inference as I
from plumbline.operators import predictors as P
from plumbline.operators import protocol as R
from plumbline.sources.spec import ItemSpec

SPEC = ItemSpec(item="image_id", label="beauty_score", histogram="hist", ratings=None, score_range=(1.0, 3.0), metadata=("group", "absent"))


def _items(spark, score=4.0):
    return spark.createDataFrame([("a", score, [2, 0, 0], "x"), ("b", 6.0, [0, 2, 0], "y")], "image_id string, beauty_score double, hist array<long>, group string")


def test_items_carry_what_exists(spark):
    assert R.build_items(_items(spark), SPEC).columns == ["item", "label", "hist", "group"]


def test_missing_label_names_the_columns(spark):
    with pytest.raises(ValueError, match="beauty_score"):
        R.build_items(_items(spark).drop("beauty_score"), SPEC)


def test_label_that_is_not_finite_is_counted(spark):
    with pytest.raises(ValueError, match="1 labels"):
        R.build_items(_items(spark, float("nan")), SPEC)


def test_capabilities(spark):
    items = R.build_items(_items(spark), SPEC)
    R.check_capabilities(items, ("distributions", "attributes"), SPEC)
    with pytest.raises(ValueError, match="landmarks"):
        R.check_capabilities(items, ("landmarks",), SPEC)


def test_spec_is_strict(tmp_path):
    assert SPEC.n_bins == 3 and ItemSpec().n_bins == 10
    with pytest.raises(ValueError, match="unknown keys: colour"):
        ItemSpec.from_dict({"colour": 1})
    (tmp_path / "s.yaml").write_text("score_range: [1, 5]\n")
    assert ItemSpec.from_yaml(str(tmp_path / "s.yaml")).n_bins == 5


@pytest.mark.parametrize(("counts", "n", "mean", "sd"), [([3, 0, 1], 4, 1.5, 1.0), ([0, 4, 0], 4, 2.0, 0.0), ([1, 1, 2], 4, 2.25, math.sqrt(2.75 / 3)), ([1, 0, 0], 1, 1.0, 0.0)])
def test_histogram_stats(spark, counts, n, mean, sd):
    r = R.histogram_stats(spark.createDataFrame([(counts,)], "c array<int>"), "c").first()
    assert (r["n"], r["label"], r["sd"]) == pytest.approx((n, mean, sd))


def test_no_ratings_have_no_standard_error(spark):
    assert R.histogram_stats(spark.createDataFrame([([0, 0],)], "c array<int>"), "c").first()["se"] is None


def test_nested_ratings(spark):
    df = spark.createDataFrame([("a", [("r1", 2.0), ("r2", 4.0)])], "id string, x array<struct<rater_id:string,score:double>>")
    assert sorted(map(tuple, R.explode_ratings(df, "id", "x").collect())) == [("a", "r1", 2.0), ("a", "r2", 4.0)]


def test_holdout_and_folds(spark):
    df = spark.createDataFrame([(i, i % 5, "train" if i < 6 else "dev" if i < 8 else "test", i // 2) for i in range(10)], "item int, fold int, split string, person int")
    assert {r["role"]: r["n"] for r in R.split_sizes(R.holdout_roles(df, "split", ("train", "dev", "test"))).collect()} == {"train": 6, "val": 2, "test": 2}
    roles = R.cv_roles(df, 5)
    assert roles.where("role = 'test'").select("item").distinct().count() == 10
    assert {r["role"]: r["n"] for r in R.split_sizes(roles.where("k = 4")).collect()} == {"train": 6, "val": 2, "test": 2}
    assert R.broken_groups(roles.where("k = 0"), "person").count() > 0
    assert R.broken_groups(R.holdout_roles(df, "split", ("train", "dev", "test")), "person").count() == 0
    with pytest.raises(ValueError, match="three folds"):
        R.cv_roles(df, 2)


def test_permutation_keeps_the_labels(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "item int, label double")
    rows = R.permuted_labels(df, "1").collect()
    assert sorted(r["shuffled"] for r in rows) == [float(i) for i in range(50)]
    assert any(r["label"] != r["shuffled"] for r in rows)


def test_leak_check(spark):
    test = spark.createDataFrame([(i, float(i)) for i in range(8)], "item int, label double")
    shuffled = test.selectExpr("item", "7 - label as label")
    assert I.leak_check(lambda d: d.selectExpr("item", "5.0D as score"), test, shuffled)
    assert not I.leak_check(lambda d: d.selectExpr("item", "label as score"), test, shuffled)


def test_early_stopping(spark):
    vals = [1.0, 0.9, 0.89995, 0.95, 0.95, 0.95, 0.95, 0.1]
    r = I.running_best(spark.createDataFrame([("m", i, v) for i, v in enumerate(vals)], "run string, epoch int, val double")).first()
    assert (r["best_epoch"], r["best"], r["stopped_at"]) == (1, 0.9, 6)


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -0.2, 3.0] + rng.normal(size=60)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "f array<double>, y double")
    b, c = P.ridge_fit(df, "f", "y", 3, 10.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert b == pytest.approx(w / x.std(0)) and c == pytest.approx(y.mean() - (w / x.std(0)) @ x.mean(0))
    wide, shift = P.bayesian_ridge_fit(df, "f", "y", 3)
    best = np.linalg.lstsq(np.c_[x, np.ones(60)], y, rcond=None)[0]
    assert np.corrcoef(x @ wide + shift, y)[0, 1] > 0.97 * np.corrcoef(x @ best[:3] + best[3], y)[0, 1]


def test_points_do_not_depend_on_place_or_size(spark):
    import numpy as np

    p = np.random.default_rng(1).normal(size=64)
    rows = [(0, p.tolist()), (1, (p * 3 + 100).tolist()), (2, [1.0] * 64)]
    df = spark.createDataFrame(rows, "i int, f array<double>").select("i", P.points("f", 32).alias("raw"))
    df = df.withColumn("pts", P.normalised_points("raw", [1, 2], [5, 6])).select("i", P.pair_distances("pts", [0, 3, 9]).alias("d"))
    d = {r["i"]: r["d"] for r in df.collect()}
    assert d[0] == pytest.approx(d[1]) and d[2] == [0, 0, 0]


def test_missing_ensemble_member(spark):
    df = spark.createDataFrame([(1, "a", 0.5)], "item int, member string, score double")
    with pytest.raises(ValueError, match="b"):
        P.ensemble_ranks(df, ["a", "b"], spark.createDataFrame([(1.0,)], "label double"))


def test_self_difference_is_nothing(spark):
    rows = [(i, float(i % 7), float((i * 5) % 7 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "at long, y double, a double")
    r = I.paired_bootstrap(df.withColumn("b2", df["a"]), n=60, resamples=50, seed="1").first()
    assert (r["difference"], r["lo"], r["hi"], r["p"]) == (0, 0, 0, 1)


def test_folds_must_be_in_range(spark):
    items = spark.createDataFrame([(i, i % 4) for i in range(8)], "item int, fold int")
    assert R.fold_count(items) == 4 and R.cv_roles(items).count() == 32
    with pytest.raises(Exception, match="0..2, got 3"):
        R.cv_roles(items, 3).collect()
    for bad in ("-1", "cast(null as int)"):
        with pytest.raises(ValueError, match="number from 0"):
            R.fold_count(items.selectExpr("item", f"case when item = 0 then {bad} else fold end as fold"))


def test_landmarks_are_pooled(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item int")
    first = spark.createDataFrame([(1, [9.0]), (1, [1.0]), (2, None), (9, [2.0])], "item int, landmarks array<double>")
    later = spark.createDataFrame([(1, [2.0]), (3, None)], "item int, landmarks array<double>")
    pooled = lambda *tables: sorted((r["item"], r["landmarks"]) for r in R.with_landmarks(items, list(tables)).collect())
    assert pooled(first) == [(1, [9.0]), (2, None), (3, None)]
    assert pooled(first, later) == [(1, [2.0]), (2, None), (3, None)]  # the later table's, not the greater ones
    assert pooled(later, first)[0] == (1, [9.0])


def test_measured_distributions_need_a_total(spark):
    from plumbline.functions import stats

    df = spark.createDataFrame([([0.0, 0.0],)], "c array<double>")
    assert df.select(stats.normalised("c")).first()[0] == [0.5, 0.5]
    with pytest.raises(Exception, match="no positive total"):
        df.select(stats.normalised("c", strict=True)).collect()


def test_ranks_and_places_within_groups(spark):
    from plumbline.functions import stats

    df = spark.createDataFrame([(g, float(v)) for g, vs in (("a", [3, 1, 1, 2]), ("b", [5] * 3), ("c", list(range(50)))) for v in vs], "g string, v double")
    ranks = stats.average_rank(df, "v", "r", ("g",)).groupBy("g").agg(F.sort_array(F.collect_list("r")).alias("r"))
    assert {r["g"]: r["r"] for r in ranks.collect()} == {"a": [0.5, 0.5, 2.0, 3.0], "b": [1.0] * 3, "c": [float(i) for i in range(50)]}
    placed = stats.row_index(df, ["v"], "at", ("g",)).where("g = 'c'").orderBy("at").collect()
    assert [r["v"] for r in placed] == [float(i) for i in range(50)] and [r["at"] for r in placed] == list(range(50))


def test_places_of_any_sortable_type(spark):
    """Strings, dates, several columns and nulls, in groups that may be null; equal to a window, and nothing runs beforehand."""
    from datetime import date, timedelta

    from pyspark.sql import Window, functions as F

    from plumbline.functions import stats

    rows = [(None if i % 5 == 0 else f"g{i % 3}", f"i{(i * 37) % 100}", date(2020, 1, 1) + timedelta(days=(i * 7) % 50), None if i % 11 == 0 else i % 4 - 1.5) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, s string, d date, v double").repartition(5)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    for order, by in ((["s"], ()), (["d", "s"], ("g",)), (["v", "d", "s"], ("g",))):
        placed = stats.row_index(df, order, "at", by)
        want = df.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs
        assert sorted(map(str, placed.select(want.columns).collect())) == sorted(map(str, want.collect()))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    whole = df.where("g is not null")
    ranks = stats.average_ranks(whole, {"d": "rd"}, ("g",))
    w = Window.partitionBy("g").orderBy("d")
    want = whole.withColumn("rd", F.rank().over(w) - 1 + (F.count("*").over(Window.partitionBy("g", "d")) - 1) / 2)
    assert sorted(map(str, ranks.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_labels_are_dealt_among_string_ids(spark):
    items = spark.createDataFrame([(f"i{k}", float(k)) for k in range(40)], "item string, label double")
    found = R.permuted_labels(items, "1").collect()
    assert sorted(r["shuffled"] for r in found) == [float(k) for k in range(40)] and [r["label"] for r in found] != [r["shuffled"] for r in found]
    assert sorted(map(str, found)) == sorted(map(str, R.permuted_labels(items.repartition(3), "1").collect()))
    assert sorted(map(str, found)) != sorted(map(str, R.permuted_labels(items, "2").collect()))


def test_ids_for_tables_without_any(spark, tmp_path):
    """The same ids on every read, by file and place in it, however the files are split; not without files."""
    for k in range(3):
        spark.range(100 * k, 100 * k + 40).selectExpr("id as v").coalesce(1).write.parquet(str(tmp_path / f"t/part={k}"))
    read = lambda: spark.read.parquet(str(tmp_path / "t")).select("v", "part")
    read_all = lambda: R.identified(spark.read.parquet(str(tmp_path / "t")), "train")
    first = {r["v"]: r["item"] for r in read_all().collect()}
    assert len(set(first.values())) == 120 and set(first.values()) == {f"train_{i}" for i in range(120)}
    assert first[0] == "train_0" and first[105] == "train_45"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert {r["v"]: r["item"] for r in read_all().repartition(7).collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert R.identified(read().withColumnRenamed("v", "item"), "x").columns == ["item", "part"]
    with pytest.raises(ValueError, match="no column 'item'"):
        R.identified(spark.createDataFrame([(1,)], "v int"), "x")
