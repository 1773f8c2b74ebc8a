"""One query for each operation, over the tables of a folder.

Items are parts, raters are suppliers, and a rating of 1 to 10 is a line item's
quantity over five, rounded up; folds are the part key modulo 5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import stats as S
from plumbline.operators import inference as I
from plumbline.operators import kernels as K
from plumbline.operators import methods as M
from plumbline.operators import predictors as P
from plumbline.operators import protocol as R
from plumbline.operators import report as T
from plumbline.plans import catalogue
from plumbline.sources.spec import ItemSpec

SPEC = ItemSpec(metadata=("brand", "type", "fold"))
FOLDS = 5
#: Resamples of all rows, and of groups.
RESAMPLES, GROUP_RESAMPLES = 2_000, 10_000
#: Nineteen of the 32 points that a vector of 64 numbers makes, and seven pairs of them that stand for mirrored ones.
KEY_POINTS = list(range(19))
MIRRORED = [(0, 16), (4, 12), (19, 24), (1, 15), (2, 14), (3, 13), (31, 25)]
WIDTH = 64


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ratings(spark, sf) -> DataFrame:
    return _read(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("rater"), F.ceil(F.col("l_quantity") / 5).cast("int").alias("score"))


def items(spark, sf) -> DataFrame:
    part = _read(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return R.label_stats(ratings(spark, sf)).join(part, "item").withColumn("fold", (F.col("item") % FOLDS).cast("int"))


def roles(spark, sf) -> DataFrame:
    return R.cv_roles(items(spark, sf), FOLDS)


def scored(spark, sf, group: str = "brand") -> DataFrame:
    """Test rows of all folds with the training mean of their group: k, item, y, p and the groups."""
    r = roles(spark, sf)
    test = r.where("role = 'test'").select("k", "item", F.round("label", 9).alias("y"), "brand", "type")
    return test.join(P.group_mean(r, group), ["k", group]).withColumn("p", F.round("p", 9))


def _six(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded to six places."""
    return df.select(*[S.r6(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def label_stats(spark, sf):
    return _six(R.label_stats(ratings(spark, sf)))


def standard_error(spark, sf):
    return _six(R.label_stats(ratings(spark, sf)).select("item", "se"))


def histogram_label_stats(spark, sf):
    return _six(R.histogram_stats(R.histogram(ratings(spark, sf), SPEC), "counts").select("item", "n", "label", "sd"))


def label_histogram(spark, sf):
    return R.histogram(ratings(spark, sf), SPEC).select("item", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


def histogram_normalised(spark, sf):
    shares = R.histogram(ratings(spark, sf), SPEC).select("item", F.posexplode(S.normalised("counts")).alias("bin", "share"))
    return _six(shares)


def cv_roles(spark, sf):
    return roles(spark, sf).select("k", "item", "role")


def split_sizes(spark, sf):
    return R.split_sizes(roles(spark, sf), "k")


def group_integrity(spark, sf):
    return R.broken_groups(roles(spark, sf).where("k = 0"), "brand")


def attribute_codes(spark, sf):
    train = roles(spark, sf).where("k = 0 and role = 'train'")
    return R.attribute_codes(train, ["type", "brand"], 32)


def permuted_labels(spark, sf):
    return _six(R.permuted_labels(items(spark, sf).select("item", "label"), "7"))


def union_of_folds(spark, sf):
    parts = [scored(spark, sf).where(F.col("k") == k).select("item", "k", "p") for k in range(FOLDS)]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("item").alias("n_distinct"))


def _points(df: DataFrame, *by: str) -> DataFrame:
    ranked = S.average_ranks(df, {"p": "rp", "y": "ry"}, by)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), S.pearson("p", "y").alias("PC"), S.pearson("rp", "ry").alias("SROCC"), S.mae("p", "y").alias("MAE"), S.rmse("p", "y").alias("RMSE"))


def point_metrics_cv(spark, sf):
    return _six(_points(scored(spark, sf), "k"))


def mean_baseline_cv(spark, sf):
    r = roles(spark, sf)
    test = r.where("role = 'test'").join(F.broadcast(P.mean_baseline(r)), "k").withColumnRenamed("label", "y")
    return _six(test.groupBy("k").agg(F.count("*").alias("n"), S.pearson("p", "y").alias("PC"), S.mae("p", "y").alias("MAE"), S.rmse("p", "y").alias("RMSE")))


def constant_prediction_zero_corr(spark, sf):
    return items(spark, sf).groupBy("type").agg(S.pearson(F.lit(5.0), "label").alias("PC"))


def spearman_by_type(spark, sf):
    return _six(_points(scored(spark, sf), "type").select("type", "SROCC"))


def average_rank(spark, sf):
    return S.average_rank(items(spark, sf).select("item", F.round("label", 9).alias("label")), "label", "rank").select("item", "rank")


def clipped_scores(spark, sf):
    return _six(scored(spark, sf).select("item", S.clip(F.col("p") * 2 - 5, *SPEC.score_range).alias("score")))


def _distributions(spark, sf) -> DataFrame:
    h = R.histogram(ratings(spark, sf), SPEC).join(items(spark, sf).select("item", "brand", "type"), "item")
    pooled = h.groupBy("brand").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(SPEC.n_bins)]).alias("all"))
    both = h.join(pooled, "brand")
    return both.select("item", "type", "counts", S.normalised("counts", strict=True).alias("a"), S.normalised("all", strict=True).alias("p"))


def distribution_metrics(spark, sf):
    d = _distributions(spark, sf)
    return _six(d.agg(F.count("*").alias("n"), *[F.avg(v).alias(k) for k, v in S.distribution_measures("p", "a").items()]))


def distribution_by_group(spark, sf):
    d = _distributions(spark, sf)
    return _six(d.groupBy("type").agg(F.count("*").alias("n"), *[F.avg(v).alias(k) for k, v in S.distribution_measures("p", "a").items()]))


def expected_scores(spark, sf):
    d = _distributions(spark, sf)
    return _six(d.select("item", S.expectation("p").alias("expected"), S.multinomial_nll("counts", "p").alias("nll")))


def multinomial_likelihood(spark, sf):
    """The mean over items of -sum of count * ln(share), over the mean number of ratings."""
    d = _distributions(spark, sf).join(items(spark, sf).select("item", "n"), "item")
    return _six(d.groupBy("type").agg((F.avg(S.multinomial_nll("counts", "p")) / F.avg("n")).alias("likelihood")))


def best_by_metric(spark, sf):
    """The best method of the first fold by each metric's direction."""
    runs = _runs(spark, sf).where("k = 0")
    return _six(T.best_by_metric(runs.select("method", *[F.round(m, 6).alias(m) for m in T.POINT])))


def counts_from_shares(spark, sf):
    d = R.histogram(ratings(spark, sf), SPEC).join(items(spark, sf).select("item", "n"), "item").withColumn("share", S.normalised("counts"))
    return _six(d.select("item", F.posexplode(S.counts_of("share", "n")).alias("bin", "count")))


def log_softmax_embeddings(spark, sf):
    e = _read(spark, sf, "embeddings").select("vec_id", S.log_softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    return _six(e.select("vec_id", F.array_max("s").alias("top"), F.array_min("s").alias("least")))


def union_of_splits(spark, sf):
    i = items(spark, sf).select("item", "label", "fold")
    parts = [i.where("item % 3 = 0"), i.where("item % 3 = 1"), i.where("item % 3 = 2").select("fold", "item", "label")]
    return R.split_sizes(R.cv_roles(R.union_splits(parts)), "k")


def attributes_of_test_items(spark, sf):
    r = roles(spark, sf).where("k = 0")
    codes = R.attribute_codes(r.where("role = 'train'"), ["type", "brand"], 32)
    return R.encoded(r.where("role = 'test'").select("item", "type", "brand"), codes, ["type", "brand"]).select("item", "code")


def fold_count(spark, sf):
    summary = T.fold_summary(_runs(spark, sf))
    return summary.agg(F.max("folds").alias("folds"))


def softmax_embeddings(spark, sf):
    e = _read(spark, sf, "embeddings").select("vec_id", S.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    return _six(e.select("vec_id", F.array_max("s").alias("top"), S.expectation("s").alias("expected")))


def losses(spark, sf):
    s = scored(spark, sf)
    e = F.col("p") - F.col("y")
    return _six(
        s.groupBy("k").agg(
            F.avg(S.smooth_l1("p", "y")).alias("smooth_l1"), F.avg(F.abs(e)).alias("l1"), F.avg(e * e).alias("mse"), F.avg(S.heteroscedastic("p", "y", F.lit(0.5))).alias("heteroscedastic")
        )
    )


def weighted_cross_entropy(spark, sf):
    d = _distributions(spark, sf).join(items(spark, sf).select("item", "label"), "item")
    b = S.clip(F.rint("label") - 1, 0, SPEC.n_bins - 1).cast("int")
    w = F.broadcast(P.class_weights(items(spark, sf), "label", SPEC.n_bins).select("bin", "weight"))
    d = d.withColumn("bin", b).join(w, "bin")
    return _six(d.agg((F.sum(-F.col("weight") * F.log(F.get("p", F.col("bin")) + S.EPS)) / F.sum("weight")).alias("cross_entropy")))


def class_weights(spark, sf):
    return _six(P.class_weights(items(spark, sf), "label", SPEC.n_bins))


def precision_weights(spark, sf):
    return _six(P.precision_weights(items(spark, sf)))


def rater_offsets(spark, sf):
    return _six(P.rater_effects(ratings(spark, sf))[0])


def rater_adjusted_quality(spark, sf):
    return _six(P.rater_effects(ratings(spark, sf))[1])


def margin_ranking_pairs(spark, sf):
    s = scored(spark, sf).withColumn("batch", F.floor(F.col("item") / 32))
    return _six(P.margin_ranking(s, "batch"))


def subgroup_metrics(spark, sf):
    return _six(I.subgroup_metrics(scored(spark, sf), "type", least=3))


def subgroup_grouping_sets(spark, sf):
    return _six(I.with_total(scored(spark, sf), "type"))


def subgroup_dimensions(spark, sf):
    d = I.dimensions(scored(spark, sf), ["type", "brand"])
    return _six(d.groupBy("dimension", "value").agg(F.count("*").alias("n"), S.pearson("p", "y").alias("PC"), S.mae("p", "y").alias("MAE")))


def subgroup_extremes(spark, sf):
    g = I.subgroup_metrics(scored(spark, sf), "type")
    return I.extremes(g.select("group", *[F.round(m, 6).alias(m) for m in ("PC", "MAE", "RMSE")]))


def _documents(spark, sf) -> DataFrame:
    d = _read(spark, sf, "documents")
    words = F.length(F.regexp_replace("text", "[^ ]+", ""))
    marks = F.length(F.regexp_replace("text", "[^.]+", ""))
    d = d.select("doc_id", F.col("n_chars").cast("double").alias("y"), words.cast("double").alias("a"), marks.cast("double").alias("b2"), "lang")
    return S.row_index(d, ["doc_id"], "at")


def bootstrap_ci(spark, sf):
    d = _documents(spark, sf).select("at", "y", F.col("a").alias("p"))
    return _six(I.bootstrap_ci(d, n=d.count(), resamples=RESAMPLES, seed="11"))


def paired_bootstrap(spark, sf):
    d = _documents(spark, sf)
    return _six(I.paired_bootstrap(d, n=d.count(), resamples=RESAMPLES, seed="13"))


def _grouped(spark, sf) -> DataFrame:
    d = _documents(spark, sf).select(F.col("lang").alias("group"), "doc_id", "y", F.col("a").alias("p"))
    return S.row_index(d, ["doc_id"], "at", ("group",))


def subgroup_bootstrap(spark, sf):
    return _six(I.subgroup_intervals(I.group_resamples(_grouped(spark, sf), resamples=GROUP_RESAMPLES, seed="17")))


def subgroup_gap(spark, sf):
    two = _grouped(spark, sf).where(F.col("group").isin("en", "de"))  # a group's draws do not depend on the others
    return _six(I.subgroup_gap(I.group_resamples(two, resamples=GROUP_RESAMPLES, seed="19"), "en", "de"))


def subgroup_table(spark, sf):
    d = _documents(spark, sf).select(F.col("doc_id").alias("item"), "lang", "y", F.col("a").alias("p"))
    return _six(I.subgroup_table(d, "lang", resamples=GROUP_RESAMPLES, seed="23"))


def _runs(spark, sf) -> DataFrame:
    """Point metrics of three methods in every fold."""
    r = roles(spark, sf)
    base = r.where("role = 'test'").select("k", "item", F.round("label", 9).alias("y"), "brand", "type").join(F.broadcast(P.mean_baseline(r)), "k")
    named = [("mean-baseline", "baseline", base), ("group-brand", "classical", scored(spark, sf)), ("group-type", "classical", scored(spark, sf, "type"))]
    every = reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("method"), F.lit(e).alias("era"), "k", "y", F.round("p", 9).alias("p")) for m, e, df in named])
    return _points(every, "method", "era", "k").select("method", "era", "k", *T.POINT)


def fold_summary(spark, sf):
    return _six(T.fold_summary(_runs(spark, sf)))


def leaderboard_ranked(spark, sf):
    runs = _runs(spark, sf).where("k = 0").select("method", "era", *[F.round(m, 6).alias(m) for m in T.POINT])
    return _six(T.leaderboard(runs, catalogue.era_order(spark)))


def chart_data(spark, sf):
    runs = _runs(spark, sf)
    return _six(T.chart_data(runs.where("k = 0"), T.fold_summary(runs.where("method != 'group-type'"))))


def equal_width_histogram(spark, sf):
    return T.histogram(items(spark, sf).withColumn("label", F.round("label", 9)), "label", 40)


def value_counts(spark, sf):
    return items(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"))


def method_catalogue(spark, sf):
    """The catalogue, with the first fold's correlation of those methods that have run."""
    s = catalogue.setups(spark).join(F.broadcast(catalogue.era_order(spark)), "era")
    runs = _runs(spark, sf).where("k = 0").select("method", F.col("PC"))
    return _six(s.join(runs, "method", "left").select("method", "era", "era_order", (F.col("schedule").isNotNull()).alias("trainable"), "PC"))


def _steps(spark, sf, setups: DataFrame) -> DataFrame:
    """Schedules with the steps of an epoch: batches of the training items of the first fold."""
    train = roles(spark, sf).where("k = 0 and role = 'train'").agg(F.count("*").alias("__n"))
    return setups.crossJoin(F.broadcast(train)).withColumn("steps", F.ceil(F.col("__n") / F.col("batch")).cast("int")).drop("__n")


def setup_table(spark, sf):
    return _steps(spark, sf, catalogue.setups(spark).where("source is not null"))


def lr_schedules(spark, sf):
    s = _steps(spark, sf, catalogue.setups(spark))
    rates = P.learning_rates(s).join(s.select("method", "steps"), "method")
    return rates.select("method", "epoch", (F.round("lr", 9) + F.lit(0.0)).alias("lr"), (F.col("epoch") * F.col("steps")).alias("first_step"))


def early_stopping(spark, sf):
    """The rule over a log that the orders make: months as epochs, the mean price of a priority as its error."""
    o = _read(spark, sf, "orders").withColumn("epoch", (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1)
    return _six(I.running_best(o.groupBy(F.col("o_orderpriority").alias("run"), "epoch").agg(F.round(F.avg("o_totalprice"), 2).alias("val"))))


def ensemble_rank_average(spark, sf):
    a, b = scored(spark, sf), scored(spark, sf, "type")
    both = a.select("item", F.lit("a").alias("member"), F.round("p", 6).alias("score")).unionByName(b.select("item", F.lit("b").alias("member"), F.round("p", 6).alias("score")))
    return _six(P.ensemble_ranks(both, ["a", "b"], items(spark, sf).select("label")))


def test_time_mean(spark, sf):
    views = scored(spark, sf).select("item", F.col("p").alias("score")).unionByName(scored(spark, sf, "type").select("item", F.col("p").alias("score")))
    return _six(P.flip_mean(views))


def _faces(spark, sf) -> DataFrame:
    e = _read(spark, sf, "embeddings").select("vec_id", "label", P.points("embedding", WIDTH // 2).alias("raw"))
    return e.withColumn("pts", P.normalised_points("raw", [1, 2, 3], [5, 6, 7]))


def pairwise_distances(spark, sf):
    return _six(_faces(spark, sf).select("vec_id", F.posexplode(P.pair_distances("pts", KEY_POINTS)).alias("pair", "distance")))


def symmetry_features(spark, sf):
    return _six(_faces(spark, sf).select("vec_id", F.posexplode(P.symmetry("pts", MIRRORED, [27, 28, 29, 30])).alias("pair", "asymmetry")))


def proportion_features(spark, sf):
    d = _faces(spark, sf).select("vec_id", P.pair_distances("pts", KEY_POINTS).alias("d"))
    # ratios of near-zero distances have no six places, so they are compared on a log scale
    return _six(d.select("vec_id", F.posexplode(F.transform(P.proportions("d", 12), lambda x: F.log(x + 1e-8))).alias("ratio", "log_value")))


def _embedded(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("features"), F.col("label").cast("double").alias("label"), (F.col("vec_id") % 5 != 0).alias("train"))


def standardised_features(spark, sf):
    e = _embedded(spark, sf)
    scale = P.scales(P.long_features(e.where("train"), "item", "features"))
    return _six(P.standardised(P.long_features(e.where("not train"), "item", "features"), scale))


def univariate_selection(spark, sf):
    e = _embedded(spark, sf).where("train")
    return _six(P.select_features(P.long_features(e, "item", "features"), e.select("item", "label"), 20))


def knn_regression(spark, sf):
    e = _embedded(spark, sf)
    return _six(P.knn_regression(e.where("train"), e.where("not train"), 15))


def ridge_prediction(spark, sf):
    e = _embedded(spark, sf)
    b, c = P.ridge_fit(e.where("train"), "features", "label", WIDTH, 10.0)
    return _six(e.where("not train").select("item", P.linear("features", b, c).alias("p")))


def bayesian_ridge_prediction(spark, sf):
    e = _embedded(spark, sf)
    b, c = P.bayesian_ridge_fit(e.where("train"), "features", "label", WIDTH)
    return _six(e.where("not train").select("item", P.linear("features", b, c).alias("p")))


def polynomial_ridge_prediction(spark, sf):
    e = _embedded(spark, sf)
    model = P.ridge_fit(e.where("train"), "features", "label", WIDTH, 100.0, P.products)
    return _six(e.where("not train").select("item", P.predictor(model, P.products)("features").alias("p")))


def kernel_ridge_prediction(spark, sf):
    e = _embedded(spark, sf)
    model = K.kernel_ridge(e.where("train"), gamma=1 / WIDTH, alpha=1.0)
    return _six(e.where("not train").select("item", model.column()("features").alias("p")))


def support_vector_prediction(spark, sf):
    e = _embedded(spark, sf)
    model = K.support_vector_regression(e.where("train"), gamma=1 / WIDTH, c=10.0, epsilon=0.1)
    return _six(e.where("not train").select("item", model.column()("features").alias("p"), F.lit(model.gap).alias("relative_gap")))


#: Epochs of the registered heads, validation and test parts of which are a fifth each.
HEAD_EPOCHS = 12


def _head_prediction(method: str):
    def query(spark, sf):
        """The scores of a linear head on the embeddings; an item's label is its class and one, with ratings around it."""
        e = _embedded(spark, sf).withColumn("label", F.col("label") + 1)
        counts = F.transform(F.sequence(F.lit(1), F.lit(SPEC.n_bins)), lambda b: F.greatest(F.lit(0), 4 - 2 * F.abs(b - F.col("label")).cast("int")))
        e = e.withColumn("counts", counts)
        fitted = M.create(method, epochs=HEAD_EPOCHS)
        fitted.fit(e.where("item % 5 > 1"), e.where("item % 5 = 1"), SPEC)
        return _six(fitted.predict(e.where("item % 5 = 0").select("item", "features")).select("item", F.col("score").alias("p")))

    return query


HEADS = {f"{m.replace('-', '_')}_prediction": _head_prediction(m) for m in ("ldl-ren2017", "comboloss", "r3cnn", "uol", "rw-ldl", "rw-ldl-noweight", "rw-ldl-kl", "dinov2-linear")}

NAMES = [
    "label_stats", "standard_error", "histogram_label_stats", "label_histogram", "histogram_normalised", "cv_roles", "split_sizes", "group_integrity", "attribute_codes",
    "permuted_labels", "union_of_folds", "point_metrics_cv", "mean_baseline_cv", "constant_prediction_zero_corr", "spearman_by_type", "average_rank", "clipped_scores",
    "distribution_metrics", "distribution_by_group", "expected_scores", "softmax_embeddings", "losses", "weighted_cross_entropy", "class_weights", "precision_weights",
    "rater_offsets", "rater_adjusted_quality", "margin_ranking_pairs", "subgroup_metrics", "subgroup_grouping_sets", "subgroup_dimensions", "subgroup_extremes",
    "bootstrap_ci", "paired_bootstrap", "subgroup_bootstrap", "subgroup_gap", "fold_summary", "leaderboard_ranked", "chart_data", "equal_width_histogram", "value_counts",
    "method_catalogue", "setup_table", "lr_schedules", "early_stopping", "ensemble_rank_average", "test_time_mean", "pairwise_distances", "symmetry_features",
    "proportion_features", "standardised_features", "univariate_selection", "knn_regression", "ridge_prediction", "bayesian_ridge_prediction", "polynomial_ridge_prediction",
    "kernel_ridge_prediction", "subgroup_table", "counts_from_shares", "log_softmax_embeddings", "union_of_splits", "attributes_of_test_items", "fold_count",
    "support_vector_prediction", "multinomial_likelihood", "best_by_metric",
]
QUERIES = {n: globals()[n] for n in NAMES} | HEADS
