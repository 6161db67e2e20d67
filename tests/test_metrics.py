import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoframe.operators import compare, metrics, ml, score


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(r.randint(0, 1), round(r.random(), 1), r.randint(0, 2)) for _ in range(300)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([*rows, (None, 0.5, 1), (1, None, 1)], "y int, s double, g int").cache()


def brute_auc(rows):
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def test_auc_and_average_precision(frame, rows):
    assert metrics.roc_auc(frame, "y", "s").first()[0] == pytest.approx(brute_auc(rows))
    pos, ap, before = sum(y for y, *_ in rows), 0.0, 0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp, n = sum(y for y, s, _ in rows if s >= t), sum(s >= t for _, s, _ in rows)
        ap += (tp - before) / pos * tp / n
        before = tp
    assert metrics.average_precision(frame, "y", "s").first()[0] == pytest.approx(ap)


def test_auc_without_both_classes(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()[0] is None


def test_threshold_grid_is_inclusive(frame, rows):
    g = {round(r["threshold"], 2): r for r in metrics.threshold_grid(frame, "y", "s").collect()}
    assert len(g) == 99
    for t in (0.01, 0.3, 0.5, 0.7, 0.99):
        assert g[t]["tp"] == sum(y for y, s, _ in rows if s >= t) and g[t]["tn"] == sum(not y for y, s, _ in rows if s < t)
    best = metrics.best_threshold(metrics.threshold_grid(frame, "y", "s"), "f1").first()
    assert best["value"] == pytest.approx(max(r["f1"] for r in g.values()))
    assert best["threshold"] == min(t for t, r in g.items() if r["f1"] == pytest.approx(best["value"]))


def test_running_sums_over_bins(spark):
    d = spark.createDataFrame([(float(x), 1) for x in (-1e9, -3, -0.5, 0, 0.25, 7, 1e12)], "s double, n int")
    got = {r["s"]: (r["run_n"], r["all_n"]) for r in metrics.running(d, "s", ["n"], descending=True).collect()}
    assert [got[s][0] for s in sorted(got, reverse=True)] == list(range(1, 8)) and got[7.0][1] == 7


@pytest.mark.parametrize("scale", [1e6, 1e-6])
def test_running_sums_spread_over_tasks_whatever_the_scale(spark, scale):
    d = spark.range(4000).select((F.col("id") * scale + 2e6 * (scale > 1)).alias("s"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = metrics.running(d, "s", ["n"]).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["run_n"] for r in sorted(got, key=lambda r: r["s"])] == list(range(1, 4001))
    assert len({r["p"] for r in got}) == 4


def test_confusion_of_nothing_divides_by_nothing(spark):
    r = metrics.confusion(spark.createDataFrame([], "y int, p int"), "y", "p").first()
    assert (r["n"], r["precision"], r["f1"]) == (0, 0.0, 0.0)


def test_chi2(spark):
    df = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 1, 0), (1, 1, 0)], "y int, a int, b int")
    got = {r["feature"]: r["chi2"] for r in metrics.chi2_scores(df, "y", ["a", "b"]).collect()}
    assert got["a"] == pytest.approx((1 - 1.5) ** 2 / 1.5 + (2 - 1.5) ** 2 / 1.5) and got["b"] == 0.0


def test_folds(spark):
    df = spark.range(2000).selectExpr("id", "id % 3 = 0 as y", "id % 50 as p")
    g = ml.grouped_fold(df, "p")
    assert g.select("p", "fold").distinct().count() == 50
    counts = {(r["y"], r["fold"]): r["count"] for r in ml.stratified_fold(df, "y", "id").groupBy("y", "fold").count().collect()}
    assert len(counts) == 10 and max(v for (y, _), v in counts.items() if y) < 1.3 * min(v for (y, _), v in counts.items() if y)


def test_thresholds_strict_and_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.51,)], "p double")
    assert [r["prediction"] for r in score.binary(df, "p").collect()] == [0, 1]
    assert [r["prediction"] for r in score.binary(df, "p", inclusive=True).collect()] == [1, 1]


def test_bootstrap_holds_the_mean(frame):
    r = metrics.bootstrap_interval(frame, "s", times=200).first()
    assert r["low"] < r["mean"] < r["high"]


def test_bootstrap_of_values_that_occur_once(spark):
    """The interval's width is that of Poisson weights: 3.92 standard errors, with the variance over n."""
    x = [i * i / 1000 for i in range(400)]
    r = metrics.bootstrap_interval(spark.createDataFrame([(v,) for v in x], "v double"), "v").first()
    mean = sum(x) / len(x)
    assert r["high"] - r["low"] == pytest.approx(3.92 * (sum((v - mean) ** 2 for v in x) / len(x) / len(x)) ** 0.5, rel=0.09)


@pytest.mark.parametrize("n", [1, 6, 400])
def test_poisson_counts(n):
    k = metrics.poisson(n, (np.arange(20000) + 0.5) / 20000)
    assert (k == k.round()).all() and k.mean() == pytest.approx(n, rel=0.01) and k.var(ddof=1) == pytest.approx(n, rel=0.02)


def test_bootstrap_against_a_plain_one(spark):
    """Within 5 % of the interval that plain resampling with replacement gives."""
    x = np.random.default_rng(3).gamma(2.0, size=500)
    means = [np.random.default_rng(i).choice(x, len(x)).mean() for i in range(4000)]
    low, high = np.percentile(means, [2.5, 97.5])
    r = metrics.bootstrap_interval(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", times=4000).first()
    assert r["high"] - r["low"] == pytest.approx(high - low, rel=0.05)
    again = metrics.bootstrap_interval(spark.createDataFrame([(float(v),) for v in x[::-1]], "v double").repartition(3), "v", times=4000).first()
    assert again["low"] == pytest.approx(r["low"]) and again["high"] == pytest.approx(r["high"])  # whatever the partitioning
    assert metrics.bootstrap_interval(spark.createDataFrame([], "v double"), "v").first()[:] == (None, None, None)


def test_bootstrap_with_empty_resamples(spark):
    assert metrics.bootstrap_interval(spark.createDataFrame([(2.0,)], "v double"), "v").first()[:] == (2.0, 2.0, 2.0)


def test_ngram_vocabulary_is_whole(spark):
    df = spark.range(4).selectExpr("transform(sequence(1, 21000), x -> concat('w', x)) as w")
    model = ml.ngram_pipeline("w", least_docs=4).fit(df)
    assert [len(s.vocabulary) for s in model.stages if hasattr(s, "vocabulary")] == [21000, 20999, 20998]


def test_varied_ngrams_are_whole(spark):
    """No vocabulary is cut: 21,000 words in half of the texts."""
    df = spark.range(10).selectExpr("if(id % 2 = 0, transform(sequence(1, 21000), x -> concat('w', x)), array('a', 'b')) as w")
    got = ml.varied_ngrams(df, "w", least_docs=5, least_variance=0.09)
    assert got.count() == 21000 + 20999 + 20998 + 3 and got.agg(F.min("n_docs")).first()[0] == 5
    assert ml.varied_ngrams(df, "w", least_docs=6).count() == 0 and ml.varied_ngrams(df.limit(0), "w").count() == 0
    one = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "w array<string>")
    assert [sorted(r[0]) for r in one.select(ml.distinct_ngrams("w")).collect()] == [["a", "a b", "a b a", "b", "b a"], [], []]


def test_sources_beyond_the_bound_are_an_error(spark):
    df = spark.range(7).withColumn("s", F.col("id").cast("string"))
    assert len(ml.left_out(df, "s", most=7)) == 7
    with pytest.raises(ValueError):
        ml.left_out(df, "s", most=6)


def test_crosstab_with_a_total_row(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "g string, c string")
    got = {r["g"]: (r["x"], r["y"], r["total"]) for r in metrics.crosstab(df, "g", "c", ["x", "y"], total_row="ALL").collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 1), None: (1, 0, 1), "ALL": (3, 1, 4)}


def test_labels_with_features_of_their_own(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0)], "k int, a double")
    with pytest.warns(UserWarning):
        got = score.multi_label(df, ["k"], {"p": {"weights": {"a": 2.0, "z": 9.0}, "bias": 0.0}, "q": None}).orderBy("k").collect()
    assert got[0].asDict().keys() == {"k", "prob_p", "pred_p"}
    assert got[0]["prob_p"] == pytest.approx(1 / (1 + np.exp(-2.0))) and [r["pred_p"] for r in got] == [1, 0]  # 0.5 itself is not above it


def walked(tree, row):
    while "leaf" not in tree:
        v = row[tree["split"]]
        to = tree["missing"] if v is None else tree["yes"] if v < tree["split_condition"] else tree["no"]
        tree = next(c for c in tree["children"] if c["nodeid"] == to)
    return tree["leaf"]


def test_boosted_trees_against_a_walk(spark):
    r = random.Random(5)

    def grown(depth, number=0):
        if depth == 0 or r.random() < 0.2:
            return {"nodeid": number, "leaf": r.uniform(-1, 1)}
        a, b = 2 * number + 1, 2 * number + 2
        return {"nodeid": number, "split": r.choice("abc"), "split_condition": r.uniform(-1, 1), "yes": a, "no": b, "missing": r.choice((a, b)), "children": [grown(depth - 1, a), grown(depth - 1, b)]}

    trees = [grown(4) for _ in range(12)]
    rows = [tuple(r.choice([None, r.uniform(-1, 1)]) for _ in range(3)) for _ in range(80)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "k int, a double, b double, c double")
    got = {x["k"]: x["prob"] for x in score.boosted(df, score.Booster(trees, ["c", "a", "b"], base=0.1)).collect()}
    for i, row in enumerate(rows):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(0.1 + sum(walked(t, dict(zip("abc", row, strict=True))) for t in trees)))))
    with pytest.raises(ValueError):
        score.Booster(trees, ["a", "b"])


def test_binary_columns_and_weights(spark):
    df = spark.createDataFrame([(0, 1, 2.5, 1), (1, None, 0.0, 0), (1, 0, 1.0, 1), (0, 1, 3.0, 1)], "a int, b int, c double, label int")
    assert ml.binary_columns(df, ["a", "b", "c"]) == (["a", "b"], ["c"])
    assert {(r["label"], round(r["weight"], 4)) for r in ml.balanced_weight(df).collect()} == {(1, round(4 / 6, 4)), (0, 2.0)}


def test_comparison_of_families(spark, quick_fits):
    r = random.Random(1)
    rows = [(i, i % 3, int(r.random() < 0.2 + 0.6 * (i % 2)), i % 2, r.random()) for i in range(240)]
    df = spark.createDataFrame([r for r in rows if r[1] < 2], "key int, source int, label int, x int, noise double").coalesce(1).cache()
    across = compare.cross_source(df, ["x", "noise"], "source", k=2).collect()
    assert {(a["train_source"], a["test_source"]) for a in across} == {("0", "1"), ("1", "0")} and all(0.6 < a["roc_auc"] <= 1 for a in across)
    assert compare.summary(spark.createDataFrame(across), ["model"]).first()["avg_roc_auc"] > 0.6 and compare.best_family(spark.createDataFrame(across)) == "logistic"
    train, test = compare.hold_out(df)
    assert train.count() + test.count() == 160 and 20 < test.count() < 50 and train.join(test, "key").count() == 0
