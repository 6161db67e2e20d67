"""Evaluation of predictions and of training data, as aggregations.

Curves and ranks are computed from counts per distinct score: the one pass over all rows is a pre-aggregated group-by, and
what is windowed afterwards are distinct scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenoframe.session import cut, shuffle_partitions


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def confusion(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """n, tp, fp, tn, fn, accuracy, precision, recall, specificity and f1; ratios without a denominator are 0. Rows with nulls are left out."""
    a, p = F.col(actual), F.col(predicted)
    n = lambda t: F.sum(F.when(t, 1).otherwise(0)).cast("long")
    g = df.where(a.isNotNull() & p.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), n((a == 1) & (p == 1)).alias("tp"), n((a == 0) & (p == 1)).alias("fp"), n((a == 0) & (p == 0)).alias("tn"), n((a == 1) & (p == 0)).alias("fn")
    )
    tp, fp, tn, fn = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("tp", "fp", "tn", "fn"))
    g = g.withColumns({"accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp)})
    return g.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_score(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Positives and negatives (p, m) per distinct score."""
    d = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull())
    return d.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(actual).cast("long")).alias("p"), F.sum(1 - F.col(actual).cast("long")).alias("m"))


def _summed(sums: list[str]):
    """The rows of a task with its number and the sums up to each row; what is carried from batch to batch is one number a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, carried = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for b in batches:
            new = []
            for c in sums:
                upto = np.cumsum(b.column(c).fill_null(0).to_numpy(zero_copy_only=False)) + carried[c]
                if len(upto):
                    carried[c] = upto[-1]
                new.append(pa.array(upto, b.column(c).type))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, dtype=np.int32)), *new], names=[*b.schema.names, "_p", *(f"_i_{c}" for c in sums)])

    return run


def running(d: DataFrame, by: str, sums: list[str], descending: bool = False) -> DataFrame:
    """d with the sum of each column up to and with its own row in the order of `by` (distinct numbers): run_<column>, and all_<column>. Nulls add nothing.

    A scan in two levels in one shuffle: rows are range-partitioned by `by`, so that tasks get like shares of them whatever the numbers' distribution, and summed in
    each task as they stream by; the tasks' totals, one row a task, give each its offset. The summed rows are written to the checkpoint folder, as their
    partitioning must not be computed twice.
    """
    order = (F.desc if descending else F.asc)(by)
    schema = T.StructType([*d.schema.fields, T.StructField("_p", T.IntegerType()), *(T.StructField(f"_i_{c}", d.schema[c].dataType) for c in sums)])
    s = cut(d.repartitionByRange(shuffle_partitions(d.sparkSession), order).sortWithinPartitions(order).mapInArrow(_summed(sums), schema))
    outer, every = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    tops = s.groupBy("_p").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    tops = tops.select("_p", *(F.coalesce(F.sum(f"_t_{c}").over(outer), F.lit(0)).alias(f"_o_{c}") for c in sums), *(F.sum(f"_t_{c}").over(every).alias(f"all_{c}") for c in sums))
    s = s.join(F.broadcast(tops), "_p")  # one row a task
    return s.withColumns({f"run_{c}": F.col(f"_i_{c}") + F.col(f"_o_{c}") for c in sums}).drop("_p", *(f"_{x}_{c}" for x in "io" for c in sums))


def curve(df: DataFrame, actual: str, score: str) -> DataFrame:
    """For each distinct score as threshold (score >= it is positive): threshold, p (positives of that score), tp, fp and the totals pos, neg."""
    d = running(by_score(df, actual, score), "s", ["p", "m"], descending=True)
    return d.select(F.col("s").alias("threshold"), "p", F.col("run_p").alias("tp"), F.col("run_m").alias("fp"), F.col("all_p").alias("pos"), F.col("all_m").alias("neg"))


def roc_curve(df: DataFrame, actual: str, score: str) -> DataFrame:
    c = curve(df, actual, score)
    return c.select("threshold", _ratio(F.col("tp"), F.col("pos")).alias("tpr"), _ratio(F.col("fp"), F.col("neg")).alias("fpr"))


def pr_curve(df: DataFrame, actual: str, score: str) -> DataFrame:
    c = curve(df, actual, score)
    return c.select("threshold", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("pos")).alias("recall"))


def roc_auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks; null without both classes."""
    d = running(by_score(df, actual, score).withColumn("k", F.col("p") + F.col("m")), "s", ["k"])
    rank = F.col("run_k") - F.col("k") + (F.col("k") + 1) / 2
    a = d.agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").cast("double").alias("p"), F.sum("m").cast("double").alias("m"))
    return a.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("m")).alias("roc_auc"))


def average_precision(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Sum of the recall's steps times the precision, over distinct scores from the top."""
    c = curve(df, actual, score)
    c = c.withColumn("x", _ratio(F.col("p"), F.col("pos")) * _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return c.agg(F.sum("x").alias("average_precision"))


def threshold_grid(df: DataFrame, actual: str, score: str, steps: int = 99) -> DataFrame:
    """tp, fp, tn, fn and metrics at each of the thresholds 1/100 ... 99/100 (score >= threshold is positive).

    Scores are first counted per grid cell, so the rows are read once and never multiplied by the thresholds.
    """
    spark = df.sparkSession
    cell = F.least(F.floor(F.round(F.col(score) * (steps + 1), 9)), F.lit(steps))
    d = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull()).groupBy(cell.alias("cell")).agg(F.sum(F.col(actual).cast("long")).alias("p"), F.sum(1 - F.col(actual).cast("long")).alias("m"))
    g = spark.range(0, steps + 1).select(F.col("id").alias("cell")).join(d, "cell", "left").na.fill(0)
    w, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")), Window.partitionBy(F.lit(0))
    g = g.select("cell", F.sum("p").over(w).alias("tp"), F.sum("m").over(w).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("m").over(every).alias("neg")).where("cell >= 1")
    g = g.select((F.col("cell") / (steps + 1)).alias("threshold"), "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall, spec = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return g.withColumns({"f1": _ratio(2 * precision * recall, precision + recall), "balanced_accuracy": (recall + spec) / 2, "youdens_j": recall + spec - 1, "precision_recall_product": precision * recall})


def best_threshold(grid: DataFrame, metric: str) -> DataFrame:
    """The threshold with the largest metric (9 digits), of equals the least: threshold, value."""
    v = F.round(F.col(metric), 9)
    return grid.agg(F.min_by("threshold", F.struct(-v, "threshold")).alias("threshold"), F.max(v).alias("value"))


def youden_threshold(df: DataFrame, actual: str, score: str) -> DataFrame:
    r = roc_curve(df, actual, score).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 9))
    return r.agg(F.min_by("threshold", F.struct(-F.col("j"), -F.col("threshold"))).alias("threshold"), F.max("j").alias("youdens_j"))


def f1_threshold(df: DataFrame, actual: str, score: str) -> DataFrame:
    """The threshold with the largest 2pr / (p + r + 1e-8)."""
    c = pr_curve(df, actual, score)
    c = c.withColumn("f1", F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8), 9))
    return c.agg(F.min_by("threshold", F.struct(-F.col("f1"), "threshold")).alias("threshold"), F.max("f1").alias("f1"))


def tpr_threshold(df: DataFrame, actual: str, score: str, target: float) -> DataFrame:
    """The operating point whose true positive rate is nearest the target, of equals the one with the higher threshold."""
    r = roc_curve(df, actual, score).withColumn("off", F.round(F.abs(F.col("tpr") - target), 9))
    return r.agg(F.min_by(F.struct("threshold", "fpr", "tpr"), F.struct("off", -F.col("threshold"))).alias("x")).select("x.*")


def chi2_scores(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """chi2 of each feature: over classes, (observed - expected)² / expected, observed the class's sum of the feature, expected its share of rows times the total."""
    sums = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.abs(F.coalesce(F.col(f"`{f}`"), F.lit(0))).cast("double")).alias(f) for f in features))
    long = sums.select("y", "n", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("o")) for f in features))).alias("x")).select("y", "n", "x.feature", "x.o")
    total = long.groupBy("feature").agg(F.sum("o").alias("t"), F.sum("n").alias("all"))
    e = F.col("n") / F.col("all") * F.col("t")
    return long.join(F.broadcast(total), "feature").groupBy("feature").agg(F.sum(F.coalesce(F.try_divide(F.pow(F.col("o") - e, 2), e), F.lit(0.0))).alias("chi2"))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("chi2"), "feature").limit(k)


def rmse_spearman(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Root mean squared error, and the correlation of average ranks."""
    d = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull()).select(F.col(actual).cast("double").alias("a"), F.col(score).cast("double").alias("b"))
    pairs = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))

    def ranks(c: str) -> DataFrame:
        g = running(pairs.groupBy(c).agg(F.sum("n").alias("k")), c, ["k"])
        return g.select(c, (F.col("run_k") - F.col("k") + (F.col("k") + 1) / 2).alias(f"r{c}"))

    r = pairs.join(ranks("a"), "a").join(ranks("b"), "b")
    n = F.sum("n").cast("double")
    sa, sb = F.sum(F.col("n") * F.col("ra")), F.sum(F.col("n") * F.col("rb"))
    cov = F.sum(F.col("n") * F.col("ra") * F.col("rb")) - sa * sb / n
    va, vb = F.sum(F.col("n") * F.col("ra") * F.col("ra")) - sa * sa / n, F.sum(F.col("n") * F.col("rb") * F.col("rb")) - sb * sb / n
    return r.agg(F.sqrt(F.sum(F.col("n") * F.pow(F.col("a") - F.col("b"), 2)) / n).alias("rmse"), F.try_divide(cov, F.sqrt(va * vb)).alias("spearman"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class, and whether a class has less than a tenth."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("share", share).withColumn("minority", (F.col("share") < 0.1).cast("int"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls of each column, as rows (column, nulls)."""
    one = df.agg(*(F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("nulls")) for c in df.columns))).alias("x")).select("x.*")


def metric_summary(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))


def best_by(rows: DataFrame, by: str, metric: str) -> DataFrame:
    """The group with the largest mean of a metric, of equals the first by name."""
    return rows.groupBy(by).agg(F.avg(metric).alias(f"{metric}_mean")).orderBy(F.desc(F.round(f"{metric}_mean", 9)), by).limit(1)


def tagged(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    return df.withColumn("error_type", F.when(a.isNull() | p.isNull(), None).when((a == 0) & (p == 1), "false_positive").when((a == 1) & (p == 0), "false_negative").otherwise("correct"))


#: Counts up to which Poisson weights are drawn exactly; the normal form beyond has the same mean and variance.
EXACT_POISSON = 400
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # of the published splitmix64


def _uniform(keys: np.ndarray, times: int, seed: int) -> np.ndarray:
    """A matrix of uniforms in (0, 1): row by key, column by resample; the same for a key wherever its row is."""
    x = keys.astype(np.uint64)[:, None] + (np.arange(1, times + 1, dtype=np.uint64) * np.uint64(_MIX[0]) + np.uint64(seed))[None, :]
    for shift, factor in ((30, _MIX[1]), (27, _MIX[2])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def poisson(n: int, u: np.ndarray) -> np.ndarray:
    """The Poisson counts of mean n at the uniforms u, by inverse distribution."""
    k = np.arange(1, int(n + 12 * n**0.5 + 40))
    upto = np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(n / k))]) - n))
    return np.searchsorted(upto, u).astype(np.float64)


def _resampled(times: int, seed: int, rows: int = 256):
    """Per task the weighted sums of each resample, so that what leaves a task does not grow with its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, any_ = np.zeros(times), np.zeros(times), False
        for b in batches:
            v, n, key = (b.column(c).to_numpy() for c in ("v", "n", "key"))
            for s in range(0, len(v), rows):
                u, m = _uniform(key[s : s + rows], times, seed), n[s : s + rows]
                w = np.empty_like(u)
                for size in np.unique(m):
                    at = m == size
                    if size <= EXACT_POISSON:
                        w[at] = poisson(int(size), u[at])
                    else:
                        other = _uniform(key[s : s + rows][at], times, seed + 1)
                        w[at] = np.maximum(0.0, size + np.sqrt(size) * np.sqrt(-2 * np.log(u[at])) * np.cos(2 * np.pi * other))
                total += v[s : s + rows] @ w
                weight += w.sum(axis=0)
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(times)), pa.array(total), pa.array(weight)], names=["r", "t", "w"])

    return run


def bootstrap_interval(values: DataFrame, value: str, times: int = 2000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean: low, mean, high. Values are first counted, then each distinct value's weight is drawn per resample from a Poisson by hash.

    Values are never multiplied by the resamples in the plan: a task sums its own values into one row a resample. Weights of values that occur up to EXACT_POISSON times are Poisson
    counts, beyond that normal ones of the same mean and variance. Resamples that drew nothing have no mean and are left out. Nulls are left out; without values all is null.
    """
    g = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = g.select("v", "n", F.xxhash64("v").alias("key")).mapInArrow(_resampled(times, seed), "r long, t double, w double")
    means = parts.groupBy("r").agg(F.try_divide(F.sum("t"), F.sum("w")).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.975)).alias("high"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str], total_row: str | None = None) -> DataFrame:
    """Counts per row value and listed column value, with a total; total_row names a last row that holds the sums of all, the row value null included."""
    counts = [F.sum(F.when(F.col(column) == v, 1).otherwise(0)).cast("long").alias(v) for v in values]
    if total_row is None:
        g = df.groupBy(row).agg(*counts)
    else:
        g = df.rollup(F.col(row).cast("string").alias(row)).agg(F.grouping_id().alias("_all"), *counts)
        g = g.withColumn(row, F.when(F.col("_all") == 1, total_row).otherwise(F.col(row))).drop("_all")
    return g.withColumn("total", reduce(lambda a, b: a + b, (F.col(v) for v in values)))
