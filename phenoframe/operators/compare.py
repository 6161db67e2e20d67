"""Comparison of model families over sources or folds, and the choice and refit of the best."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.operators import metrics, ml

MEASURES = ("accuracy", "precision", "recall", "f1", "roc_auc", "auprc")
ROWS = "model string, train_source string, test_source string, " + ", ".join(f"{m} double" for m in MEASURES) + ", best_params string"


def measured(scored: DataFrame, label: str = "label") -> dict[str, float | None]:
    """The measures of predictions with a probability (prob) and a class (prediction)."""
    c = metrics.confusion(scored, label, "prediction").first()
    out = {m: c[m] for m in MEASURES[:4]}
    out["roc_auc"] = metrics.roc_auc(scored, label, "prob").first()[0]
    out["auprc"] = metrics.average_precision(scored, label, "prob").first()[0]
    return out


def _scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions with prob; margins of a machine without probabilities serve as prob too, as the measures need their order only."""
    got = model.transform(df)
    return ml.probability(got) if "probability" in got.columns else got.withColumn("prob", ml.vector_to_array("rawPrediction")[1])


def search(train: DataFrame, names: list[str], family: str, label: str = "label", key: str = "key", k: int = 5, seed: int = 42) -> tuple[PipelineModel, str]:
    """The best model of a family's grid by ROC AUC over stratified folds, refit on all of train, and its parameters."""
    estimator, grid = ml.families(label, seed=seed)[family]
    folds = ml.stratified_fold(train, label, key, k).cache()
    try:
        prepared = ml.scaled_pipeline(folds, names, estimator)
        found = ml.grid_search(folds, prepared, grid, label, k=k)
        best = max(range(len(grid)), key=lambda i: (found.avgMetrics[i], -i))
        return found.bestModel, ", ".join(f"{p.name}={v}" for p, v in sorted(grid[best].items(), key=lambda x: x[0].name))
    finally:
        folds.unpersist()


def cross_source(df: DataFrame, names: list[str], source: str, label: str = "label", key: str = "key", families: Iterable[str] = ("logistic",), k: int = 5, seed: int = 42) -> DataFrame:
    """Each family trained on each source and measured on each other one: a row a pair. Sources are few (an error otherwise); those with one class only give nulls."""
    spark, rows = df.sparkSession, []
    known = ml.sources_of(df, source)
    for family in families:
        for one in known:
            model, params = search(df.where(F.col(source) == one), names, family, label, key, k, seed)
            rows += [(family, str(one), str(other), *measured(_scores(model, df.where(F.col(source) == other)), label).values(), params) for other in known if other != one]
    return spark.createDataFrame(rows, ROWS)


def leave_one_out(df: DataFrame, names: list[str], source: str, label: str = "label", key: str = "key", families: Iterable[str] = ("logistic",), k: int = 5, seed: int = 42) -> DataFrame:
    """Each family trained on all sources but one and measured on that one: a row each; train_source is 'others'."""
    rows = []
    for family in families:
        for one, train, test in ml.left_out(df, source):
            model, params = search(train, names, family, label, key, k, seed)
            rows.append((family, "others", str(one), *measured(_scores(model, test), label).values(), params))
    return df.sparkSession.createDataFrame(rows, ROWS)


def k_folds(df: DataFrame, names: list[str], label: str = "label", key: str = "key", families: Iterable[str] = ("logistic",), k: int = 5, seed: int = 42) -> DataFrame:
    """Each family measured on each of k stratified folds, trained (with a search of its own) on the others: a row each; test_source is the fold's number."""
    outer = ml.stratified_fold(df, label, key, k, "outer_fold").cache()
    rows = []
    for family in families:
        for fold in range(k):
            model, params = search(outer.where(F.col("outer_fold") != fold), names, family, label, key, k, seed)
            rows.append((family, "others", str(fold), *measured(_scores(model, outer.where(F.col("outer_fold") == fold)), label).values(), params))
    out = df.sparkSession.createDataFrame(rows, ROWS)
    outer.unpersist()
    return out


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean measures: avg_<measure>."""
    return rows.groupBy(*by).agg(*(F.avg(m).alias(f"avg_{m}") for m in MEASURES))


def best_family(rows: DataFrame) -> str:
    """The family with the largest mean ROC AUC, of equals the first by name."""
    return metrics.best_by(rows, "model", "roc_auc").first()["model"]


def hold_out(df: DataFrame, label: str = "label", key: str = "key", test: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test): a stratified split, one part in `test` for testing."""
    f = ml.stratified_fold(df, label, key, test, "_part")
    return f.where("_part <> 0").drop("_part"), f.where("_part = 0").drop("_part")


def production_model(df: DataFrame, names: list[str], family: str, label: str = "label", key: str = "key", metric: str = "f1", k: int = 5, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """The family's model refit on all rows; and one row on the held-out fifth of a model trained on the rest: family, parameters, threshold (best by metric), measures there."""
    train, test = hold_out(df, label, key)
    probe, params = search(train, names, family, label, key, k, seed)
    scored = _scores(probe, test)
    best = metrics.best_threshold(metrics.threshold_grid(scored, label, "prob"), metric).first()
    at = scored.withColumn("prediction", (F.col("prob") >= best["threshold"]).cast("int"))
    model, _ = search(df, names, family, label, key, k, seed)
    row = (family, params, metric, float(best["threshold"]), *measured(at, label).values())
    return model, df.sparkSession.createDataFrame([row], "model string, best_params string, metric string, threshold double, " + ", ".join(f"{m} double" for m in MEASURES))
