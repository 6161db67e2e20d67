"""Training: folds, vectors, estimators."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, NGram, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_fold(df: DataFrame, key: str, k: int = 5, name: str = "fold") -> DataFrame:
    """A fold by the hash of a key: all rows of a key share it."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))


def stratified_fold(df: DataFrame, label: str, key: str, k: int = 5, name: str = "fold") -> DataFrame:
    """Folds of near-equal class shares. Rows are ranked within hash buckets of a class, so that no class is sorted in one task."""
    b = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(256))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy(F.xxhash64(key), key))
    return df.withColumn("_b", b).withColumn(name, F.pmod(rank + F.col("_b"), F.lit(k)).cast("int")).drop("_b")


def binary_columns(df: DataFrame, names: list[str]) -> tuple[list[str], list[str]]:
    """(0/1 features, others), from one aggregation."""
    row = df.agg(*(F.min(F.when(F.col(f"`{c}`").isin(0, 1) | F.col(f"`{c}`").isNull(), 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(names))).first()
    two = [c for i, c in enumerate(names) if row[f"c{i}"] in (1, None)]
    return two, [c for c in names if c not in two]


def scaled_pipeline(df: DataFrame, names: list[str], estimator) -> Pipeline:
    """Only columns that are not 0/1 are scaled."""
    two, rest = binary_columns(df, names)
    stages, parts = [], []
    if rest:
        stages += [VectorAssembler(inputCols=rest, outputCol="_rest", handleInvalid="keep"), StandardScaler(inputCol="_rest", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    if two:
        stages.append(VectorAssembler(inputCols=two, outputCol="_two", handleInvalid="keep"))
        parts.append("_two")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features"), estimator])


def families(label: str = "label", weight: str | None = None, seed: int = 42) -> dict[str, tuple]:
    """Estimators with their grids, by name. Kernel machines have no distributed form here; boosters that others trained are scored by score.boosted."""
    w = {"weightCol": weight} if weight else {}
    lr = LogisticRegression(labelCol=label, maxIter=50, **w)
    l1 = LogisticRegression(labelCol=label, elasticNetParam=1.0, maxIter=50, **w)
    net = LogisticRegression(labelCol=label, maxIter=50, **w)
    rf, gbt, svc = RandomForestClassifier(labelCol=label, seed=seed, **w), GBTClassifier(labelCol=label, seed=seed, maxIter=20, **w), LinearSVC(labelCol=label, maxIter=50, **w)
    return {
        "logistic": (lr, ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1, 1.0]).build()),
        "logistic_l1": (l1, ParamGridBuilder().addGrid(l1.regParam, [0.001, 0.01, 0.1]).build()),
        "elastic_net": (net, ParamGridBuilder().addGrid(net.regParam, [0.01, 0.1]).addGrid(net.elasticNetParam, [0.2, 0.5, 0.8]).build()),
        "random_forest": (rf, ParamGridBuilder().addGrid(rf.numTrees, [50, 100]).addGrid(rf.maxDepth, [5, 10]).build()),
        "boosted_trees": (gbt, ParamGridBuilder().addGrid(gbt.maxDepth, [3, 5]).build()),
        "linear_svc": (svc, ParamGridBuilder().addGrid(svc.regParam, [0.01, 0.1]).build()),
    }


def balanced_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """df with a weight by class, rows over classes times the class's rows; the counts of the classes are the only thing that is collected."""
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError("more than 1,000 classes")
    whole, out = sum(counts.values()), F.lit(0.0)
    for value, n in counts.items():
        out = F.when(F.col(label) == value, whole / (len(counts) * n)).otherwise(out)
    return df.withColumn(name, out)


def grid_search(train: DataFrame, estimator, grid: list, label: str = "label", fold: str = "fold", k: int = 5, metric: str = "areaUnderROC", parallelism: int = 4) -> CrossValidatorModel:
    """Cross validation over a grid with the given fold column."""
    ev = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=ev, numFolds=k, foldCol=fold, parallelism=parallelism).fit(train)


def sources_of(df: DataFrame, source: str, most: int = 1000) -> list:
    """The values of a source column in order; more than `most` are an error, as each of them is to be a model of its own."""
    names = [r[0] for r in df.where(F.col(source).isNotNull()).select(source).distinct().orderBy(source).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} values of {source}")
    return names


def left_out(df: DataFrame, source: str, most: int = 1000) -> list[tuple[str, DataFrame, DataFrame]]:
    """(source, all others, that source) for each source; more than `most` sources are an error."""
    return [(n, df.where(F.col(source) != n), df.where(F.col(source) == n)) for n in sources_of(df, source, most)]


def probability(df: DataFrame, name: str = "prob") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction")


def ngram_pipeline(tokens: str, least_docs: int = 5, most: int = 2**31 - 1) -> Pipeline:
    """Binary vectors of all 1- to 3-grams that occur in at least least_docs texts; `most` is no bound by default, what is collected are the n-grams that there are."""
    stages, parts = [], []
    for n in (1, 2, 3):
        stages.append(NGram(n=n, inputCol=tokens, outputCol=f"_g{n}"))
        stages.append(CountVectorizer(inputCol=f"_g{n}", outputCol=f"_v{n}", binary=True, minDF=float(least_docs), vocabSize=most))
        parts.append(f"_v{n}")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def distinct_ngrams(tokens: Column | str, most: int = 3) -> Column:
    """The distinct 1- to `most`-grams of an array of words, as texts."""
    w = F.col(tokens) if isinstance(tokens, str) else tokens

    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(runs(n) for n in range(1, most + 1))))


def varied_ngrams(df: DataFrame, tokens: str, least_docs: int = 5, least_variance: float = 0.09) -> DataFrame:
    """(ngram, n_docs) of all 1- to 3-grams that occur in at least least_docs texts and whose presence varies more than least_variance (population variance p (1 - p)).

    Counted by a pre-aggregated group-by, nothing is collected. An n-gram with that variance is in a share p of all texts that is bounded below, so
    however large the corpus, no more than (n-grams of a text) / p come out. An empty table gives an empty result.
    """
    n = df.count()
    grams = df.select(F.explode(distinct_ngrams(tokens)).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n_docs"))
    p = F.col("n_docs") / F.lit(float(max(n, 1)))
    return grams.where((F.col("n_docs") >= least_docs) & (p * (1 - p) > least_variance))


def varied(df: DataFrame, features: str, least: float) -> list[int]:
    """Places of the vector whose population variance exceeds `least`."""
    row = df.agg(Summarizer.variance(F.col(features)).alias("v"), F.count(F.lit(1)).alias("n")).first()
    n = row["n"]
    return [i for i, v in enumerate(row["v"].toArray()) if n and v * (n - 1) / n > least]


def lasso(label: str, alpha: float) -> LinearRegression:
    return LinearRegression(labelCol=label, regParam=alpha, elasticNetParam=1.0, standardization=False)
