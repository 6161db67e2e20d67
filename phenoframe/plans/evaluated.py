"""Queries on predictions: metrics, thresholds, training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.functions import text
from phenoframe.operators import metrics, ml, score
from phenoframe.plans.base import Book, scored, sql
from phenoframe.plans.texts import _TOKENS
from phenoframe.session import broadcast_if_small, cut, table

query = Book()


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("pred", (F.col("score") > 0.5).cast("int"))


_CONF = """count(*) as n, sum((label = 1 and pred = 1)::int)::bigint as tp, sum((label = 0 and pred = 1)::int)::bigint as fp,
sum((label = 0 and pred = 0)::int)::bigint as tn, sum((label = 1 and pred = 0)::int)::bigint as fn"""
_RATES = """round((tp + tn) / n, 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
round(coalesce(tn / nullif(tn + fp, 0), 0), 6) as specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1"""
_P = "p as (select *, (score > 0.5)::int as pred from s)"


@query(sql(f"select * from (with {_P} select grp, n, tp, fp, tn, fn, {_RATES} from (select grp, {_CONF} from p group by 1))"))
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.confusion(_predicted(spark, d), "label", "pred", ["grp"]))


_D = "d as (select score, sum(label)::bigint as p, sum(1 - label)::bigint as m from s group by 1), v as (select score, p, sum(p) over w as tp, sum(m) over w as fp, sum(p) over () as pos, sum(m) over () as neg from d window w as (order by score desc))"


def _curve(x: str) -> str:
    return sql(f"select * from (with {_D} {x})")


@query(sql("select round((sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) as roc_auc from (select label, (rank() over (order by score) + (count(*) over (partition by score) - 1) / 2) as r from s)"))
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.roc_auc(scored(spark, d), "label", "score"))


@query(_curve("select round(sum(p / pos * tp / (tp + fp)), 6) as average_precision from v"))
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.average_precision(scored(spark, d), "label", "score"))


@query(_curve("select score as threshold, round(tp / pos, 6) as tpr, round(fp / neg, 6) as fpr from v"))
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.roc_curve(scored(spark, d), "label", "score"))


@query(_curve("select score as threshold, round(tp / (tp + fp), 6) as precision, round(tp / pos, 6) as recall from v"))
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.pr_curve(scored(spark, d), "label", "score"))


_GRID = """
select t / 100 as threshold, tp, fp, tn, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round((tpr + tnr) / 2, 6) as balanced_accuracy,
  round(tpr + tnr - 1, 6) as youdens_j, round(coalesce(tp / nullif(tp + fp, 0), 0) * tpr, 6) as precision_recall_product from (
  select *, coalesce(tp / nullif(tp + fn, 0), 0) as tpr, coalesce(tn / nullif(tn + fp, 0), 0) as tnr from (
    select t, sum((label = 1 and x >= t)::int)::bigint as tp, sum((label = 0 and x >= t)::int)::bigint as fp, sum((label = 0 and x < t)::int)::bigint as tn, sum((label = 1 and x < t)::int)::bigint as fn
    from (select label, round(score * 100, 9) as x from s), range(1, 100) r(t) group by t))"""


@query(sql(_GRID))
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.threshold_grid(scored(spark, d), "label", "score"))


@query(sql(f"select threshold, youdens_j as value from ({_GRID}) order by 2 desc, 1 limit 1"))
def best_grid_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.best_threshold(metrics.threshold_grid(scored(spark, d), "label", "score"), "youdens_j"))


@query(_curve("select score as threshold, round(tp / pos - fp / neg, 6) as youdens_j from v order by round(tp / pos - fp / neg, 9) desc, score desc limit 1"))
def youden_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.youden_threshold(scored(spark, d), "label", "score"))


@query(_curve("select score as threshold, round(f, 6) as f1 from (select score, 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos + 1e-8) as f from v) order by round(f, 9) desc, score limit 1"))
def f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.f1_threshold(scored(spark, d), "label", "score"))


@query(_curve("select score as threshold, round(fp / neg, 6) as fpr, round(tp / pos, 6) as tpr from v order by round(abs(tp / pos - 0.95), 9), score desc limit 1"))
def tpr_target_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.tpr_threshold(scored(spark, d), "label", "score", 0.95))


_WORDS = ["tremor", "falls", "clinic", "velumodor", "seizure", "mri"]


def _features(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").where("annot in (0, 1) and note is not null")
    patient = F.coalesce("bdsp_patient_id", F.concat(F.lit("note "), F.col("note_id").cast("string")))  # who is not known is alone
    return n.select("note_id", "grp", patient.alias("patient"), F.col("annot").alias("label"), *(text.matches(F.lower("note"), w).alias(w) for w in _WORDS))


_FEAT = "f as (select note_id, annot as label, " + ", ".join(f"contains(lower(note), '{w}')::int as {w}" for w in _WORDS) + " from notes where annot in (0, 1) and note is not null)"


@query(
    f"with {_FEAT}, u as (unpivot f on {', '.join(_WORDS)} into name feature value x), "
    "g as (select feature, label, sum(x) as o, count(*) as n from u group by 1, 2), t as (select feature, sum(o) as t, sum(n) as a from g group by 1) "
    "select feature, round(sum(coalesce((o - n / a * t) ** 2 / nullif(n / a * t, 0), 0)), 6) as chi2 from g join t using (feature) group by 1 order by sum(coalesce((o - n / a * t) ** 2 / nullif(n / a * t, 0), 0)) desc, feature limit 4"
)
def chi2_topk(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.top_features(metrics.chi2_scores(_features(spark, d), "label", _WORDS), 4))


@query(sql("""
select round(sqrt(avg((a - b) ** 2)), 6) as rmse, round(corr(ra, rb), 6) as spearman from (
  select a, b, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb
  from (select key % 42 as a, score * 42 as b from s))"""))
def rmse_spearman(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select((F.col("key") % 42).alias("a"), (F.col("score") * 42).alias("b"))
    return metrics.rounded(metrics.rmse_spearman(s, "a", "b"))


@query(sql("select label, n, round(n / sum(n) over (), 6) as share, (n / sum(n) over () < 0.1)::int as minority from (select label, count(*) as n from s group by 1)"))
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.class_balance(scored(spark, d), "label"))


_BY = "select grp, (key % 3)::bigint as model, avg((label = (score > 0.5)::int)::int) as accuracy from s group by 1, 2"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    s = _predicted(spark, d).withColumn("model", F.col("key") % 3)
    return s.groupBy("grp", "model").agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))


@query(sql(f"select model, round(avg(accuracy), 6) as accuracy_mean, round(stddev_samp(accuracy), 6) as accuracy_std from ({_BY}) group by 1"))
def metric_summary_by_model(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.metric_summary(_runs(spark, d), ["model"], ["accuracy"]))


@query(sql(f"select model, round(avg(accuracy), 6) as accuracy_mean from ({_BY}) group by 1 order by round(avg(accuracy), 9) desc, model limit 1"))
def best_model_top1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(metrics.best_by(_runs(spark, d), "model", "accuracy"))


@query(sql(f"select * from (with {_P} select key, case when label = 0 and pred = 1 then 'false_positive' when label = 1 and pred = 0 then 'false_negative' else 'correct' end as error_type from p)"))
def error_tagging(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tagged(_predicted(spark, d), "label", "pred").select("key", "error_type")


@query(sql("select key, round(1 - score, 6) as \"prob_NO\", round(score, 6) as \"prob_YES\", (score > 0.5)::int as prediction from s"))
def binary_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(score.binary(scored(spark, d), "score").select("key", "prob_NO", "prob_YES", "prediction"))


@query(sql("select key, score as prob_any, (score >= 0.5)::int as pred_any, score * score as prob_one, (score * score >= 0.3)::int as pred_one from s"))
def multi_task_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return score.multi(scored(spark, d), {"any": s, "one": s * s}, {"any": 0.5, "one": 0.3}, True).select("key", "prob_any", "pred_any", "prob_one", "pred_one")


@query(sql("select key, greatest(0, least(42, round(score * 60 - 9, 6))) as score from s"))
def clipped_regression(spark: SparkSession, d: str) -> DataFrame:
    return score.clipped(scored(spark, d), F.round(F.col("score") * 60 - 9, 6), 0.0, 42.0, "score").select("key", "score")


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_interval(scored(spark, d), "score")


@query()
def ml_logreg_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression on keyword flags, scored on the rows: note_id and the binary prediction."""
    f = _features(spark, d)
    model = ml.scaled_pipeline(f, _WORDS, ml.families()["logistic"][0]).fit(f)
    return score.binary(ml.probability(model.transform(f)), "prob").select("note_id", "prob_NO", "prob_YES", "prediction")


@query()
def ml_group_kfold(spark: SparkSession, d: str) -> DataFrame:
    """Mean AUC of each point of a grid in cross validation over folds by patient."""
    f = ml.grouped_fold(_features(spark, d).na.drop("any"), "patient", 3)
    est, grid = ml.families()["logistic_l1"]
    f = ml.scaled_pipeline(f, _WORDS, est).fit(f).transform(f).select("features", "label", "fold")
    cv = ml.grid_search(f, est, grid, k=3)
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(cv.avgMetrics)], "point int, auc double")


@query()
def ml_lasso_clip(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    f = VectorAssembler(inputCols=_WORDS, outputCol="features").transform(_features(spark, d).withColumn("y", F.col("label") * 20.0))
    return score.clipped(ml.lasso("y", 0.1).fit(f).transform(f), "prediction", 0.0, 42.0, "score").select("note_id", "score")


@query(f"""
with w as (select note_id, {_TOKENS} as w from (select note_id, note from notes where note is not null)),
g as (select distinct note_id, g from (select note_id, unnest(w) as g from w
  union all select note_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w union all select note_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w)),
v as (select g from g group by g having count(*) >= 5 and count(*) / (select count(*) from w) * (1 - count(*) / (select count(*) from w)) > 0.09)
select w.note_id, count(v.g)::bigint as n_grams from w left join g on g.note_id = w.note_id left join v on v.g = g.g group by 1""")
def ml_ngram_vectorizer(spark: SparkSession, d: str) -> DataFrame:
    """1- to 3-grams of at least 5 notes whose presence has a variance above 0.09, and the number of these that each note holds."""
    n = cut(table(spark, d, "notes").where("note is not null").select("note_id", text.tokens(text.clean_standard("note")).alias("w")))
    keep = broadcast_if_small(ml.varied_ngrams(n, "w").select("ngram"))
    held = n.select("note_id", F.explode(ml.distinct_ngrams("w")).alias("ngram")).join(keep, "ngram").groupBy("note_id").agg(F.count(F.lit(1)).alias("n_grams"))
    return n.select("note_id").join(held, "note_id", "left").na.fill(0, ["n_grams"])


@query()
def ml_multitask(spark: SparkSession, d: str) -> DataFrame:
    """One model per task on the same features, thresholds inclusive."""
    f = _features(spark, d)
    out = f.select("note_id", *_WORDS, "label")
    for task, label in (("any", F.col("label")), ("first_group", (F.col("grp") == 1).cast("int"))):
        g = f.withColumn("label", F.coalesce(label, F.lit(0)))
        model = ml.scaled_pipeline(g, _WORDS, ml.families()["logistic"][0]).fit(g)
        p = ml.probability(model.transform(g)).select("note_id", F.col("prob").alias(f"prob_{task}"))
        out = out.join(p, "note_id")
    return score.multi(out, {t: F.col(f"prob_{t}") for t in ("any", "first_group")}, {"any": 0.5, "first_group": 0.5}, True).select("note_id", "prob_any", "pred_any", "prob_first_group", "pred_first_group")
