"""Command lines: predictions of a batch of phenotypes, and the comparison of model families.

python -m phenoframe.cli predict --data-dir DIR --output DIR [--prefix NAME] [--models A,B] [--return-features]
python -m phenoframe.cli compare --input TABLE --output_dir DIR [--source_column C] [--target_column C] [--drop_columns A,B] [--n_folds K] [--random_seed N] [--families A,B]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.operators import compare, metrics
from phenoframe.plans.engine import Engine
from phenoframe.session import column_free
from phenoframe.sources import tables

log = logging.getLogger("phenoframe")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="phenoframe", description=__doc__.splitlines()[0])
    what = p.add_subparsers(dest="what", required=True)
    a = what.add_parser("predict", help="predict all phenotypes that the tables of a folder allow")
    a.add_argument("--output", required=True)
    a.add_argument("--data-dir", required=True)
    a.add_argument("--prefix", default="outcome_prediction", help="tables are <prefix>_notes.parquet, <prefix>_icd.parquet, ...")
    a.add_argument("--models", help="comma-separated names; all that the tables allow if left out")
    a.add_argument("--return-features", action="store_true")
    a.add_argument("--show-progress", action="store_true")
    b = what.add_parser("compare", help="compare model families over sources, or over folds without a source column")
    b.add_argument("--input", required=True)
    b.add_argument("--output_dir", required=True)
    b.add_argument("--source_column", default="source")
    b.add_argument("--target_column", default="annot")
    b.add_argument("--drop_columns", default="")
    b.add_argument("--random_seed", type=int, default=42)
    b.add_argument("--n_folds", type=int, default=5)
    b.add_argument("--families", default="logistic,logistic_l1,random_forest,boosted_trees,linear_svc")
    return p


def predict(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Writes <output>/<phenotype>/predictions.parquet for each phenotype; one that fails is reported and left out, and all failing is an error."""
    engine, data = Engine(spark), tables.read_roles(spark, args.data_dir, args.prefix)
    names = args.models.split(",") if args.models else engine.find_compatible_models(data)
    done, failed = [], {}
    for k, name in enumerate(names, 1):
        if args.show_progress:
            log.warning("%d of %d: %s", k, len(names), name)
        try:
            done += engine.save_predictions({name: engine.predict(name, data, return_features=args.return_features)}, args.output)
        except ValueError as e:
            failed[name] = str(e)
            log.warning("%s: %s", name, e)
    if failed and not done:
        raise ValueError(f"no phenotype could be predicted: {failed}")
    return done


def run_comparison(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Writes results, their summary, class counts, the final model and its row under output_dir; gives the final row."""
    df = tables.read_parquet(spark, args.input).drop(*(c for c in args.drop_columns.split(",") if c))
    df = df.where(F.col(args.target_column).isNotNull()).withColumnRenamed(args.target_column, "label")
    key = column_free(df, "_key")
    by_source = args.source_column in df.columns
    names = [c for c, t in df.dtypes if c not in ("label", args.source_column) and t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")]
    df = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in names), F.col("label").cast("int").alias("label"), *([args.source_column] if by_source else [])).na.fill(0, names)
    df = df.withColumn(key, F.xxhash64(*(F.col(f"`{c}`") for c in names)))
    out, families = args.output_dir.rstrip("/"), args.families.split(",")
    tables.write(metrics.class_balance(df, "label"), f"{out}/class_balance", "csv")
    if by_source:
        rows = compare.leave_one_out(df, names, args.source_column, key=key, families=families, k=args.n_folds, seed=args.random_seed)
        tables.write(rows, f"{out}/leave_one_out_results", "csv")
        tables.write(compare.summary(rows, ["model", "test_source"]).orderBy("model", "test_source"), f"{out}/leave_one_out_summary", "csv")
    else:
        rows = compare.k_folds(df, names, key=key, families=families, k=args.n_folds, seed=args.random_seed)
        tables.write(rows, f"{out}/kfold_results", "csv")
        tables.write(compare.summary(rows, ["model"]).orderBy("model"), f"{out}/kfold_summary", "csv")
    model, row = compare.production_model(df, names, compare.best_family(rows), key=key, k=args.n_folds, seed=args.random_seed)
    tables.save_model(model, f"{out}/final_model")
    tables.write(row, f"{out}/final_model_info", "json")
    return row


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("phenoframe").getOrCreate()
    (predict if args.what == "predict" else run_comparison)(spark, args)


if __name__ == "__main__":
    main()
