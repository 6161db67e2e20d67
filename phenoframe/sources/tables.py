"""Reading tables by role and writing results."""

from __future__ import annotations

from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

ROLES = {"note": "notes", "icd": "icd", "med": "med", "cpt": "cpt", "demo": "demo"}


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One table from any number of files, folders or globs; with a schema only its columns are read, so files may differ in the rest."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_roles(spark: SparkSession, folder: str, prefix: str) -> dict[str, DataFrame]:
    """The tables <folder>/<prefix>_<role>.parquet that exist; none at all is an error."""
    out = {}
    for role, suffix in ROLES.items():
        try:
            out[role] = spark.read.parquet(f"{folder}/{prefix}_{suffix}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not out:
        raise ValueError(f"no table {prefix}_*.parquet in {folder}")
    return out


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table as a folder of parquet, csv (with header) or json files."""
    w = df.write.mode(mode)
    {"parquet": w.parquet, "csv": w.option("header", True).option("escape", '"').csv, "json": w.json}[kind](path)


def save_predictions(results, folder: str) -> list[str]:
    """<folder>/<phenotype>/predictions.parquet, and features.parquet where a result brings features; a single result goes under output/."""
    done = []
    for name, result in (results if isinstance(results, dict) else {"output": results}).items():
        features, predictions = result if isinstance(result, tuple) else (None, result)
        write(predictions, f"{folder}/{name}/predictions.parquet")
        done.append(f"{folder}/{name}/predictions.parquet")
        if features is not None:
            write(features, f"{folder}/{name}/features.parquet")
            done.append(f"{folder}/{name}/features.parquet")
    return done


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline as a folder, over what was there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def spec_folder() -> Path:
    return Path(__file__).parent.parent / "plans" / "specs"
