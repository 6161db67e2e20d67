"""Phenotypes by rules on codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.operators.codes import any_pattern
from phenoframe.operators.temporal import with_next


def any_code(df: DataFrame, code: str, patterns: list[str]) -> DataFrame:
    """Each row with a matching code, predicted 1."""
    return df.where(any_pattern(code, patterns)).withColumn("prediction", F.lit(1))


def two_codes(df: DataFrame, code: str, patterns: list[str], key: str = "id", date: str = "date", over: int = 7, most: int = 365, tie: tuple[str, ...] = ()) -> DataFrame:
    """Of consecutive matching rows of a key the earlier one if more than `over` and at most `most` days lie between: next_date, time_diff, prediction."""
    hit = df.where(any_pattern(code, patterns))
    hit = with_next(hit, key, date, *tie).withColumn("time_diff", F.datediff("next_date", date))
    return hit.where((F.col("time_diff") > over) & (F.col("time_diff") <= most)).withColumn("prediction", F.lit(1))


def union_codes(parts: list[tuple[DataFrame, str, list[str], str]]) -> DataFrame:
    """Matching rows of several tables under one column `code`, with code_type; columns that a table lacks are null."""
    out = None
    for df, code, patterns, kind in parts:
        x = any_code(df, code, patterns).withColumnRenamed(code, "code").withColumn("code_type", F.lit(kind))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out
