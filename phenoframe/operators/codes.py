"""Grouping of diagnosis, procedure and medication codes into features."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.functions.text import col


def pattern_tests(c: Column | str, patterns: list[str]) -> dict[str, Column]:
    """A search test for each pattern, named by feature_name."""
    return {feature_name(p): col(c).rlike(p) for p in patterns}


def group_tests(c: Column | str, groups: dict[str, list[str]]) -> dict[str, Column]:
    return {g: col(c).rlike("|".join(ps)) for g, ps in groups.items()}


def prefix_tests(c: Column | str, groups: dict[str, list[str]]) -> dict[str, Column]:
    """Literal prefixes, not patterns."""
    return {g: reduce(lambda a, b: a | b, (col(c).startswith(p) for p in ps)) for g, ps in groups.items()}


def equal_tests(c: Column | str, values: list[str]) -> dict[str, Column]:
    return {feature_name(v): col(c) == v for v in values}


def any_pattern(c: Column | str, patterns: list[str]) -> Column:
    return col(c).rlike("|".join(patterns))


def first_group(c: Column | str, groups: dict[str, str], otherwise: Column | None = None) -> Column:
    """The first group, in the given order, whose pattern the value contains."""
    out = None
    for name, p in groups.items():
        out = F.when(col(c).rlike(p), name) if out is None else out.when(col(c).rlike(p), name)
    return out if otherwise is None else out.otherwise(otherwise)


def first_canonical(c: Column | str, names: dict[str, str]) -> Column:
    """The canonical name of the first name, in the given order, that the value contains, whatever the case; null without one."""
    out = None
    for name, canonical in names.items():
        t = F.contains(F.lower(col(c)), F.lit(name.lower()))
        out = F.when(t, canonical) if out is None else out.when(t, canonical)
    return out


def one_hot(df: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """One row per keys with a 0/1 column for each of names, those that never occur included; other values are left out."""
    return df.groupBy(*keys).agg(*(F.max((F.coalesce(F.col(value), F.lit("")) == n).cast("int")).alias(feature_name(n)) for n in names))


def total(df: DataFrame, names: list[str], out: str) -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a + b, (F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in names)))


def merge_synonyms(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each (a, b) in order: a becomes the larger of both, b goes."""
    for a, b in pairs:
        df = df.withColumn(a, F.greatest(f"`{a}`", f"`{b}`")).drop(b)
    return df


def feature_name(pattern: str) -> str:
    """A column name for a pattern: letters and digits only, parted by underscores."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", pattern).strip("_").lower()


def safe_names(df: DataFrame, marks: str = "[]<>") -> DataFrame:
    """Columns renamed with an underscore for each of the marks."""
    return df.withColumnsRenamed({c: re.sub(f"[{re.escape(marks)}]", "_", c) for c in df.columns if any(m in c for m in marks)})


# Names for the signs of a pattern, for learners that allow letters, digits and underscores only.
SIGNS = {
    r"\b": "_B_", r"\s": "_S_", "|": "_OR_", "(": "_LP_", ")": "_RP_", "[": "_LB_", "]": "_RB_", "{": "_LC_", "}": "_RC_", "+": "_PLUS_", "?": "_Q_", "*": "_STAR_", "^": "_CARET_",
}


def spelt_name(pattern: str) -> str:
    """A pattern with its signs spelt out."""
    return re.sub("|".join(map(re.escape, SIGNS)), lambda m: SIGNS[m[0]], pattern)


def spelt_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: spelt_name(c) for c in df.columns if spelt_name(c) != c})


def suffixed(df: DataFrame, suffix: str, but: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in but})
