"""Turning probabilities, regressions and grades into predictions."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.functions.dates import clip
from phenoframe.functions.text import any_phrase, col, last_match, literals


def binary(df: DataFrame, prob: Column | str, threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """prob_NO, prob_YES and prediction; the threshold itself counts only if inclusive."""
    p = col(prob).cast("double")
    return df.withColumns({"prob_NO": 1 - p, "prob_YES": p, "prediction": (p >= threshold if inclusive else p > threshold).cast("int")})


def multi(df: DataFrame, probs: dict[str, Column], thresholds: dict[str, float], inclusive: bool) -> DataFrame:
    """prob_<task> and pred_<task> for each task, each with its own threshold."""
    new = {}
    for task, p in probs.items():
        new[f"prob_{task}"] = p
        new[f"pred_{task}"] = (p >= thresholds[task] if inclusive else p > thresholds[task]).cast("int")
    return df.withColumns(new)


def clipped(df: DataFrame, score: Column | str, low: float, high: float, name: str) -> DataFrame:
    return df.withColumn(name, clip(score, low, high))


def linear(features: dict[str, float], bias: float) -> Column:
    """Weighted sum of feature columns; a missing value counts as 0."""
    out = F.lit(float(bias))
    for c, w in features.items():
        out = out + F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) * w
    return out


def logistic(features: dict[str, float], bias: float) -> Column:
    return 1 / (1 + F.exp(-linear(features, bias)))


def multi_label(df: DataFrame, keys: list[str], models: dict[str, dict | None]) -> DataFrame:
    """keys and prob_<label>, pred_<label> for each label that has a model: {weights, bias, threshold}. Each has its own features; those that df lacks count as 0.

    The threshold itself does not count. Labels without a model are left out with a warning.
    """
    have = set(df.columns)
    new = {}
    for label, m in models.items():
        if m is None:
            warnings.warn(f"no model for {label}", stacklevel=2)
            continue
        absent = [f for f in m["weights"] if f not in have]
        if absent:
            warnings.warn(f"{label}: {len(absent)} features are missing and count as 0", stacklevel=2)
        p = logistic({f: w for f, w in m["weights"].items() if f in have}, m.get("bias", 0.0))
        new[f"prob_{label}"], new[f"pred_{label}"] = p, (p > m.get("threshold", 0.5)).cast("int")
    return df.select(*keys, *(c.alias(n) for n, c in new.items()))


class Booster:
    """Boosted trees from a JSON dump (a list of trees of nodes: nodeid, split, split_condition, yes, no, missing, children; leaves: nodeid, leaf), as arrays.

    Features are named in an explicit order. A node sends a value below its condition to `yes`, others to `no`, nulls and NaN to `missing`.
    """

    def __init__(self, trees: list[dict], features: list[str], base: float = 0.0):
        self.features, self.base = list(features), float(base)
        place = {f: i for i, f in enumerate(self.features)}
        split, at, yes, no, missing, leaf, self.roots = [], [], [], [], [], [], []
        for tree in trees:
            first, todo, number = len(split), [tree], {}
            nodes = []
            while todo:
                node = todo.pop()
                number[node["nodeid"]] = first + len(nodes)
                nodes.append(node)
                todo += node.get("children", [])
            self.roots.append(first)
            for k, node in enumerate(nodes, first):
                if "leaf" not in node and node["split"] not in place:
                    raise ValueError(f"a tree splits on {node['split']!r}, which is not among the features")
                inner = "leaf" not in node
                split.append(place[node["split"]] if inner else 0)
                at.append(float(node["split_condition"]) if inner else 0.0)
                leaf.append(0.0 if inner else float(node["leaf"]))
                for out, way in ((yes, "yes"), (no, "no"), (missing, "missing")):
                    out.append(number[node.get(way, node["yes"])] if inner else k)
        self.split, self.at, self.leaf = np.array(split, dtype=np.int64), np.array(at), np.array(leaf)
        self.yes, self.no, self.missing = (np.array(x, dtype=np.int64) for x in (yes, no, missing))

    @classmethod
    def load(cls, path: str, features: list[str], base: float = 0.0) -> Booster:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")), features, base)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """base and the leaves' sum for each row of a matrix; all rows walk down a tree together."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                v = x[rows, self.split[node]]
                to = np.where(np.isnan(v), self.missing[node], np.where(v < self.at[node], self.yes[node], self.no[node]))
                if (to == node).all():
                    break
                node = to
            out += self.leaf[node]
        return out


def boosted(df: DataFrame, model: Booster, name: str = "prob") -> DataFrame:
    """df with the probability of a booster of a logistic objective, in Arrow batches; the model is broadcast, its size does not depend on the data."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(1 / (1 + np.exp(-sent.value.margin(x.to_numpy(dtype=float, na_value=np.nan)))))

    run.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    values = F.struct(*(F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(model.features)))
    return df.withColumn(name, F.pandas_udf(run, "double")(values))


# What a note says that grades a patient outright - phrases of death, the lines of the rubric that a template spells out with the words that vouch for
# that template, and the mention of a grade.
DEATH = (
    "notice of death", "death note", "patient deceased", "patient is deceased", "patient is dead", "deceased patient", "physician deceased", "report of death",
    "patient passed away", "patient died", "patient has died", "patient expired", "patient is expired", "patient as deceased", "time of death", "death was pronounced",
)
RUBRIC = {
    0: "the patient has no residual symptoms", 1: "the patient has no significant disability", 2: "the patient has slight disability", 3: "the patient has moderate disability",
    4: "the patient has moderately severe disability", 5: "the patient has severe disability", 6: "the patient has expired",
}
RUBRIC_NEEDS = "comprehensive stroke center"
MENTION = r"rankin(?:\s+scale)?(?:\s+is)?(?:\s+of)?\s*[:\-]?\s*([0-5])\b"


def stated_grade(text: Column | str, rubric: dict[int, str] | None = None, rubric_needs: str = RUBRIC_NEEDS, death: tuple[str, ...] = DEATH) -> Column:
    """The grade that a note states: 6 for a death phrase; else, in a note with the words that vouch for the template, the first grade of the rubric whose line
    (number, dash, text) it has; else the last mention of a grade (mrs counts as rankin, premorbid ones don't); null if it states none or is null."""
    t = F.lower(col(text))
    lines = F.lit(None).cast("int")
    for grade, line in reversed((RUBRIC if rubric is None else rubric).items()):
        lines = F.when(t.rlike(rf"{grade}\s?-\s?{re.escape(line).replace(chr(92) + ' ', ' ')}"), grade).otherwise(lines)
    mention = last_match(literals(t, [("mrs", "rankin"), ("premorbid rankin", "")]), MENTION).cast("int")
    return F.coalesce(F.when(any_phrase(t, list(death)), 6), F.when(t.contains(rubric_needs), lines), mention)


def overridden(df: DataFrame, grade: Column, prob: str, poor: int = 3, threshold: float = 0.5) -> DataFrame:
    """prob_poor and prediction, where a stated grade overrides the model: grade >= poor is 1 at probability 1, less is 0 at 0. The threshold itself counts."""
    df = df.withColumn("_grade", grade)
    p = F.coalesce((F.col("_grade") >= poor).cast("double"), col(prob))
    return df.withColumns({"prob_poor": p, "prediction": F.coalesce((F.col("_grade") >= poor).cast("int"), (col(prob) >= threshold).cast("int"))}).drop("_grade")


def aligned_features(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and exactly the named features, in order; features that are missing are 0."""
    have = set(df.columns)
    return df.select(*keys, *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) if n in have else F.lit(0).alias(n) for n in names))
