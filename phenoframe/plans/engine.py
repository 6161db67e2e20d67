"""The facade: a registry of phenotypes and prediction over tables by role."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from phenoframe.operators import metrics
from phenoframe.plans.phenotypes import RULES, Phenotype, features, predict
from phenoframe.session import ship
from phenoframe.sources.schema import validated
from phenoframe.sources.tables import load_model, save_predictions, spec_folder


class Registry:
    """Phenotypes by canonical name, and their aliases."""

    def __init__(self, folder: Path | None = None) -> None:
        self.models: dict[str, Phenotype] = {}
        self.aliases: dict[str, str] = {}
        for path in sorted((folder or spec_folder()).glob("*.yaml")):
            self.register_model(Phenotype.load(path))

    def register_model(self, p: Phenotype) -> None:
        self.models[p.name] = p
        for a in p.aliases:
            self.register_alias(a, p.name)

    def register_alias(self, alias: str, name: str) -> None:
        if name not in self.models:
            raise ValueError(f"no phenotype {name!r} to be called {alias!r}")
        if alias in self.models:
            raise ValueError(f"{alias!r} is a phenotype's own name")
        self.aliases[alias] = name

    def resolve(self, name: str) -> Phenotype:
        found = self.models.get(self.aliases.get(name, name))
        if found is None:
            raise ValueError(f"unknown phenotype {name!r}; known are {', '.join(self.all_names())}")
        return found

    def is_valid(self, name: str) -> bool:
        return self.aliases.get(name, name) in self.models

    def all_names(self, aliases: bool = True) -> list[str]:
        return sorted([*self.models, *(self.aliases if aliases else [])])

    def info(self, name: str) -> dict:
        p = self.resolve(name)
        return {"name": p.name, "aliases": sorted(a for a, n in self.aliases.items() if n == p.name), "kind": p.kind, "inputs": p.inputs, "credits": p.credits, "link": p.link}


class Engine:
    """Predicts phenotypes: Engine(spark).predict("af", icd=icd).

    A prediction is a lazy plan; nothing is read but for the validation of null keys and the test that there are rows at all, which strict=False leaves out.
    Saved models are loaded once.
    """

    def __init__(self, spark: SparkSession, registry: Registry | None = None, strict: bool = True) -> None:
        ship(spark)
        self.spark, self.registry, self.strict = spark, registry or Registry(), strict
        self._models: dict[str, Any] = {}

    def register(self, path: str) -> Phenotype:
        """Add a phenotype from a YAML file."""
        p = Phenotype.load(path)
        self.registry.register_model(p)
        return p

    def get_available_models(self) -> list[str]:
        return self.registry.all_names(aliases=False)

    def get_data_format(self, phenotype: str) -> dict[str, dict[str, str]]:
        return self.registry.resolve(phenotype).inputs

    def get_credits(self, phenotype: str) -> str:
        p = self.registry.resolve(phenotype)
        return " ".join(x for x in (p.credits, p.link) if x)

    def find_compatible_models(self, data: dict[str, DataFrame]) -> list[str]:
        """Phenotypes whose tables are all among the given ones; columns are checked at prediction."""
        return [n for n, p in sorted(self.registry.models.items()) if set(p.inputs) <= set(data)]

    def _data(self, p: Phenotype, data: dict[str, DataFrame] | None, roles: dict[str, DataFrame], force: bool) -> dict[str, DataFrame]:
        every = {**(data or {}), **roles}
        missing = [r for r in p.inputs if r not in every]
        if missing:
            raise ValueError(f"{p.name} needs the tables {missing}")
        out = validated({r: every[r] for r in every}, p.inputs, force, self.strict)
        first = next(iter(p.inputs)) if p.kind in RULES else "note"
        if self.strict and p.inputs and out[first].isEmpty():
            raise ValueError(f"{p.name}: the table {first} has no rows")
        return out

    def _model(self, path: str):
        if path not in self._models:
            self._models[path] = load_model(path)
        return self._models[path]

    def features(self, phenotype: str, data: dict[str, DataFrame] | None = None, force_casting: bool = False, **roles: DataFrame) -> DataFrame:
        """The features of a phenotype with notes, one row a note; a model is not needed for them."""
        p = self.registry.resolve(phenotype)
        if p.kind in RULES:
            raise ValueError(f"{p.name} is a rule on codes and has no features")
        return features(p, self._data(p, data, roles, force_casting))

    def predict(self, phenotype: str | list[str], data: dict[str, DataFrame] | None = None, return_features: bool = False, force_casting: bool = False, **roles: DataFrame):
        """Predictions of one phenotype, or a dict of them by the names as given; with features as (features or None, predictions)."""
        if isinstance(phenotype, str):
            p = self.registry.resolve(phenotype)
            made, predictions = predict(p, self._data(p, data, roles, force_casting), self._model)
            return (made, predictions) if return_features else predictions
        return {name: self.predict(name, data, return_features, force_casting, **roles) for name in phenotype}

    def save_predictions(self, results, folder: str) -> list[str]:
        return save_predictions(results, folder)

    def evaluate(self, phenotype: str, truth: DataFrame, data: dict[str, DataFrame] | None = None, **roles: DataFrame) -> DataFrame:
        """One row of metrics against truth (id, date or note_idx, actual): the confusion counts and rates, and ROC AUC where there are probabilities."""
        found = self.predict(phenotype, data, **roles)
        on = [c for c in ("note_idx", "id", "date") if c in found.columns and c in truth.columns]
        both = found.join(truth.select(*on, "actual"), on)
        out = metrics.confusion(both, "actual", "prediction")
        return out.withColumn("roc_auc", metrics.roc_auc(both, "actual", "prob_YES").scalar()) if "prob_YES" in found.columns else out
