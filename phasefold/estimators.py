"""Estimators: settings in the constructor, ``fit(train, test)``, tables as the result."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from phasefold.operators import crossmap, crossval, multiview, selection, simplex, smap


@dataclass
class Estimator:
    x: list[str]
    y: list[str]
    settings: dict[str, Any] = field(default_factory=dict)
    result: Any = None

    def fit(self, train: DataFrame, test: DataFrame | None = None) -> Any:
        self.result = self._run(train, test)
        return self.result

    def _run(self, train: DataFrame, test: DataFrame | None) -> Any:
        raise NotImplementedError


class Simplex(Estimator):
    def _run(self, train, test):
        return simplex.simplex(train, self.x, self.y, test, **self.settings)


class SMap(Estimator):
    def _run(self, train, test):
        return smap.smap(train, self.x, self.y, test, **self.settings)


class Multiview(Estimator):
    def _run(self, train, test):
        return multiview.multiview(train, self.x, self.y, test, **self.settings)


class CrossMap(Estimator):
    def _run(self, train, test):
        return crossmap.mean_skill(crossmap.cross_map(train, self.x, self.y, test, **self.settings))


class CrossMapFolds(Estimator):
    def _run(self, train, test=None):
        return crossval.cross_map_by_fold(train, self.x, self.y, **self.settings)


class Selection(Estimator):
    """Greedy choice for every target; the gate is 'pre' where none is set."""

    def _run(self, train, test):
        self.train = train
        s = {"gate": "pre"} | self.settings
        self.choices = {t: selection.choose(train, self.x, t, test, **s) for t in self.y}
        return {t: c.steps for t, c in self.choices.items()}

    def predict(self, test: DataFrame | None = None, theta: float | None = None) -> DataFrame:
        """(run_id, pos, target, pred) of every target from its chosen variables."""
        return _union([selection.predict_selected(self.train, c.variables, t, test, self.settings.get("horizon", 1), theta=theta) for t, c in self.choices.items()])


class SelectionFolds(Estimator):
    """Greedy choice in every fold; ``how`` the final variables are taken: 'best_fold', 'frequency' or 'reselect'."""

    def _run(self, train, test=None):
        self.train = train
        self.folds = self.settings.get("folds")
        self.own = {k: v for k, v in self.settings.items() if k not in ("folds", "how")}
        s = {"gate": "post"} | self.own
        return {t: crossval.select_by_fold(train, self.x, t, self.folds, **s) for t in self.y}

    def variables(self) -> dict[str, list[str]]:
        how = self.settings.get("how", "best_fold")
        return {t: crossval.final_variables(self.train, f, self.x, t, how, **self.own) for t, f in self.result.items()}

    def best_folds(self) -> dict[str, int | None]:
        return {t: crossval.best_fold(f) for t, f in self.result.items()}

    def fold_predictions(self) -> DataFrame:
        return _union([crossval.fold_predictions(self.train, f, t, self.folds, self.own.get("horizon", 1)) for t, f in self.result.items()])

    def predict(self, test: DataFrame) -> DataFrame:
        """(run_id, pos, target, pred) of new data from all training runs and the final variables."""
        return _union([selection.predict_selected(self.train, v, t, test, self.own.get("horizon", 1)) for t, v in self.variables().items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
