"""Model selection: own ridge, own lasso and ridge on each graph for every horizon, the penalty chosen on validation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from . import models
from .panel import moments, pooled, predictions


def ridge_path(of: dict[tuple[str, int], np.ndarray], g: np.ndarray, tau: int, columns: np.ndarray, free: bool, c: Config = CONFIG) -> list[tuple[float, float, np.ndarray]]:
    """alpha, validation error, theta of every ridge penalty, from the panel's moments."""
    train, val = (pooled(of[split, tau], g, c) for split in ("train", "val"))
    return [(a, models.mse_of(val, theta), theta) for a in models.RIDGE_ALPHAS for theta in [models.ridge(train, a, columns, free)]]


def fitted(rows: DataFrame, graphs: dict[str, np.ndarray], c: Config = CONFIG) -> list[tuple[str, str, int, float, float, np.ndarray]]:
    """model, graph, tau, alpha, val_mse, theta of the best penalty (the first of equals) for every horizon and model."""
    found, own, every = [], np.append(np.arange(c.features), 2 * c.features), np.arange(2 * c.features + 1)
    none, of = np.zeros((c.assets, c.assets)), moments(rows, c)
    alone = {(split, tau): pooled(of[split, tau], none, c) for tau in c.taus for split in ("train", "val")}
    lassos = dict(zip(c.taus, models.lassos([alone["train", tau] for tau in c.taus], models.LASSO_ALPHAS, own), strict=True))
    for tau in c.taus:
        tried = [("ridge_own", "none", ridge_path(of, none, tau, own, True, c))]
        tried.append(("lasso_own", "none", [(a, models.mse_of(alone["val", tau], theta), theta) for a, theta in zip(models.LASSO_ALPHAS, lassos[tau], strict=True)]))
        tried += [("graph_ridge", name, ridge_path(of, g, tau, every, False, c)) for name, g in graphs.items()]
        for model, name, path in tried:
            alpha, error, theta = min(path, key=lambda t: t[1])
            found.append((model, name, tau, alpha, error, theta))
    return found


def selection(rows: DataFrame, graphs: dict[str, np.ndarray], c: Config = CONFIG) -> DataFrame:
    """model, graph, tau, alpha, val_mse and the test split's mse, mae, da, sharpe: one row for every horizon and model."""
    best, none = fitted(rows, graphs, c), np.zeros((c.assets, c.assets))
    tested = models.metrics(predictions(rows, [(i, tau, theta, graphs.get(name, none)) for i, (_, name, tau, _, _, theta) in enumerate(best)], c=c), c, "model")
    listed = rows.sparkSession.createDataFrame([(i, m, g, t, float(a), float(v)) for i, (m, g, t, a, v, _) in enumerate(best)], "number int, model string, graph string, tau int, alpha double, val_mse double")
    return listed.join(tested.withColumnRenamed("model", "number"), "number").drop("number")


def best_of_tau(selected: DataFrame) -> DataFrame:
    """Per horizon the row with the smallest validation error."""
    return selected.groupBy("tau").agg(F.min_by(F.struct(*selected.columns), F.struct("val_mse", "model", "graph")).alias("r")).select("r.*")
