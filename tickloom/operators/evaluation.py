"""Evaluation of trained cells on the test split: clean metrics, metrics under attack by radius, sensitivity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from . import models
from .attacks import feature_attack, products
from .panel import Bins, predictions, sums
from .training import Cell, graph_losses

#: Radii and steps of the attacks that models are judged by, batches and their bins for sensitivity.
RHOS, STEPS, STARTS, BATCH = (0.01, 0.05, 0.1, 0.2), 7, 8, 512
#: The same of the older attack.
RAW_RHOS, RAW_STEPS = (0.05, 0.1), 5


def label(rho: float) -> str:
    """0.05 -> r005: a radius as part of a column's name."""
    return f"r{round(rho * 100):03d}"


def _starts(tau: int, c: Config, size: int = BATCH) -> list[tuple[int, int]]:
    """Bins [first, end) of the deterministic batches that sensitivity is averaged over."""
    a, b = c.split("test", tau)
    return [(a + s, min(a + s + size, b)) for s in np.linspace(0, max(0, b - a - size), STARTS).astype(int).tolist()]


def _feature_rows(rows: DataFrame, cells: list[Cell], g: np.ndarray, rhos: tuple[float, ...], c: Config, steps: int = STEPS, raw: bool = False) -> DataFrame:
    """cell, rho, bin_idx, asset, y, pred; rho 0 is clean."""
    d, known = c.features, [(x.number, x.tau, x.kept) for x in cells]
    size = {tau: (c.split("test", tau)[1] - c.split("test", tau)[0]) * c.assets for tau in c.taus}

    def attacked(batches):
        for batch in batches:
            bins = Bins(batch, c) if batch.num_rows else None
            for number, tau, theta in known if bins else []:
                at = bins.inside("test", tau, c)
                if not len(at):
                    continue
                s, p, y = bins.x[at] @ theta[:d], bins.x[at] @ theta[d : 2 * d], bins.y[tau][at]
                pp, q, r = products(theta, c)
                for rho in (0.0, *rhos):
                    a, b = feature_attack(s, p, y, g, theta, rho, steps, size[tau], c, raw)
                    pred = s + a * pp + b * q + (p + a * q + b * r) @ g.T + theta[-1]
                    yield pa.record_batch([pa.array(np.full(pred.size, number, np.int32)), pa.array(np.full(pred.size, rho)), pa.array(np.repeat(bins.bin[at], c.assets)), pa.array(np.tile(np.arange(c.assets, dtype=np.int32), len(at))), pa.array(y.ravel()), pa.array(pred.ravel())], ["cell", "rho", "bin_idx", "asset", "y", "pred"])

    return rows.mapInArrow(attacked, "cell int, rho double, bin_idx long, asset int, y double, pred double")


def _feature_sensitivity(rows: DataFrame, cells: list[Cell], g: np.ndarray, c: Config) -> dict[int, float]:
    """Mean over the batches of the mean norm of a bin's gradient by its features."""
    d, known = c.features, [(x.number, x.tau, x.kept) for x in cells]

    def per(bins: Bins):
        for number, tau, theta in known:
            at = bins.inside("test", tau, c)
            s, p, y = bins.x[at] @ theta[:d], bins.x[at] @ theta[d : 2 * d], bins.y[tau][at]
            pp, q, r = products(theta, c)
            a = s + p @ g.T + theta[-1] - y
            b = a @ g
            norm = np.sqrt(np.maximum(0, a * a * pp + 2 * a * b * q + b * b * r).sum(1))
            yield (number,), np.concatenate([[norm[i].sum(), i.sum()] for first, end in _starts(tau, c) for i in [(bins.bin[at] >= first) & (bins.bin[at] < end)]])

    # a batch of n bins has n x assets values, and the loss is their mean
    found = {k: v.reshape(-1, 2) for (k,), v in sums(rows, "cell long", per, c).items()}
    return {k: float(np.mean([2 * s / (n * c.assets) / n for s, n in v if n])) for k, v in found.items()}


def _evaluated(rows: DataFrame, cells: list[Cell], tested: DataFrame, extra: dict[str, dict[int, float]], rhos: tuple[float, ...]) -> DataFrame:
    """One row a cell. tested: cell, rho and metrics."""
    tidy = tested.groupBy("cell").agg(*(F.max(F.when(F.col("rho") == r, F.col(m))).alias(f"{m}_{label(r)}") for r in (0.0, *rhos) for m in ("mse", "da", "sharpe")))
    clean = lambda m: F.col(f"{m}_{label(0.0)}")
    out = [clean(m).alias(f"clean_{m}") for m in ("mse", "da", "sharpe")]
    for r in rhos:
        out += [F.col(f"mse_{label(r)}").alias(f"pert_mse_{label(r)}"), (F.col(f"mse_{label(r)}") - clean("mse")).alias(f"deg_mse_{label(r)}")]
        out += [(clean(m) - F.col(f"{m}_{label(r)}")).alias(f"deg_{m}_{label(r)}") for m in ("da", "sharpe")]
    listed = [(x.number, x.tau, x.rho, x.steps, float(x.best), *(float(v[x.number]) for v in extra.values())) for x in cells]
    listed = rows.sparkSession.createDataFrame(listed, "cell int, tau int, rho double, r_adv int, val_mse double" + "".join(f", {k} double" for k in extra))
    return listed.join(tidy.select("cell", *out), "cell").drop("cell")


def evaluate_features(rows: DataFrame, cells: list[Cell], g: np.ndarray, rhos: tuple[float, ...] = RHOS, c: Config = CONFIG, steps: int = STEPS, raw: bool = False) -> DataFrame:
    """One row a cell: tau, rho, r_adv, val_mse, sensitivity, clean and attacked metrics; attacks on features, normalised or raw."""
    tested = models.metrics(_feature_rows(rows, cells, g, rhos, c, steps, raw), c, "cell", "rho")
    return _evaluated(rows, cells, tested, {"sensitivity": _feature_sensitivity(rows, cells, g, c)}, rhos)


def evaluate_graphs(rows: DataFrame, cells: list[Cell], g: np.ndarray, rhos: tuple[float, ...] = RHOS, c: Config = CONFIG) -> DataFrame:
    """The same for attacks on the graph, one change of it for the whole split; delta_fro: how large the change is."""
    taus = {x.number: x.tau for x in cells}
    known = [(x.number, x.tau, x.kept) for x in cells]
    losses = graph_losses(rows, known, lambda bins, i: bins.inside("test", taus[i], c), c)
    changes = {(x.number, r): losses[x.number].attack(g, r, STEPS, c) for x in cells for r in rhos}
    every = [(x, r) for x in cells for r in (0.0, *rhos)]
    pred = predictions(rows, [(i, x.tau, x.kept, g + changes.get((x.number, r), 0)) for i, (x, r) in enumerate(every)], c=c)
    keys = rows.sparkSession.createDataFrame([(i, x.number, float(r)) for i, (x, r) in enumerate(every)], "model int, cell int, rho double")
    tested = models.metrics(pred, c, "model").join(keys, "model").drop("model")
    batches = [(x.number * STARTS + k, x.tau, x.kept) for x in cells for k in range(STARTS)]
    spans = {x.number * STARTS + k: (x.tau, *s) for x in cells for k, s in enumerate(_starts(x.tau, c))}

    def inside(bins: Bins, i: int) -> np.ndarray:
        tau, first, end = spans[i]
        at = bins.inside("test", tau, c)
        return at[(bins.bin[at] >= first) & (bins.bin[at] < end)]

    norms = {i: np.linalg.norm(loss.gradient(g)) for i, loss in graph_losses(rows, batches, inside, c).items()}
    sensitivity = {x.number: float(np.mean([norms[i] for i in range(x.number * STARTS, (x.number + 1) * STARTS) if i in norms])) for x in cells}
    sizes = {f"delta_fro_{label(r)}": {x.number: float(np.linalg.norm(changes[x.number, r])) for x in cells} for r in rhos}
    return _evaluated(rows, cells, tested, {"sensitivity": sensitivity, **sizes}, rhos)
