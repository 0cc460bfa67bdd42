"""The panel: one row a bin with the features and targets of all assets in arrays, and what models need of it.

A pooled linear model over [own features, neighbours' features, 1] sees of a split nothing but the sums of products of
the bins' values, whatever the graph. These are summed on executors, once for all splits, horizons and graphs;
(assets x features)^2 numbers a split and horizon come to the driver, however many bins there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config

SPLITS = ("train", "val", "test")


def panel(std: DataFrame, targets: DataFrame, c: Config = CONFIG) -> DataFrame:
    """bin_idx, x (asset by asset), y<tau> (NaN where there is none). Bins that lack an asset or a finite feature are left out."""
    x = std.groupBy("bin_idx").agg(F.array_sort(F.collect_list(F.struct("asset", "f", "x"))).alias("r"))
    x = x.select("bin_idx", F.expr("transform(r, e -> e.x)").alias("x")).filter(F.size("x") == c.assets * c.features)
    x = x.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    per = [F.array_sort(F.collect_list(F.when(F.col("tau") == t, F.struct("asset", F.coalesce("y", F.lit(float("nan"))).alias("y"))))).alias(f"r{t}") for t in c.taus]
    y = targets.groupBy("bin_idx").agg(*per).select("bin_idx", *(F.expr(f"transform(r{t}, e -> e.y)").alias(f"y{t}") for t in c.taus))
    return x.join(y, "bin_idx")


class Bins:
    """Some bins as arrays: bin, x (bins, assets, features), y by horizon (bins, assets)."""

    def __init__(self, batch: pa.RecordBatch, c: Config = CONFIG):
        n = batch.num_rows
        self.bin = batch.column("bin_idx").to_numpy()
        self.x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, c.assets, c.features)
        self.y = {t: batch.column(f"y{t}").flatten().to_numpy(zero_copy_only=False).reshape(n, c.assets) for t in c.taus}

    @classmethod
    def together(cls, parts: list[Bins], c: Config = CONFIG) -> Bins:
        """The bins of all parts, in order of bins."""
        out = cls.__new__(cls)
        out.bin = np.concatenate([p.bin for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(out.bin, kind="stable")
        out.bin = out.bin[order]
        out.x = np.concatenate([p.x for p in parts])[order] if parts else np.zeros((0, c.assets, c.features))
        out.y = {t: np.concatenate([p.y[t] for p in parts])[order] if parts else np.zeros((0, c.assets)) for t in c.taus}
        return out

    def inside(self, split: str, tau: int, c: Config = CONFIG) -> np.ndarray:
        a, b = c.split(split, tau)
        return np.flatnonzero((self.bin >= a) & (self.bin < b) & np.isfinite(self.y[tau]).all(1))


def sums(rows: DataFrame, keys: str, function: Callable[[Bins], Iterator[tuple]], c: Config = CONFIG) -> dict[tuple, np.ndarray]:
    """For each key that function gives with an array for some bins, the sum of the arrays over all bins.

    keys: the schema of the key's columns. The arrays of a key have one length; that and the number of keys must not grow with the bins.
    """
    names = [k.split()[0] for k in keys.split(", ")]

    def partial(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, value in function(Bins(batch, c)):
                    total[key] = total[key] + value if key in total else value
        for key, value in total.items():
            n = value.size
            yield pa.record_batch([*(pa.array([k] * n) for k in key), pa.array(np.arange(n)), pa.array(value.ravel().astype(float))], [*names, "i", "v"])

    found = rows.mapInArrow(partial, f"{keys}, i long, v double").groupBy(*names, "i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    out: dict[tuple, list] = {}
    for *key, v in zip(*(found.column(k).to_pylist() for k in (*names, "v")), strict=True):
        out.setdefault(tuple(key), []).append(v)
    return {k: np.array(v) for k, v in out.items()}


def moments(rows: DataFrame, c: Config = CONFIG) -> dict[tuple[str, int], np.ndarray]:
    """For each (split, tau) the sums of products of [features of all assets, 1, targets of all assets]."""

    def per(bins: Bins):
        for tau in c.taus:
            for split in SPLITS:
                at = bins.inside(split, tau, c)
                if len(at):
                    v = np.column_stack([bins.x[at].reshape(len(at), -1), np.ones(len(at)), bins.y[tau][at]])
                    yield (split, tau), v.T @ v

    n = c.assets * c.features + 1 + c.assets
    return {k: v.reshape(n, n) for k, v in sums(rows, "split string, tau long", per, c).items()}


def pooled(m: np.ndarray, g: np.ndarray, c: Config = CONFIG) -> np.ndarray:
    """The moments of [own, neighbours', 1, y] pooled over assets, from those of a split; g: assets x assets."""
    d, one = c.features, c.assets * c.features
    out = np.zeros((2 * d + 2, 2 * d + 2))
    for i in range(c.assets):
        t = np.zeros((2 * d + 2, len(m)))
        t[np.arange(d), i * d + np.arange(d)] = 1
        for j in range(c.assets):
            t[d + np.arange(d), j * d + np.arange(d)] += g[i, j]
        t[2 * d, one] = t[2 * d + 1, one + 1 + i] = 1
        out += t @ m @ t.T
    return out


def predictions(rows: DataFrame, models: list[tuple[int, int, np.ndarray, np.ndarray]], split: str = "test", c: Config = CONFIG) -> DataFrame:
    """model, bin_idx, asset, y, pred on a split of each model (number, tau, theta, graph)."""
    d = c.features

    def predicted(batches):
        for batch in batches:
            bins = Bins(batch, c) if batch.num_rows else None
            for number, tau, theta, g in models if bins else []:
                at = bins.inside(split, tau, c)
                if len(at):
                    pred = bins.x[at] @ theta[:d] + (bins.x[at] @ theta[d : 2 * d]) @ g.T + theta[-1]
                    yield pa.record_batch([pa.array(np.full(pred.size, number, np.int32)), pa.array(np.repeat(bins.bin[at], c.assets)), pa.array(np.tile(np.arange(c.assets, dtype=np.int32), len(at))), pa.array(bins.y[tau][at].ravel()), pa.array(pred.ravel())], ["model", "bin_idx", "asset", "y", "pred"])

    return rows.mapInArrow(predicted, "model int, bin_idx long, asset int, y double, pred double")
