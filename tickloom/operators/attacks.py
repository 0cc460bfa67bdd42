"""Bounded adversarial changes to features and to graph edges.

Gradients by features are a w0 + b w1 for each (bin, asset), so a perturbation is the pair (a, b) and all norms follow
from the products of w0 and w1. Attacks on a graph need only sums over bins of 5 x 5 numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config


#: The older attack's step is so many times rho / steps of the gradient.
RAW_STEP = 1.25


def products(theta: np.ndarray, c: Config = CONFIG) -> tuple[float, float, float]:
    w0, w1 = theta[: c.features], theta[c.features : 2 * c.features]
    return float(w0 @ w0), float(w0 @ w1), float(w1 @ w1)


def feature_gradient(errors: DataFrame, g: DataFrame, theta: np.ndarray, c: Config = CONFIG) -> DataFrame:
    """asset, bin_idx, a, b, norm2 (squared norm of the row). errors: asset, bin_idx, e; all rows are one batch."""
    n = F.broadcast(errors.agg(F.count("*").alias("n")))
    coeff = errors.join(n, F.lit(True)).select("asset", "bin_idx", (2 * F.col("e") / F.col("n")).alias("a"))
    back = coeff.join(F.broadcast(g.select(F.col("src").alias("asset"), "dst", "w")), "asset").groupBy(F.col("dst").alias("asset"), "bin_idx").agg(F.sum(F.col("w") * F.col("a")).alias("b"))
    p, q, r = products(theta, c)
    norm2 = F.col("a") * F.col("a") * p + 2 * F.col("a") * F.col("b") * q + F.col("b") * F.col("b") * r
    return coeff.join(back, ["asset", "bin_idx"]).withColumn("norm2", F.greatest(F.lit(0.0), norm2))


def project_features(u: DataFrame, rho: float, c: Config = CONFIG) -> DataFrame:
    """Caps each asset's norm at rho / sqrt(assets), then each bin's at rho. u: asset, bin_idx, a, b, norm2."""
    if rho <= 0:
        return u.select("asset", "bin_idx", *(F.lit(0.0).alias(x) for x in ("a", "b", "norm2")))
    s = F.least(F.lit(1.0), rho / math.sqrt(c.assets) / (F.sqrt("norm2") + c.tiny))
    u = u.select("asset", "bin_idx", (F.col("a") * s).alias("a"), (F.col("b") * s).alias("b"), (F.col("norm2") * s * s).alias("norm2"))
    per_bin = u.groupBy("bin_idx").agg(F.sqrt(F.sum("norm2")).alias("fro"))
    s = F.least(F.lit(1.0), rho / (F.col("fro") + c.tiny))
    return u.join(per_bin, "bin_idx").select("asset", "bin_idx", (F.col("a") * s).alias("a"), (F.col("b") * s).alias("b"), (F.col("norm2") * s * s).alias("norm2"))


def raw_feature_step(gradient: DataFrame, rho: float, steps: int, c: Config = CONFIG) -> DataFrame:
    """The first step of the older attack, along the gradient as it is, projected."""
    k = RAW_STEP * rho / steps
    return project_features(gradient.select("asset", "bin_idx", (F.col("a") * k).alias("a"), (F.col("b") * k).alias("b"), (F.col("norm2") * k * k).alias("norm2")), rho, c)


def feature_step(gradient: DataFrame, rho: float, steps: int, c: Config = CONFIG) -> DataFrame:
    """The first normalised step of an attack of so many steps, projected."""
    fro = gradient.groupBy("bin_idx").agg(F.sqrt(F.sum("norm2")).alias("fro"))
    k = rho / steps / (F.col("fro") + c.tiny)
    u = gradient.join(fro, "bin_idx").select("asset", "bin_idx", (F.col("a") * k).alias("a"), (F.col("b") * k).alias("b"), (F.col("norm2") * k * k).alias("norm2"))
    return project_features(u, rho, c)


def packed(rows: DataFrame, *columns: str, c: Config = CONFIG) -> DataFrame:
    """One row a bin with an array over assets of each column; bins with a missing asset or value are left out."""
    n = c.assets
    x = rows.groupBy("bin_idx").agg(F.array_sort(F.collect_list(F.struct("asset", *columns))).alias("r"))
    for name in columns:
        x = x.withColumn(name, F.expr(f"transform(r, e -> e.{name})"))
    return x.drop("r").filter(F.size(columns[0]) == n).filter(" and ".join(f"forall({name}, v -> v is not null)" for name in columns))


def feature_attack(s: np.ndarray, p: np.ndarray, y: np.ndarray, g: np.ndarray, theta: np.ndarray, rho: float, steps: int, n: int, c: Config = CONFIG, raw: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of an attack on bins (rows) x assets; n: values in the whole batch. Steps are normalised, or raw."""
    a, b = np.zeros_like(s), np.zeros_like(s)
    if rho <= 0:
        return a, b
    pp, q, r = products(theta, c)
    norm2 = lambda a, b: np.maximum(0, a * a * pp + 2 * a * b * q + b * b * r)
    for _ in range(steps):
        pred = s + a * pp + b * q + (p + a * q + b * r) @ g.T + theta[-1]
        da = 2 * (pred - y) / n
        db = da @ g
        k = RAW_STEP * rho / steps if raw else rho / steps / (np.sqrt(norm2(da, db).sum(1, keepdims=True)) + c.tiny)
        a, b = a + k * da, b + k * db
        k = np.minimum(1, rho / math.sqrt(c.assets) / (np.sqrt(norm2(a, b)) + c.tiny))
        a, b = a * k, b * k
        k = np.minimum(1, rho / (np.sqrt(norm2(a, b).sum(1, keepdims=True)) + c.tiny))
        a, b = a * k, b * k
    return a, b


def attacked(bins: DataFrame, g: np.ndarray, theta: np.ndarray, rhos: tuple[float, ...], steps: int, n: int, c: Config = CONFIG, raw: bool = False) -> DataFrame:
    """rho, bin_idx, asset, y, clean, pred after the attack. bins: packed s, p, y."""
    p0, q, r = products(theta, c)

    def rows(batches):
        for x in batches:
            if not len(x):
                continue
            s, p, y = (np.stack(x[k].to_numpy()) for k in ("s", "p", "y"))
            clean = s + p @ g.T + theta[-1]
            for rho in rhos:
                a, b = feature_attack(s, p, y, g, theta, rho, steps, n, c, raw)
                pred = s + a * p0 + b * q + (p + a * q + b * r) @ g.T + theta[-1]
                yield pd.DataFrame({"rho": rho, "bin_idx": np.repeat(x["bin_idx"].to_numpy(), c.assets), "asset": np.tile(np.arange(c.assets, dtype=np.int32), len(x)), "y": y.ravel(), "clean": clean.ravel(), "pred": pred.ravel()})

    return bins.mapInPandas(rows, "rho double, bin_idx long, asset int, y double, clean double, pred double")


def graph_gradient(rows: DataFrame) -> DataFrame:
    """src, dst, g: symmetrised gradient by the edges, zero on the diagonal. rows: asset, bin_idx, p, e."""
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    a, b = rows.select(F.col("asset").alias("src"), "bin_idx", "e"), rows.select(F.col("asset").alias("dst"), "bin_idx", "p")
    raw = a.join(b, "bin_idx").groupBy("src", "dst").agg(F.sum(F.col("e") * F.col("p")).alias("v"))
    raw = raw.join(n, F.lit(True)).select("src", "dst", (2 * F.col("v") / F.col("n")).alias("v"))
    both = raw.join(raw.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("v").alias("back")), ["src", "dst"])
    return both.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise((F.col("v") + F.col("back")) / 2).alias("g"))


def project_graph(delta: np.ndarray, g: np.ndarray, rho: float, c: Config = CONFIG) -> np.ndarray:
    """The change of g nearest to delta's that keeps an undirected graph with weights in [0, 1] and is at most rho long.

    Such a graph has one free weight for each pair of assets: the change is worked out on these, each counting twice in
    its length. Shortening a change of a valid graph to another keeps its weights in [0, 1].
    """
    i, j = np.triu_indices(len(g), 1)
    own = (g[i, j] + g[j, i]) / 2
    free = np.clip(own + (delta[i, j] + delta[j, i]) / 2, 0, 1) - own
    length = math.sqrt(2) * float(np.linalg.norm(free))
    if rho <= 0:
        free = 0 * free
    elif length > rho:
        free = free * (rho / (length + c.tiny))
    out = np.diag(-np.diag(g))
    out[i, j], out[j, i] = own + free - g[i, j], own + free - g[j, i]
    return out


class GraphLoss:
    """The mean squared error of a batch as a function of the graph, from sums over its bins."""

    def __init__(self, ep: np.ndarray, pp: np.ndarray, ee: float, n: float):
        """ep, pp: sums of e p and p p by pairs of assets, e the error without the graph; ee: of e e; n: values."""
        self.ep, self.pp, self.ee, self.n = ep, pp, ee, n

    def mse(self, g: np.ndarray) -> float:
        return float((self.ee + 2 * (g * self.ep).sum() + np.einsum("ij,ik,jk->", g, g, self.pp)) / self.n)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """Symmetrised, zero on the diagonal."""
        d = (self.ep + g @ self.pp) / self.n
        d = d + d.T
        return d - np.diag(np.diag(d))

    def attack(self, g: np.ndarray, rho: float, steps: int, c: Config = CONFIG) -> np.ndarray:
        """The change of g after so many normalised steps up the gradient, projected."""
        delta = np.zeros_like(g)
        for _ in range(steps if rho > 0 else 0):
            d = self.gradient(g + delta)
            delta = project_graph(delta + rho / steps * d / (np.linalg.norm(d) + c.tiny), g, rho, c)
        return delta


def graph_loss(rows: DataFrame, intercept: float, c: Config = CONFIG) -> GraphLoss:
    """From rows asset, bin_idx, s, p, y; assets x assets sums come to the driver."""
    a = rows.select(F.col("asset").alias("i"), "bin_idx", (F.col("s") + intercept - F.col("y")).alias("e0"), F.col("p").alias("pi"))
    b = rows.select(F.col("asset").alias("j"), "bin_idx", "p")
    found = a.join(b, "bin_idx").groupBy("i", "j").agg(F.sum(F.col("e0") * F.col("p")).alias("ep"), F.sum(F.col("pi") * F.col("p")).alias("pp")).collect()
    base = a.agg(F.count("*").alias("n"), F.sum(F.col("e0") * F.col("e0")).alias("ee")).first()
    ep, pp = np.zeros((c.assets, c.assets)), np.zeros((c.assets, c.assets))
    for r in found:
        ep[r["i"], r["j"]], pp[r["i"], r["j"]] = r["ep"], r["pp"]
    return GraphLoss(ep, pp, base["ee"] or 0.0, base["n"])


def graph_step(gradient: DataFrame, g: DataFrame, rho: float, steps: int, c: Config = CONFIG) -> DataFrame:
    """src, dst, d: the first normalised step of an attack of so many steps on a symmetric graph, projected. gradient: src, dst, g."""
    norm = gradient.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))
    x = gradient.join(g, ["src", "dst"]).join(F.broadcast(norm), F.lit(True))
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w") + F.col("g") * (rho / steps) / (F.col("norm") + c.tiny))) - F.col("w")
    x = x.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(kept).alias("d"))
    fro = x.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("fro"))
    return x.join(F.broadcast(fro), F.lit(True)).select("src", "dst", (F.col("d") * F.when(F.col("fro") > rho, rho / (F.col("fro") + c.tiny)).otherwise(1.0)).alias("d"))
