"""Linear models over [own features, neighbours' features, 1]: moments, ridge, lasso, predictions, metrics, gradients."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config

#: The penalties that are tried.
RIDGE_ALPHAS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)
LASSO_ALPHAS = (1e-7, 1e-6, 1e-5, 1e-4, 1e-3)


def fixed_theta(c: Config = CONFIG) -> np.ndarray:
    """A deterministic parameter vector for checks: ((37 k) mod 11 - 5) / 1000."""
    return np.array([((k * 37) % 11 - 5) / 1000 for k in range(2 * c.features + 1)])


def theta_table(df: DataFrame, theta: np.ndarray, c: Config = CONFIG) -> DataFrame:
    """f, w0, w1 of each feature: small, for a broadcast."""
    d = c.features
    return F.broadcast(df.sparkSession.createDataFrame([(k, float(theta[k]), float(theta[d + k])) for k in range(d)], "f int, w0 double, w1 double"))


def projections(std: DataFrame, theta: np.ndarray, c: Config = CONFIG) -> DataFrame:
    """asset, bin_idx, s = x.w0, p = x.w1."""
    return std.join(theta_table(std, theta, c), "f").groupBy("asset", "bin_idx").agg(F.sum(F.col("x") * F.col("w0")).alias("s"), F.sum(F.col("x") * F.col("w1")).alias("p"))


def predicted(proj: DataFrame, g: DataFrame, intercept: float) -> DataFrame:
    """asset, bin_idx, s, p, pred = s + sum_j G_ij p_j + b. The graph is a small table and broadcast."""
    e = F.broadcast(g.select("src", F.col("dst").alias("asset"), "w"))
    around = proj.join(e, "asset").groupBy("src", "bin_idx").agg(F.sum(F.col("w") * F.col("p")).alias("around")).withColumnRenamed("src", "asset")
    return proj.join(around, ["asset", "bin_idx"]).withColumn("pred", F.col("s") + F.col("around") + intercept)


def legacy_predicted(std: DataFrame, near: DataFrame, theta: np.ndarray) -> DataFrame:
    """A known defect kept for comparison: (sum of the design row) x (sum of theta)."""
    d = std.unionByName(near).groupBy("asset", "bin_idx").agg((F.sum("x") + 1).alias("d"))
    return d.select("asset", "bin_idx", (F.col("d") * float(theta.sum())).alias("pred"))


def metrics(rows: DataFrame, c: Config = CONFIG, *keys: str) -> DataFrame:
    """mse, mae, da, sharpe of rows (bin_idx, y, pred), for each of the keys."""
    e = F.col("pred") - F.col("y")
    hit = F.when(F.col("y") != 0, (F.signum("pred") == F.signum("y")).cast("double"))
    per_bin = rows.groupBy(*keys, "bin_idx").agg(F.count("*").alias("n"), F.sum(e * e).alias("se"), F.sum(F.abs(e)).alias("ae"), F.sum(hit).alias("hits"), F.count(hit).alias("signs"), (F.sum(F.col("pred") * F.col("y")) / (F.sum(F.abs("pred")) + c.tiny)).alias("pnl"))
    return per_bin.groupBy(*keys).agg((F.sum("se") / F.sum("n")).alias("mse"), (F.sum("ae") / F.sum("n")).alias("mae"), F.try_divide(F.sum("hits"), F.sum("signs")).alias("da"), (F.avg("pnl") / (F.stddev_pop("pnl") + c.tiny)).alias("sharpe"))


def design(std: DataFrame, near: DataFrame, y: DataFrame) -> DataFrame:
    """bin_idx, asset, y, d (103 values) of the rows that have a target and only finite features."""
    pack = lambda x, name: x.groupBy("asset", "bin_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "x"))), lambda e: e["x"]).alias(name))
    rows = pack(std, "own").join(pack(near, "around"), ["asset", "bin_idx"]).join(y.filter("y is not null"), ["asset", "bin_idx"])
    d = F.concat("own", "around", F.array(F.lit(1.0)))
    return rows.select("bin_idx", "asset", "y", d.alias("d")).filter(F.forall("d", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))


def gram(rows: DataFrame) -> DataFrame:
    """i, j, v: sums of products of the columns of [d, y]; each task sums its rows, then the tasks' sums are summed."""

    def partial(batches):
        total = None
        for batch in batches:
            n = batch.num_rows
            a = np.column_stack([batch.column("d").flatten().to_numpy().reshape(n, -1), batch.column("y").to_numpy()]) if n else None
            if n:
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.record_batch([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    return rows.select("d", "y").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram_matrix(rows: DataFrame) -> np.ndarray:
    """The moments on the driver: (p + 1) squared numbers."""
    found = gram(rows).toArrow()
    n = int(found.column("i").to_numpy().max()) + 1
    out = np.zeros((n, n))
    out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("v").to_numpy()
    return out


def ridge(m: np.ndarray, alpha: float, columns: np.ndarray, free: bool = True) -> np.ndarray:
    """Solves from moments; the last of the columns is the intercept, not penalised if free. Other parameters are 0."""
    a, b = m[np.ix_(columns, columns)], m[columns, -1]
    penalty = np.full(len(columns), alpha)
    if free:
        penalty[-1] = 0
    theta = np.zeros(len(m) - 1)
    theta[columns] = np.linalg.solve(a + np.diag(penalty), b)
    return theta


def lasso_path(a: np.ndarray, b: np.ndarray, alphas: tuple[float, ...]) -> np.ndarray:
    """w[alpha] that minimise w'a w / 2 - b'w + alpha |w|, from the largest penalty down, each starting from the one before.

    An active set with signs: its linear system is solved, and w moves to the best point of the way there among those where
    a coordinate becomes 0 (which then leaves). When the system's solution is reached, the coordinate whose gradient is
    most above the penalty comes in. Each move lowers the objective, so this ends, with the exact solution however alike columns
    are; coordinate descent doesn't get there in thousands of turns. Of equal columns one comes in.
    """
    d, scale = len(b), np.diag(a)
    out, w = np.zeros((len(alphas), d)), np.zeros(d)
    usable = scale > 1e-15
    for i in sorted(range(len(alphas)), key=lambda i: -alphas[i]):
        alpha, sign = alphas[i], np.sign(w)
        loss = lambda v, alpha=alpha: v @ (a @ v) / 2 - b @ v + alpha * np.abs(v).sum()
        for _ in range(100 * d):
            on = np.flatnonzero(sign)
            if len(on):
                x = np.zeros(d)
                within, wanted = a[np.ix_(on, on)], b[on] - alpha * sign[on]
                x[on] = np.linalg.lstsq(within, wanted, rcond=1e-13)[0]
                rest = wanted - within @ x[on]
                back = w[on] * rest < 0
                if np.abs(rest).max() > 1e-3 * alpha and back.any():
                    # dependent columns: the loss doesn't bend along what is left of the system, so on until all that shrink are 0
                    x[on] = w[on] + 1.5 * rest * (np.abs(w[on][back]) / np.abs(rest[back])).max()
                crossed = on[(np.sign(x[on]) != sign[on])]
                if len(crossed):
                    # where each coordinate that changes its sign is 0 on the way
                    step = np.unique(np.clip(w[crossed] / np.where(w[crossed] == x[crossed], 1.0, w[crossed] - x[crossed]), 0, 1))
                    points = [w + t * (x - w) for t in step] + [x]
                    for v, t in zip(points, [*step, 1.0], strict=True):
                        v[crossed[np.abs(v[crossed]) <= 1e-14 * np.abs(w[crossed] - x[crossed])]] = 0
                    best = min(points, key=loss)
                    if loss(best) < loss(w) or (sign != np.sign(best)).any():
                        w, sign = best, np.sign(best)
                        if (w != x).any() or len(crossed):
                            continue
                w = x
            grad = np.where((sign == 0) & usable, b - a @ w, 0.0)
            k = int(np.argmax(np.abs(grad)))
            if abs(grad[k]) <= alpha * (1 + 1e-9):
                break
            sign[k] = np.sign(grad[k])
        out[i] = w
    return out


def lassos(ms: list[np.ndarray], alphas: tuple[float, ...], columns: np.ndarray) -> list[list[np.ndarray]]:
    """theta of each moments and penalty, for squared error / (2 n) + alpha |w|; the intercept (last column) is free."""
    last, own = columns[-1], columns[:-1]
    means = [(m[own, last] / m[last, last], m[last, -1] / m[last, last]) for m in ms]
    a = np.array([m[np.ix_(own, own)] / m[last, last] - np.outer(x, x) for m, (x, _) in zip(ms, means, strict=True)])
    b = np.array([m[own, -1] / m[last, last] - x * y for m, (x, y) in zip(ms, means, strict=True)])
    out = []
    for w, m, (x, y) in zip([lasso_path(*p, alphas) for p in zip(a, b, strict=True)], ms, means, strict=True):
        out.append([np.zeros(len(m) - 1) for _ in alphas])
        for theta, v in zip(out[-1], w, strict=True):
            theta[own], theta[last] = v, y - x @ v
    return out


def mse_of(m: np.ndarray, theta: np.ndarray) -> float:
    """Mean squared error from the moments of a split."""
    t = np.append(theta, -1.0)
    last = len(m) - 2
    return float(t @ m @ t / m[last, last])


def grad_theta(std: DataFrame, errors: DataFrame, g: DataFrame, theta: np.ndarray, decay: float, c: Config = CONFIG) -> DataFrame:
    """k, g: gradient of the mean squared error and weight decay (not on the intercept). errors: asset, bin_idx, e."""
    back = errors.join(F.broadcast(g.select(F.col("src").alias("asset"), "dst", "w")), "asset").groupBy(F.col("dst").alias("asset"), "bin_idx").agg(F.sum(F.col("w") * F.col("e")).alias("eb"))
    x = std.join(errors, ["asset", "bin_idx"]).join(back, ["asset", "bin_idx"])
    n = errors.agg(F.count("*").alias("n"), F.sum("e").alias("e"))
    per = x.groupBy("f").agg(F.sum(F.col("x") * F.col("e")).alias("a"), F.sum(F.col("x") * F.col("eb")).alias("b"))
    stacked = per.selectExpr("f", f"stack(2, f, a, f + {c.features}, b) AS (k, v)").select("k", "v").unionByName(n.select(F.lit(2 * c.features).alias("k"), F.col("e").alias("v")))
    t = F.broadcast(std.sparkSession.createDataFrame([(k, float(v) if k < 2 * c.features else 0.0) for k, v in enumerate(theta)], "k int, t double"))
    return stacked.join(F.broadcast(n.select("n")), F.lit(True)).join(t, "k").select("k", (2 * F.col("v") / F.col("n") + 2 * decay * F.col("t")).alias("g"))
