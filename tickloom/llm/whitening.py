"""Whitening of embeddings from an exact integer scatter matrix.

* Every vector's entries become whole numbers (a fixed-point grid), so that sums and products have no rounding. Each
  distinct vector counts once (the fit list).
* Tasks subtract the shift, add sums S and products XtX of their rows and give them as limbs of LIMB bits; Spark adds the
  limbs, the driver puts together numbers of any size. Products of a block of rows are taken in double precision while all
  partial sums stay below 2^53, so they are exact; rows with larger entries are multiplied as Python integers.
* n XtX - S St is formed from whole numbers and doesn't depend on the shift. Only then it becomes floating point, divided by
  n squared, and eigh takes it apart: dimensions squared numbers on the driver, however many rows there are.
* Each row is centred exactly (n x - S, whole) before it is projected. The identity's error comes from a pass over the whitened
  fit list, not from the decomposition.

Cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those whose length isn't
the commonest (the smaller of two as common), nor those with an entry beyond the grid's 2^62. Rows without vec_id and
repeated rows are rows like others. A component whose eigenvalue is not above rounding (constant or dependent
dimensions) can't have variance 1: whitened is null there, explained is what it is (0 without any variance), and it isn't
in the identity's error (null if there is no other). deviation is null where it is no long. No row gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stage
from .text import small_batches

#: The grid: so many steps a unit, and what is added to every entry.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Bits of a limb, and limbs of a sum: 2^22 tasks can add theirs in a long; sums stay under 2^199.
LIMB, LIMBS = 40, 5
#: Below this all whole numbers are exact in double precision.
EXACT = 1 << 53


def on_grid(vector: str) -> Column:
    """The vector's entries as whole numbers; null if it takes no part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 56)))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * SCALE).cast("long") + F.lit(OFFSET).cast("long")))


def prepared(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and x of the rows that take part."""
    x = rows.select(F.col(f"`{key}`").alias("key"), on_grid(vector).alias("x")).filter("x is not null")
    # most common length: one row a length
    length = F.broadcast(x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d")))
    return x.join(length, F.size("x") == F.col("d")).select(F.col("key").alias(key), "x")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def products(x: np.ndarray) -> np.ndarray:
    """The exact sums of products of the columns of [x, 1], x whole: as Python integers."""
    n, d = x.shape
    total = np.zeros((d + 1, d + 1), object)
    most = int(max(1, -int(x.min()), int(x.max())))
    if most * most >= EXACT:
        own = np.column_stack([x.astype(object), np.ones(n, object)])
        return own.T @ own
    own, rows = np.column_stack([x, np.ones(n, np.int64)]).astype(np.float64), EXACT // (most * most)
    for a in range(0, n, rows):
        part = own[a : a + rows]
        # every partial sum is a whole number below EXACT
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def limbs(values: list[int]) -> list[list[int]]:
    """Each number as LIMBS parts, lowest first; all but the last are in [0, 2^LIMB)."""
    out = []
    for v in values:
        parts = []
        for _ in range(LIMBS - 1):
            parts.append(v & ((1 << LIMB) - 1))
            v >>= LIMB
        out.append([*parts, v])
    return out


def scatter(fit: DataFrame, shift: int = OFFSET) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n XtX - S St of the rows' x, exact; S is of unshifted numbers. No row: 0."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                # |x - shift| stays below 2^63: entries are below 2^62
                own = products(_matrix(batch.column("x")) - shift)
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            parts = np.array(limbs([int(v) for v in total[i, j]]), np.int64)
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(parts[:, k]) for k in range(LIMBS))], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    found = fit.select("x").mapInArrow(partial, "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    found = found.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()
    if not found:
        return 0, [], []
    d = max(r["j"] for r in found)
    m = [[0] * (d + 1) for _ in range(d + 1)]
    for r in found:
        m[r["i"]][r["j"]] = m[r["j"]][r["i"]] = sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS))
    n, s = m[d][d], m[d][:d]
    return n, [v + n * shift for v in s], [[n * m[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]


class Whitener:
    """Components of an exact scatter: row n x - S, divided by n, times `weights` is whitened."""

    def __init__(self, n: int, s: list[int], c: list[list[int]], components: int = COMPONENTS):
        self.n, self.s = n, s
        # whole numbers are scaled by a power of two before they become doubles, which may not hold them
        most = max((abs(v) for row in c for v in row), default=0)
        down = max(0, most.bit_length() - 1000)
        v = np.array([[float(x >> down) if down else float(x) for x in row] for row in c])
        self.values, vectors = np.linalg.eigh(v)
        order = np.argsort(-self.values, kind="stable")[:components]
        self.total = float(np.trace(v))
        limit = max(float(self.values.max(initial=0)), 0.0) * len(s) * np.finfo(float).eps * 4
        self.alive = self.values[order] > limit
        self.explained = [float(max(x, 0.0) / self.total) if self.total > 0 else 0.0 for x in self.values[order]]
        root = np.sqrt(np.where(self.alive, self.values[order], 1.0)) * 2.0 ** (down / 2) / n
        self.weights = vectors[:, order] / root

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 where that can hold it, else Python integers."""
        s, x = [v - self.n * OFFSET for v in self.s], x - OFFSET
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(abs(v) for v in s)
        if most < 1 << 62:
            return x * self.n - np.array(s, np.int64)
        return x.astype(object) * self.n - np.array(s, object)

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Of each row its deviation, and its whitened components (nan where there is no variance)."""
        own = self.centred(x)
        real = own.astype(np.float64)
        about = (real * real).sum(1)
        if own.dtype == object:
            exact = (own * own).sum(1)
        else:
            # the sum modulo 2^64 is the sum itself where it is surely below; near the bound it is taken again
            whole = own.view(np.uint64)
            exact = (whole * whole).sum(1).astype(object)
            for i in np.flatnonzero(about > 2.0**62):
                exact[i] = sum(int(v) ** 2 for v in own[i])
        white = (real / self.n) @ self.weights
        white[:, ~self.alive] = np.nan
        return [int(v) if v < 1 << 63 else None for v in exact], white


def identity_error(fit: DataFrame, white: Whitener) -> float | None:
    """The largest absolute entry of the fit list's whitened covariance less the identity."""
    alive = np.flatnonzero(white.alive)
    if not len(alive):
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = white.apply(_matrix(batch.column("x")))[1][:, alive]
                # the whitened list's mean is 0 but for rounding; its square is taken off below
                w = np.column_stack([w, np.ones(len(w))])
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.record_batch([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    found = fit.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((len(alive) + 1,) * 2)
    for r in found:
        m[r["i"], r["j"]] = r["v"]
    mean = m[-1, :-1] / m[-1, -1]
    return float(np.abs(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean) - np.eye(len(alive))).max())


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component."""
    small_batches(rows.sparkSession)
    every = stage(prepared(rows, vector, key))
    kind = dict(every.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stage(every.select("x").distinct())
    n, s, c = scatter(fit)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    white = Whitener(n, s, c, components)
    error = identity_error(fit, white)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(white.explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            deviation, w = white.apply(_matrix(batch.column("x")))
            m = batch.num_rows
            owner = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch(
                [
                    batch.column(key).take(owner),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, white.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(owner),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(white.explained, m)),
                    pa.array(np.full(m * k, error if error is not None else 0.0), mask=np.full(m * k, error is None)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return every.mapInArrow(out, schema)
