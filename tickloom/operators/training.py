"""Adversarial training of a grid of linear models, all cells side by side over the panel.

All epochs and batches are one job. Its tasks run at the same time (a barrier stage) and keep their share of the bins; at
each step they attack their part of the cells' current batches, tell each other the gradients' sums (some numbers a
cell) and all move the parameters alike. Which batch a bin is in follows from the bin, the epoch and the cell's seed by a
keyed permutation, so no order of all bins exists anywhere. Warm start and validation use the panel's moments.

If a task is lost the others fail with it and Spark starts the stage again; the same keys give the same models. Sums are added in order of tasks, so
results don't depend on which task was first, but on their number by rounding.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

from ..config import CONFIG, Config
from . import models
from .attacks import GraphLoss, feature_attack
from .panel import Bins, moments, pooled, sums

#: Radii and steps of the attacks that are trained against.
RHOS, STEPS = (0.05, 0.10, 0.20), (1, 3)
#: Epochs and seed by kind of attack: on features along the raw gradient, normalised, on the graph.
KINDS = {"raw": (8, 7), "feature": (6, 11), "graph": (7, 23)}
#: Bins a batch, rate, decay, penalty of the warm start.
BATCH, RATE, DECAY, WARM = 512, 0.03, 1e-4, 1e-2
_U = np.uint64


@dataclass
class Cell:
    """One model of the grid: horizon, radius and steps of the attack it is trained against, its seed and state."""

    number: int
    tau: int
    rho: float
    steps: int
    seed: int
    theta: np.ndarray | None = None
    best: float = np.inf
    kept: np.ndarray | None = field(default=None)

    def move(self, gradient: np.ndarray, rate: float, decay: float) -> None:
        """A step against the gradient with decay (not of the intercept); gradients longer than 1 are cut to 1."""
        full = gradient + 2 * decay * np.append(self.theta[:-1], 0)
        self.theta = self.theta - rate * full / max(1.0, float(np.linalg.norm(full)))

    def judge(self, error: float) -> None:
        if error < self.best:
            self.best, self.kept = error, self.theta.copy()


def grid(taus: tuple[int, ...] = CONFIG.taus, rhos: tuple[float, ...] = RHOS, steps: tuple[int, ...] = STEPS) -> list[tuple[int, float, int]]:
    """(tau, rho, steps): the plain model, then each rho with each number of steps."""
    return [(t, r, s) for t in taus for r, s in [(0.0, 1), *((r, s) for r in rhos for s in steps)]]


def shuffled(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where places 0..n-1 go in the key's permutation of all n: four Feistel rounds over a power of four, gone on until below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    low, out = _U((1 << half) - 1), places.astype(_U)

    def turn(x: np.ndarray) -> np.ndarray:
        left, right = x >> _U(half), x & low
        for r in range(4):
            z = right + _U((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> _U(31))) & low)
        return left << _U(half) | right

    out = turn(out)
    while len(far := np.flatnonzero(out >= _U(n))):
        out[far] = turn(out[far])
    return out.astype(np.int64)


def batch_of(bins: np.ndarray, cell: Cell, epoch: int, size: int, c: Config = CONFIG) -> np.ndarray:
    """The batch of each training bin in an epoch."""
    first, end = c.split("train", cell.tau)
    return shuffled(bins - first, end - first, cell.seed * 1000 + epoch) // size


def gradient_sum(x: np.ndarray, y: np.ndarray, cell: Cell, kind: str, g: np.ndarray, change: np.ndarray | float, n: int, c: Config = CONFIG) -> np.ndarray:
    """The sum over bins of half the gradient of squared errors under attack; n: values in the whole batch."""
    d = c.features
    w0, w1 = cell.theta[:d], cell.theta[d : 2 * d]
    if kind != "graph":
        a, b = feature_attack(x @ w0, x @ w1, y, g, cell.theta, cell.rho, cell.steps, n, c, raw=kind == "raw")
        x = x + a[..., None] * w0 + b[..., None] * w1
    around = g + change
    error = x @ w0 + (x @ w1) @ around.T + cell.theta[-1] - y
    return np.concatenate([np.einsum("ta,tad->d", error, x), np.einsum("ta,tad->d", error @ around, x), [error.sum()]])


def loss_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray, c: Config = CONFIG) -> np.ndarray:
    """What a GraphLoss is made of, one after the other, but for the number of values."""
    d = c.features
    e, p = x @ theta[:d] + theta[-1] - y, x @ theta[d : 2 * d]
    return np.concatenate([(e.T @ p).ravel(), (p.T @ p).ravel(), [(e * e).sum()]])


def loss_of(v: np.ndarray, n: float, c: Config = CONFIG) -> GraphLoss:
    k = c.assets
    return GraphLoss(v[: k * k].reshape(k, k), v[k * k : 2 * k * k].reshape(k, k), v[2 * k * k], n)


def graph_losses(rows: DataFrame, cells: list[tuple[int, int, np.ndarray]], picked: Callable[[Bins, int], np.ndarray], c: Config = CONFIG) -> dict[int, GraphLoss]:
    """Of each cell (number, tau, theta) the loss as a function of the graph; picked(bins, number): the bins it is over."""

    def per(bins: Bins) -> Iterator[tuple]:
        for number, tau, theta in cells:
            at = picked(bins, number)
            if len(at):
                yield (number,), np.append(loss_sums(bins.x[at], bins.y[tau][at], theta, c), len(at) * c.assets)

    return {k: loss_of(v[:-1], v[-1], c) for (k,), v in sums(rows, "cell long", per, c).items()}


class Together:
    """The tasks of a barrier stage adding arrays: each tells task 0 its own, which adds them in order of tasks and tells all.

    Spark's own gathering looks for news once a second, so it only passes on where task 0 listens.
    """

    def __init__(self, context: BarrierTaskContext):
        self.first, every = context.partitionId() == 0, context.getTaskInfos()
        self.peers, listener, told = [], None, ""
        if len(every) == 1:
            return
        if self.first:
            key = secrets.token_hex(16)
            listener = Listener(("", 0), backlog=len(every), authkey=key.encode())
            told = f"{listener.address[1]} {key}"
        port, key = context.allGather(told)[0].split()
        if listener is None:
            self.peers = [Client((every[0].address.rpartition(":")[0] or every[0].address, int(port)), authkey=key.encode())]
            self.peers[0].send(context.partitionId())
        else:
            come = [listener.accept() for _ in every[1:]]
            self.peers = [x for _, x in sorted(((x.recv(), x) for x in come), key=lambda p: p[0])]
            listener.close()

    def __call__(self, own: np.ndarray) -> np.ndarray:
        total = np.array(own, np.float64)
        if self.first:
            for x in self.peers:
                total += np.frombuffer(x.recv_bytes()).reshape(total.shape)
            for x in self.peers:
                x.send_bytes(total.tobytes())
        else:
            self.peers[0].send_bytes(total.tobytes())
            total = np.frombuffer(self.peers[0].recv_bytes()).reshape(total.shape)
        return total

    def close(self) -> None:
        for x in self.peers:
            x.close()


def run_epochs(bins: Bins, cells: list[Cell], g: np.ndarray, kind: str, epochs: int, checked: dict[int, np.ndarray], size: int, together: Callable[[np.ndarray], np.ndarray], c: Config = CONFIG) -> None:
    """Trains the cells on a task's share of the bins; together(array) is the sum of it over all tasks."""
    inside = {tau: bins.inside("train", tau, c) for tau in c.taus}
    batches = {cell.number: -(-(c.split("train", cell.tau)[1] - c.split("train", cell.tau)[0]) // size) for cell in cells}
    most, k2 = max(batches.values()), 2 * c.assets**2 + 1
    for epoch in range(epochs):
        # of each cell its bins in order of batches, and where each batch begins
        dealt, counts = {}, np.zeros((len(cells), most))
        for i, cell in enumerate(cells):
            batch = batch_of(bins.bin[inside[cell.tau]], cell, epoch, size, c)
            order = np.argsort(batch, kind="stable")
            edges = np.searchsorted(batch[order], np.arange(most + 1))
            dealt[i], counts[i] = (inside[cell.tau][order], edges), np.diff(edges)
        counts = together(counts) * c.assets

        def part(i: int, cell: Cell, k: int, dealt: dict = dealt) -> tuple[np.ndarray, np.ndarray]:
            rows, edges = dealt[i]
            at = rows[edges[k] : edges[k + 1]]
            return bins.x[at], bins.y[cell.tau][at]

        for k in range(most):
            live = [(i, cell) for i, cell in enumerate(cells) if counts[i, k]]
            changes = dict.fromkeys((i for i, _ in live), 0.0)
            attacked = [(i, cell) for i, cell in live if cell.rho > 0] if kind == "graph" else []
            if attacked:
                own = together(np.array([loss_sums(*part(i, cell, k), cell.theta, c) for i, cell in attacked]).reshape(-1, k2))
                changes |= {i: loss_of(v, counts[i, k], c).attack(g, cell.rho, cell.steps, c) for (i, cell), v in zip(attacked, own, strict=True)}
            if live:
                total = together(np.array([gradient_sum(*part(i, cell, k), cell, kind, g, changes[i], int(counts[i, k]), c) for i, cell in live]))
                for (i, cell), v in zip(live, total, strict=True):
                    cell.move(2 * v / counts[i, k], RATE, DECAY)
        for cell in cells:
            cell.judge(models.mse_of(checked[cell.tau], cell.theta))


def train(rows: DataFrame, g: np.ndarray, kind: str, epochs: int | None = None, seed: int | None = None, cells: list[tuple[int, float, int]] | None = None, c: Config = CONFIG, size: int = BATCH, tasks: int | None = None) -> list[Cell]:
    """The cells after training; kept: theta of the best epoch by validation error, best: that error. kind: one of KINDS.

    Tasks run at once, so there may be no more than the session has cores for (as many as batches, unless told).
    """
    epochs, seed = epochs or KINDS[kind][0], KINDS[kind][1] if seed is None else seed
    of, columns = moments(rows, c), np.arange(2 * c.features + 1)
    start = [Cell(i, tau, rho, steps, seed + tau + int(1000 * rho) + steps) for i, (tau, rho, steps) in enumerate(cells or grid(c.taus))]
    for cell in start:
        cell.theta = models.ridge(pooled(of["train", cell.tau], g, c), WARM, columns)
    checked = {tau: pooled(of["val", tau], g, c) for tau in {cell.tau for cell in start}}
    tasks = tasks or max(1, min(rows.sparkSession.sparkContext.defaultParallelism, c.train_end // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = Together(BarrierTaskContext.get())
        found = Bins.together([Bins(b, c) for b in batches if b.num_rows], c)
        run_epochs(found, start, g, kind, epochs, checked, size, together, c)
        together.close()
        if together.first:
            yield pa.record_batch([pa.array([x.number for x in start]), pa.array([float(x.best) for x in start]), pa.array([x.kept.tolist() for x in start], pa.list_(pa.float64()))], ["number", "best", "kept"])

    for r in rows.repartition(tasks, "bin_idx").mapInArrow(run, "number long, best double, kept array<double>", barrier=True).collect():
        start[r["number"]].best, start[r["number"]].kept = r["best"], np.array(r["kept"])
    return start
