"""Constants of the market pipeline: grid, splits, levels, horizons."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    start: str = "2024-01-01 00:00:00"
    bin_us: int = 3_600_000_000
    bins: int = 720
    train_end: int = 504
    val_end: int = 612
    assets: int = 5
    levels: int = 10
    features: int = 51
    #: Horizons in bins.
    taus: tuple[int, ...] = (1, 2, 10, 20)
    eps: float = 1e-8
    tiny: float = 1e-12

    def split(self, name: str, tau: int) -> tuple[int, int]:
        """Bins [first, end) of a split, purged of the last tau."""
        first, end = {"train": (0, self.train_end), "val": (self.train_end, self.val_end), "test": (self.val_end, self.bins)}[name]
        return first, end - tau


CONFIG = Config()
#: Event types of submissions, cancellations and executions.
CLASSES = {"sub": (1,), "can": (2, 3), "exe": (4, 5)}
