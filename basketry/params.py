"""Validated parameters of miners and recommenders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, rounding: str) -> Column:
    """``round`` (half up) or ``floor``."""
    if rounding == "round":
        return F.round(value)
    if rounding == "floor":
        return F.floor(value)
    raise ValueError(f"rounding is round or floor, not {rounding!r}")


@dataclass(frozen=True)
class MiningParams:
    """Largest itemset, least share of baskets, least confidence."""

    max_k: int = 3
    minsup: float = 0.6
    minconf: float = 0.4
    rounding: str = "round"

    def __post_init__(self) -> None:
        if self.max_k < 1:
            raise ValueError("max_k must be at least 1")
        if self.minsup <= 0 or self.minconf <= 0:
            raise ValueError("minsup and minconf must be positive")
        if self.rounding not in ("round", "floor"):
            raise ValueError("rounding is round or floor")

    def least_count(self, baskets: int) -> int:
        """Baskets that a frequent itemset needs."""
        share = baskets * self.minsup
        return max(1, int(share + 0.5) if self.rounding == "round" else int(share))


@dataclass(frozen=True)
class CFParams:
    """Similarities up to ``threshold`` are left out; ``top_n`` 0 returns every recommendation."""

    threshold: float = 0.0
    top_n: int = 0
    rounding: str = "round"

    def __post_init__(self) -> None:
        if self.top_n < 0:
            raise ValueError("top_n must not be negative")
        if self.rounding not in ("round", "floor"):
            raise ValueError("rounding is round or floor")
