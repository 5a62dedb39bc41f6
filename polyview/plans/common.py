"""What the three fitting plans share: options, the course of an iteration and the result."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

log = logging.getLogger("polyview")

LOADINGS = "component int, view_idx int, feature_id bigint, loading double"
SIGMA = "component int, view_i int, view_j int, sigma double"
MEANS = "component int, view_idx int, mean double"


@dataclass
class FitOptions:
    k: int = 1
    rhos: Sequence[float] = (0.1,)
    max_iter: int = 1000
    tol: float = 1e-4
    centered: bool = True
    full_deflation: bool = False


@dataclass
class FitResult:
    """Loadings stay a table; sigma and score means are a few numbers per view."""

    loadings: DataFrame
    sigma: list[tuple[int, int, int, float]]
    score_means: list[tuple[int, int, float]]
    widths: list[int]
    # By (component, view, other view).
    progress: dict[tuple[int, int, int], Progress] = field(default_factory=dict)


class Progress:
    """One iteration's course: fed the loss of every step, it knows when to end and why.

    ``reason`` stays None while steps are to follow.  From the second step on it becomes
    "zero" at a loss of 0, "converged" when the loss moved by no more than ``tol`` of the one
    before, or "limit" when one step less than ``max_iter`` was taken.
    """

    def __init__(self, options: FitOptions):
        self.options = options
        self.losses: list[float] = []
        self.reason: str | None = None

    @property
    def steps(self) -> int:
        return len(self.losses)

    def step(self, loss: float) -> None:
        self.losses.append(loss)
        if self.steps < 2:
            return
        before = self.losses[-2]
        if loss == 0:
            self.reason = "zero"
        elif before and abs(loss - before) <= self.options.tol * abs(before):
            self.reason = "converged"
        elif self.steps + 1 == self.options.max_iter:
            self.reason = "limit"


def others(i: int, d: int) -> list[int]:
    return [j for j in range(d) if j != i]


def deflated_by(component: int, full: bool) -> list[int]:
    """Earlier components that the refit and sigma remove from the covariance."""
    return list(range(component)) if full else list(range(component))[-1:]


def warn_zero(component: int, view: int) -> None:
    log.warning("component %d: the loading of view %d is all zero, its pairs are skipped",
                component, view)


def symmetric(component: int, d: int, lower: dict) -> list[tuple[int, int, int, float]]:
    return [
        (component, i, j, 0.0 if i == j else float(lower[max(i, j), min(i, j)]))
        for i in range(d) for j in range(d)
    ]


def add_partials(partials: DataFrame, *keys: str) -> dict[tuple, np.ndarray]:
    """Sum the arrays that tasks emitted per key; the sums fit on the driver."""
    table = (
        partials.groupBy(*keys)
        .agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        .toArrow()
    )
    names = zip(*[table.column(k).to_pylist() for k in keys])
    return {key: s.values.to_numpy() for key, s in zip(names, table.column("sums"))}
