"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A spread below this share of the largest magnitude counts as a constant column.
CONSTANT_SPREAD = 1e-12


def soft_threshold(value: Column, bound: Column | float) -> Column:
    """Shrink towards zero by ``bound``; values within the bound become 0."""
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.signum(value) * F.greatest(F.lit(0.0), F.abs(value) - bound) + F.lit(0.0)


def safe_divide(num: Column, den: Column, otherwise: Column | float = 0.0) -> Column:
    """``num / den``, or ``otherwise`` where the denominator is 0 or null."""
    fallback = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.coalesce(F.try_divide(num, den), fallback)


def _spread(x: Column) -> Column:
    sd = F.stddev_pop(x)
    return F.when(sd > CONSTANT_SPREAD * F.max(F.abs(x)), sd)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; constant or empty input gives 0."""
    return F.coalesce(F.covar_pop(x, y) / (_spread(x) * _spread(y)), F.lit(0.0))


def array_literal(values: Sequence[float], kind: str = "double") -> Column:
    """A constant array held in the plan as one string, folded once per query."""
    if len(values) == 0:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def sparse_dot(array: Column, indices: Sequence[int], weights: Sequence[float]) -> Column:
    """Dot product of an array column with a sparse vector held in the plan."""
    if len(indices) == 0:
        return F.lit(0.0)
    idx = array_literal([int(i) for i in indices], "int")
    wts = array_literal([float(w) for w in weights])
    terms = F.zip_with(idx, wts, lambda i, w: F.get(array, i).cast("double") * w)
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
