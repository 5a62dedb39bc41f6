"""Scores and predictions of array columns, by the weights' support alone.

The views' weights become one small row: the supports' positions and the weights there.
It enters a plan as a scalar subquery, so the plan's text and the driver do not grow
with the weights, and no row carries more of them than the entries of one subject in the supports.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.functions.scalar import CONSTANT_SPREAD
from polyview.session import scan_tasks

# Features whose moments travel together, and numbers of one array taken out of an Arrow batch at a time.
CHUNK = 256
NUMBERS = 1 << 21


def packed(weights: DataFrame, views: Sequence[int], components: int, widths: Sequence[int]) -> Column:
    """The views' rows of ``weights(view_idx, component, feature_id, value)`` as a struct with a field ``v<view>`` each.

    idx: the support in order; w: its weights, an array per component; gaps: how many features
    lie before each of the support, since the one before; tail: how many lie behind it.
    """
    names = [f"w{q}" for q in range(components)]
    entries = weights.groupBy("view_idx", "feature_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("component") == q, F.col("value"))), F.lit(0.0)).alias(n) for q, n in enumerate(names)])
    row = entries.agg(*[
        F.array_sort(F.collect_list(F.when(F.col("view_idx") == v, F.struct("feature_id", *names)))).alias(f"s{v}") for v in views])
    fields = []
    for v in views:
        # A field of an array of structs is the array of the fields.
        idx = F.col(f"s{v}.feature_id").cast("array<int>")
        before = F.concat(F.array(F.lit(-1)), idx)
        fields.append(F.struct(
            idx.alias("idx"), F.array(*[F.col(f"s{v}.{n}") for n in names]).alias("w"),
            F.zip_with(idx, F.slice(before, 1, F.size(idx)), lambda i, b: i - b - 1).alias("gaps"),
            (F.lit(widths[v] - 1) - F.element_at(before, -1)).alias("tail")).alias(f"v{v}"))
    return row.select(F.struct(*fields)).scalar()


def dots(array: str, weights: str, components: int) -> Column:
    """The array's products with every component's weights; both are names of columns or fields.

    What a lambda takes from outside may be computed anew for every entry, so the array is
    repeated (by reference) outside of it.
    """
    entries = f"zip_with({weights}.idx, array_repeat({array}, size({weights}.idx)), (i, a) -> get(a, i))"
    return F.expr("array(" + ", ".join(
        f"aggregate(zip_with({entries}, {weights}.w[{q}], (x, w) -> x * w), 0D, (total, t) -> total + t)"
        for q in range(components)) + ")")


def spread_out(sums: str, weights: str, components: int) -> Column:
    """``sums`` (one number per component) times the weights, with 0 outside the support."""
    values = reduce(lambda a, b: f"zip_with({a}, {b}, (x, y) -> x + y)", [
        f"zip_with({weights}.w[{q}], array_repeat({sums}[{q}], size({weights}.idx)), (w, x) -> w * x)" for q in range(components)])
    return F.expr(f"concat(flatten(zip_with({weights}.gaps, {values}, (gap, v) -> concat(array_repeat(0D, gap), array(v)))), "
                  f"array_repeat(0D, {weights}.tail))")


def _moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per column of two matrices of equal shape: means, centred sums of squares and products, largest magnitudes."""
    mean_a, mean_b = a.mean(0), b.mean(0)
    da, db = a - mean_a, b - mean_b
    return np.stack([mean_a, mean_b, (da * da).sum(0), (db * db).sum(0), (da * db).sum(0), np.abs(a).max(0), np.abs(b).max(0)])


def _merged(n: int, x: np.ndarray, m: int, y: np.ndarray) -> np.ndarray:
    """The moments of ``n`` and ``m`` rows together; large means cost no digits."""
    gap = y[:2] - x[:2]
    between = np.stack([gap[0] * gap[0], gap[1] * gap[1], gap[0] * gap[1]]) * (n * m / (n + m))
    return np.concatenate([x[:2] + gap * (m / (n + m)), x[2:5] + y[2:5] + between, np.maximum(x[5:], y[5:])])


def _pair_matrices(batches):
    """Slices of a bounded size as two matrices; rows without one of the arrays are left out."""
    for batch in batches:
        batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
        at = 0
        while at < batch.num_rows:
            width = len(batch.column(0)[at])
            part = batch.slice(at, max(1, NUMBERS // max(width, 1)))
            at += part.num_rows
            flat = [c.flatten() for c in part.columns]
            if any(f.null_count or (c.value_lengths().to_numpy() != width).any() for c, f in zip(part.columns, flat, strict=True)):
                raise ValueError("null entries or arrays of different lengths in a view and its prediction")
            yield [f.to_numpy().reshape(-1, width) for f in flat]


def paired_correlations(pairs: DataFrame) -> DataFrame:
    """``(features, total)`` per chunk of features: how many they are and the sum of the correlations of two array columns.

    A task keeps one row of moments for all of its subjects, so no row of a subject and a
    feature is made and a shuffle carries seven numbers for each task and feature.  A constant
    feature, or a prediction that is, counts as 0.  Rows that lack an array are left out; an array with
    a null entry, or arrays of different lengths, fail the query.  No rows give no chunks.
    """
    def partial(batches):
        n, kept = 0, None
        for a, b in _pair_matrices(batches):
            found = _moments(a, b)
            if kept is not None and kept.shape != found.shape:
                raise ValueError("null entries or arrays of different lengths in a view and its prediction")
            kept = found if kept is None else _merged(n, kept, len(a), found)
            n += len(a)
        if kept is None:
            return
        for chunk, at in enumerate(range(0, kept.shape[1], CHUNK)):
            own = np.ascontiguousarray(kept[:, at:at + CHUNK])
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([n]), pa.array([own.ravel()], pa.list_(pa.float64()))], ["chunk", "n", "moments"])

    def whole(rows: pa.Table) -> pa.Table:
        n, kept = 0, None
        for m, moments in zip(rows["n"].to_pylist(), rows["moments"], strict=True):
            found = moments.values.to_numpy().reshape(7, -1)
            if kept is not None and kept.shape != found.shape:
                raise ValueError("null entries or arrays of different lengths in a view and its prediction")
            kept = found if kept is None else _merged(n, kept, m, found)
            n += m
        spread = np.sqrt(kept[2:4] / n)
        varies = (spread > CONSTANT_SPREAD * kept[5:]).all(0)
        total = (kept[4, varies] / n / (spread[0, varies] * spread[1, varies])).sum()
        return pa.table({"features": pa.array([kept.shape[1]]), "total": pa.array([total])})

    moments = scan_tasks(pairs).mapInArrow(partial, "chunk long, n long, moments array<double>")
    return moments.groupBy("chunk").applyInArrow(whole, "features long, total double")
