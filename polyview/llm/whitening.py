"""Whitened principal components of vectors, by the polarisation identity.

Entries become whole numbers, so all sums are exact.  Over the distinct vectors,
one pass adds up the entries; a second one adds up the squares of the centred
values of every dimension and of the sum of every two dimensions.  Half of what
the variance of a sum exceeds its terms' variances by is their covariance:
2 cov(a, b) = var(a + b) - var(a) - var(b).  The matrix goes to eigh; a third pass
measures the covariance of what came out, by the same identity.

Tasks send one partial sum per dimension or pair; the driver holds numbers by the
square of the dimension, none by the rows.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import slices
from polyview.session import cut_lineage, scan_tasks

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Rows that are added up in 64 bits; sums of their squares fit while entries stay below LARGE.
ROWS = 1024
LARGE = 1 << 25


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: the vectors as whole numbers, without those that are null or hold null or non-finite entries."""
    entry = F.col("v")
    fine = entry.isNotNull() & (F.size(entry) > 0) & F.forall(
        entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(fine).select("vec_id", F.transform(
        "v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT)).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def added(rows: DataFrame, width: int, entries, slots: int) -> list[int]:
    """Exact sums over all rows of the whole numbers that ``entries(matrix)`` gives per slot."""

    def run(batches):
        total = [0] * slots
        for part in slices(batches, ROWS):
            if part.num_rows:
                total = [a + int(b) for a, b in zip(total, entries(matrix(part["x"], width)), strict=True)]
        if any(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slots), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["slot", "part"])

    found = scan_tasks(rows.select("x"), 32 * slots).mapInArrow(run, "slot int, part decimal(38,0)").groupBy("slot").agg(
        F.sum("part").alias("total")).collect()
    if any(r["total"] is None for r in found):
        raise ArithmeticError("a sum of squares has more than 38 digits")
    by_slot = {r["slot"]: int(r["total"]) for r in found}
    return [by_slot.get(s, 0) for s in range(slots)]


def squares(centred: np.ndarray) -> list[int]:
    """Sums of squares of every dimension, and of the sum of every two, by (first, second)."""
    if np.abs(centred).max(initial=0) >= LARGE:
        centred = centred.astype(object)
    out = []
    for a in range(centred.shape[1]):
        pairs = centred[:, a:a + 1] + centred[:, a + 1:]
        out += [(centred[:, a] ** 2).sum(), *(pairs ** 2).sum(axis=0)]
    return out


def covariances(rows: DataFrame, width: int, n: int, sums: list[int]) -> list[list[Fraction]]:
    """Exact covariances, divisor n.

    Values are centred on the whole part of the mean, and the squares' sums moved to
    the mean itself, which is exact too.
    """
    middle = [s // n for s in sums]
    around = np.array(middle, np.int64)
    slots = width * (width + 1) // 2
    found = added(rows, width, lambda x: squares(x - around), slots)
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    variance, at = {}, 0
    for a in range(width):
        for b in range(a, width):
            off = rest[a] if a == b else rest[a] + rest[b]
            variance[a, b] = Fraction(n * found[at] - off * off, n * n)
            at += 1
    out = [[Fraction(0)] * width for _ in range(width)]
    for (a, b), v in variance.items():
        out[a][b] = out[b][a] = v if a == b else (v - variance[a, a] - variance[b, b]) / 2
    return out


def centred_on(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double precision; the whole part is taken off exactly."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(float) - np.array([(s % n) / n for s in sums])


def identity_error(rows: DataFrame, width: int, n: int, sums: list[int], weights: np.ndarray) -> float:
    """Largest entry of the whitened values' covariance less the identity, measured over the rows by polarisation."""
    k = weights.shape[1]

    def run(batches):
        total = np.zeros((2, k, k))
        for part in slices(batches, ROWS):
            if part.num_rows:
                z = centred_on(matrix(part["x"], width), n, sums) @ weights
                total[0, 0] += z.sum(axis=0)
                total[1] += ((z[:, :, None] + z[:, None, :]) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * k * k), pa.int32()), pa.array(total.ravel())], ["slot", "part"])

    found = scan_tasks(rows.select("x"), 16 * k * k).mapInArrow(run, "slot int, part double").groupBy("slot").agg(
        F.sum("part").alias("total")).collect()
    total = np.zeros(2 * k * k)
    for r in found:
        total[r["slot"]] = r["total"]
    total = total.reshape(2, k, k) / n
    mean = total[0, 0]
    variance = total[1] - (mean[:, None] + mean[None, :]) ** 2
    single = np.diag(variance) / 4
    cov = (variance - single[:, None] - single[None, :]) / 2
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error and exact_deviation.

    A row for each vector that is left and each component with variance, ``components`` at most; repeated
    vectors and ids keep their rows, a null id stays null.  Vectors are left out if they are null, empty or
    hold a null or non-finite entry, and if their length is not the commonest one (of two, the greater).
    A deviation that does not fit a long is null; exact_deviation, in decimal digits, always holds it.
    Entries whose whole number does not fit a long fail.  Without vectors, or if all are equal, there are no rows.
    """
    spark = vectors.sparkSession
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, exact_deviation string")
    every = whole_vectors(vectors, id_col, vector_col)
    length = every.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    width = length["width"]
    every = every.filter(F.size("x") == width)
    fit = cut_lineage(every.select("x").distinct())
    n = fit.count()
    sums = added(fit, width, lambda x: x.astype(object).sum(axis=0) if np.abs(x).max() >> 52 else x.sum(axis=0), width)
    cov = covariances(fit, width, n, sums)
    values, axes = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    trace = float(sum(cov[a][a] for a in range(width)))
    # Components whose variance is rounding have no direction.
    order = [i for i in np.argsort(-values) if values[i] > width * np.finfo(float).eps * max(trace, 1e-300)][:components]
    if not order:
        return spark.createDataFrame([], schema)
    weights = axes[:, order] / np.sqrt(values[order])
    explained = [float(values[i] / trace) for i in order]
    error = identity_error(fit, width, n, sums, weights)
    k = len(order)

    def run(batches):
        middle, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        for part in slices(batches, ROWS):
            x = matrix(part["x"], width)
            rows = part.num_rows
            if not rows:
                continue
            z = centred_on(x, n, sums) @ weights
            # n x - sums = n (x - middle) - rest, in 64 bits where that is sure to be exact.
            near = x - middle
            small = width * (n * (int(np.abs(near).max()) + 1)) ** 2 < 1 << 63
            wide = (near if small else near.astype(object)) * n - rest
            deviation = [int(d) for d in (wide ** 2).sum(axis=1)]
            columns = [
                part["vec_id"].take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, n), pa.int64()),
                pa.array([d if d < 1 << 63 else None for d in deviation for _ in range(k)], pa.int64()),
                pa.array(z.ravel()), pa.array(explained * rows), pa.array([error] * (rows * k)),
                pa.array([str(d) for d in deviation for _ in range(k)])]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return every.mapInArrow(run, schema)
