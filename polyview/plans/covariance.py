"""Fitting plan for many subjects and few features.

One Spark pass over the subjects sums the centred cross-products of the views;
map tasks add their rows up with BLAS and send one partial matrix each.  The
iterations then work on the features-by-features result, whose size is checked
before this plan is chosen and does not depend on the number of subjects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.plans.common import (
    LOADINGS, FitOptions, FitResult, Progress, add_partials, deflated_by, others, symmetric, warn_zero,
)
from polyview.session import scan_tasks


def _cross_sums(widths: list[int], origin: np.ndarray):
    """Per task: column sums and, for each view, its product with the later views."""
    ends = np.cumsum(widths)

    def run(batches):
        total, cross, count = np.zeros(ends[-1]), None, 0
        for batch in batches:
            n = batch.num_rows
            parts = []
            for c, width in zip(batch.columns, widths):
                flat = c.flatten().to_numpy(zero_copy_only=False)
                if len(flat) != n * width or not (c.value_lengths().to_numpy() == width).all():
                    raise ValueError("every subject needs arrays of the same length per view")
                parts.append(flat.reshape(n, width))
            x = np.hstack(parts) - origin
            if not np.isfinite(x).all():
                raise ValueError("null, NaN or infinite entry in a view")
            part = [x[:, e - w:e].T @ x[:, e:] for e, w in zip(ends[:-1], widths[:-1])]
            cross = part if cross is None else [a + b for a, b in zip(cross, part)]
            total += x.sum(axis=0)
            count += n
        if count:
            rows = [np.append(total, count)] + [r for block in cross for r in block]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, len(rows) - 1), pa.int32()),
                 pa.array(rows, pa.list_(pa.float64()))],
                names=["line", "sums"],
            )

    return run


def cross_covariances(
    rows: DataFrame, views: list[Column], widths: list[int], centered: bool
) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray, int]:
    """``X_i' X_j`` for i < j, the column means, and the number of subjects.

    Sums are taken around one subject's values, so that large offsets do not
    cancel, and moved to the means (or back to 0) afterwards.
    """
    arrays = rows.select(*[v.cast("array<double>").alias(f"v{i}") for i, v in enumerate(views)])
    first = arrays.first()
    origin = np.array([x for v in first for x in v], dtype=float) if centered else np.zeros(sum(widths))
    if not np.isfinite(origin).all():
        raise ValueError("null, NaN or infinite entry in a view")
    partials = scan_tasks(arrays, 4 * sum(widths) ** 2).mapInArrow(
        _cross_sums(widths, origin), "line int, sums array<double>")
    lines = {line: sums for (line,), sums in add_partials(partials, "line").items()}
    n = int(lines[-1][-1])
    total = lines[-1][:-1]
    starts = np.concatenate([[0], np.cumsum(widths)])
    out = {}
    for i in range(len(widths) - 1):
        a, b = starts[i], starts[i + 1]
        block = np.vstack([lines[r] for r in range(a, b)])
        if centered:
            block = block - np.outer(total[a:b], total[b:]) / n
        for j in range(i + 1, len(widths)):
            out[i, j] = block[:, starts[j] - b:starts[j + 1] - b]
    return out, origin + total / n, n


def _soft(z, r):
    return np.sign(z) * np.maximum(0.0, np.abs(z) - r)


def _unit(z):
    norm = np.linalg.norm(z)
    return z / norm if norm > 0 else z


def first_max(norms: np.ndarray) -> int:
    """Lowest index whose norm equals the maximum up to rounding."""
    return int(np.argmax(norms >= norms.max() * (1 - 1e-11)))


def power_pair(a: np.ndarray, rho: float, opts: FitOptions):
    """L1 power iteration on ``a`` (features of the view by features of the other)."""
    norms = np.linalg.norm(a, axis=1)
    best = first_max(norms)
    top = norms[best]
    if top == 0:
        return None
    x, r = a[best] / top, rho * top
    course = Progress(opts)
    while not course.reason:
        z = _soft(a @ x, r)
        x = _unit(a.T @ z)
        course.step(float(z @ z))
    return a @ x, r, course


def solve(cov: dict, widths: list[int], opts: FitOptions):
    """All components from the cross-covariances: loadings, sigma, the courses of the power iterations."""
    d = len(widths)

    def c(i, j):
        return cov[i, j] if i < j else cov[j, i].T

    deflated = {(i, j): c(i, j).copy() for i in range(d) for j in range(i + 1, d)}
    loadings: list[list[np.ndarray]] = []
    sigmas: list[dict] = []
    courses = {}
    for k in range(opts.k):
        start, supports = [], []
        for i in range(d):
            total, bound = np.zeros(widths[i]), 0.0
            for j in others(i, d):
                a = deflated[i, j] if i < j else deflated[j, i].T
                if j < i:
                    if supports[j].size == 0:
                        warn_zero(k, j)
                        continue
                    a = a[:, supports[j]]
                found = power_pair(a, opts.rhos[i], opts)
                if found is None:
                    warn_zero(k, i)
                    continue
                total += found[0]
                bound = max(bound, found[1])
                courses[k, i, j] = found[2]
            z = _unit(_soft(total, bound))
            start.append(z)
            supports.append(np.flatnonzero(z))

        removed = deflated_by(k, opts.full_deflation)

        def reduced(i, j):
            si, sj = supports[i], supports[j]
            block = c(i, j)[np.ix_(si, sj)]
            for q in removed:
                block = block - sigmas[q][max(i, j), min(i, j)] * np.outer(
                    loadings[q][i][si], loadings[q][j][sj])
            return block

        final = []
        for i in range(d):
            z = np.zeros(widths[i])
            if supports[i].size:
                blocks = {j: reduced(i, j) for j in others(i, d) if supports[j].size}
                zi, course = start[i][supports[i]], Progress(opts)
                while not course.reason:
                    t = np.zeros(len(zi))
                    for j, b in blocks.items():
                        t += b @ final[j][supports[j]] if j < i else b @ (b.T @ zi)
                    zi = _unit(t)
                    course.step(-2.0 * float(np.linalg.norm(t)))
                z[supports[i]] = zi
            final.append(z)

        sigma = {}
        for i in range(d):
            for j in range(i):
                value = 0.0
                if supports[i].size and supports[j].size:
                    value = final[i][supports[i]] @ reduced(i, j) @ final[j][supports[j]]
                sigma[i, j] = float(value)
                deflated[j, i] -= value * np.outer(final[j], final[i])
        loadings.append(final)
        sigmas.append(sigma)
    return loadings, sigmas, courses


def fit(rows: DataFrame, views: list[Column], widths: list[int], opts: FitOptions) -> FitResult:
    cov, means, _ = cross_covariances(rows, views, widths, opts.centered)
    loadings, sigmas, courses = solve(cov, widths, opts)
    starts = np.concatenate([[0], np.cumsum(widths)])
    table, score_means, sigma = [], [], []
    for k, (zs, s) in enumerate(zip(loadings, sigmas)):
        sigma += symmetric(k, len(widths), s)
        for i, z in enumerate(zs):
            table += [(k, i, int(f), float(z[f])) for f in np.flatnonzero(z)]
            score_means.append((k, i, float(means[starts[i]:starts[i + 1]] @ z)))
    columns = list(zip(*table, strict=True)) or [()] * 4
    arrow = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)],
                     names=["component", "view_idx", "feature_id", "loading"])
    return FitResult(
        rows.sparkSession.createDataFrame(arrow, LOADINGS), sigma, score_means, list(widths), courses
    )
