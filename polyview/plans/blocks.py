"""Fitting plan for many subjects and views whose feature vectors fit on the driver.

Cells are packed once into blocks: all cells of some subjects, as arrays in their
smallest exact types, placed by subject and kept.  A product ``X_t' X_s v`` is then
one pass over the blocks without a join or a shuffle of cells: every task goes from
features to its subjects and back and emits one partial vector per column.  Tasks are
a few per core, so what they emit does not grow with the subjects.  The iterations
work on vectors of feature size, whose width is bounded; nothing of subject size
leaves the tasks.

The strongest column is searched as in the sparse plan, by bounds from probe vectors.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview import session
from polyview.plans.common import (
    LOADINGS, FitOptions, FitResult, Progress, add_partials, deflated_by, others, symmetric, warn_zero,
)
from polyview.plans.covariance import _soft, _unit, first_max
from polyview.plans.sparse import DIRECT, PROBES, SLOTS, TIE, _better
from polyview.session import scan_tasks, task_parts
from polyview.sources.views import NULL_KEY, REPEATED

# Views of more features are fitted by joins.
WIDTH = 1 << 17
# Entries of all partial vectors that one task emits.
PANEL = 1 << 22
# Cells that are packed into one block, or into more where one subject has more.
BLOCK = 1 << 16


def takes(widths: list[int]) -> bool:
    return max(widths) <= min(WIDTH, session.BROADCAST_ROWS)


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices of an array, from each start to the next, as binary values."""
    return pa.Array.from_buffers(
        pa.binary(), len(starts) - 1,
        [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy().astype(np.int64)


def _flat(column: pa.Array, dtype) -> np.ndarray:
    """All values of a column of binary values that is not empty."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(dtype)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, and the end."""
    new = np.zeros(len(keys[0]) + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        new[1:-1] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


RUNS = "row_id bigint, view_idx int, features binary, cells binary"


def packed(view: np.ndarray, row: pa.Array, starts: np.ndarray, feature: np.ndarray, value: np.ndarray, width: int) -> pa.RecordBatch:
    """Runs of cells of one subject and view: their views and subjects, where each one starts, and the end; ``width`` of the widest view."""
    return pa.RecordBatch.from_arrays(
        [row, pa.array(view.astype(np.int32)), _binary(feature.astype(_index_type(width)), starts), _binary(_smallest(value), starts)],
        names=["row_id", "view_idx", "features", "cells"])


def checked_runs(runs: DataFrame) -> DataFrame:
    """Runs of a null subject fail the query that reads them, as such cells do."""
    return runs.filter(F.when(F.col("row_id").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit(NULL_KEY)).cast("boolean")))


def _runs(width):
    """Runs of cells as they come."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            view, row, feature, value = (c.to_numpy() for c in batch.columns)
            same = row[1:] == row[:-1]
            if ((row[1:] < row[:-1]) | (same & (view[1:] < view[:-1]))).any():
                order = np.lexsort((view, row))
                view, row, feature, value = view[order], row[order], feature[order], value[order]
            at = _changes(row, view)
            yield packed(view[at[:-1]], pa.array(row[at[:-1]]), at, feature, value, width)

    return run


def _smallest(values: np.ndarray) -> np.ndarray:
    """The values in the smallest type that holds them exactly; its size tells which it is."""
    for dtype in (np.uint8, np.uint16):
        with np.errstate(invalid="ignore"):
            small = values.astype(dtype)
        if (small == values).all():
            return small
    return values


VALUES = {1: np.uint8, 2: np.uint16, 8: np.float64}


def _index_type(width: int):
    return np.uint16 if width <= 1 << 16 else np.int32


def _block(widths, row, view, feature, value):
    """One block of whole subjects; cells that are 0 only count the subject."""
    at = _changes(row)
    local = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = [len(at) - 1, np.asarray(row[at[:-1]], np.int64).tobytes()]
    for v, width in enumerate(widths):
        here = np.flatnonzero((view == v) & (value != 0))
        key = local[here] * width + feature[here]
        if (key[1:] <= key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, here = key[order], here[order]
            if (key[1:] == key[:-1]).any():
                raise ValueError(REPEATED)
        out += [np.bincount(key // width, minlength=len(at) - 1).astype(np.int32).tobytes(),
                (key % width).astype(_index_type(width)).tobytes(), _smallest(value[here]).tobytes()]
    return out


def _blocks(widths, names, size):
    """From runs in order of their subjects."""
    index = _index_type(max(widths))

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, index), np.zeros(0)]

        def written(whole):
            row = whole[0]
            subjects = _changes(row)
            first = 0
            while first < len(row):
                # The subjects that begin in the next so many cells.
                end = int(subjects[np.searchsorted(subjects, min(first + size, len(row)))])
                line = _block(widths, *[c[first:end] for c in whole])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in line], names=names)
                first = end

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = _lengths(batch.column("features")) // np.dtype(index).itemsize
            each = _lengths(batch.column("cells")) // sizes
            parts = [held]
            for size_of in np.unique(each):
                some = batch.filter(pa.array(each == size_of))
                row, view = (np.repeat(some.column(c).to_numpy(), sizes[each == size_of]) for c in ("row_id", "view_idx"))
                parts.append([row, view, _flat(some.column("features"), index),
                              _flat(some.column("cells"), VALUES[size_of]).astype(float)])
            held = [np.concatenate(p) for p in zip(*parts)]
            if len(parts) > 2:
                order = np.argsort(held[0], kind="stable")
                held = [c[order] for c in held]
            # The last subject may go on in the next batch.
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield from written([c[:last] for c in held])
            held = [c[last:] for c in held]
        if len(held[0]):
            yield from written(held)

    return run


def _cells_of(batch, i, view, width):
    """Local subject, feature and value of a block's cells of one view."""
    sizes, features, values = (batch.column(f"{c}{view}")[i].as_buffer() for c in ("sizes", "features", "cells"))
    feature = np.frombuffer(features, _index_type(width)).astype(np.intp)
    row = np.repeat(np.arange(len(sizes) // 4), np.frombuffer(sizes, np.int32))
    each = len(values) // max(len(feature), 1)
    value = np.frombuffer(values, VALUES[each or 1]).astype(float)
    return row, feature, value


def _lines(arrays):
    """One row per array, numbered."""
    rows = [row for a in arrays for row in a]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["line", "sums"])


LINES = "line int, sums array<double>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _column_facts(view, width):
    """Column sums and squares, and four sums of 26 hash bits per cell, which are equal for columns that are copies of each other."""

    def run(batches):
        total, seen = np.zeros((6, width)), False
        for batch in batches:
            for i in range(batch.num_rows):
                seen = True
                row, feature, value = _cells_of(batch, i, view, width)
                ids = np.frombuffer(batch.column("rows")[i].as_buffer(), np.uint64)[row]
                weights = [value, value * value]
                for seed in (1, 2):
                    h = _mixed(_mixed(ids + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) ^ _mixed(value.view(np.uint64)))
                    weights += [(h & np.uint64((1 << 26) - 1)).astype(float), (h >> np.uint64(38)).astype(float)]
                for t, w in zip(total, weights):
                    t += np.bincount(feature, w, minlength=width)
        if seen:
            yield from _lines([total])

    return run


def _products(source, targets, widths, panel, picked, shifts):
    """Per task: ``X_t' (X_s p - shift)`` for the columns p of a panel, or of picked features of the source."""
    m = len(shifts)
    slots = None
    if picked is not None:
        slots = np.full(widths[source], -1)
        slots[picked] = np.arange(m)

    def run(batches):
        totals, seen = {t: np.zeros((m, widths[t])) for t in targets}, False
        for batch in batches:
            for i in range(batch.num_rows):
                seen = True
                cells = {v: _cells_of(batch, i, v, widths[v]) for v in {source, *targets}}
                row, feature, value = cells[source]
                n = batch.column("subjects")[i].as_py()
                if slots is not None:
                    slot = slots[feature]
                    here = np.flatnonzero(slot >= 0)
                    here = here[np.argsort(slot[here], kind="stable")]
                    ends = np.searchsorted(slot[here], np.arange(m + 1))
                for c in range(m):
                    if slots is None:
                        u = np.bincount(row, value * panel[c][feature], minlength=n)
                    else:
                        some = here[ends[c]:ends[c + 1]]
                        u = np.bincount(row[some], value[some], minlength=n)
                    u = u - shifts[c]
                    for t in targets:
                        r, f, v = cells[t]
                        totals[t][c] += np.bincount(f, v * u[r], minlength=widths[t])
        if seen:
            yield from _lines(totals[t] for t in targets)

    return run


class Blocks:
    """The packed cells of all views; ``runs`` are the same cells as ``packed`` gives them, where the caller has them so."""

    def __init__(self, cells: DataFrame, widths: list[int], runs: DataFrame | None = None):
        self.widths = list(widths)
        self.cells = cells.select("view_idx", "row_id", "feature_id", "value")
        self.runs = runs
        self.kept: list[DataFrame] = []

    @cached_property
    def blocks(self) -> DataFrame:
        kept, index = StorageLevel.MEMORY_AND_DISK, _index_type(max(self.widths))
        runs = self.cells.mapInArrow(_runs(max(self.widths)), RUNS) if self.runs is None else checked_runs(self.runs)
        runs = runs.persist(kept)
        try:
            bytes_of = runs.agg(F.sum(F.octet_length("features").cast("long"))).first()[0] or 0
            parts = task_parts(runs.sparkSession, bytes_of // np.dtype(index).itemsize)
            names = ["subjects", "rows"] + [f"{c}{v}" for v in range(len(self.widths)) for c in ("sizes", "features", "cells")]
            blocks = runs.repartition(parts, "row_id").sortWithinPartitions("row_id", "view_idx").mapInArrow(
                _blocks(self.widths, names, BLOCK), ", ".join(["subjects int"] + [f"{c} binary" for c in names[1:]])).persist(kept)
            self.kept.append(blocks)
            self.subjects_with_cells = blocks.agg(F.sum(F.col("subjects").cast("long"))).first()[0] or 0
        finally:
            runs.unpersist()
        return blocks

    def subjects(self) -> int:
        """How many subjects have cells."""
        self.blocks
        return self.subjects_with_cells

    def release(self):
        for kept in self.kept:
            kept.unpersist()

    def _summed(self, views, entries, task, *columns) -> dict[int, np.ndarray]:
        named = [f"{c}{v}" for v in sorted(set(views)) for c in ("sizes", "features", "cells")]
        partials = scan_tasks(self.blocks.select(*columns, *named), 8 * entries).mapInArrow(task, LINES)
        return {line: sums for (line,), sums in add_partials(partials, "line").items()}

    def facts(self, view: int) -> np.ndarray:
        """Column sums, squares and fingerprints."""
        width = self.widths[view]
        lines = self._summed([view], 6 * width, _column_facts(view, width), "rows")
        return np.array([lines.get(i, np.zeros(width)) for i in range(6)])

    def products(self, source, targets, shifts, panel=None, picked=None) -> list[np.ndarray]:
        """For each target its features by the panel's columns."""
        m = len(shifts)
        entries = m * sum(self.widths[t] for t in targets)
        task = _products(source, targets, self.widths, panel, picked, shifts)
        lines = self._summed([source, *targets], entries, task, "subjects")
        return [np.array([lines.get(p * m + c, np.zeros(self.widths[t])) for c in range(m)]).T for p, t in enumerate(targets)]


class Side:
    """A view restricted to some features, with its earlier loadings."""

    def __init__(self, blocks: Blocks, view: int, n: int, facts: np.ndarray, centered: bool, priors, known: dict):
        self.blocks, self.view, self.n = blocks, view, n
        self.total = facts[0] if centered else np.zeros_like(facts[0])
        self.square, self.prints = facts[1], facts[2:]
        self.priors = priors
        self.mask, self.small = np.ones(len(self.total), bool), False
        # By (view, other view): the view's few features, and its columns of the product with the other.
        self.known = known

    def within(self, support: np.ndarray) -> Side:
        out = object.__new__(Side)
        out.__dict__.update(self.__dict__)
        out.mask, out.small = support, True
        return out

    def meet(self, other: Side) -> None:
        """Bring the columns of ``X_other' X_self`` to the driver in one pass, where they are few enough."""
        support, key = np.flatnonzero(self.mask), (self.view, other.view)
        if key not in self.known and 0 < len(support) <= PANEL // max(len(self.total), len(other.total)):
            columns, = self.blocks.products(self.view, [other.view], list(self.total[support] / self.n), picked=support)
            self.known[key] = support, columns


def times(source: Side, target: Side, vector: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Deflated ``X_target' X_source v``."""
    s, t = source.view, target.view
    if source.small and (s, t) in source.known:
        support, columns = source.known[s, t]
        z = columns @ vector[support]
    elif target.small and (t, s) in source.known:
        support, columns = source.known[t, s]
        z = np.zeros(len(target.total))
        z[support] = vector @ columns
    else:
        out, = source.blocks.products(s, [t], [float(source.total @ vector) / source.n], panel=[vector])
        z = out[:, 0]
    for weight, a, b in zip(sigma, source.priors, target.priors):
        z = z - weight * (a @ vector) * b
    return np.where(target.mask, z, 0.0)


def columns_of(left: Side, right: Side, sigma: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The picked columns of the deflated ``X_left' X_right``."""
    out, = left.blocks.products(right.view, [left.view], list(right.total[picked] / right.n), picked=picked)
    for s, a, b in zip(sigma, left.priors, right.priors):
        out = out - s * np.outer(a, b[picked])
    return np.where(left.mask[:, None], out, 0.0)


def column_bounds(left: Side, right: Side, sigma: np.ndarray) -> np.ndarray:
    """Upper bounds on the column norms of ``X_left' X_right``, derived as in the sparse plan."""
    n, width = left.n, len(left.total)
    seeds = np.where(np.random.default_rng(0).integers(0, 2, (PROBES, width)) * left.mask, 1.0, -1.0 * left.mask)
    image, across = left.blocks.products(left.view, [left.view, right.view], list(seeds @ left.total / n), panel=seeds)
    image = np.where(left.mask[:, None], image, 0.0)
    g = seeds @ image
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    keep = values > 1e-6 * max(values.max(), 0.0)
    turn = vectors[:, keep] / np.sqrt(values[keep])
    bb = turn.T @ (image.T @ image) @ turn
    rest_left = float((left.square - left.total ** 2 / n)[left.mask].sum())
    rest = max(rest_left - float(np.trace(bb)), 0.0)
    a = across @ turn
    size = np.maximum(right.square - right.total ** 2 / n, 0.0)
    bound = (np.sqrt(np.maximum(((a @ bb) * a).sum(axis=1), 0.0))
             + np.sqrt(rest) * np.sqrt(np.maximum(size - (a * a).sum(axis=1), 0.0))
             + 1e-6 * np.sqrt(max(rest_left, 0.0)) * np.sqrt(size))
    for s, z in zip(sigma, right.priors):
        bound = bound + abs(s) * np.abs(z)
    return bound


def strongest_column(left: Side, right: Side, sigma: np.ndarray, batch: int = SLOTS, direct: int = DIRECT):
    """``(norm, feature, column, evaluated)`` of the largest column, or None if all are 0; exact, as in the sparse plan."""
    if left.small and (left.view, right.view) in left.known:
        support, columns = left.known[left.view, right.view]
        whole = columns.T
        for weight, a, b in zip(sigma, left.priors, right.priors):
            whole = whole - weight * np.outer(a[support], b)
        norms = np.linalg.norm(whole, axis=0)
        if not norms.any():
            return None
        best, column = first_max(norms), np.zeros(len(left.total))
        column[support] = whole[:, best]
        return float(norms[best]), best, column, 0
    most = max(1, PANEL // max(len(left.total), len(right.total)))
    left_over = np.flatnonzero((right.square > 0) & right.mask)
    if len(left_over) == 0:
        return None
    bounds = None
    if len(left_over) > direct:
        bounds = column_bounds(left, right, sigma)
        # Copies of a column have the same norm; the lowest feature stands for them all.
        same = np.vstack([right.prints, *right.priors])[:, left_over].T
        _, first, group = np.unique(same, axis=0, return_index=True, return_inverse=True)
        top_of = np.zeros(len(first))
        np.maximum.at(top_of, group.reshape(-1), bounds[left_over])
        order = np.lexsort((left_over[first], -top_of))
        left_over, bounds = left_over[first][order], top_of[order]
    else:
        batch = most
    top, best, column, done = 0.0, None, None, 0
    while done < len(left_over):
        picked = left_over[done:done + min(batch, most)]
        if bounds is not None:
            picked = picked[bounds[done:done + len(picked)] >= top * (1 - TIE)]
            if not len(picked):
                break
        found = columns_of(left, right, sigma, picked)
        norms = np.linalg.norm(found, axis=0)
        before = best
        top, best = _better(top, best, {int(f): float(x) for f, x in zip(picked, norms)})
        if best != before:
            column = found[:, int(np.flatnonzero(picked == best)[0])]
        done += len(picked)
        batch *= 4
    return (top, best, column, done) if top else None


def _power_pair(left: Side, right: Side, sigma: np.ndarray, rho: float, opts: FitOptions):
    found = strongest_column(left, right, sigma)
    if found is None:
        return None
    x, bound, course = _unit(found[2]), rho * found[0], Progress(opts)
    while not course.reason:
        z = _soft(times(left, right, x, sigma), bound)
        x = _unit(times(right, left, z, sigma))
        course.step(float(z @ z))
    return times(left, right, x, sigma), bound, course


def solve(blocks: Blocks, n: int, opts: FitOptions):
    """All components: loadings, sigma, the courses of the iterations, and the column sums."""
    d = len(blocks.widths)
    facts = [blocks.facts(v) for v in range(d)]
    totals = [f[0] if opts.centered else np.zeros_like(f[0]) for f in facts]
    loadings: list[list[np.ndarray]] = []
    sigmas: list[dict] = []
    courses: dict = {}

    def sigma_row(i, j, comps):
        return np.array([sigmas[q][max(i, j), min(i, j)] for q in comps])

    for k in range(opts.k):
        comps, known = list(range(k)), {}
        sides = [Side(blocks, v, n, facts[v], opts.centered, [z[v] for z in loadings], known) for v in range(d)]
        start = [np.zeros(w) for w in blocks.widths]
        for i in range(d):
            total, bound = np.zeros(blocks.widths[i]), 0.0
            for j in others(i, d):
                left = sides[j].within(start[j] != 0) if j < i else sides[j]
                if not left.mask.any():
                    warn_zero(k, j)
                    continue
                if j < i:
                    left.meet(sides[i])
                pair = _power_pair(left, sides[i], sigma_row(i, j, comps), opts.rhos[i], opts)
                if pair is None:
                    warn_zero(k, i)
                    continue
                total, bound = total + pair[0], max(bound, pair[1])
                courses[k, i, j] = pair[2]
            start[i] = _unit(_soft(total, bound))
        small = [side.within(z != 0) for side, z in zip(sides, start)]
        used = [s.mask.any() for s in small]
        removed = deflated_by(k, opts.full_deflation)

        def weights(i, j):
            w = np.zeros(k)
            w[removed] = sigma_row(i, j, removed)
            return w

        final: list[np.ndarray] = []
        for i in range(d):
            z = start[i]
            if used[i]:
                fixed = sum((times(small[j], small[i], final[j], weights(i, j)) for j in range(i) if used[j]),
                            np.zeros(blocks.widths[i]))
                course = Progress(opts)
                while not course.reason:
                    t = fixed
                    for j in range(i + 1, d):
                        if used[j]:
                            w = weights(i, j)
                            t = t + times(small[j], small[i], times(small[i], small[j], z, w), w)
                    z = _unit(t)
                    course.step(-2.0 * float(np.linalg.norm(t)))
            final.append(z)
        sigmas.append({
            (i, j): float(times(small[j], small[i], final[j], weights(i, j)) @ final[i]) if used[i] and used[j] else 0.0
            for i in range(d) for j in range(i)})
        loadings.append(final)
    return loadings, sigmas, courses, totals


def fit(blocks: Blocks, n: int, opts: FitOptions) -> FitResult:
    spark = blocks.cells.sparkSession
    try:
        loadings, sigmas, courses, totals = solve(blocks, n, opts)
    finally:
        blocks.release()
    d = len(blocks.widths)
    found = [(k, i, f, z[f]) for k, zs in enumerate(loadings) for i, z in enumerate(zs) for f in [np.flatnonzero(z)]]
    table = pa.table({
        "component": np.concatenate([np.full(len(f), k, np.int32) for k, _, f, _ in found]),
        "view_idx": np.concatenate([np.full(len(f), i, np.int32) for _, i, f, _ in found]),
        "feature_id": np.concatenate([f.astype(np.int64) for *_, f, _ in found]),
        "loading": np.concatenate([z for *_, z in found])})
    means = [(k, i, float(totals[i] @ z) / n) for k, zs in enumerate(loadings) for i, z in enumerate(zs) if z.any()]
    return FitResult(spark.createDataFrame(table, LOADINGS), [row for k, s in enumerate(sigmas) for row in symmetric(k, d, s)],
                     means, list(blocks.widths), courses)
