"""Fitting plan for many subjects and many features.

Every vector is a table and every product is a join with a grouped sum; nothing
of subject or feature size reaches the driver.  Centring is kept implicit (the
cells stay sparse) and deflation stays a low-rank correction.

Cells are placed by subject once and kept.  A product with a feature vector
broadcasts that vector (when its bound allows) and sums locally; a product with
a subject vector moves only that vector.  Subjects holding a large share of the
cells are spread over all tasks, and since only few can be that large, their
vector entries are broadcast.

The strongest column of a cross-covariance is found exactly without forming the
product: upper bounds for all columns come from a few probe vectors, and
columns are evaluated in order of their bound until no bound exceeds the best
value found.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.functions.scalar import soft_threshold
from polyview.plans.common import (
    LOADINGS, FitOptions, FitResult, Progress, deflated_by, others, symmetric, warn_zero,
)
from polyview.session import BROADCAST_ROWS, cut_lineage, lookup, task_parts
from polyview.sources.views import REPEATED

TIE = 1e-11
PROBES = 8
SLOTS = 32
# Up to this many columns are all evaluated at once, without bounds.
DIRECT = 1024
KEPT = StorageLevel.MEMORY_AND_DISK


def _names(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


class Placed:
    """Cells hash-partitioned by ``key``, keys above a share of the cells spread out."""

    def __init__(self, cells: DataFrame, key: str, parts: int, n_cells: int):
        self.key, self.parts = key, parts
        other = "feature_id" if key == "row_id" else "row_id"
        # Each heavy key holds over 1/(4*parts) of the cells, so there are at most 4*parts.
        limit = max(n_cells // (4 * parts), 1)
        counts = cells.groupBy(key).agg(F.count("*").alias("n"))
        heavy = [r[key] for r in counts.filter(F.col("n") > max(limit, 1024)).collect()]
        self.heavy_keys = None
        self.heavy = None
        self.kept = []
        light = cells
        if heavy:
            ids = cells.sparkSession.createDataFrame([(h,) for h in heavy], f"{key} bigint")
            self.heavy_keys = F.broadcast(ids)
            light = cells.join(self.heavy_keys, key, "left_anti")
            self.heavy = self._keep(cells.join(self.heavy_keys, key, "left_semi").repartition(parts, key, other))
        # In order of the key, so that no product sorts the cells again.
        self.light = self._keep(light.repartition(parts, key).sortWithinPartitions(key))

    def _keep(self, placed: DataFrame) -> DataFrame:
        self.kept.append(placed.persist(KEPT))
        return placed

    def refuse_repeats(self):
        """Equal cells lie in one partition, so only a maximum per task moves.  A cell that is 0 repeats nothing."""
        for piece in self.kept:
            if (piece.groupBy("row_id", "feature_id").count().agg(F.max("count")).first()[0] or 0) > 1:
                raise ValueError(REPEATED)

    def pieces(self):
        return [self.light] + ([self.heavy] if self.heavy is not None else [])

    def release(self):
        for piece in self.kept:
            piece.unpersist()


class Matrix:
    """One view: placed cells and the column sums and squares."""

    def __init__(self, cells: DataFrame, n: int, width: int, centered: bool, parts: int, n_cells: int):
        self.n, self.width, self.centered, self.parts = n, width, centered, parts
        self.n_cells = n_cells
        self.cells = cells
        self.by_row = Placed(cells, "row_id", parts, n_cells)
        self.by_row.refuse_repeats()
        self.by_feature = None
        self.owned = True
        if width > BROADCAST_ROWS:
            self.by_feature = Placed(cells, "feature_id", parts, n_cells)
        self._columns()

    def _columns(self):
        sums = F.sum("value") if self.centered else F.max(F.lit(0.0))
        cells = None
        for piece in self.by_row.pieces():
            part = piece.select("row_id", "feature_id", "value")
            cells = part if cells is None else cells.unionByName(part)
        # The two fingerprints are equal for columns that are copies of each other.
        self.columns = cut_lineage(cells.groupBy("feature_id").agg(
            sums.alias("colsum"),
            F.sum(F.col("value") * F.col("value")).alias("square"),
            F.bit_xor(F.xxhash64("row_id", "value")).alias("print1"),
            F.bit_xor(F.xxhash64("value", "row_id", F.lit(1))).alias("print2"),
        ))

    def restrict(self, support: DataFrame, rows: int) -> "Matrix":
        """The columns in the support.  A support that can be broadcast filters
        the placed cells where they are."""
        keep = lookup(support.select("feature_id"), rows)
        if rows > BROADCAST_ROWS:
            cells = cut_lineage(self.cells.join(keep, "feature_id", "left_semi"))
            return Matrix(cells, self.n, self.width, self.centered, self.parts, cells.count())
        out = object.__new__(Matrix)
        out.__dict__.update(self.__dict__)
        out.owned = False
        out.width = rows
        out.by_row = object.__new__(Placed)
        out.by_row.__dict__.update(self.by_row.__dict__)
        out.by_row.light = self.by_row.light.join(keep, "feature_id", "left_semi")
        if self.by_row.heavy is not None:
            out.by_row.heavy = self.by_row.heavy.join(keep, "feature_id", "left_semi")
        out.by_feature = None
        out.columns = self.columns.join(keep, "feature_id", "left_semi")
        return out

    def to_subjects(self, panel: DataFrame, names: list[str]) -> DataFrame:
        """``X panel`` before centring: sums per subject of value times entries."""
        sums = [F.sum(F.col("value") * F.col(c)).alias(c) for c in names]
        if self.by_feature is None:
            pieces = [
                p.join(lookup(panel, self.width), "feature_id").groupBy("row_id").agg(*sums)
                for p in self.by_row.pieces()
            ]
            out = pieces[0]
            for p in pieces[1:]:
                out = out.unionByName(p)
            return out
        return self._moved(self.by_feature, panel, "feature_id", "row_id", names)

    def to_features(self, panel: DataFrame, names: list[str], extra: list[DataFrame] = ()) -> DataFrame:
        """``X' panel`` plus correction rows ``extra(feature_id, names)``."""
        return self._moved(self.by_row, panel, "row_id", "feature_id", names, extra)

    @staticmethod
    def _moved(placed, panel, key, out, names, extra=()):
        sums = [F.sum(F.col("value") * F.col(c)).alias(c) for c in names]
        parts = [placed.light.join(panel, key).groupBy(out).agg(*sums)]
        if placed.heavy is not None:
            few = panel.join(placed.heavy_keys, key, "left_semi")
            parts.append(placed.heavy.join(F.broadcast(few), key).groupBy(out).agg(*sums))
        parts += list(extra)
        if len(parts) == 1:
            return parts[0]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return both.groupBy(out).agg(*[F.sum(c).alias(c) for c in names])

    def release(self):
        if self.owned:
            self.by_row.release()
            if self.by_feature is not None:
                self.by_feature.release()


class Side:
    """A view's column sums next to its earlier loadings, for scalar products."""

    def __init__(self, matrix: Matrix, priors: list[tuple[DataFrame, int]]):
        self.matrix, self.priors = matrix, priors
        table = matrix.columns
        for q, (z, rows) in enumerate(priors):
            table = table.join(lookup(z.withColumnRenamed("value", f"z{q}"), rows), "feature_id", "left")
        self.table = table.select(
            "feature_id", "colsum", "square", "print1", "print2",
            *[F.coalesce(f"z{q}", F.lit(0.0)).alias(f"z{q}") for q in range(len(priors))],
        )

    def written(self, vector: DataFrame):
        """The vector written, and its scalars: ``|v|^2``, the mean of ``X v``, ``Z v``, and the number
        of entries.  Their factors are written beside the entries, so the sums need no join."""
        names = [f"z{q}" for q in range(len(self.priors))]
        kept = cut_lineage(
            vector.join(self.table.select("feature_id", "colsum", *names), "feature_id", "left"))
        value = F.col("value")
        row = kept.agg(
            F.coalesce(F.sum(value * value), F.lit(0.0)).alias("square"),
            F.coalesce(F.sum(value * F.col("colsum")), F.lit(0.0)).alias("shift"),
            *[F.coalesce(F.sum(value * F.col(z)), F.lit(0.0)).alias(z) for z in names],
            F.count("*").alias("n"),
        ).first()
        return (kept.select("feature_id", "value"),
                (row["square"], row["shift"] / self.matrix.n, np.array([row[z] for z in names]), row["n"]))

    def unit(self, vector: DataFrame):
        """The normalised vector, its scalars and the norm that it had."""
        kept, (square, shift, dots, count) = self.written(vector)
        norm = float(np.sqrt(square))
        if norm == 0:
            return kept, (0.0, shift, dots, count), norm
        scaled = kept.withColumn("value", F.col("value") / F.lit(norm))
        return scaled, (1.0, shift / norm, dots / norm, count), norm

    def corrections(self, shift: float, weights: np.ndarray) -> list[DataFrame]:
        """Rows for ``- colsum * shift - sum_q weights_q z_q`` on this view's columns."""
        out = []
        if self.matrix.centered and shift:
            out.append(self.matrix.columns.select(
                "feature_id", (F.col("colsum") * F.lit(-float(shift))).alias("c0")))
        for q, w in enumerate(weights):
            if w:
                z = self.priors[q][0].join(self.matrix.columns.select("feature_id"), "feature_id", "left_semi")
                out.append(z.select("feature_id", (F.col("value") * F.lit(-float(w))).alias("c0")))
        return out


def times(source: Side, target: Side, vector: DataFrame, facts, sigma: np.ndarray) -> DataFrame:
    """Deflated ``X_target' X_source v`` for a feature vector ``v`` with known scalars."""
    _, shift, dots, _ = facts
    u = source.matrix.to_subjects(vector.withColumnRenamed("value", "c0"), ["c0"])
    z = target.matrix.to_features(u, ["c0"], target.corrections(shift, sigma * dots))
    return z.select("feature_id", F.col("c0").alias("value"))


# ---------------------------------------------------------------- strongest column

def _dense_sum(pairs) -> Column:
    total = F.lit(0.0)
    for weight, column in pairs:
        total = total + F.lit(float(weight)) * column
    return total


def _gram(panel: DataFrame, names: list[str]) -> np.ndarray:
    w = len(names)
    sums = panel.agg(*[
        F.coalesce(F.sum(F.col(names[a]) * F.col(names[b])), F.lit(0.0)).alias(f"g{a}_{b}")
        for a in range(w) for b in range(a + 1)
    ], *[F.coalesce(F.sum(n), F.lit(0.0)).alias(f"s_{n}") for n in names]).first()
    g = np.array([[sums[f"g{max(a, b)}_{min(a, b)}"] for b in range(w)] for a in range(w)])
    return g, np.array([sums[f"s_{n}"] for n in names])


def _centre_rows(matrix: Matrix, shift: np.ndarray, names: list[str]) -> list[DataFrame]:
    if not matrix.centered:
        return []
    return [matrix.columns.select(
        "feature_id", *[(F.col("colsum") * F.lit(-float(s))).alias(c) for s, c in zip(shift, names)])]


def column_bounds(left: Side, right: Side, sigma: np.ndarray) -> DataFrame:
    """Upper bounds on the column norms of ``X_left' X_right``: ``(feature_id, bound)``.

    For orthonormal probes Q (one round of subspace iteration on the left view)
    a column x splits into ``Q a`` and a rest e, and
    ``|X_l' x| <= |(X_l' Q) a| + |X_l - Q Q' X_l|_F |e|`` holds whatever Q is.
    """
    names = _names(PROBES)
    lm, rm = left.matrix, right.matrix
    n = lm.n
    seeds = [
        (F.pmod(F.xxhash64("feature_id", F.lit(i)), F.lit(2)) * 2 - 1).cast("double").alias(c)
        for i, c in enumerate(names)
    ]
    probe = cut_lineage(lm.to_subjects(lm.columns.select("feature_id", *seeds), names))
    g, total = _gram(probe, names)
    shift = total / n if lm.centered else np.zeros(PROBES)
    g = g - n * np.outer(shift, shift)
    values, vectors = np.linalg.eigh(g)
    keep = values > 1e-6 * max(values.max(), 0.0)
    turn = vectors[:, keep] / np.sqrt(values[keep]) if keep.any() else np.zeros((PROBES, 0))
    q_names = names[:turn.shape[1]]
    a_square = bound_a = F.lit(0.0)
    rest_left = lm.columns.agg(
        F.coalesce(F.sum(F.col("square") - F.col("colsum") * F.col("colsum") / n), F.lit(0.0))
    ).first()[0]
    rest = rest_left
    coefficients = None
    if q_names:
        q = probe.select("row_id", *[
            _dense_sum((turn[v, w], F.col(names[v])) for v in range(PROBES)).alias(c)
            for w, c in enumerate(q_names)])
        q = cut_lineage(q)
        q_shift = shift @ turn
        image = lm.to_features(q, q_names, _centre_rows(lm, q_shift, q_names))
        bb, _ = _gram(image, q_names)
        rest = max(rest_left - float(np.trace(bb)), 0.0)
        coefficients = rm.to_features(q, q_names, _centre_rows(rm, q_shift, q_names))
        cols = [F.coalesce(c, F.lit(0.0)) for c in q_names]
        a_square = _dense_sum((1.0, c * c) for c in cols)
        bound_a = _dense_sum(
            (bb[a, b], cols[a] * cols[b]) for a in range(len(cols)) for b in range(len(cols)))
    table = right.table
    if coefficients is not None:
        table = table.join(coefficients, "feature_id", "left")
    size = F.col("square") - F.col("colsum") * F.col("colsum") / n
    bound = (
        F.sqrt(F.greatest(F.lit(0.0), bound_a))
        + F.lit(float(np.sqrt(rest))) * F.sqrt(F.greatest(F.lit(0.0), size - a_square))
        + F.lit(1e-6 * float(np.sqrt(max(rest_left, 0.0)))) * F.sqrt(F.greatest(F.lit(0.0), size))
    )
    for q, s in enumerate(sigma):
        bound = bound + F.lit(abs(float(s))) * F.abs(F.col(f"z{q}"))
    # Copies of a column have the same norm; the lowest feature stands for them all.
    copies = ["print1", "print2", *[f"z{q}" for q in range(len(right.priors))]]
    return cut_lineage(
        table.withColumn("bound", bound).groupBy(*copies)
        .agg(F.min("feature_id").alias("feature_id"), F.max("bound").alias("bound"))
        .select("feature_id", "bound")
    )


def _columns_of(
    left: Side, right: Side, sigma: np.ndarray, known: dict, slots: int = SLOTS
) -> DataFrame:
    """The columns listed in ``known`` of the deflated product in slots: ``(feature_id, chunk, c0 ..)``."""
    features = list(known)
    spark = right.table.sparkSession
    names = _names(slots)
    listed = spark.createDataFrame(
        [(int(f), i // slots, i % slots) for i, f in enumerate(features)],
        "feature_id bigint, chunk int, slot int",
    )
    picked = F.broadcast(listed)
    spread = [F.sum(F.when(F.col("slot") == s, F.col("value"))).alias(c) for s, c in enumerate(names)]
    panels = None
    for piece in right.matrix.by_row.pieces():
        part = piece.join(picked, "feature_id").groupBy("row_id", "chunk").agg(*spread)
        panels = part if panels is None else panels.unionByName(part)
    sums = [F.sum(F.col("value") * F.col(c)).alias(c) for c in names]
    placed = left.matrix.by_row
    parts = [placed.light.join(panels, "row_id").groupBy("feature_id", "chunk").agg(*sums)]
    if placed.heavy is not None:
        few = panels.join(placed.heavy_keys, "row_id", "left_semi")
        parts.append(placed.heavy.join(F.broadcast(few), "row_id").groupBy("feature_id", "chunk").agg(*sums))
    # Centring and deflation, as rows of the same shape.
    weights = {"colsum": [known[f]["colsum"] / left.matrix.n for f in features]}
    for q, s in enumerate(sigma):
        weights[f"z{q}"] = [float(s) * known[f][f"z{q}"] for f in features]
    n_chunks = (len(features) - 1) // slots + 1
    for column, w in weights.items():
        if not any(w):
            continue
        w = w + [0.0] * (n_chunks * slots - len(w))
        for chunk in range(n_chunks):
            here = w[chunk * slots:(chunk + 1) * slots]
            if any(here):
                parts.append(left.table.filter(F.col(column) != 0).select(
                    "feature_id", F.lit(chunk).alias("chunk"),
                    *[(F.col(column) * F.lit(-float(x))).alias(c) for x, c in zip(here, names)]))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("feature_id", "chunk").agg(*[F.sum(c).alias(c) for c in names])


def _norms(left: Side, right: Side, sigma: np.ndarray, known: dict) -> dict[int, float]:
    names, features = _names(SLOTS), list(known)
    rows = _columns_of(left, right, sigma, known).groupBy("chunk").agg(
        *[F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)).alias(c) for c in names]
    ).collect()
    out = {f: 0.0 for f in features}
    for r in rows:
        for s, c in enumerate(names):
            i = r["chunk"] * SLOTS + s
            if i < len(features):
                out[features[i]] = float(np.sqrt(r[c]))
    return out


def _better(top: float, best: int | None, norms: dict[int, float]) -> tuple[float, int | None]:
    """Running maximum; ties up to rounding go to the lowest feature."""
    for feature, norm in norms.items():
        if best is None or norm * (1 - TIE) > top:
            top, best = norm, feature
        elif norm >= top * (1 - TIE):
            top, best = max(top, norm), min(best, feature)
    return top, best


def strongest_column(left: Side, right: Side, sigma: np.ndarray, batch: int = 4 * SLOTS, direct: int = DIRECT):
    """``(norm, feature_id, column, evaluated)`` of the largest column, or None if all are 0.

    Batches grow while bounds fail to settle the search; in the worst case all
    columns are evaluated, so the answer is always the exact maximum.
    """
    top, best, evaluated = 0.0, None, 0
    if right.matrix.width <= direct:
        known = {r["feature_id"]: r for r in sorted(right.table.collect())}
        if known:
            top, best = _better(top, best, _norms(left, right, sigma, known))
            evaluated = len(known)
    else:
        bounds, cursor, known = column_bounds(left, right, sigma), None, {}
        while True:
            rest = bounds.filter(F.col("bound") >= top * (1 - TIE))
            if cursor is not None:
                rest = rest.filter(
                    (F.col("bound") < cursor[0])
                    | ((F.col("bound") == cursor[0]) & (F.col("feature_id") > cursor[1])))
            rows = rest.orderBy(F.desc("bound"), "feature_id").limit(batch).collect()
            if not rows:
                break
            listed = right.table.sparkSession.createDataFrame([(r["feature_id"],) for r in rows], "feature_id bigint")
            scalars = {r["feature_id"]: r for r in right.table.join(F.broadcast(listed), "feature_id").collect()}
            batch_known = {r["feature_id"]: scalars[r["feature_id"]] for r in rows}
            before = best
            top, best = _better(top, best, _norms(left, right, sigma, batch_known))
            if best != before:
                known = {best: batch_known[best]}
            cursor = (rows[-1]["bound"], rows[-1]["feature_id"])
            evaluated += len(rows)
            if len(rows) < batch:
                break
            batch = min(batch * 4, 64 * SLOTS)
    if top == 0:
        return None
    column = _columns_of(left, right, sigma, {best: known[best]}, 1).select(
        "feature_id", F.col("c0").alias("value")).filter(F.coalesce("value", F.lit(0.0)) != 0)
    return top, best, column, evaluated


# ---------------------------------------------------------------- fitting

def _power_pair(left: Side, right: Side, sigma: np.ndarray, rho: float, opts: FitOptions):
    found = strongest_column(left, right, sigma)
    if found is None:
        return None
    top, _, column, _ = found
    x, facts, _ = left.unit(column)
    bound = rho * top
    course = Progress(opts)
    while not course.reason:
        raw = times(left, right, x, facts, sigma)
        z, z_facts = right.written(
            raw.withColumn("value", soft_threshold(F.col("value"), bound)).filter(F.col("value") != 0))
        x, facts, _ = left.unit(times(right, left, z, z_facts, sigma))
        course.step(z_facts[0])
    return cut_lineage(times(left, right, x, facts, sigma)), bound, course


def solve(matrices: list[Matrix], opts: FitOptions):
    d = len(matrices)
    priors: list[list[tuple[DataFrame, int]]] = [[] for _ in range(d)]
    sigmas: list[dict] = []
    courses: dict = {}
    saved = []
    spark = matrices[0].columns.sparkSession
    empty = spark.createDataFrame([], "feature_id bigint, value double")

    def sigma_row(i, j, comps):
        return np.array([sigmas[q][max(i, j), min(i, j)] for q in comps])

    for k in range(opts.k):
        comps = list(range(k))
        sides = [Side(m, p) for m, p in zip(matrices, priors)]
        starts: list = [None] * d
        small: list = [None] * d
        for i in range(d):
            terms, bound = None, 0.0
            for j in others(i, d):
                if j < i and small[j] is None:
                    warn_zero(k, j)
                    continue
                left = small[j] if j < i else sides[j]
                pair = _power_pair(left, sides[i], sigma_row(i, j, comps), opts.rhos[i], opts)
                if pair is None:
                    warn_zero(k, i)
                    continue
                terms = pair[0] if terms is None else terms.unionByName(pair[0])
                bound = max(bound, pair[1])
                courses[k, i, j] = pair[2]
            if terms is None:
                continue
            total = terms.groupBy("feature_id").agg(F.sum("value").alias("value"))
            z, facts, norm = sides[i].unit(
                total.withColumn("value", soft_threshold(F.col("value"), bound)).filter(F.col("value") != 0))
            if norm == 0:
                continue
            starts[i] = (z, facts)
            small[i] = Side(matrices[i].restrict(z, facts[3]), priors[i])

        removed = deflated_by(k, opts.full_deflation)

        def weights(i, j):
            w = np.zeros(k)
            w[removed] = sigma_row(i, j, removed)
            return w

        final: list = [None] * d
        for i in range(d):
            if starts[i] is None:
                continue
            me = small[i]
            fixed = None
            for j in range(i):
                if final[j] is not None:
                    part = times(small[j], me, final[j][0], final[j][1], weights(i, j))
                    fixed = part if fixed is None else fixed.unionByName(part)
            if fixed is not None:
                fixed = cut_lineage(fixed.groupBy("feature_id").agg(F.sum("value").alias("value")))
            z, facts = starts[i]
            course = Progress(opts)
            while not course.reason:
                t = fixed
                for j in range(i + 1, d):
                    if small[j] is None:
                        continue
                    v, v_facts = small[j].written(times(me, small[j], z, facts, weights(i, j)))
                    part = times(small[j], me, v, v_facts, weights(i, j))
                    t = part if t is None else t.unionByName(part)
                t = empty if t is None else t.groupBy("feature_id").agg(F.sum("value").alias("value"))
                z, facts, norm = me.unit(t)
                course.step(-2.0 * norm)
            final[i] = (z, facts)

        lower = {}
        for i in range(d):
            for j in range(i):
                value = 0.0
                if final[i] is not None and final[j] is not None:
                    image = times(small[j], small[i], final[j][0], final[j][1], weights(i, j))
                    value = (
                        image.withColumnRenamed("value", "_a").join(final[i][0], "feature_id")
                        .agg(F.coalesce(F.sum(F.col("_a") * F.col("value")), F.lit(0.0))).first()[0])
                lower[i, j] = value
        sigmas.append(lower)
        for side in small:
            if side is not None:
                side.matrix.release()
        for i in range(d):
            if final[i] is None:
                priors[i].append((empty, 0))
                continue
            z = final[i][0].filter(F.col("value") != 0)
            saved.append((k, i, z, final[i][1][1]))
            priors[i].append((z, final[i][1][3]))
    return saved, sigmas, courses


def fit(cells: DataFrame, n: int, widths: list[int], opts: FitOptions) -> FitResult:
    spark = cells.sparkSession
    cells = cells.persist(KEPT)
    counts = {r["view_idx"]: r["n"] for r in
              cells.groupBy("view_idx").agg(F.count("*").alias("n")).collect()}
    # The same for all views, whose subjects then lie together.
    parts = task_parts(spark, max(counts.values(), default=0))
    matrices = []
    try:
        for i, w in enumerate(widths):
            one = cells.filter((F.col("view_idx") == i) & (F.col("value") != 0)).select(
                "row_id", "feature_id", "value")
            matrices.append(Matrix(one, n, w, opts.centered, parts, counts.get(i, 0)))
        saved, sigmas, courses = solve(matrices, opts)
    finally:
        for m in matrices:
            m.release()
        cells.unpersist()
    loadings = spark.createDataFrame([], LOADINGS)
    for k, i, z, _ in saved:
        loadings = loadings.unionByName(
            z.select(F.lit(k).alias("component"), F.lit(i).alias("view_idx"), "feature_id",
                     F.col("value").alias("loading")))
    sigma = [row for k, s in enumerate(sigmas) for row in symmetric(k, len(widths), s)]
    return FitResult(loadings, sigma, [(k, i, m) for k, i, _, m in saved], list(widths), courses)
