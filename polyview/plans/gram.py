"""Fitting plan for few subjects and any number of features.

Views are kept feature-major, one row per feature with its subject vector.
Every step is one pass over a view's features that adds up subject-sized
vectors; between passes the driver keeps subject-by-subject matrices only,
whose size is checked before this plan is chosen.  No table or vector with a
feature index ever reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.plans.common import (
    LOADINGS, FitOptions, FitResult, Progress, add_partials, deflated_by, others, symmetric, warn_zero,
)
from polyview.session import BROADCAST_ROWS, cut_lineage, lookup, scan_tasks
from polyview.sources.views import feature_vectors

TIE = 1e-11


def _matrix(batch, name="vec", centered=False):
    x = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    if not np.isfinite(x).all():
        raise ValueError("null, NaN or infinite entry in a view")
    return x - x.mean(axis=1, keepdims=True) if centered else x


def _record(**columns):
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _floats(rows):
    return pa.array(rows, pa.list_(pa.float64()))


def _moments_pass(centered):
    """Per task: lines of ``A'A``, ``A'P`` and ``P'P`` for features A (by subject)
    and their columns P: earlier loadings and, last, a start value."""

    def run(batches):
        g = u = m = None
        for batch in filter(len, batches):
            x = _matrix(batch, centered=centered)
            p = _matrix(batch, "extra")
            gg, uu, mm = x.T @ x, p.T @ x, p.T @ p
            g, u, m = (gg, uu, mm) if g is None else (g + gg, u + uu, m + mm)
        if g is not None:
            # The Gram matrix is symmetric: its lower triangle is enough.
            lines = [("g", i, r[:i + 1]) for i, r in enumerate(g)]
            lines += [("u", i, r) for i, r in enumerate(u)]
            lines += [("m", i, r) for i, r in enumerate(m)]
            yield _record(
                part=pa.array([a for a, _, _ in lines]),
                line=pa.array([b for _, b, _ in lines], pa.int32()),
                sums=_floats([c for _, _, c in lines]),
            )

    return run


def _best_pass(centered, state, n_prior):
    """Per task and other view: the feature with the greatest deflated norm."""

    def run(batches):
        shared, best = state.value, {}
        for batch in filter(len, batches):
            x = _matrix(batch, centered=centered)
            z = _matrix(batch, "extra")[:, :n_prior]
            ids = batch.column("feature_id").to_numpy()
            for j, s in shared.items():
                b = z * s["sigma"]
                sq = np.einsum("fi,fi->f", x @ s["g"], x)
                sq += np.einsum("fk,fk->f", b @ s["m"] - 2.0 * (x @ s["u"].T), b)
                norm = np.sqrt(np.maximum(sq, 0.0))
                near = norm >= norm.max() * (1 - TIE)
                found = (float(norm.max()), int(ids[near].min()))
                if j in best:
                    top = max(found[0], best[j][0])
                    tied = [f for f in (found, best[j]) if f[0] >= top * (1 - TIE)]
                    found = (top, min(f[1] for f in tied))
                best[j] = found
        if best:
            yield _record(
                other=pa.array(list(best), pa.int32()),
                norm=pa.array([v[0] for v in best.values()], pa.float64()),
                feature_id=pa.array([v[1] for v in best.values()], pa.int64()),
            )

    return run


def _step_pass(centered, state, n_prior):
    """Per task and running pair: sums of ``z_f x_f``, ``z_f Z_f`` and ``z_f^2``."""

    def run(batches):
        shared, sums = state.value, {}
        for batch in filter(len, batches):
            x = _matrix(batch, centered=centered)
            prior = _matrix(batch, "extra")[:, :n_prior]
            for j, (y, a, r) in shared.items():
                z = x @ y - prior @ a
                z = np.sign(z) * np.maximum(0.0, np.abs(z) - r)
                part = np.concatenate([z @ x, z @ prior, [z @ z]])
                sums[j] = part if j not in sums else sums[j] + part
        if sums:
            yield _record(
                other=pa.array(list(sums), pa.int32()), sums=_floats(list(sums.values()))
            )

    return run


def _combine_pass(centered, pairs, n_prior, bound):
    """Per feature: the summed pair vectors, thresholded once; zeros are dropped."""

    def run(batches):
        y = np.sum([p[0] for p in pairs.value], axis=0)
        a = np.sum([p[1] for p in pairs.value], axis=0)
        for batch in filter(len, batches):
            z = _matrix(batch, centered=centered) @ y - _matrix(batch, "extra")[:, :n_prior] @ a
            z = np.sign(z) * np.maximum(0.0, np.abs(z) - bound)
            yield _kept(batch, z)

    return run


def _readout_pass(centered, y, c, removed, scale):
    def run(batches):
        for batch in filter(len, batches):
            prior = _matrix(batch, "extra")[:, removed]
            raw = _matrix(batch)
            center = raw.mean(axis=1)
            x = raw - center[:, None] if centered else raw
            yield _kept(batch, (x @ y + prior @ c) * scale, center=center)

    return run


def _kept(batch, z, **more):
    keep = np.flatnonzero(z)
    return _record(
        feature_id=batch.column("feature_id").take(pa.array(keep)),
        value=pa.array(z[keep], pa.float64()),
        **{name: pa.array(v[keep], pa.float64()) for name, v in more.items()},
    )


class _View:
    """One view's features with an ``extra`` array: a loading per earlier
    component, then one slot for the start value of the current refit."""

    def __init__(self, vectors: DataFrame, index: int, n: int, centered: bool):
        self.base = vectors.filter(F.col("view_idx") == index).select("feature_id", "vec")
        self.index, self.n, self.centered = index, n, centered
        self.components: list[tuple[DataFrame, int]] = []
        self.features = self._with_extra()

    def _with_extra(self) -> DataFrame:
        out, names = self.base, []
        for q, (z, rows) in enumerate(self.components):
            names.append(F.coalesce(F.col(f"z{q}"), F.lit(0.0)))
            side = lookup(z.withColumnRenamed("value", f"z{q}"), rows)
            out = out.join(side, "feature_id", "left")
        return out.select("feature_id", "vec", F.array(*names, F.lit(0.0)).alias("extra"))

    def add(self, loading: DataFrame, rows: int) -> None:
        """Attach a finished loading.  Small ones are looked up in every pass;
        a large one is joined once and the joined features are kept."""
        before = self.features
        self.components.append((loading, rows))
        self.features = self._with_extra()
        if rows > BROADCAST_ROWS:
            self.features.persist()
        before.unpersist()

    def on_support(self, start: DataFrame, rows: int) -> DataFrame:
        """Features in ``start(feature_id, value)``, its value in the last slot."""
        k = len(self.components)
        return self.features.join(lookup(start, rows), "feature_id").select(
            "feature_id", "vec",
            F.concat(F.slice("extra", 1, k), F.array("value")).alias("extra"),
        )

    def moments(self, features: DataFrame) -> dict:
        k = len(self.components)
        partials = scan_tasks(features, 4 * self.n ** 2).mapInArrow(
            _moments_pass(self.centered), "part string, line int, sums array<double>")
        got = add_partials(partials, "part", "line")
        n = self.n

        def stack(part, count, width):
            return np.array([got.get((part, i), np.zeros(width)) for i in range(count)]).reshape(count, width)

        u, m, g = stack("u", k + 1, n), stack("m", k + 1, k + 1), np.zeros((n, n))
        for i in range(n):
            g[i, :i + 1] = g[:i + 1, i] = got.get(("g", i), 0.0)
        return {
            "g": g,
            "u": u[:k], "m": m[:k, :k], "start": u[k], "overlap": m[:k, k],
        }


def solve(views: list[_View], n: int, opts: FitOptions) -> tuple[list, list, dict]:
    d = len(views)
    spark = views[0].base.sparkSession
    sc = spark.sparkContext
    sigmas: list[dict] = []
    courses: dict = {}
    full: dict[int, np.ndarray] = {}
    # Per view: score vectors of the finished loadings and their inner products.
    scored = [np.zeros((0, n)) for _ in views]
    inner = [np.zeros((0, 0)) for _ in views]
    saved: list[tuple[int, int, DataFrame]] = []

    def sigma_row(i, j, comps):
        return np.array([sigmas[q][max(i, j), min(i, j)] for q in comps])

    def best_columns(i, state, k):
        shared = sc.broadcast(state)
        rows = scan_tasks(views[i].features).mapInArrow(
            _best_pass(views[i].centered, shared, k), "other int, norm double, feature_id bigint"
        ).collect()
        tops = {}
        for j in state:
            mine = [r for r in rows if r["other"] == j]
            top = max(r["norm"] for r in mine)
            tied = [r["feature_id"] for r in mine if r["norm"] >= top * (1 - TIE)]
            tops[j] = min(tied)
        chosen = {
            r["feature_id"]: r
            for r in views[i].features.filter(F.col("feature_id").isin(sorted(set(tops.values())))).collect()
        }
        shared.unpersist()
        return {j: chosen[f] for j, f in tops.items()}

    for k in range(opts.k):
        comps = list(range(k))
        starts: list[tuple[DataFrame, int] | None] = []
        restricted: list[dict | None] = []
        for i in range(d):
            # What the power steps need to know about each other view.
            state = {}
            for j in others(i, d):
                if j < i:
                    if starts[j] is None:
                        warn_zero(k, j)
                        continue
                    known = restricted[j]
                else:
                    if j not in full:
                        full[j] = views[j].moments(views[j].features)["g"]
                    known = {"g": full[j], "u": scored[j], "m": inner[j]}
                state[j] = {"g": known["g"], "u": known["u"], "m": known["m"],
                            "sigma": sigma_row(i, j, comps)}
            pairs = _power_pairs(views[i], state, best_columns(i, state, k) if state else {},
                                 opts.rhos[i], k, opts)
            for j, (_, _, _, course) in pairs.items():
                courses[k, i, j] = course
            starts.append(None)
            restricted.append(None)
            if not pairs:
                warn_zero(k, i)
                continue
            bound = max(p[2] for p in pairs.values())
            shared = sc.broadcast([(p[0], p[1]) for p in pairs.values()])
            raw = cut_lineage(
                views[i].features.mapInArrow(
                    _combine_pass(views[i].centered, shared, k, bound), "feature_id bigint, value double"
                )
            )
            size, square = raw.agg(F.count("*"), F.sum(F.col("value") * F.col("value"))).first()
            if size:
                start = raw.select("feature_id", (F.col("value") / F.lit(float(np.sqrt(square)))).alias("value"))
                starts[i] = (start, size)
                restricted[i] = views[i].moments(views[i].on_support(start, size))

        removed = deflated_by(k, opts.full_deflation)
        scores, dots, outs = _refit(restricted, sigma_row, removed, n, k, opts)
        overlaps = [o[removed] for o in dots]
        lower = {}
        for i in range(d):
            for j in range(i):
                value = float(scores[i] @ scores[j])
                value -= float(np.sum(sigma_row(i, j, removed) * overlaps[i] * overlaps[j]))
                lower[i, j] = value
        for i in range(d):
            scored[i] = np.vstack([scored[i], scores[i]])
            corner = np.array([[0.0 if starts[i] is None else 1.0]])
            inner[i] = np.block([[inner[i], dots[i][:, None]], [dots[i][None, :], corner]])
            if starts[i] is None:
                empty = spark.createDataFrame([], "feature_id bigint, value double")
                views[i].add(empty, 0)
                continue
            y, c, scale = outs[i]
            loading = cut_lineage(
                views[i].on_support(*starts[i]).mapInArrow(
                    _readout_pass(views[i].centered, y, c, removed, scale),
                    "feature_id bigint, value double, center double",
                )
            )
            saved.append((k, i, loading))
            views[i].add(loading.select("feature_id", "value"), starts[i][1])
        sigmas.append(lower)
    return saved, sigmas, courses


def _power_pairs(view, state, tops, rho, k, opts):
    """Power iterations of one view against all the others, one pass per step
    for every pair that is still running."""
    sc = view.base.sparkSession.sparkContext
    run, done = {}, {}
    for j, row in tops.items():
        s = state[j]
        u = np.array(row["vec"])
        u = u - u.mean() if view.centered else u
        w = s["sigma"] * np.array(row["extra"][:k])
        y, a, norm = _advance(s, u, w)
        if norm > 0:
            run[j] = {"y": y / norm, "a": a / norm, "r": rho * norm, "course": Progress(opts)}
    while run:
        shared = sc.broadcast({j: (p["y"], p["a"], p["r"]) for j, p in run.items()})
        partials = scan_tasks(view.features).mapInArrow(
            _step_pass(view.centered, shared, k), "other int, sums array<double>")
        found = add_partials(partials, "other")
        shared.unpersist()
        for (j,), sums in found.items():
            p, s = run[j], state[j]
            u, w = sums[:view.n], s["sigma"] * sums[view.n:-1]
            y, a, norm = _advance(s, u, w)
            norm = norm if norm > 0 else 1.0
            p["y"], p["a"] = y / norm, a / norm
            p["course"].step(float(sums[-1]))
            if p["course"].reason:
                done[j] = (p["y"], p["a"], p["r"], p["course"])
                del run[j]
    return done


def _advance(s, u, w):
    """From ``u = X_i z`` and ``w``: the next subject vector, its low-rank part
    and the norm by which both are to be divided."""
    y = s["g"] @ u - w @ s["u"]
    a = s["sigma"] * (s["u"] @ u - s["m"] @ w)
    square = u @ s["g"] @ u - 2.0 * (w @ (s["u"] @ u)) + w @ s["m"] @ w
    return y, a, float(np.sqrt(max(square, 0.0)))


def _refit(restricted, sigma_row, removed, n, k, opts):
    """Refit each view on its support in subject space.

    A loading on the support has the form ``(X' y + Z' c) * scale``, so its
    score vector and its overlap with earlier loadings follow from the
    restricted Gram matrices alone.  Returns the scores, the overlaps with all
    earlier loadings, and ``(y, c, scale)`` per view.
    """
    d = len(restricted)
    scores = [np.zeros(n) for _ in range(d)]
    overlaps = [np.zeros(k) for _ in range(d)]
    outs: list = [None] * d
    for i in range(d):
        mine = restricted[i]
        if mine is None:
            continue
        u_i, m_i = mine["u"][removed], mine["m"][:, removed]
        g, e = mine["start"], mine["overlap"]
        course = Progress(opts)
        while not course.reason:
            y, c = np.zeros(n), np.zeros(len(removed))
            for j in others(i, d):
                his = restricted[j]
                if his is None:
                    continue
                s = sigma_row(i, j, removed)
                if j < i:
                    y += scores[j]
                    c -= s * overlaps[j][removed]
                else:
                    u_j, m_j = his["u"][removed], his["m"][np.ix_(removed, removed)]
                    f = s * e[removed]
                    y += his["g"] @ g - f @ u_j
                    c -= s * (u_j @ g - m_j @ f)
            gy = mine["g"] @ y
            square = y @ gy + 2.0 * (c @ (u_i @ y)) + c @ m_i[removed] @ c
            norm = float(np.sqrt(max(square, 0.0)))
            scale = 1.0 / norm if norm > 0 else 1.0
            g, e = (gy + c @ u_i) * scale, (mine["u"] @ y + m_i @ c) * scale
            outs[i] = (y, c, scale)
            course.step(-2.0 * norm)
        scores[i], overlaps[i] = g, e
    return scores, overlaps, outs


def vectors_of_cells(cells: DataFrame, subjects: DataFrame, n: int) -> DataFrame:
    """Feature vectors from ``cells`` and ``subjects(row_id, row_idx)``."""
    return feature_vectors(cells, subjects, n, chunk_rows=n).select("view_idx", "feature_id", "vec")


def fit(vectors: DataFrame, n: int, widths: list[int], opts: FitOptions) -> FitResult:
    """``vectors(view_idx, feature_id, vec)`` of all views over ``n`` subjects."""
    vectors = vectors.persist()
    views = []
    try:
        views += [_View(vectors, i, n, opts.centered) for i in range(len(widths))]
        saved, sigmas, courses = solve(views, n, opts)
        spark = vectors.sparkSession
        loadings = spark.createDataFrame([], LOADINGS)
        for k, i, z in saved:
            loadings = loadings.unionByName(
                z.select(F.lit(k).alias("component"), F.lit(i).alias("view_idx"), "feature_id",
                         F.col("value").alias("loading"))
            )
        means = [
            (k, i, z.agg(F.coalesce(F.sum(F.col("value") * F.col("center")), F.lit(0.0))).first()[0])
            for k, i, z in saved]
    finally:
        for view in views:
            view.features.unpersist()
        vectors.unpersist()
    sigma = [row for k, s in enumerate(sigmas) for row in symmetric(k, len(widths), s)]
    return FitResult(loadings, sigma, means, list(widths), courses)
