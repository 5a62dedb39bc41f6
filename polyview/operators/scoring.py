"""Scores, canonical correlations, covariances and predictions from loadings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.functions.scalar import safe_corr
from polyview.session import BROADCAST_ROWS, lookup

__all__ = [
    "canonical_correlations", "center_scores", "center_table", "long_scores", "mean_correlation",
    "other_view_score_sum", "other_view_sums", "predict_cells", "prediction_weights", "project",
    "score_table", "scores_wide", "sigma_pairs",
]


def project(cells: DataFrame, loadings: DataFrame, rows: int | None = None) -> DataFrame:
    """Scores ``X z``: ``(view_idx, row_id, component, score)``.

    The sparse loadings drop most cells before the shuffle; subjects without a
    cell in the support have no row (see :func:`score_table`).
    """
    return (
        cells.join(lookup(loadings, rows), ["view_idx", "feature_id"])
        .groupBy("view_idx", "row_id", "component")
        .agg(F.sum(F.col("value") * F.col("loading")).alias("score"))
    )


def score_table(
    cells: DataFrame, loadings: DataFrame, n_views: int, components: int,
    subjects: DataFrame | None = None, rows: int | None = None,
) -> DataFrame:
    """All scores of a subject in one row: ``(row_id, s0_0, s0_1, ..)`` (view, component).

    Every subject that has cells, or is listed in ``subjects(row_id)`` if that is given, gets a
    row.  Loadings with a known small bound are broadcast, so one pass sums up map-side and only
    a row per subject moves.  Beyond it, cells outside the support are dropped in the join.
    """
    sums = [
        F.coalesce(
            F.sum(F.when((F.col("view_idx") == i) & (F.col("component") == q),
                         F.col("value") * F.col("loading"))),
            F.lit(0.0),
        ).alias(f"s{i}_{q}")
        for i in range(n_views) for q in range(components)
    ]
    keys = ["view_idx", "feature_id"]
    if subjects is None and rows is not None and rows <= BROADCAST_ROWS:
        return cells.join(F.broadcast(loadings), keys, "left").groupBy("row_id").agg(*sums)
    out = cells.join(lookup(loadings, rows), keys).groupBy("row_id").agg(*sums)
    names = [c for c in out.columns if c != "row_id"]
    ids = cells.select("row_id").distinct() if subjects is None else subjects.select("row_id")
    return ids.join(out, "row_id", "left").na.fill(0.0, names)


def center_table(table: DataFrame) -> DataFrame:
    """Subtract the mean of every score column of :func:`score_table`."""
    names = [c for c in table.columns if c != "row_id"]
    means = table.agg(F.struct(*[F.avg(c).alias(c) for c in names]).alias("m")).scalar()
    return table.withColumn("_m", means).select(
        "row_id", *[(F.col(c) - F.col("_m")[c]).alias(c) for c in names])


def long_scores(table: DataFrame, n_views: int, components: int) -> DataFrame:
    """``score_table`` in long form: ``(view_idx, row_id, component, score)``."""
    items = F.array(*[
        F.struct(F.lit(i).cast("int").alias("view_idx"), F.lit(q).cast("int").alias("component"),
                 F.col(f"s{i}_{q}").alias("score"))
        for i in range(n_views) for q in range(components)])
    return table.select("row_id", F.inline(items)).select("view_idx", "row_id", "component", "score")


def other_view_sums(table: DataFrame, n_views: int, components: int, only: int | None = None) -> DataFrame:
    """Sums over the other views from one row per subject, without a shuffle.

    Returns ``(view_idx, row_id, s)`` with ``s`` an array of (component, score).
    """
    def sums(i):
        return F.array(*[
            F.struct(
                F.lit(q).cast("int").alias("component"),
                sum((F.col(f"s{j}_{q}") for j in range(n_views) if j != i), F.lit(0.0)).alias("score"))
            for q in range(components)])

    views = range(n_views) if only is None else [only]
    items = F.array(*[
        F.struct(F.lit(i).cast("int").alias("view_idx"), sums(i).alias("s")) for i in views])
    return table.select("row_id", F.inline(items)).select("view_idx", "row_id", "s")


def center_scores(scores: DataFrame) -> DataFrame:
    """Subtract each view's mean score per component.

    Centring the columns first and projecting afterwards gives the same
    numbers, but needs a feature-sized table of means; this needs one number
    per view and component.
    """
    means = scores.groupBy("view_idx", "component").agg(F.avg("score").alias("_m"))
    return scores.join(F.broadcast(means), ["view_idx", "component"]).select(
        "view_idx", "row_id", "component", (F.col("score") - F.col("_m")).alias("score")
    )


def scores_wide(scores: DataFrame, n_views: int) -> DataFrame:
    """One row per (subject, component) with a column per view: ``s0, s1, ...``."""
    return scores.groupBy("row_id", "component").agg(
        *[
            F.coalesce(F.max(F.when(F.col("view_idx") == i, F.col("score"))), F.lit(0.0)).alias(f"s{i}")
            for i in range(n_views)
        ]
    )


def _pairs_table(wide: DataFrame, measures, diagonal, name: str, n_views: int) -> DataFrame:
    per_component = wide.groupBy("component").agg(
        *[m.alias(f"m{i}_{j}") for (i, j), m in measures.items()]
    )
    entries = []
    for i in range(n_views):
        for j in range(n_views):
            value = F.lit(diagonal) if i == j else F.col(f"m{max(i, j)}_{min(i, j)}")
            entries.append(
                F.struct(
                    F.lit(i).cast("int").alias("view_i"), F.lit(j).cast("int").alias("view_j"),
                    value.cast("double").alias(name),
                )
            )
    return per_component.select("component", F.inline(F.array(*entries)))


def canonical_correlations(scores: DataFrame, n_views: int) -> DataFrame:
    """Correlation of the scores of every two views, per component.

    All pairs come out of one aggregation over one row per subject and
    component; the diagonal is 1 and undefined correlations are 0.
    """
    wide = scores_wide(scores, n_views)
    measures = {
        (i, j): safe_corr(F.col(f"s{i}"), F.col(f"s{j}"))
        for i in range(n_views) for j in range(i)
    }
    return _pairs_table(wide, measures, 1.0, "corr", n_views)


def sigma_pairs(
    scores: DataFrame, n_views: int,
    loadings: DataFrame | None = None, previous: DataFrame | None = None,
    previous_sigma: DataFrame | None = None,
) -> DataFrame:
    """``z_i' X_i' X_j z_j`` per component and pair, symmetric with zero diagonal.

    With ``previous(view_idx, feature_id, loading)`` and
    ``previous_sigma(view_i, view_j, sigma)`` the cross-covariance is first
    reduced by that component.
    """
    wide = scores_wide(scores, n_views)
    measures = {
        (i, j): F.sum(F.col(f"s{i}") * F.col(f"s{j}"))
        for i in range(n_views) for j in range(i)
    }
    plain = _pairs_table(wide, measures, 0.0, "sigma", n_views)
    if previous is None:
        return plain
    overlap = (
        loadings.join(previous.withColumnRenamed("loading", "_p"), ["view_idx", "feature_id"])
        .groupBy("component", "view_idx")
        .agg(F.sum(F.col("loading") * F.col("_p")).alias("dot"))
    )
    di = overlap.select("component", F.col("view_idx").alias("view_i"), F.col("dot").alias("dot_i"))
    dj = overlap.select("component", F.col("view_idx").alias("view_j"), F.col("dot").alias("dot_j"))
    prev = previous_sigma.withColumnRenamed("sigma", "_s")
    return (
        plain.join(prev, ["view_i", "view_j"], "left")
        .join(di, ["component", "view_i"], "left")
        .join(dj, ["component", "view_j"], "left")
        .select(
            "component", "view_i", "view_j",
            (F.col("sigma") - F.coalesce(F.col("_s") * F.col("dot_i") * F.col("dot_j"), F.lit(0.0)))
            .alias("sigma"),
        )
    )


def other_view_score_sum(scores: DataFrame, n_views: int) -> DataFrame:
    """For each view, the sum of the other views' scores per subject and component."""
    wide = scores_wide(scores, n_views)
    total = F.lit(0.0)
    for i in range(n_views):
        total = total + F.col(f"s{i}")
    return wide.select(
        "row_id", "component",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("int").alias("view_idx"),
                        (total - F.col(f"s{i}")).alias("score"),
                    )
                    for i in range(n_views)
                ]
            )
        ),
    ).select("view_idx", "row_id", "component", "score")


def inverse_grams(loadings: DataFrame) -> list[tuple[int, int, int, float]]:
    """Pseudo-inverses of the component-by-component matrices ``Z Z'``, per view.

    Spark sums the products over features; what reaches the driver is one
    number per view and pair of components.
    """
    of_feature = loadings.groupBy("view_idx", "feature_id").agg(
        F.collect_list(F.struct("component", "loading")).alias("z"))
    products = of_feature.select("view_idx", "z", F.explode("z").alias("a")).select("view_idx", "a", F.explode("z").alias("b"))
    grams: dict[int, dict[tuple[int, int], float]] = {}
    for r in (
        products.groupBy("view_idx", F.col("a.component").alias("component"), F.col("b.component").alias("c2"))
        .agg(F.sum(F.col("a.loading") * F.col("b.loading")).alias("g"))
        .collect()
    ):
        grams.setdefault(r["view_idx"], {})[r["component"], r["c2"]] = r["g"]
    out = []
    for view, entries in grams.items():
        comps = sorted({a for a, _ in entries})
        g = np.array([[entries.get((a, b), 0.0) for b in comps] for a in comps])
        inv = np.linalg.pinv(g, hermitian=True)
        out += [
            (view, a, b, float(inv[i, j]))
            for i, a in enumerate(comps) for j, b in enumerate(comps)
        ]
    return out


def prediction_weights(loadings: DataFrame) -> DataFrame:
    """``pinv(Z)'`` per view: ``(view_idx, component, feature_id, weight)``.

    Uses ``pinv(Z)' = pinv(Z Z') Z``, so only the small inverse is local.
    """
    inverse = loadings.sparkSession.createDataFrame(
        inverse_grams(loadings), "view_idx int, component int, c2 int, inv double"
    )
    z = loadings.withColumnRenamed("component", "c2")
    return (
        z.join(F.broadcast(inverse), ["view_idx", "c2"])
        .groupBy("view_idx", "component", "feature_id")
        .agg(F.sum(F.col("inv") * F.col("loading")).alias("weight"))
    )


def _all_features(spark, widths: Sequence[int]) -> DataFrame:
    views = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("view_idx"),
                F.sequence(F.lit(0).cast("bigint"), F.lit(w - 1).cast("bigint")).alias("ids"),
            )
            for i, w in enumerate(widths)
        ]
    )
    return spark.range(1).select(F.inline(views)).select("view_idx", F.explode("ids").alias("feature_id"))


def subject_blocks(spark, widths: Sequence[int], chunk: int) -> int:
    """So many blocks of subjects that (chunk, block) pairs are four per shuffle partition at least."""
    chunks = sum(-(-w // chunk) for w in widths)
    return max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // chunks))


def predict_cells(
    sums: DataFrame, weights: DataFrame, widths: Sequence[int],
    dense: bool = True, rows: int | None = None, chunk: int = 1024,
) -> DataFrame:
    """``(sum of other scores) pinv(Z)'``: ``(view_idx, row_id, feature_id, prediction)``.

    ``sums`` comes from :func:`other_view_sums` or :func:`other_view_score_sum`,
    ``widths`` holds the features per view.  Features outside every support are predicted 0; with
    ``dense=False`` they are left out.

    Weights with a known small bound are broadcast.  Otherwise it is a blocked product:
    weights are packed into chunks of features and subjects dealt into blocks; a subject's
    row is sent once per chunk and a chunk once per block, so a task's share is one block
    against one chunk, however few chunks or views there are.
    """
    per_feature = weights.groupBy("view_idx", "feature_id").agg(
        F.map_from_entries(F.collect_list(F.struct("component", "weight"))).alias("w")
    )
    if dense:
        per_feature = _all_features(sums.sparkSession, widths).join(
            per_feature, ["view_idx", "feature_id"], "left"
        )
        rows = sum(widths)
    by_subject = sums
    if "s" not in sums.columns:
        by_subject = sums.groupBy("view_idx", "row_id").agg(
            F.collect_list(F.struct("component", "score")).alias("s")
        )
    if rows is not None and rows <= BROADCAST_ROWS:
        joined = by_subject.join(F.broadcast(per_feature), "view_idx")
    else:
        packed = (
            per_feature.withColumn("chunk", F.floor(F.col("feature_id") / chunk))
            .groupBy("view_idx", "chunk")
            .agg(F.collect_list(F.struct("feature_id", "w")).alias("features"))
        )
        chunks = F.lit(0)
        for i, w in enumerate(widths):
            chunks = F.when(F.col("view_idx") == i, F.lit((w - 1) // chunk)).otherwise(chunks)
        blocks = subject_blocks(sums.sparkSession, widths, chunk)
        sent = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        joined = (
            by_subject.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")).withColumn(
                "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks.cast("bigint"))))
            .join(sent, ["view_idx", "chunk", "block"])
            .select("view_idx", "row_id", "s", F.inline("features"))
        )
    term = F.aggregate(
        "s", F.lit(0.0),
        lambda acc, e: acc
        + e["score"] * F.coalesce(F.try_element_at(F.col("w"), e["component"]), F.lit(0.0)),
    )
    return joined.select(
        "view_idx", "row_id", "feature_id",
        F.when(F.col("w").isNull(), F.lit(0.0)).otherwise(term).alias("prediction"),
    )


def mean_correlation(actual: DataFrame, predictions: DataFrame, n_features: int) -> DataFrame:
    """Mean over all features of corr(prediction, actual), constants counting 0.

    ``predictions`` may list the support only: a feature that is missing there
    has a constant prediction, adds 0 to the sum and still counts in the mean.
    """
    per_feature = (
        actual.join(predictions, ["view_idx", "row_id", "feature_id"])
        .groupBy("feature_id")
        .agg(safe_corr(F.col("prediction"), F.col("value")).alias("corr"))
    )
    return per_feature.agg(
        (F.coalesce(F.sum("corr"), F.lit(0.0)) / F.lit(float(n_features))).alias("metric")
    )
