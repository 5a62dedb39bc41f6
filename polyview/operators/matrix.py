"""Matrix operators on cell and vector tables.

Cells are ``(view_idx, row_id, feature_id, value)``, vectors are
``(feature_id, value)`` or ``(row_id, value)``.  Operators that look values up
in a feature- or subject-sized table take the known bound on its rows
(``rows=``); without one, adaptive execution picks the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.functions.scalar import safe_divide, soft_threshold
from polyview.operators.panels import panel, panel_product, slots, unpanel
from polyview.session import lookup

__all__ = [
    "center_columns", "column_means", "column_power_sums", "combine_pairs",
    "cross_covariance", "deflate_covariance", "deflated_matvec", "get_column",
    "get_columns", "l2_normalize", "left_multiply", "matvec", "matvec_t",
    "max_l2_column", "power_loss", "restrict_support", "scale_entries", "soft_threshold_vector",
    "standardize_columns", "standardize_scalar", "subtract_outer", "support",
]

# Norms within this relative distance are ties; the lowest feature wins.
TIE = 1e-11


def column_means(cells: DataFrame, n_subjects: int | None = None) -> DataFrame:
    """Mean of each column.  With ``n_subjects``, absent cells count as zeros."""
    mean = F.avg("value") if n_subjects is None else F.sum("value") / F.lit(float(n_subjects))
    return cells.groupBy("view_idx", "feature_id").agg(mean.alias("center"))


def center_columns(
    cells: DataFrame, rows: int | None = None, n_subjects: int | None = None
) -> DataFrame:
    """Subtract column means.  Expects every cell present (see ``fill_missing``).

    Means are partial-aggregated and looked up rather than computed over a
    window, so the cells are not shuffled by feature: few wide-open columns do
    not limit the parallelism.
    """
    means = column_means(cells, n_subjects)
    return cells.join(lookup(means, rows), ["view_idx", "feature_id"]).select(
        "view_idx", "row_id", "feature_id", (F.col("value") - F.col("center")).alias("value")
    )


def standardize_columns(cells: DataFrame, stats: DataFrame, rows: int | None = None) -> DataFrame:
    """``(value - center) / scale`` with ``stats(view_idx, feature_id, center, scale)``."""
    return cells.join(lookup(stats, rows), ["view_idx", "feature_id"]).select(
        "view_idx", "row_id", "feature_id",
        ((F.col("value") - F.col("center")) / F.col("scale")).alias("value"),
    )


def standardize_scalar(cells: DataFrame, center: float = 0.0, scale: float = 1.0) -> DataFrame:
    return cells.withColumn("value", (F.col("value") - F.lit(float(center))) / F.lit(float(scale)))


def scale_entries(cells: DataFrame, norm: float) -> DataFrame:
    """Divide every entry by one number."""
    return cells.withColumn("value", F.col("value") / F.lit(float(norm)))


def soft_threshold_vector(vector: DataFrame, bound: Column | float) -> DataFrame:
    return vector.withColumn("value", soft_threshold(F.col("value"), bound))


def get_column(cells: DataFrame, feature_id: int, norm: float = 1.0) -> DataFrame:
    """One column divided by ``norm``, renumbered 0."""
    return cells.filter(F.col("feature_id") == feature_id).select(
        "view_idx", "row_id", F.lit(0).cast("bigint").alias("feature_id"),
        (F.col("value") / F.lit(float(norm))).alias("value"),
    )


def get_columns(cells: DataFrame, feature_ids: Sequence[int], norm: float = 1.0) -> DataFrame:
    """The listed columns in the listed order; repeats are allowed."""
    chosen = cells.sparkSession.createDataFrame(
        [(int(f), i) for i, f in enumerate(feature_ids)], "feature_id bigint, new_id bigint"
    )
    return cells.join(lookup(chosen, len(feature_ids)), "feature_id").select(
        "view_idx", "row_id", F.col("new_id").alias("feature_id"),
        (F.col("value") / F.lit(float(norm))).alias("value"),
    )


def restrict_support(
    cells: DataFrame, support_ids: DataFrame, on: str | Sequence[str] = "feature_id",
    rows: int | None = None, allow_empty: bool = False,
) -> DataFrame:
    """Keep only the entries whose key is in the support; an empty one is an error unless allowed."""
    if not allow_empty and support_ids.isEmpty():
        raise ValueError("the support must not be empty")
    keys = [on] if isinstance(on, str) else list(on)
    return cells.join(lookup(support_ids.select(*keys), rows), keys, "left_semi")


def l2_normalize(vector: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Divide by the L2 norm, overall or per ``by`` group; zero vectors stay."""
    square = F.sqrt(F.sum(F.col("value") * F.col("value")))
    if by:
        norms = vector.groupBy(*by).agg(square.alias("nrm"))
        scaled = vector.join(norms, list(by))
    else:
        scaled = vector.withColumn("nrm", vector.agg(square.alias("nrm")).scalar())
    return scaled.select(
        *[c for c in vector.columns if c != "value"],
        safe_divide(F.col("value"), F.col("nrm"), F.col("value")).alias("value"),
    )


def support(vector: DataFrame, value: str = "value") -> DataFrame:
    """The keys of the non-zero entries."""
    return vector.filter(F.col(value) != 0).drop(value)


def left_multiply(matrix: DataFrame, cells: DataFrame, width: int = 32) -> DataFrame:
    """``M @ X``: ``matrix(out_row, row_id, value)`` times one view's cells.

    M is packed into panels by subject, so a cell of X meets one row per
    ``width`` rows of M.
    """
    panels = panel(matrix, "row_id", "out_row", width)
    product = panel_product(cells, panels, "row_id", "feature_id", width)
    return unpanel(product, "feature_id", "out_row", width).select("out_row", "feature_id", "value")


# The key of a row that no subject has.
NOBODY = -(1 << 63)


def cross_covariance(left: DataFrame, right: DataFrame, width: int = 32, subjects: int | None = None) -> DataFrame:
    """``X_left' X_right`` (not divided by n): ``(left_feature, right_feature, value)``.

    Absent cells count as 0.  With ``subjects``, how many there are, columns are centred without
    filling anything in: the product of the stored cells less n times the means' product, which
    is one more row of either operand, made of the column sums.  Every pair of features that have
    cells then gets a value.
    """
    def panels_of(cells):
        return panel(cells.select("row_id", F.col("feature_id").alias("right_feature"), "value"),
                     "row_id", "right_feature", width)

    def product_of(cells, panels):
        return panel_product(cells.withColumnRenamed("feature_id", "left_feature"), panels,
                             "row_id", "left_feature", width)

    product = product_of(left, panels_of(right))
    if subjects is not None:
        # Beside the cells, not among them: those stay where they are placed.
        def sums(cells, by):
            return cells.groupBy("feature_id").agg((F.sum("value") * F.lit(by)).alias("value")).withColumn(
                "row_id", F.lit(NOBODY).cast("bigint"))

        product = product.unionByName(
            product_of(sums(left, -1.0 / subjects), F.broadcast(panels_of(sums(right, 1.0))))
        ).groupBy("left_feature", "chunk").agg(*[F.sum(c).alias(c) for c in slots(width)])
    return unpanel(product, "left_feature", "right_feature", width)


def matvec(cells: DataFrame, vector: DataFrame, rows: int | None = None) -> DataFrame:
    """``X z``: cells of one view with ``vector(feature_id, value)`` to ``(row_id, value)``."""
    z = vector.select("feature_id", F.col("value").alias("_z"))
    return cells.join(lookup(z, rows), "feature_id").groupBy("row_id").agg(
        F.sum(F.col("value") * F.col("_z")).alias("value")
    )


def matvec_t(cells: DataFrame, vector: DataFrame, rows: int | None = None) -> DataFrame:
    """``X' u``: cells of one view with ``vector(row_id, value)`` to ``(feature_id, value)``."""
    u = vector.select("row_id", F.col("value").alias("_u"))
    return cells.join(lookup(u, rows), "row_id").groupBy("feature_id").agg(
        F.sum(F.col("value") * F.col("_u")).alias("value")
    )


def deflated_matvec(
    left: DataFrame, right: DataFrame, x: DataFrame,
    left_loadings: DataFrame, right_loadings: DataFrame, sigma: DataFrame,
    rows: int | None = None,
) -> DataFrame:
    """``X_r' (X_l x) - sum_c sigma_c z_r^c (z_l^c . x)`` as ``(feature_id, value)``.

    ``*_loadings(component, feature_id, loading)``, ``sigma(component, sigma)``.
    The correction stays a low-rank sum; no features-by-features table forms.
    """
    main = matvec_t(right, matvec(left, x, rows))
    weight = (
        left_loadings.join(x, "feature_id")
        .groupBy("component").agg(F.sum(F.col("loading") * F.col("value")).alias("dot"))
        .join(sigma, "component")
        .select("component", (F.col("sigma") * F.col("dot")).alias("w"))
    )
    # One row per component.
    correction = right_loadings.join(F.broadcast(weight), "component").select(
        "feature_id", (-F.col("loading") * F.col("w")).alias("value")
    )
    return main.unionByName(correction).groupBy("feature_id").agg(F.sum("value").alias("value"))


def subtract_outer(
    cells: DataFrame, left: DataFrame, right: DataFrame,
    left_rows: int | None = None, right_rows: int | None = None,
) -> DataFrame:
    """``X - left right'`` with ``left(row_id, value)`` and ``right(feature_id, value)``.

    Returns a new table; expects every cell present.
    """
    lv = left.select("row_id", F.col("value").alias("_l"))
    rv = right.select("feature_id", F.col("value").alias("_r"))
    outer = F.coalesce(F.col("_l") * F.col("_r"), F.lit(0.0))
    return (
        cells.join(lookup(rv, right_rows), "feature_id", "left")
        .join(lookup(lv, left_rows), "row_id", "left")
        .withColumn("value", F.col("value") - outer)
        .select(*cells.columns)
    )


def deflate_covariance(
    cov: DataFrame, left_loading: DataFrame, right_loading: DataFrame, sigma: Column | float,
    left_rows: int | None = None, right_rows: int | None = None,
) -> DataFrame:
    """``C - sigma z_l z_r'`` on ``cov(left_feature, right_feature, value)``."""
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    lv = left_loading.select(F.col("feature_id").alias("left_feature"), F.col("value").alias("_l"))
    rv = right_loading.select(F.col("feature_id").alias("right_feature"), F.col("value").alias("_r"))
    outer = F.coalesce(s * F.col("_l") * F.col("_r"), F.lit(0.0))
    return (
        cov.join(lookup(lv, left_rows), "left_feature", "left")
        .join(lookup(rv, right_rows), "right_feature", "left")
        .select("left_feature", "right_feature", (F.col("value") - outer).alias("value"))
    )


def column_power_sums(cells: DataFrame, power: float = 1) -> DataFrame:
    """Per column, the sum of ``value ** power``."""
    term = F.col("value") if power == 1 else F.pow(F.col("value"), F.lit(float(power)))
    return cells.groupBy("view_idx", "feature_id").agg(F.sum(term).alias("total"))


def max_l2_column(cells: DataFrame, rows_support: DataFrame | None = None) -> DataFrame:
    """The column of greatest L2 norm: ``(norm, feature_id, row_id, value)``.

    ``rows_support(row_id)`` restricts the rows.  Ties, up to rounding of the
    sums, go to the lowest feature.
    """
    if rows_support is not None:
        cells = restrict_support(cells, rows_support, "row_id")
    norms = cells.groupBy("feature_id").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    )
    top = norms.agg(F.max("norm")).scalar()
    best = (
        norms.filter(F.col("norm") >= top * (1 - TIE))
        .orderBy("feature_id").limit(1)
    )
    return cells.join(F.broadcast(best), "feature_id").select(
        "norm", "feature_id", "row_id", "value"
    )


def combine_pairs(terms: DataFrame, bounds: DataFrame, rows: int | None = 1000) -> DataFrame:
    """Sum per-pair vectors and take the largest per-pair threshold.

    ``terms(view_idx, other_idx, feature_id, value)``,
    ``bounds(view_idx, other_idx, bound)`` to ``(view_idx, feature_id, value, bound)``.
    """
    total = terms.groupBy("view_idx", "feature_id").agg(F.sum("value").alias("value"))
    top = bounds.groupBy("view_idx").agg(F.max("bound").alias("bound"))
    return total.join(lookup(top, rows), "view_idx").select(
        "view_idx", "feature_id", "value", "bound"
    )


def power_loss(vector: DataFrame) -> DataFrame:
    """The loss of one power step: the squared norm of the thresholded vector."""
    return vector.agg(F.sum(F.col("value") * F.col("value")).alias("loss"))
