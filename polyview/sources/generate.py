"""Low-rank test data: every view is an outer product of one subject factor
with that view's weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weight_pattern(feature_id: Column, width: int, share: float) -> Column:
    """+1 on the first half of the non-zero features, -1 on the second, then 0."""
    half = round(share * width / 2)
    return (
        F.when(feature_id < half, F.lit(1.0))
        .when(feature_id < 2 * half, F.lit(-1.0))
        .otherwise(F.lit(0.0))
    )


def _gauss(*keys: Column) -> Column:
    """Standard normal draw that depends only on its keys (Box-Muller on 52 bits of their MD5, as SQL can repeat it)."""
    def uniform(salt: int) -> Column:
        text = F.concat_ws(",", *[k.cast("string") for k in keys], F.lit(str(salt)))
        bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
        return (bits + F.lit(0.5)) / F.lit(float(1 << 52))

    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * F.pi() * uniform(2))


def low_rank_cells(
    subjects: DataFrame,
    widths: Sequence[int],
    shares: Sequence[float] = (0.1,),
    eps: float = 0.1,
    seed: int = 1,
    factor: Column | None = None,
) -> DataFrame:
    """Cells of ``u w'`` for each view, over the given ``subjects(row_id)``.

    ``eps`` is the standard deviation of the noise on the weights, ``shares``
    the share of non-zero weights (one, or one per view).  Draws are keyed by
    subject and feature, so the result does not depend on partitioning.
    """
    shares = list(shares) * len(widths) if len(shares) == 1 else list(shares)
    u = factor if factor is not None else _gauss(F.lit(seed), F.lit(-1), F.col("row_id"))
    views = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("view_idx"),
                F.sequence(F.lit(0).cast("bigint"), F.lit(w - 1).cast("bigint")).alias("ids"),
            )
            for i, w in enumerate(widths)
        ]
    )
    grid = subjects.select("row_id", u.alias("u"), F.inline(views)).select(
        "view_idx", "row_id", "u", F.explode("ids").alias("feature_id")
    )
    weight = F.lit(0.0)
    for i, (w, share) in enumerate(zip(widths, shares)):
        weight = F.when(
            F.col("view_idx") == i, weight_pattern(F.col("feature_id"), w, share)
        ).otherwise(weight)
    if eps:
        weight = weight + eps * _gauss(F.lit(seed), F.col("view_idx"), F.col("feature_id"))
    return grid.select("view_idx", "row_id", "feature_id", (F.col("u") * weight).alias("value"))
