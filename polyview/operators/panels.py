"""Column panels: several matrix columns side by side in one row.

A product of two long-form matrices joins on the shared index.  Joining cell to
cell would emit every pair of cells with the same index; a panel packs
``width`` columns of one operand into one row, so each cell of the other
operand meets ``1/width`` as many rows and the sums stay in primitive
aggregation buffers with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


def panel(df: DataFrame, inner: str, column: str, width: int = 32) -> DataFrame:
    """``(inner, column, value)`` to ``(inner, chunk, c0 .. c{width-1})``; absent is null."""
    slot = F.col(column) % width
    return df.groupBy(inner, F.floor(F.col(column) / width).alias("chunk")).agg(
        *[F.sum(F.when(slot == i, F.col("value"))).alias(c) for i, c in enumerate(slots(width))]
    )


def panel_product(
    cells: DataFrame, panels: DataFrame, inner: str, out: str, width: int = 32
) -> DataFrame:
    """``sum over inner of value * c_i`` per ``(out, chunk)``."""
    return (
        cells.select(inner, out, "value")
        .join(panels, inner)
        .groupBy(out, "chunk")
        .agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in slots(width)])
    )


def unpanel(df: DataFrame, out: str, column: str, width: int = 32) -> DataFrame:
    """Back to long form; slots that no row contributed to are dropped."""
    items: Column = F.array(*[F.col(c) for c in slots(width)])
    return (
        df.select(out, "chunk", F.posexplode(items).alias("slot", "value"))
        .filter(F.col("value").isNotNull())
        .select(out, (F.col("chunk") * width + F.col("slot")).cast("bigint").alias(column), "value")
    )
