"""Splits for model selection; the search itself is Spark's ``CrossValidator``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_column(key: str | Column, folds: int, seed: int = 0, hashed: bool = True) -> Column:
    """Fold number per subject key, for ``CrossValidator(foldCol=...)``.

    A subject keeps its fold whatever the partitioning or the order of rows.
    ``hashed=False`` spreads integer keys by a multiplication instead.
    """
    key = F.col(key) if isinstance(key, str) else key
    mixed = F.xxhash64(key, F.lit(seed)) if hashed else key.cast("bigint") * 7919 + seed
    return F.pmod(mixed, F.lit(folds)).cast("int")


def kth_key(keys: DataFrame, key: str, k: int, buckets: int = 4096) -> int | None:
    """The key of rank ``k``, from 0, among integer keys; None if there are no more than k.

    Each pass counts the keys of equal ranges and goes on in the one that holds the rank; six passes
    over the keys alone settle any 64-bit range.
    """
    ends = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if ends[2] <= k:
        return None
    low, high = int(ends[0]), int(ends[1])
    while low < high:
        width = (high - low) // buckets + 1
        place = F.expr(f"(CAST(`{key}` AS DECIMAL(20, 0)) - {low}) div {width}")
        counts = keys.filter(F.col(key).between(low, high)).groupBy(place.alias("place")).agg(
            F.count(F.lit(1)).alias("n")).orderBy("place").collect()
        for row in counts:
            if k < row["n"]:
                break
            k -= row["n"]
        low = low + row["place"] * width
        high = min(high, low + width - 1)
    return low


def holdout_split(df: DataFrame, key: str, cut: int) -> tuple[DataFrame, DataFrame]:
    """The first ``cut`` subjects in key order, and the rest; two filters, nothing is ranked or written."""
    first = kth_key(df.select(key), key, cut)
    if first is None:
        return df, df.limit(0)
    return df.filter(F.col(key) < first), df.filter(F.col(key) >= first)
