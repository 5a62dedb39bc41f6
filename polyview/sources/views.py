"""Loaders that turn tables into view cells, and reshapes of view cells.

A *view* is a numeric matrix whose rows are subjects.  Its interchange form is
``cells(view_idx INT, row_id BIGINT, feature_id BIGINT, value DOUBLE)``; a cell
that is absent counts as 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyview.session import cut_lineage, lookup

CELL_COLUMNS = ["view_idx", "row_id", "feature_id", "value"]


def _bad(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def cells_from_arrays(
    df: DataFrame, row_col: str, views: Sequence[str | Column], how: str = "error"
) -> DataFrame:
    """One array column (or array expression) per view, read in a single scan.

    ``how`` decides about null or NaN entries: ``"error"`` fails the query,
    ``"drop"`` leaves the subject out of every view.
    """
    if how not in ("error", "drop"):
        raise ValueError("how must be 'error' or 'drop'")
    arrays = [(F.col(v) if isinstance(v, str) else v).cast("array<double>") for v in views]
    wide = df.select(
        F.col(row_col).cast("bigint").alias("row_id"),
        *[a.alias(f"a{i}") for i, a in enumerate(arrays)],
    )
    names = [f"a{i}" for i in range(len(arrays))]
    if how == "drop":
        clean = F.lit(True)
        for c in names:
            clean = clean & F.col(c).isNotNull() & ~F.exists(c, _bad)
        wide = wide.filter(clean)
        checked = {c: F.col(c) for c in names}
    else:
        # Checked per array: a null array has no cell that could fail later.
        checked = {
            c: F.when(F.col(c).isNull() | F.exists(c, _bad),
                      F.raise_error(F.lit("null, NaN or infinite entry in a view"))).otherwise(F.col(c))
            for c in names}
    stacked = F.array(
        *[F.struct(F.lit(i).alias("view_idx"), checked[c].alias("vals")) for i, c in enumerate(names)]
    )
    return (
        wide.select("row_id", F.inline(stacked))
        .select("view_idx", "row_id", F.posexplode("vals").alias("feature_id", "value"))
        .withColumn("feature_id", F.col("feature_id").cast("bigint"))
    )


def cells_from_columns(
    df: DataFrame, row_col: str, views: Sequence[Sequence[str]], how: str = "error"
) -> DataFrame:
    """Wide tables: each view is a list of numeric columns."""
    arrays = [F.array(*[F.col(c).cast("double") for c in cols]) for cols in views]
    return cells_from_arrays(df, row_col, arrays, how)


def cells_from_facts(
    facts: DataFrame,
    row_col: str,
    attribute: str,
    value: Column,
    view_idx: int,
    features: DataFrame,
    feature_rows: int | None = None,
) -> DataFrame:
    """Sum a fact table per (subject, attribute); the long form of a pivot.

    ``features(feature_id, name)`` numbers the attribute values.  The sum is
    taken per attribute first, so rows shrink before the feature lookup.
    """
    sums = facts.groupBy(
        F.col(row_col).cast("bigint").alias("row_id"), F.col(attribute).alias("name")
    ).agg(F.sum(value).cast("double").alias("value"))
    return sums.join(lookup(features, feature_rows), "name").select(
        F.lit(view_idx).cast("int").alias("view_idx"),
        "row_id",
        F.col("feature_id").cast("bigint").alias("feature_id"),
        "value",
    )


def dense_index(
    df: DataFrame, keys: Sequence[str], name: str,
    rows: int | None = None, single_task_rows: int = 100_000,
) -> DataFrame:
    """Add ``name``: the 0-based rank of each row by its (unique) ``keys``.

    Small inputs use one ordered window.  Larger ones are range-partitioned and
    written once, then each range's position is shifted by the sizes of the
    ranges before it, so no task sees more than one range.  ``rows`` passes a
    known count.
    """
    keys = list(keys)
    if (df.count() if rows is None else rows) <= single_task_rows:
        return df.withColumn(
            name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("bigint")
        )
    ranged = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    part = F.shiftright("_pos", 33)
    sizes = sorted(
        (r["part"], r["n"])
        for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    )
    offsets, start = [], 0
    for number, size in sizes:
        offsets.append((number, start))
        start += size
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _start bigint")
    return (
        ranged.withColumn("_part", part.cast("bigint"))
        .join(lookup(table, len(offsets)), "_part")
        .withColumn(name, F.col("_start") + (F.col("_pos") - F.shiftleft("_part", 33)))
        .drop("_pos", "_part", "_start")
    )


def checked_subjects(subjects: DataFrame) -> DataFrame:
    """``row_id`` of the subjects; a null or repeated key raises."""
    ids = subjects.select(F.col("row_id").cast("bigint").alias("row_id"))
    found = ids.groupBy("row_id").count().agg(
        F.max("count").alias("most"), F.max(F.col("row_id").isNull()).alias("null")).first()
    if found["null"]:
        raise ValueError("a subject has a null key")
    if (found["most"] or 0) > 1:
        raise ValueError("a subject's key is repeated")
    return ids


NULL_KEY, OUTSIDE, BAD_VALUE, REPEATED = CELL_FAULTS = (
    "a cell has a null key", "a cell is outside the views", "a cell is null, NaN or infinite", "a cell is repeated")


def checked_cells(cells: DataFrame, subjects: DataFrame | None, widths: Sequence[int]) -> DataFrame:
    """The cells of the given subjects; a faulty one fails the query that reads it.

    Null keys, views or features out of range and null, NaN or infinite values are found by a filter,
    without a pass of its own; repeated cells where the plans bring a subject's cells together.
    """
    typed = cells.select(
        F.col("view_idx").cast("int").alias("view_idx"), F.col("row_id").cast("bigint").alias("row_id"),
        F.col("feature_id").cast("bigint").alias("feature_id"), F.col("value").cast("double").alias("value"))
    if subjects is not None:
        typed = typed.join(subjects.select("row_id"), "row_id", "left_semi").select(*CELL_COLUMNS)
    width = F.get(F.lit([int(w) for w in widths]), F.when(F.col("view_idx") >= 0, F.col("view_idx")))
    null = F.col("view_idx").isNull() | F.col("row_id").isNull() | F.col("feature_id").isNull()
    outside = ~F.coalesce((F.col("feature_id") >= 0) & (F.col("feature_id") < width), F.lit(False))
    fault = F.when(null, F.lit(NULL_KEY)).when(outside, F.lit(OUTSIDE)).when(_bad(F.col("value")), F.lit(BAD_VALUE))
    return typed.filter(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))


def match_subjects(cells: DataFrame, n_views: int) -> DataFrame:
    """Keep the subjects that occur in every view; views are matched by key."""
    inside = cells.filter(F.col("view_idx").between(0, n_views - 1))
    names = [f"seen{i}" for i in range(n_views)]
    seen = inside.groupBy("row_id").agg(*[F.max(F.col("view_idx") == i).alias(c) for i, c in enumerate(names)])
    everywhere = seen.filter(reduce(and_, map(F.col, names))).select("row_id")
    return cells.join(everywhere, "row_id", "left_semi").select(*CELL_COLUMNS)


def fill_missing(cells: DataFrame, subjects: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Every (subject, feature) cell of every view, absent ones as 0."""
    views = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("view_idx"),
                F.sequence(F.lit(0).cast("bigint"), F.lit(w - 1).cast("bigint")).alias("ids"),
            )
            for i, w in enumerate(widths)
        ]
    )
    grid = subjects.select("row_id", F.inline(views)).select(
        "view_idx", "row_id", F.explode("ids").alias("feature_id")
    )
    return grid.join(cells, ["view_idx", "row_id", "feature_id"], "left").select(
        "view_idx", "row_id", "feature_id", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def _scatter(batches):
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        pos, val = batch.column("pos"), batch.column("val")
        counts = pos.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0)
        target = np.repeat(ends - sizes, counts) + pos.flatten().to_numpy()
        taken = np.zeros(len(flat), bool)
        taken[target] = True
        if np.count_nonzero(taken) < len(target):
            raise ValueError(REPEATED)
        flat[target] = val.flatten().to_numpy()
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        keep = [n for n in batch.schema.names if n not in ("pos", "val", "size")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in keep] + [pa.ListArray.from_arrays(offsets, pa.array(flat))],
            names=[*keep, "vec"],
        )


def _dense_chunks(cells, key, chunk, pos, size):
    lists = (
        cells.groupBy("view_idx", key, chunk.cast("bigint").alias("chunk"))
        .agg(F.collect_list(F.struct(pos.cast("int").alias("pos"), "value")).alias("items"))
        .withColumn("size", size)
        .select("view_idx", key, "chunk", F.col("items.pos").alias("pos"),
                F.col("items.value").alias("val"), "size")
    )
    return lists.mapInArrow(
        _scatter, f"view_idx int, {key} bigint, chunk bigint, vec array<double>"
    )


def feature_vectors(
    cells: DataFrame, subjects: DataFrame, n_subjects: int, chunk_rows: int = 4096
) -> DataFrame:
    """Feature-major form: ``(view_idx, feature_id, chunk, vec)``.

    ``subjects(row_id, row_idx)`` gives positions.  A vector is cut into chunks
    of ``chunk_rows`` positions, so no group holds more than one chunk whatever
    the number of subjects; absent cells are 0.
    """
    placed = cells.join(lookup(subjects, n_subjects), "row_id")
    start = F.col("chunk") * chunk_rows
    return _dense_chunks(
        placed, "feature_id",
        F.floor(F.col("row_idx") / chunk_rows), F.col("row_idx") % chunk_rows,
        F.least(F.lit(chunk_rows), F.lit(n_subjects) - start).cast("int"),
    )


def _transpose(n_subjects: int, width: int):
    """One (view, chunk) group: subject slices in, one vector per feature out."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = table.column("row_idx").to_numpy()
        slices = table.column("vals").combine_chunks()
        size = len(slices[0])
        if not (slices.value_lengths().to_numpy(zero_copy_only=False) == size).all():
            raise ValueError("every subject needs arrays of the same length per view")
        x = np.zeros((n_subjects, size))
        x[order] = slices.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        view, chunk = table.column("view_idx")[0].as_py(), table.column("chunk")[0].as_py()
        offsets = pa.array(np.arange(0, (size + 1) * n_subjects, n_subjects), pa.int32())
        return pa.table({
            "view_idx": pa.array(np.full(size, view), pa.int32()),
            "feature_id": pa.array(chunk * width + np.arange(size), pa.int64()),
            "vec": pa.ListArray.from_arrays(offsets, pa.array(x.T.ravel())),
        })

    return run


def feature_vectors_from_arrays(
    df: DataFrame, row_col: str, views: Sequence[Column], subjects: DataFrame, n_subjects: int,
    chunk_cols: int = 1024,
) -> DataFrame:
    """Feature-major form ``(view_idx, feature_id, vec)`` straight from array columns.

    For few subjects and wide arrays: subjects travel in slices of
    ``chunk_cols`` features, so the shuffle carries little more than the
    numbers, and a group holds ``n_subjects * chunk_cols`` of them.
    """
    def checked(v):
        empty = F.raise_error(F.lit("missing or empty array in a view"))
        return F.when(v.isNull() | (F.size(v) == 0), empty).otherwise(v.cast("array<double>"))

    stacked = F.array(*[
        F.struct(F.lit(i).cast("int").alias("view_idx"), checked(v).alias("a"))
        for i, v in enumerate(views)])
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("a") - 1) / chunk_cols).cast("int")),
        lambda c: F.slice("a", c * chunk_cols + 1, F.lit(chunk_cols)))
    return (
        df.select(F.col(row_col).cast("bigint").alias("row_id"), F.inline(stacked))
        .join(lookup(subjects, n_subjects), "row_id")
        .select("view_idx", F.col("row_idx").cast("int").alias("row_idx"),
                F.posexplode(pieces).alias("chunk", "vals"))
        .groupBy("view_idx", "chunk")
        .applyInArrow(_transpose(n_subjects, chunk_cols),
                      "view_idx int, feature_id bigint, vec array<double>")
    )


def matrix_rows(cells: DataFrame, n_features: int, chunk_cols: int = 4096) -> DataFrame:
    """Row-major form: ``(view_idx, row_id, chunk, vec)`` with features in order."""
    start = F.col("chunk") * chunk_cols
    return _dense_chunks(
        cells, "row_id",
        F.floor(F.col("feature_id") / chunk_cols), F.col("feature_id") % chunk_cols,
        F.least(F.lit(chunk_cols), F.lit(n_features) - start).cast("int"),
    )


def ordered_cells(cells: DataFrame) -> DataFrame:
    """The matrix in reading order; a distributed range sort."""
    return cells.orderBy("view_idx", "row_id", "feature_id")


def vector_table(source: SparkSession | DataFrame, values: Sequence[float] | Column) -> DataFrame:
    """A vector as ``(feature_id, value)``, from a local list or an array column."""
    if isinstance(source, SparkSession):
        return source.createDataFrame(
            [(i, float(v)) for i, v in enumerate(values)], "feature_id bigint, value double"
        )
    return source.select(F.posexplode(values).alias("feature_id", "value")).select(
        F.col("feature_id").cast("bigint").alias("feature_id"),
        F.col("value").cast("double").alias("value"),
    )
