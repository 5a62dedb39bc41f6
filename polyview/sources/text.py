"""Whitespace-separated matrix files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyview.session import cut_lineage, lookup


def read_matrix_text(
    spark: SparkSession, path: str, view_idx: int = 0, row_id_first: bool = False
) -> DataFrame:
    """Read a headerless matrix as cells.

    With ``row_id_first`` the first token of each line is the subject key and
    the read is a plain map.  Otherwise lines are numbered from 0 in file order,
    by path, split and position; blank lines do not count, an empty input has no cells.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ).filter(F.col("line") != "")
    tokens = F.split("line", r"\s+")
    if row_id_first:
        rows = lines.select(tokens.alias("tokens")).select(
            F.col("tokens")[0].cast("bigint").alias("row_id"),
            F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("tokens"),
        )
    else:
        rows = _numbered(lines).select("row_id", tokens.alias("tokens"))
    return rows.select(
        F.lit(view_idx).cast("int").alias("view_idx"),
        "row_id",
        F.posexplode(F.col("tokens").cast("array<double>")).alias("feature_id", "value"),
    ).withColumn("feature_id", F.col("feature_id").cast("bigint"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds ``row_id`` to ``(line, file, block)`` by counts of the splits alone; no line is sorted or moved.

    A task reads the lines of a split one after another, so a line's number is its place
    behind the first of its split plus the lines of all splits before.  The lines are written
    once: how files are dealt to tasks may differ from one scan to the next.  One row a split
    goes through one task, as many as the driver lists to plan the scan.
    """
    written = cut_lineage(lines.withColumn("place", F.monotonically_increasing_id()))
    splits = written.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut_lineage(splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    return written.join(lookup(splits.drop("n"), splits.count()), ["file", "block"]).withColumn(
        "row_id", F.col("before") + F.col("place") - F.col("first"))
