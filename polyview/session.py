"""Session helpers: lineage cuts in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table is broadcast only when its row count is known to be at most this.
BROADCAST_ROWS = 1_000_000

# Rows of a large table that one task is given, so that its memory and spill do not grow with the input.
TASK_ROWS = 1_000_000

# What the partial matrices of one pass may add up to before tasks are made fewer.
PARTIAL_BYTES = 32 << 30


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names in ``spark.checkpoint.dir``.

    Only a local master may go without: its tasks share the driver's temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="polyview-"))
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup(table: DataFrame, rows: int | None) -> DataFrame:
    """Mark ``table`` for broadcast if its known row bound allows it.

    With no known bound the join is left to adaptive execution, which measures
    the side at run time.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return F.broadcast(table)
    return table


def scan_tasks(df: DataFrame, partial_bytes: int = 0) -> DataFrame:
    """Bound the number of tasks that each emit one partial aggregate.

    ``coalesce`` adds no shuffle: every task reads several input splits in
    turn, so partial aggregates number a few per core instead of one per split.
    When one partial takes ``partial_bytes``, large ones lower the number to
    one per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = 3 * cores
    if partial_bytes:
        tasks = max(cores, min(tasks, PARTIAL_BYTES // partial_bytes))
    return df.coalesce(max(1, tasks))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores.

    Meant for scans that feed heavy row-wise work.  Such an input is small (a
    few splits), so the shuffle is too; larger inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def task_parts(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Shuffle partitions for ``rows``: the session's number, more where a task would get over ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def sized(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` where the session's shuffle partitions are too few for its rows.

    Otherwise ``df`` is left to adaptive execution.
    """
    parts = task_parts(df.sparkSession, rows)
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if parts > few else df
