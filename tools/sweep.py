"""Fit time against the number of features, on generated low-rank views.

    python tools/sweep.py 1000 10000 100000
"""

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from polyview import MultiViewCCA  # noqa: E402
from polyview.sources import low_rank_cells  # noqa: E402


def main():
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    subjects = spark.range(100).select(F.col("id").alias("row_id"))

    def fit(widths, rhos):
        cells = low_rank_cells(subjects, widths, [0.1])
        start = time.perf_counter()
        model = MultiViewCCA(k=1, rhos=rhos).fit_cells(cells, subjects, widths)
        kept = model.loadings.count()
        steps = sum(model.steps.values())
        print(f"widths {widths}: {time.perf_counter() - start:.1f}s, {steps} power steps, {kept} loadings", flush=True)

    fit([300, 500, 700, 1000], [0.1, 0.3, 0.7, 0.4])
    fit([300, 500, 700, 1000], [0.1, 0.3, 0.7, 0.4])
    for p in map(int, sys.argv[1:]):
        fit([p, p], [0.1])


main()
