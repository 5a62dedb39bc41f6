"""Sparse multi-view association analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors get the task functions with the job and need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

from polyview.ml import (  # noqa: E402,F401
    CanonicalCorrelationEvaluator,
    MultiViewCCA,
    MultiViewCCAModel,
    PredictionEvaluator,
    fold_column,
    holdout_split,
)
