from polyview.ml.estimator import MultiViewCCA, MultiViewCCAModel  # noqa: F401
from polyview.ml.evaluation import CanonicalCorrelationEvaluator, PredictionEvaluator  # noqa: F401
from polyview.ml.tuning import fold_column, holdout_split  # noqa: F401
