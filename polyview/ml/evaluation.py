"""Evaluators over a scored DataFrame, usable in Spark's ``CrossValidator``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.functions.scalar import safe_corr
from polyview.ml.estimator import view_column
from polyview.operators.wide import paired_correlations


class PredictionEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean over all features of the outcome view of corr(prediction, actual).

    Without ``outcomeCol`` the first view that has a prediction is judged.
    """

    outcomeCol = Param(Params._dummy(), "outcomeCol", "the view whose prediction is judged",
                       typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, outcomeCol=None):
        super().__init__()
        if outcomeCol is not None:
            self._set(outcomeCol=outcomeCol)

    def setOutcomeCol(self, value: str):
        return self._set(outcomeCol=value)

    def getOutcomeCol(self) -> str:
        return self.getOrDefault(self.outcomeCol)

    def metric(self, dataset: DataFrame) -> DataFrame:
        mark = "prediction_"
        name = self.getOutcomeCol() if self.isSet("outcomeCol") else next(
            c.removeprefix(mark) for c in dataset.columns if c.startswith(mark) and c.removeprefix(mark) in dataset.columns)
        pairs = dataset.select(view_column(dataset, name).cast("array<double>"), F.col(f"prediction_{name}").cast("array<double>"))
        return paired_correlations(pairs).agg((F.sum("total") / F.sum("features")).alias("metric"))

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.metric(dataset).first()[0])

    def isLargerBetter(self) -> bool:
        return True


class CanonicalCorrelationEvaluator(
    Evaluator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable
):
    """Mean canonical correlation over components and pairs of views.

    By default the unit diagonal is part of the mean; ``offDiagonalOnly``
    leaves it out.
    """

    offDiagonalOnly = Param(Params._dummy(), "offDiagonalOnly", "leave out the unit diagonal",
                            typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, offDiagonalOnly=False):
        super().__init__()
        self._setDefault(offDiagonalOnly=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setInputCols(self, value: Sequence[str]):
        return self._set(inputCols=list(value))

    def setOffDiagonalOnly(self, value: bool):
        return self._set(offDiagonalOnly=value)

    def metric(self, dataset: DataFrame) -> DataFrame:
        d = len(self.getInputCols())
        arrays = [F.col(f"score_{c}").alias(f"s{i}") for i, c in enumerate(self.getInputCols())]
        rows = dataset.select(F.posexplode(F.arrays_zip(*arrays)).alias("component", "p"))
        pairs = sum(
            (safe_corr(F.col(f"p.s{i}"), F.col(f"p.s{j}")) for i in range(d) for j in range(i)),
            F.lit(0.0))
        per = rows.groupBy("component").agg(pairs.alias("total"))
        if self.getOrDefault(self.offDiagonalOnly):
            value = F.avg(F.col("total") / F.lit(d * (d - 1) / 2))
        else:
            value = F.avg((F.lit(float(d)) + 2.0 * F.col("total")) / F.lit(float(d * d)))
        return per.agg(value.alias("metric"))

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.metric(dataset).first()[0])

    def isLargerBetter(self) -> bool:
        return True
