"""Sparse multi-view canonical correlation analysis as a Spark ML estimator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark import StorageLevel, keyword_only
from pyspark.errors import PySparkException
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasMaxIter, HasStandardization, HasTol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.functions.scalar import safe_corr
from polyview.operators import scoring, wide
from polyview.plans import blocks, covariance, gram, sparse
from polyview.plans.common import MEANS, SIGMA, FitOptions, FitResult, log

from polyview.sources.views import (
    CELL_FAULTS, _scatter, cells_from_arrays, checked_cells, checked_subjects, dense_index, feature_vectors_from_arrays,
)

def view_column(df: DataFrame, name: str) -> Column:
    """An input column as an array; ML vectors are converted."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        return vector_to_array(F.col(name))
    return F.col(name)


def whole_array(array: Column, width: int) -> Column:
    """The array; a null array, a null entry or another number of entries fails the query."""
    bad = array.isNull() | F.exists(array, lambda x: x.isNull()) | (F.size(array) != width)
    return F.when(bad, F.raise_error(F.lit(f"null array or entry in a view, or not {width} entries"))).otherwise(
        array.cast("array<double>"))


def _pack_rows(cells: DataFrame, subjects: DataFrame | None, widths: Sequence[int]) -> DataFrame:
    """All views of a subject in one dense array (used when the total width is small)."""
    start, offset = F.lit(0), 0
    for i, w in enumerate(widths):
        start = F.when(F.col("view_idx") == i, F.lit(offset)).otherwise(start)
        offset += w
    items = cells.groupBy("row_id").agg(
        F.collect_list(F.struct((F.col("feature_id") + start).cast("int").alias("pos"), "value")).alias("items")
    )
    if subjects is not None:
        items = subjects.select("row_id").join(items, "row_id", "left")
    lists = items.select(
        "row_id",
        F.coalesce(F.col("items.pos"), F.array().cast("array<int>")).alias("pos"),
        F.coalesce(F.col("items.value"), F.array().cast("array<double>")).alias("val"),
        F.lit(offset).cast("int").alias("size"),
    )
    return lists.mapInArrow(_scatter, "row_id bigint, vec array<double>")


class _Shared(HasInputCols, HasStandardization):
    k = Param(Params._dummy(), "k", "number of components", typeConverter=TypeConverters.toInt)
    rhos = Param(Params._dummy(), "rhos", "sparsity in [0, 1], one value or one per view",
                 typeConverter=TypeConverters.toListFloat)
    rowCol = Param(Params._dummy(), "rowCol", "integer subject key",
                   typeConverter=TypeConverters.toString)
    centering = Param(Params._dummy(), "centering",
                      "scores are centred on the 'batch' scored or on the 'training' data",
                      typeConverter=TypeConverters.toString)

    def getK(self) -> int:
        return self.getOrDefault(self.k)

    def getRhos(self) -> list[float]:
        return self.getOrDefault(self.rhos)

    def getRowCol(self) -> str:
        return self.getOrDefault(self.rowCol)

    def getCentering(self) -> str:
        return self.getOrDefault(self.centering)

    def setK(self, value: int):
        if value <= 0:
            raise ValueError("k must be greater than 0")
        return self._set(k=value)

    def setRhos(self, value: Sequence[float]):
        if len(value) == 0 or min(value) < 0 or max(value) > 1:
            raise ValueError("all rhos must be in [0, 1]")
        return self._set(rhos=value)

    def setRowCol(self, value: str):
        return self._set(rowCol=value)

    def setInputCols(self, value: Sequence[str]):
        return self._set(inputCols=list(value))

    def setStandardization(self, value: bool):
        return self._set(standardization=value)

    def setCentering(self, value: str):
        if value not in ("batch", "training"):
            raise ValueError("centering must be 'batch' or 'training'")
        return self._set(centering=value)


class MultiViewCCA(
    Estimator, _Shared, HasMaxIter, HasTol, DefaultParamsReadable, DefaultParamsWritable
):
    """Find sparse weights per view whose projections agree across views.

    ``inputCols`` names one array or vector column per view.  Three plans give
    the same result; ``plan="auto"`` picks by measured size:

    * ``covariance``: total width up to ``maxCovarianceFeatures``;
    * ``gram``: up to ``maxGramSubjects`` subjects, any width;
    * ``sparse``: neither bound holds.
    """

    verbose = Param(Params._dummy(), "verbose", "log progress", typeConverter=TypeConverters.toBoolean)
    fullDeflation = Param(
        Params._dummy(), "fullDeflation",
        "remove all earlier components in the refit, not only the previous one",
        typeConverter=TypeConverters.toBoolean)
    plan = Param(Params._dummy(), "plan", "auto, covariance, gram or sparse",
                 typeConverter=TypeConverters.toString)
    maxCovarianceFeatures = Param(
        Params._dummy(), "maxCovarianceFeatures", "largest total width for the covariance plan",
        typeConverter=TypeConverters.toInt)
    maxGramSubjects = Param(
        Params._dummy(), "maxGramSubjects", "most subjects for the gram plan",
        typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, rowCol="row_id", k=1, maxIter=1000, rhos=(0.1,),
                 standardization=True, tol=1e-4, verbose=False, fullDeflation=False,
                 centering="batch", plan="auto", maxCovarianceFeatures=2048, maxGramSubjects=2048):
        super().__init__()
        self._setDefault(
            rowCol="row_id", k=1, maxIter=1000, rhos=[0.1], standardization=True, tol=1e-4,
            verbose=False, fullDeflation=False, centering="batch", plan="auto",
            maxCovarianceFeatures=2048, maxGramSubjects=2048)
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, inputCols=None, rowCol="row_id", k=1, maxIter=1000, rhos=(0.1,),
                  standardization=True, tol=1e-4, verbose=False, fullDeflation=False,
                  centering="batch", plan="auto", maxCovarianceFeatures=2048, maxGramSubjects=2048):
        given = {n: list(v) if n == "rhos" else v for n, v in self._input_kwargs.items() if v is not None}
        for name in ("k", "rhos", "centering", "plan"):
            if name in given:
                getattr(self, "set" + name[0].upper() + name[1:])(given.pop(name))
        return self._set(**given)

    def setMaxIter(self, value: int):
        return self._set(maxIter=value)

    def setTol(self, value: float):
        return self._set(tol=value)

    def setVerbose(self, value: bool):
        return self._set(verbose=value)

    def getVerbose(self) -> bool:
        return self.getOrDefault(self.verbose)

    def setFullDeflation(self, value: bool):
        return self._set(fullDeflation=value)

    def getFullDeflation(self) -> bool:
        return self.getOrDefault(self.fullDeflation)

    def getPlan(self) -> str:
        return self.getOrDefault(self.plan)

    def setMaxCovarianceFeatures(self, value: int):
        return self._set(maxCovarianceFeatures=value)

    def setMaxGramSubjects(self, value: int):
        return self._set(maxGramSubjects=value)

    def setPlan(self, value: str):
        if value not in ("auto", "covariance", "gram", "sparse"):
            raise ValueError("plan must be auto, covariance, gram or sparse")
        return self._set(plan=value)

    def _options(self, d: int) -> FitOptions:
        if d < 2:
            raise ValueError("need at least 2 views")
        rhos = self.getRhos()
        if len(rhos) not in (1, d):
            raise ValueError("give one sparsity value, or one per view")
        if self.getK() <= 0 or min(rhos) < 0 or max(rhos) > 1:
            raise ValueError("k must be positive and rhos in [0, 1]")
        return FitOptions(
            k=self.getK(), rhos=rhos * d if len(rhos) == 1 else rhos, max_iter=self.getMaxIter(),
            tol=self.getTol(), centered=self.getStandardization(),
            full_deflation=self.getOrDefault(self.fullDeflation))

    def _choose(self, widths: Sequence[int], count) -> str:
        """The plan; one that is set by hand is held to the same bounds on what reaches the driver."""
        plan = self.getOrDefault(self.plan)
        narrow = sum(widths) <= self.getOrDefault(self.maxCovarianceFeatures)
        if plan == "covariance" and not narrow:
            raise ValueError("the views are wider than maxCovarianceFeatures")
        if plan == "gram" and count() > self.getOrDefault(self.maxGramSubjects):
            raise ValueError("there are more subjects than maxGramSubjects")
        if plan != "auto":
            return plan
        if narrow:
            return "covariance"
        return "gram" if count() <= self.getOrDefault(self.maxGramSubjects) else "sparse"

    def _fit(self, dataset: DataFrame) -> "MultiViewCCAModel":
        cols = self.getInputCols()
        opts = self._options(len(cols))
        if self.getRowCol() not in dataset.columns:
            raise ValueError(f"there is no column {self.getRowCol()} for the subjects' keys")
        subjects = checked_subjects(dataset.select(F.col(self.getRowCol()).alias("row_id")))
        views = [view_column(dataset, c) for c in cols]
        sizes = dataset.select(*[F.size(v).alias(f"n{i}") for i, v in enumerate(views)]).first()
        if sizes is None:
            raise ValueError("there are no subjects")
        widths = [int(s) for s in sizes]
        plan = self._choose(widths, dataset.count)
        if plan == "covariance":
            return self._model(covariance.fit(dataset, views, widths, opts), cols)
        if plan == "gram":
            n = subjects.count()
            index = dense_index(subjects, ["row_id"], "row_idx", n)
            vectors = feature_vectors_from_arrays(dataset, self.getRowCol(), views, index, n)
            return self._model(gram.fit(vectors, n, widths, opts), cols)
        cells = cells_from_arrays(dataset, self.getRowCol(), views)
        if blocks.takes(widths):
            return self._model(blocks.fit(blocks.Blocks(cells, widths), subjects.count(), opts), cols)
        return self._model(sparse.fit(cells, subjects.count(), widths, opts), cols)

    def fit_cells(self, cells: DataFrame, subjects: DataFrame | None = None,
                  widths: Sequence[int] | None = None, runs: DataFrame | None = None) -> "MultiViewCCAModel":
        """Fit on long cells.  ``subjects(row_id)`` names the subjects: those without any cell
        count, cells of others are left out.  ``widths`` gives the features per view when the last ones may be absent. ``runs`` are the same cells
        packed by ``plans.blocks.packed``, which the plan for many subjects then reads in their place."""
        if widths is None:
            found = {r["view_idx"]: r["w"] for r in
                     cells.groupBy("view_idx").agg((F.max("feature_id") + 1).alias("w")).collect()}
            if not found:
                raise ValueError("there are no cells")
            widths = [int(found.get(i, 1)) for i in range(max(found) + 1)]
        opts = self._options(len(widths))
        cols = self.getInputCols() if self.isSet("inputCols") else [f"view{i}" for i in range(len(widths))]
        return self._fit_long(cells, subjects, list(widths), opts, cols, runs)

    def _fit_long(self, cells, subjects, widths, opts, cols, runs=None):
        try:
            return self._fit_checked(cells, subjects, widths, opts, cols, runs)
        except PySparkException as error:
            for fault in CELL_FAULTS:
                if fault in str(error):
                    raise ValueError(fault) from error
            raise

    def _fit_checked(self, cells, subjects, widths, opts, cols, runs):
        subjects = checked_subjects(subjects) if subjects is not None else None
        cells = checked_cells(cells, subjects, widths)
        ids = subjects if subjects is not None else cells.select("row_id").distinct()
        packed = blocks.Blocks(cells, widths, runs if subjects is None else None) if blocks.takes(widths) else None
        # Cells that are packed are counted there, so that they are read once.
        count = cache(packed.subjects if packed and subjects is None else ids.count)
        plan = self._choose(widths, count)
        if self.getVerbose():
            log.info("fitting with the %s plan", plan)
        if plan == "sparse" and packed:
            return self._model(blocks.fit(packed, count(), opts), cols)
        if packed:
            packed.release()
        if plan == "covariance":
            rows = _pack_rows(cells, subjects, widths).persist(StorageLevel.MEMORY_AND_DISK)
            start, views = 1, []
            for w in widths:
                views.append(F.slice("vec", start, w))
                start += w
            try:
                return self._model(covariance.fit(rows, views, widths, opts), cols)
            finally:
                rows.unpersist()
        if plan == "gram":
            index = dense_index(ids, ["row_id"], "row_idx", count())
            return self._model(gram.fit(gram.vectors_of_cells(cells, index, count()), count(), widths, opts), cols)
        return self._model(sparse.fit(cells, count(), widths, opts), cols)

    def _model(self, result: FitResult, cols: Sequence[str]) -> "MultiViewCCAModel":
        model = MultiViewCCAModel(result)
        self._copyValues(model)
        return model._set(inputCols=list(cols))


class MultiViewCCAModel(Model, _Shared, MLWritable, MLReadable):
    """Fitted loadings with scoring, correlations and cross-view prediction."""

    outcomeCol = Param(Params._dummy(), "outcomeCol", "the one view that transform predicts; all of them if not set",
                       typeConverter=TypeConverters.toString)

    def setOutcomeCol(self, value: str):
        if value not in self.getInputCols():
            raise ValueError("outcomeCol is not one of the views")
        return self._set(outcomeCol=value)

    def getOutcomeCol(self) -> str:
        return self.getOrDefault(self.outcomeCol)

    def __init__(self, result: FitResult | None = None):
        super().__init__()
        self._setDefault(rowCol="row_id", k=1, rhos=[0.1], standardization=True, centering="batch")
        self._result = result
        self._rows: int | None = None
        self._inverse: dict | None = None

    # ------------------------------------------------------------ tables

    @property
    def loadings(self) -> DataFrame:
        """``(component, view_idx, feature_id, loading)``, non-zeros only."""
        return self._result.loadings

    @property
    def sigma(self) -> DataFrame:
        """``(component, view_i, view_j, sigma)``, symmetric with zero diagonal."""
        spark = self.loadings.sparkSession
        return spark.createDataFrame(self._result.sigma, SIGMA)

    @property
    def widths(self) -> list[int]:
        return self._result.widths

    @property
    def steps(self) -> dict[tuple[int, int, int], int]:
        """Power steps taken, by (component, view, other view)."""
        return {key: course.steps for key, course in self._result.progress.items()}

    @property
    def stop_reasons(self) -> dict[tuple[int, int, int], str]:
        """Why each power iteration ended: "converged", "zero" or "limit"."""
        return {key: course.reason for key, course in self._result.progress.items()}

    @property
    def losses(self) -> dict[tuple[int, int, int], list[float]]:
        """The losses of each power iteration, one per step."""
        return {key: list(course.losses) for key, course in self._result.progress.items()}

    def support(self) -> DataFrame:
        return self.loadings.select("component", "view_idx", "feature_id")

    def _rows_bound(self) -> int:
        """The number of loadings, counted once."""
        if self._rows is None:
            self._rows = self.loadings.count()
        return self._rows

    # ------------------------------------------------------------ wide form

    def transform(self, dataset: DataFrame, params=None) -> DataFrame:
        """Append ``score_<view>`` (k numbers) and ``prediction_<view>`` (all features).

        With ``outcomeCol`` only that view is predicted.  One plan whatever the width: the loadings'
        supports are read as one row per view, scores take a subject's entries in them, and
        predictions are 0 elsewhere.
        """
        return super().transform(dataset, params)

    def _raw_scores(self, dataset: DataFrame) -> DataFrame:
        """The dataset, ``_z``, the packed loadings, and ``_r<view>``, the uncentred scores of every component."""
        cols, k = self.getInputCols(), self.getK()
        if len(cols) != len(self.widths):
            raise ValueError(f"the model needs {len(self.widths)} views")
        loadings = self.loadings.withColumnRenamed("loading", "value")
        views = range(len(cols))
        rows = dataset.withColumns(
            {f"_a{i}": whole_array(view_column(dataset, c), w) for i, (c, w) in enumerate(zip(cols, self.widths, strict=True))}
            | {"_z": wide.packed(loadings, views, k, self.widths)})
        return rows.withColumns({f"_r{i}": wide.dots(f"_a{i}", f"_z.v{i}", k) for i in views}).drop(
            *[f"_a{i}" for i in views])

    def _inverses(self) -> dict[tuple[int, int, int], float]:
        """The pseudo-inverses of the components' products, by (view, component, component); computed once."""
        if self._inverse is None:
            self._inverse = {(v, a, b): x for v, a, b, x in scoring.inverse_grams(self.loadings)}
        return self._inverse

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols, d, k = self.getInputCols(), len(self.widths), self.getK()
        outcomes = [cols.index(self.getOutcomeCol())] if self.isDefined(self.outcomeCol) else list(range(d))
        out = self._raw_scores(dataset)
        pairs = [(i, q) for i in range(d) for q in range(k)]
        if not self.getStandardization():
            mean = {key: F.lit(0.0) for key in pairs}
        elif self.getCentering() == "training":
            known = {(i, q): m for q, i, m in self._result.score_means}
            mean = {key: F.lit(float(known.get(key, 0.0))) for key in pairs}
        else:
            means = out.agg(F.struct(*[F.avg(F.col(f"_r{i}")[q]).alias(f"m{i}_{q}") for i, q in pairs]).alias("m")).scalar()
            out = out.withColumn("_m", means)
            mean = {(i, q): F.col("_m")[f"m{i}_{q}"] for i, q in pairs}
        out = out.withColumns({
            f"score_{c}": F.array(*[F.col(f"_r{i}")[q] - mean[i, q] for q in range(k)]) for i, c in enumerate(cols)})
        # pinv(Z)' = pinv(Z Z') Z: the sums of the other views' scores meet the small inverse, then the loadings.
        inverse = self._inverses()

        def times_inverse(o, q):
            return sum((F.col(f"score_{c}")[p] * F.lit(inverse.get((o, p, q), 0.0))
                        for j, c in enumerate(cols) if j != o for p in range(k)), F.lit(0.0))

        out = out.withColumns({f"_t{o}": F.array(*[times_inverse(o, q) for q in range(k)]) for o in outcomes})
        out = out.withColumns({f"prediction_{cols[o]}": wide.spread_out(f"_t{o}", f"_z.v{o}", k) for o in outcomes})
        return out.drop("_m", "_z", *[f"_r{i}" for i in range(d)], *[f"_t{o}" for o in outcomes])

    def canonical_correlations_frame(self, dataset: DataFrame) -> DataFrame:
        """``(component, view_i, view_j, corr)`` on array or vector columns, in one aggregate."""
        d, k = len(self.widths), self.getK()
        raw = self._raw_scores(dataset)
        found = raw.agg(*[
            safe_corr(F.col(f"_r{i}")[q], F.col(f"_r{j}")[q]).alias(f"c{q}_{i}_{j}")
            for q in range(k) for i in range(d) for j in range(i)])
        return found.select(F.inline(F.array(*[
            F.struct(F.lit(q).cast("int").alias("component"), F.lit(i).cast("int").alias("view_i"), F.lit(j).cast("int").alias("view_j"),
                     (F.lit(1.0) if i == j else F.col(f"c{q}_{max(i, j)}_{min(i, j)}")).alias("corr"))
            for q in range(k) for i in range(d) for j in range(d)])))

    # ------------------------------------------------------------ long form

    def _score_table(self, cells, subjects, centered) -> DataFrame:
        table = scoring.score_table(
            cells, self.loadings, len(self.widths), self.getK(), subjects, self._rows_bound())
        if not centered:
            return table
        if self.getCentering() == "batch":
            return scoring.center_table(table)
        known = {f"s{i}_{q}": m for q, i, m in self._result.score_means}
        return table.select("row_id", *[
            (F.col(c) - F.lit(float(known.get(c, 0.0)))).alias(c)
            for c in table.columns if c != "row_id"])

    def score_cells(self, cells: DataFrame, subjects: DataFrame | None = None,
                    centered: bool | None = None) -> DataFrame:
        """Scores from long cells: ``(view_idx, row_id, component, score)``.

        ``subjects(row_id)`` adds subjects without any cell.
        """
        centered = self.getStandardization() if centered is None else centered
        return scoring.long_scores(
            self._score_table(cells, subjects, centered), len(self.widths), self.getK())

    def predict_cells(self, cells: DataFrame, subjects: DataFrame | None = None,
                      outcome: int | None = None, dense: bool = True) -> DataFrame:
        """Predict one view (``outcome``) or every view from the others, in long form."""
        loadings, widths = self.loadings, list(self.widths)
        if outcome is not None:
            if not 0 <= outcome < len(widths):
                raise ValueError("outcome is not the number of a view")
            loadings = loadings.filter(F.col("view_idx") == outcome)
        table = self._score_table(cells, subjects, self.getStandardization())
        sums = scoring.other_view_sums(table, len(widths), self.getK(), outcome)
        return scoring.predict_cells(
            sums, scoring.prediction_weights(loadings), widths, dense, self._rows_bound())

    def canonical_correlations(self, cells: DataFrame) -> DataFrame:
        """``(component, view_i, view_j, corr)`` on long cells."""
        return scoring.canonical_correlations(self.score_cells(cells, centered=False), len(self.widths))

    # ------------------------------------------------------------ storage

    def write(self) -> "MLWriter":
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> "MLReader":
        return _ModelReader()

    def copy(self, extra=None):
        that = super().copy(extra)
        that._result, that._rows, that._inverse = self._result, self._rows, self._inverse
        return that


class _ModelWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model, spark = self.instance, self.sparkSession
        r = model._result
        DefaultParamsWriter.saveMetadata(
            model, path, spark, extraMetadata={"widths": r.widths})
        r.loadings.write.parquet(f"{path}/loadings")
        spark.createDataFrame(r.sigma, SIGMA).coalesce(1).write.parquet(f"{path}/sigma")
        spark.createDataFrame(r.score_means, MEANS).coalesce(1).write.parquet(f"{path}/score_means")


class _ModelReader(MLReader):
    def load(self, path: str) -> MultiViewCCAModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        sigma = [tuple(r) for r in spark.read.parquet(f"{path}/sigma").collect()]
        means = [tuple(r) for r in spark.read.parquet(f"{path}/score_means").collect()]
        result = FitResult(spark.read.parquet(f"{path}/loadings"), sigma, means, metadata["widths"])
        model = MultiViewCCAModel(result)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
