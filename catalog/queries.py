"""One registered query per operator; each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import (
    THREE, TWO, customer_cells, document_cells, document_runs, embedding_cells, embedding_frame, event_cells,
    table, width,
)
from polyview import (
    CanonicalCorrelationEvaluator, MultiViewCCA, MultiViewCCAModel, PredictionEvaluator,
    fold_column, holdout_split,
)
from polyview import operators as ops
from polyview.functions import soft_threshold
from polyview.session import ensure_checkpoint_dir
from polyview.sources import (
    cells_from_columns, dense_index, feature_vectors, fill_missing, low_rank_cells, matrix_rows,
    match_subjects, ordered_cells, read_matrix_text, vector_table,
)

P = width(TWO)
RHO = 0.1


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def view(cells: DataFrame, index: int) -> DataFrame:
    return cells.filter(F.col("view_idx") == index)


def two(spark, sf) -> DataFrame:
    return embedding_cells(spark, sf, TWO)


def means_of(cells: DataFrame) -> DataFrame:
    return ops.column_means(cells).withColumnRenamed("center", "value")


def labels_of(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("value"))


def customer_dense(spark, sf) -> tuple[DataFrame, list[int], int]:
    cells, widths = customer_cells(spark, sf)
    cells = cells.persist()
    subjects = match_subjects(cells, 3).select("row_id").distinct().persist()
    return fill_missing(cells, subjects, widths).persist(), widths, subjects.count()


def estimator(d: int, **params) -> MultiViewCCA:
    settings = {"rhos": [RHO], "maxIter": 4, "tol": 0.0, **params}
    return MultiViewCCA(inputCols=[f"v{i}" for i in range(d)], **settings)


def fitted(spark, sf, parts, **params) -> tuple[MultiViewCCAModel, DataFrame]:
    frame = embedding_frame(spark, sf, parts)
    return estimator(len(parts), **params).fit(frame), frame


def cov_of(cells: DataFrame) -> DataFrame:
    """Covariance of the second view's features with the first view's."""
    centred = ops.center_columns(cells, P)
    return ops.cross_covariance(view(centred, 1), view(centred, 0))


# ---------------------------------------------------------------- sources

def view_cells_from_array(spark, sf):
    return rounded(two(spark, sf), "value")


def view_cells_from_columns(spark, sf):
    return cells_from_columns(table(spark, sf, "part"), "p_partkey", [["p_size"], ["p_retailprice"]])


def view_cells_from_pivot(spark, sf):
    return rounded(customer_cells(spark, sf)[0], "value", digits=4)


def view_cells_matched(spark, sf):
    # Means of values with two decimals can end in a 5 at few digits.
    digits = F.when(F.col("view_idx") == 1, F.round("value", 9)).otherwise(F.round("value", 4))
    return event_cells(spark, sf)[0].withColumn("value", digits + F.lit(0.0))


def view_cells_from_documents(spark, sf):
    # Counts are whole numbers; there is nothing to round.
    return document_cells(spark, sf)[0]


def fill_missing_cells(spark, sf):
    return rounded(customer_dense(spark, sf)[0], "value", digits=4)


def matrix_text_roundtrip(spark, sf):
    """Write every view as a text matrix (key first) and read it back."""
    frame, read = embedding_frame(spark, sf, TWO), []
    for i in range(len(TWO)):
        path = f"{ensure_checkpoint_dir(spark)}/matrix-{uuid.uuid4().hex}"
        frame.select(
            F.concat_ws(" ", F.col("row_id").cast("string"), F.array_join(F.col(f"v{i}").cast("array<string>"), " "))
        ).write.text(path)
        read.append(read_matrix_text(spark, path, i, row_id_first=True))
    return rounded(read[0].unionByName(read[1]), "value")


def matrix_text_lines(spark, sf):
    """Write a view in order without keys, as several files, and read it back; lines are numbered through all files."""
    frame, path = embedding_frame(spark, sf, TWO), f"{ensure_checkpoint_dir(spark)}/matrix-{uuid.uuid4().hex}"
    frame.repartitionByRange(5, "row_id").sortWithinPartitions("row_id").select(
        F.array_join(F.col("v1").cast("array<string>"), " ")).write.text(path)
    return rounded(read_matrix_text(spark, path, 1), "value")


def subject_index(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("row_id")).distinct()
    return dense_index(ids, ["row_id"], "row_idx")


def feature_vector_chunks(spark, sf):
    cells = two(spark, sf)
    ids = cells.select("row_id").distinct()
    n = ids.count()
    out = feature_vectors(cells, dense_index(ids, ["row_id"], "row_idx", n), n, chunk_rows=256)
    return out.withColumn("vec", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)))


def matrix_row_chunks(spark, sf):
    out = matrix_rows(two(spark, sf), 32, chunk_cols=20)
    return out.withColumn("vec", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)))


def matrix_ordered(spark, sf):
    return ordered_cells(rounded(two(spark, sf), "value"))


def vector_from_array(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.sum("l_quantity").alias("q"))
    array = sums.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q")))["q"].alias("a"))
    return rounded(vector_table(array, F.col("a")), "value", digits=4)


def _vector_subjects(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"))


def lowrank_pattern(spark, sf):
    factor = (F.col("row_id") % 7 - 3).cast("double")
    cells = low_rank_cells(_vector_subjects(spark, sf), [40, 30], [0.2, 0.4], eps=0.0, factor=factor)
    return cells.withColumn("value", F.col("value") + F.lit(0.0))


def lowrank_cells(spark, sf):
    return rounded(low_rank_cells(_vector_subjects(spark, sf), [40, 30], [0.2, 0.4], eps=0.1, seed=1), "value")


# ---------------------------------------------------------------- projections

def center_columns(spark, sf):
    return rounded(ops.center_columns(two(spark, sf), P), "value")


def center_customer_columns(spark, sf):
    cells, widths, n = customer_dense(spark, sf)
    # Amounts have few decimals, so centred values can end in an exact half; a
    # prime unit keeps them from being rounded either way.
    return rounded(ops.scale_entries(ops.center_columns(cells, sum(widths), n), 1009.0), "value")


def standardize_columns(spark, sf):
    cells = two(spark, sf)
    stats = cells.groupBy("view_idx", "feature_id").agg(
        F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    return rounded(ops.standardize_columns(cells, stats, P), "value")


def standardize_scalar(spark, sf):
    return rounded(ops.standardize_scalar(two(spark, sf), 0.25, 2.0), "value")


def scale_entries(spark, sf):
    return rounded(ops.scale_entries(two(spark, sf), 3.0), "value")


def soft_thresholded(spark, sf):
    return rounded(ops.soft_threshold_vector(means_of(two(spark, sf)), 0.01), "value")


def get_column(spark, sf):
    return rounded(ops.get_column(two(spark, sf), 9, 2.0), "value")


def get_columns(spark, sf):
    return rounded(ops.get_columns(two(spark, sf), [9, 3, 9, 30], 2.0), "value")


def _large_means(cells):
    return means_of(cells).filter(F.abs("value") > 0.01)


def restrict_support(spark, sf):
    """No rows where no mean is large, as on many vectors."""
    cells = two(spark, sf)
    kept = ops.restrict_support(cells, _large_means(cells), ["view_idx", "feature_id"], P, allow_empty=True)
    return rounded(kept, "value")


def l2_normalize(spark, sf):
    return rounded(ops.l2_normalize(means_of(two(spark, sf)), ["view_idx"]), "value")


def support(spark, sf):
    vector = means_of(two(spark, sf)).withColumn(
        "value", F.when(F.abs("value") > 0.01, F.col("value")).otherwise(0.0))
    return ops.support(vector)


# ---------------------------------------------------------------- products

def left_multiply(spark, sf):
    matrix = table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("out_row"), F.col("vec_id").alias("row_id"), F.lit(1.0).alias("value"))
    return rounded(ops.left_multiply(matrix, view(two(spark, sf), 0)), "value")


def cross_covariance(spark, sf):
    return rounded(cov_of(two(spark, sf)), "value")


def cross_covariance_customers(spark, sf):
    # Absent cells add nothing to the product.
    cells = match_subjects(customer_cells(spark, sf)[0], 3)
    scaled = ops.scale_entries(view(cells, 0), 1000.0)
    return rounded(ops.cross_covariance(scaled, view(cells, 2)), "value", digits=4)


def cross_covariance_centered(spark, sf):
    """Centred over all matched customers, from the stored cells alone."""
    cells = match_subjects(customer_cells(spark, sf)[0], 3)
    n = view(cells, 2).select("row_id").distinct().count()
    scaled = ops.scale_entries(view(cells, 0), 1000.0)
    return rounded(ops.cross_covariance(scaled, view(cells, 2), subjects=n), "value", digits=4)


def matvec(spark, sf):
    cells = view(two(spark, sf), 0)
    return rounded(ops.matvec(cells, means_of(cells), P), "value")


def matvec_t(spark, sf):
    return rounded(ops.matvec_t(view(two(spark, sf), 0), labels_of(spark, sf)), "value")


def deflated_matvec(spark, sf):
    model, _ = fitted(spark, sf, TWO, k=2)
    centred = ops.center_columns(two(spark, sf), P)
    left, right = view(centred, 1), view(centred, 0)
    start = left.groupBy("feature_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))
    sigma = model.sigma.filter("view_i = 0 AND view_j = 1").select("component", "sigma")
    out = ops.deflated_matvec(
        left, right, start, view(model.loadings, 1), view(model.loadings, 0), sigma, P)
    return rounded(out, "value")


def subtract_outer(spark, sf):
    cells = view(two(spark, sf), 0)
    return rounded(ops.subtract_outer(cells, labels_of(spark, sf), means_of(cells), None, P), "value")


def deflate_covariance(spark, sf):
    cells = two(spark, sf)
    means = means_of(cells)
    out = ops.deflate_covariance(cov_of(cells), view(means, 1), view(means, 0), 0.5, P, P)
    return rounded(out, "value")


def scores(spark, sf):
    model, _ = fitted(spark, sf, THREE)
    return rounded(model.score_cells(embedding_cells(spark, sf, THREE)), "score")


# ---------------------------------------------------------------- aggregates

def column_power_sums(spark, sf):
    return rounded(ops.column_power_sums(two(spark, sf), 3), "total")


def max_l2_column(spark, sf):
    return rounded(ops.max_l2_column(view(ops.center_columns(two(spark, sf), P), 0)), "norm", "value")


def max_l2_column_support(spark, sf):
    rows = labels_of(spark, sf).filter("value > 0").select("row_id")
    cells = view(ops.center_columns(two(spark, sf), P), 0)
    return rounded(ops.max_l2_column(cells, rows), "norm", "value")


def combine_pairs(spark, sf):
    centred = ops.center_columns(embedding_cells(spark, sf, THREE), width(THREE)).persist()
    norms = None
    for i in range(3):
        for j in (j for j in range(3) if j != i):
            part = (
                ops.cross_covariance(view(centred, j), view(centred, i))
                .groupBy(F.col("right_feature").alias("feature_id"))
                .agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))
                .select(F.lit(i).alias("view_idx"), F.lit(j).alias("other_idx"), "feature_id", "value"))
            norms = part if norms is None else norms.unionByName(part)
    bounds = norms.groupBy("view_idx", "other_idx").agg((RHO * F.max("value")).alias("bound"))
    return rounded(ops.combine_pairs(norms, bounds), "value", "bound")


def canonical_correlations(spark, sf):
    model, _ = fitted(spark, sf, THREE)
    return rounded(model.canonical_correlations(embedding_cells(spark, sf, THREE)), "corr")


def eval_canonical_corr(spark, sf):
    model, frame = fitted(spark, sf, THREE)
    judge = CanonicalCorrelationEvaluator(inputCols=["v0", "v1", "v2"])
    return rounded(judge.metric(model.transform(frame)), "metric")


def eval_prediction(spark, sf):
    model, frame = fitted(spark, sf, THREE)
    return rounded(PredictionEvaluator(outcomeCol="v0").metric(model.transform(frame)), "metric")


def sigma_pairs(spark, sf):
    """The deflated products of the scores, recomputed from the loadings."""
    model, _ = fitted(spark, sf, THREE, k=2)
    scored = model.score_cells(embedding_cells(spark, sf, THREE)).persist()
    first = ops.sigma_pairs(scored.filter("component = 0"), 3)
    second = ops.sigma_pairs(
        scored.filter("component = 1"), 3, model.loadings.filter("component = 1"),
        model.loadings.filter("component = 0").drop("component"), first.drop("component"))
    return rounded(first.unionByName(second), "sigma")


def other_view_score_sum(spark, sf):
    model, _ = fitted(spark, sf, THREE)
    scored = model.score_cells(embedding_cells(spark, sf, THREE))
    return rounded(ops.other_view_score_sum(scored, 3), "score")


# ---------------------------------------------------------------- iterations

def _start(cells):
    """Start vector and bound of the pair (view 0 against view 1)."""
    cov = cov_of(cells).persist()
    asked = cov.select(F.col("right_feature").alias("feature_id"), F.col("left_feature").alias("row_id"), "value")
    top = ops.max_l2_column(asked)
    return cov, top.select(
        F.col("row_id").alias("feature_id"), (F.col("value") / F.col("norm")).alias("value"),
        (RHO * F.col("norm")).alias("bound"))


def l1_power_init(spark, sf):
    return rounded(_start(two(spark, sf))[1], "value", "bound")


def power_loss(spark, sf):
    """Loss after the first thresholded product."""
    cov, start = _start(two(spark, sf))
    product = (
        cov.withColumnRenamed("left_feature", "feature_id").withColumnRenamed("value", "c")
        .join(start, "feature_id")
        .groupBy("right_feature").agg(F.sum(F.col("c") * F.col("value")).alias("value"), F.max("bound").alias("bound")))
    z = product.select(
        F.col("right_feature").alias("feature_id"), soft_threshold(F.col("value"), F.col("bound")).alias("value"))
    return rounded(ops.power_loss(z), "loss")


def l1_power_iteration(spark, sf):
    """The vector of one pair before thresholding, by the steps over tables."""
    from polyview.plans import sparse
    from polyview.plans.common import FitOptions
    import numpy as np

    cells = two(spark, sf)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = table(spark, sf, "embeddings").count()
    left, right = (
        sparse.Side(
            sparse.Matrix(view(cells, i).select("row_id", "feature_id", "value"), n, 32, True, parts, n * 32), [])
        for i in (1, 0))
    raw, _, _ = sparse._power_pair(left, right, np.zeros(0), RHO, FitOptions(max_iter=4, tol=0.0))
    left.matrix.release()
    right.matrix.release()
    return rounded(raw, "value")


def refit_on_support(spark, sf):
    model, _ = fitted(spark, sf, TWO)
    return rounded(
        model.loadings.select("view_idx", "feature_id", F.col("loading").alias("value")), "value")


def _loadings(model):
    return rounded(model.loadings, "loading")


def fit_two_view(spark, sf):
    return _loadings(fitted(spark, sf, TWO)[0])


def fit_two_view_gram(spark, sf):
    """The gram plan up to its most subjects; its subject-by-subject matrices grow with their square,
    so more subjects take the plan that their size asks for, with the same loadings."""
    frame = embedding_frame(spark, sf, TWO)
    cca = estimator(2)
    fits = frame.count() <= cca.getOrDefault(cca.maxGramSubjects)
    return _loadings(cca.setPlan("gram" if fits else "auto").fit(frame))


def fit_two_view_sparse(spark, sf):
    return _loadings(fitted(spark, sf, TWO, plan="sparse")[0])


def fit_three_view(spark, sf):
    return _loadings(fitted(spark, sf, THREE, rhos=[0.1, 0.3, 0.2])[0])


def fit_k2(spark, sf):
    return _loadings(fitted(spark, sf, TWO, k=2)[0])


def fit_k3_three_view(spark, sf):
    return _loadings(fitted(spark, sf, THREE, k=3)[0])


def fit_customer_views(spark, sf):
    cells, widths = customer_cells(spark, sf)
    matched = match_subjects(cells.persist(), 3).persist()
    return _loadings(estimator(3).fit_cells(matched, widths=widths))


def fit_customer_views_sparse(spark, sf):
    cells, widths = customer_cells(spark, sf)
    return _loadings(estimator(3, plan="sparse").fit_cells(match_subjects(cells, 3), widths=widths))


def fit_cells_subset_subjects(spark, sf):
    """Cells of subjects that are not listed take no part."""
    cells = two(spark, sf)
    listed = cells.select("row_id").distinct().filter("row_id % 3 > 0")
    return _loadings(estimator(2, plan="sparse").fit_cells(cells, listed, widths=[n for _, n in TWO]))


def fit_two_view_converged(spark, sf):
    return _loadings(fitted(spark, sf, TWO, maxIter=1000, tol=1e-4)[0])


def fit_three_view_converged(spark, sf):
    return _loadings(fitted(spark, sf, THREE, maxIter=1000, tol=1e-4)[0])


def fit_documents(spark, sf):
    """Words against character grams; wide and sparse, whole texts; runs until it converges."""
    cells, widths = document_cells(spark, sf)
    runs = document_runs(spark, sf)
    return _loadings(MultiViewCCA(inputCols=["v0", "v1"], rhos=[RHO]).fit_cells(cells, widths=widths, runs=runs))


def model_roundtrip(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    fitted(spark, sf, TWO)[0].save(path)
    return _loadings(MultiViewCCAModel.load(path))


# ---------------------------------------------------------------- prediction

def prediction_weights(spark, sf):
    return rounded(ops.prediction_weights(fitted(spark, sf, TWO, k=2)[0].loadings), "weight")


def predict_view(spark, sf):
    model, _ = fitted(spark, sf, THREE)
    return rounded(model.predict_cells(embedding_cells(spark, sf, THREE), outcome=1), "prediction")


def predict_all_views(spark, sf):
    model, _ = fitted(spark, sf, THREE)
    return rounded(model.predict_cells(embedding_cells(spark, sf, THREE)), "prediction")


def predict_two_components(spark, sf):
    model, _ = fitted(spark, sf, TWO, k=2)
    return rounded(model.predict_cells(two(spark, sf)), "prediction")


def transform_frame(spark, sf):
    model, frame = fitted(spark, sf, THREE)
    out = model.transform(frame).select("row_id", F.posexplode("prediction_v0").alias("feature_id", "prediction"))
    return rounded(out.withColumn("feature_id", F.col("feature_id").cast("bigint")), "prediction")


def transform_outcome(spark, sf):
    """One view's prediction only, as the parameter asks."""
    model, frame = fitted(spark, sf, THREE)
    out = model.transform(frame, {model.outcomeCol: "v1"})
    return rounded(out.select(
        F.lit(1).alias("view_idx"), "row_id", F.posexplode("prediction_v1").alias("feature_id", "prediction")).withColumn(
        "feature_id", F.col("feature_id").cast("bigint")), "prediction")


def canonical_correlations_frame(spark, sf):
    model, frame = fitted(spark, sf, THREE)
    return rounded(model.canonical_correlations_frame(frame), "corr")


# ---------------------------------------------------------------- model selection

def kfold_assign(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), fold_column("vec_id", 5, hashed=False).alias("fold"))


def holdout(spark, sf):
    train, test = holdout_split(_vector_subjects(spark, sf), "row_id", 400)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def cv_grid(spark, sf):
    frame = embedding_frame(spark, sf, TWO).withColumn("fold", fold_column("row_id", 2, hashed=False))
    cca = estimator(2)
    grid = ParamGridBuilder().addGrid(cca.rhos, [[0.1], [0.5]]).build()
    search = CrossValidator(
        estimator=cca, estimatorParamMaps=grid, evaluator=PredictionEvaluator(outcomeCol="v0"),
        numFolds=2, foldCol="fold", parallelism=2)
    found = search.fit(frame)
    best = found.bestModel.getRhos()
    rows = [(g, float(m), grid[g][cca.rhos] == best) for g, m in enumerate(found.avgMetrics)]
    return rounded(spark.createDataFrame(rows, "grid_point int, metric double, best boolean"), "metric")


ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "view_cells_from_array": view_cells_from_array,
    "view_cells_from_columns": view_cells_from_columns,
    "view_cells_from_pivot": view_cells_from_pivot,
    "view_cells_matched": view_cells_matched,
    "view_cells_from_documents": view_cells_from_documents,
    "fill_missing_cells": fill_missing_cells,
    "matrix_text_roundtrip": matrix_text_roundtrip,
    "matrix_text_lines": matrix_text_lines,
    "subject_index": subject_index,
    "feature_vectors": feature_vector_chunks,
    "matrix_rows": matrix_row_chunks,
    "matrix_ordered": matrix_ordered,
    "vector_table": vector_from_array,
    "lowrank_pattern": lowrank_pattern,
    "lowrank_cells": lowrank_cells,
    "center_columns": center_columns,
    "center_customer_columns": center_customer_columns,
    "standardize_columns": standardize_columns,
    "standardize_scalar": standardize_scalar,
    "scale_entries": scale_entries,
    "soft_threshold": soft_thresholded,
    "get_column": get_column,
    "get_columns": get_columns,
    "restrict_support": restrict_support,
    "l2_normalize": l2_normalize,
    "support": support,
    "left_multiply": left_multiply,
    "cross_covariance": cross_covariance,
    "cross_covariance_customers": cross_covariance_customers,
    "cross_covariance_centered": cross_covariance_centered,
    "matvec": matvec,
    "matvec_t": matvec_t,
    "deflated_matvec": deflated_matvec,
    "subtract_outer": subtract_outer,
    "deflate_covariance": deflate_covariance,
    "scores": scores,
    "column_power_sums": column_power_sums,
    "max_l2_column": max_l2_column,
    "max_l2_column_support": max_l2_column_support,
    "combine_pairs": combine_pairs,
    "canonical_correlations": canonical_correlations,
    "eval_canonical_corr": eval_canonical_corr,
    "eval_prediction": eval_prediction,
    "sigma_pairs": sigma_pairs,
    "other_view_score_sum": other_view_score_sum,
    "l1_power_init": l1_power_init,
    "power_loss": power_loss,
    "l1_power_iteration": l1_power_iteration,
    "refit_on_support": refit_on_support,
    "fit_two_view": fit_two_view,
    "fit_two_view_gram": fit_two_view_gram,
    "fit_two_view_sparse": fit_two_view_sparse,
    "fit_three_view": fit_three_view,
    "fit_k2": fit_k2,
    "fit_k3_three_view": fit_k3_three_view,
    "fit_customer_views": fit_customer_views,
    "fit_customer_views_sparse": fit_customer_views_sparse,
    "fit_cells_subset_subjects": fit_cells_subset_subjects,
    "fit_two_view_converged": fit_two_view_converged,
    "fit_three_view_converged": fit_three_view_converged,
    "fit_documents": fit_documents,
    "model_roundtrip": model_roundtrip,
    "prediction_weights": prediction_weights,
    "predict_view": predict_view,
    "predict_all_views": predict_all_views,
    "predict_two_components": predict_two_components,
    "transform_frame": transform_frame,
    "transform_outcome": transform_outcome,
    "canonical_correlations_frame": canonical_correlations_frame,
    "kfold_assign": kfold_assign,
    "holdout_split": holdout,
    "cv_grid": cv_grid,
}
