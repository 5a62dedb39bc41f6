import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from polyview import (
    CanonicalCorrelationEvaluator, MultiViewCCA, MultiViewCCAModel, PredictionEvaluator,
    fold_column, holdout_split,
)
from polyview.ml.tuning import kth_key
from polyview.operators import mean_correlation, wide
from polyview.plans.common import FitResult
from polyview.sources import cells_from_arrays
from test_fit import correlated, dense, frame

COLS = ["v0", "v1", "v2"]


@pytest.fixture(scope="module")
def data():
    return correlated(25, (6, 8, 5), seed=7)


@pytest.fixture(scope="module")
def fitted(spark, data):
    df = frame(spark, data).persist()
    return MultiViewCCA(inputCols=COLS, k=2, rhos=[0.3]).fit(df), df


def expected(xs, zs, means=None):
    centred = [x - (x.mean(0) if means is None else m) for x, m in zip(xs, means or xs)]
    s = [x @ z.T for x, z in zip(centred, zs)]
    return s, [sum(s[j] for j in range(3) if j != o) @ np.linalg.pinv(zs[o]).T for o in range(3)]


def safe(a, b):
    return np.corrcoef(a, b)[0, 1] if a.std() > 1e-12 and b.std() > 1e-12 else 0.0


def test_transform(fitted, data):
    model, df = fitted
    scores, predictions = expected(data, dense(model))
    rows = model.transform(df).orderBy("row_id").collect()
    for i in range(3):
        assert np.allclose([r[f"score_v{i}"] for r in rows], scores[i])
        assert np.allclose([r[f"prediction_v{i}"] for r in rows], predictions[i])


def test_transform_of_one_view(fitted, data):
    model, df = fitted
    _, predictions = expected(data, dense(model))
    out = model.transform(df, {model.outcomeCol: "v1"})
    assert [c for c in out.columns if c.startswith("prediction")] == ["prediction_v1"] and not any(c.startswith("_") for c in out.columns)
    assert np.allclose([r.prediction_v1 for r in out.orderBy("row_id").collect()], predictions[1])
    with pytest.raises(ValueError):
        model.copy().setOutcomeCol("row_id")


def test_transform_of_wide_views(spark):
    """Two million features and as many loadings in the second view; the plan holds none of them."""
    width, n = 2_000_000, 3
    cells = [(0, 5, 2.0), (0, width - 1, -1.0), (1, 0, 0.5), (1, 7, 3.0)]
    one = spark.createDataFrame([(0, v, f, z) for v, f, z in cells], "component int, view_idx int, feature_id bigint, loading double")
    rest = spark.range(100, width, 10).selectExpr("1 component", "1 view_idx", "id feature_id", "id / 1e6 loading")
    model = MultiViewCCAModel(FitResult(one.unionByName(rest), [], [], [width, width]))
    model._set(inputCols=["a", "b"], k=2)
    xs = [np.array([(np.arange(width) * a + row * row * b) % c / 8 for row in range(n)]) for a, b, c in ((7, 13, 101), (11, 5, 97))]
    z = np.zeros((2, 2, width))
    for v, f, w in cells:
        z[v, 0, f] = w
    z[1, 1, 100::10] = np.arange(100, width, 10) / 1e6
    every = F.sequence(F.lit(0), F.lit(width - 1))
    frame = spark.range(n).select(F.col("id").alias("row_id"), *[
        F.transform(every, lambda f: (f * a + F.col("id") * F.col("id") * b) % c / 8).alias(name)  # noqa: B023
        for name, a, b, c in (("a", 7, 13, 101), ("b", 11, 5, 97))])
    out = model.transform(frame)
    assert len(out._jdf.queryExecution().toString()) < 100_000
    got = out.orderBy("row_id").toArrow()
    s = [(x - x.mean(0)) @ w.T for x, w in zip(xs, z)]
    for i in range(2):
        assert np.allclose(got[f"score_{'ab'[i]}"].to_pylist(), s[i])
        want = s[1 - i] @ np.linalg.pinv(z[i] @ z[i].T) @ z[i]
        assert np.allclose(got[f"prediction_{'ab'[i]}"].combine_chunks().flatten().to_numpy().reshape(n, width), want)


def test_courses(fitted):
    model, _ = fitted
    assert set(model.stop_reasons.values()) <= {"converged", "zero", "limit"}
    assert model.steps.keys() == model.losses.keys() and all(len(model.losses[key]) == n for key, n in model.steps.items())


def test_transform_matches_long_form(fitted, data):
    model, df = fitted
    cells = cells_from_arrays(df, "row_id", COLS)
    _, predictions = expected(data, dense(model))
    for outcome in (None, 1):
        got = [np.full(x.shape, np.nan) for x in data]
        for r in model.predict_cells(cells, outcome=outcome).collect():
            got[r["view_idx"]][r["row_id"], r["feature_id"]] = r["prediction"]
        for o in range(3):
            if outcome in (None, o):
                assert np.allclose(got[o], predictions[o])
            else:
                assert np.isnan(got[o]).all()
    some = model.predict_cells(cells, dense=False)
    assert some.select("view_idx", "feature_id").distinct().count() == model.support().select(
        "view_idx", "feature_id").distinct().count()
    metric = mean_correlation(cells.filter("view_idx = 0"), some, 6).first()[0]
    want = np.mean([safe(predictions[0][:, f], data[0][:, f]) for f in range(6)])
    assert metric == pytest.approx(want)


def test_long_form_in_chunks(fitted, data, monkeypatch):
    """The join on (view, chunk) that is used when weights may not be broadcast."""
    from polyview.operators import scoring
    model, df = fitted
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 0)
    cells = cells_from_arrays(df, "row_id", COLS)
    table = model._score_table(cells, None, True)
    sums = scoring.other_view_sums(table, 3, 2)
    out = scoring.predict_cells(sums, scoring.prediction_weights(model.loadings), [6, 8, 5], chunk=3)
    _, predictions = expected(data, dense(model))
    got = [np.full(x.shape, np.nan) for x in data]
    for r in out.collect():
        got[r["view_idx"]][r["row_id"], r["feature_id"]] = r["prediction"]
    assert all(np.allclose(a, b) for a, b in zip(got, predictions))


def test_training_centring(spark, fitted, data):
    model, df = fitted
    one = df.filter("row_id = 3")
    batch = model.transform(one).first()
    assert np.allclose(batch["prediction_v0"], 0)
    model = model.copy({model.centering: "training"})
    scores, predictions = expected([x[3:4] for x in data], dense(model), [x.mean(0) for x in data])
    row = model.transform(one).first()
    assert np.allclose(row["score_v1"], scores[1][0]) and np.allclose(row["prediction_v0"], predictions[0][0])
    long = model.score_cells(cells_from_arrays(one, "row_id", COLS)).filter("view_idx = 1").orderBy("component")
    assert np.allclose([r["score"] for r in long.collect()], scores[1][0])


def test_correlations_of_arrays_from_moments(spark):
    """Several chunks of features and tasks; large means, constant columns, rows without an array."""
    rng, n, p = np.random.default_rng(8), 90, 2 * wide.CHUNK + 5
    a = rng.normal(size=(n, p)) + 1e7 * (np.arange(p) % 3 == 0)
    b = a * rng.normal(size=p) + rng.normal(size=(n, p))
    a[:, 4], b[:, 7] = 0.1, 0.0
    rows = [(x, y) for x, y in zip(a.tolist(), b.tolist())] + [(None, b[0].tolist()), (a[0].tolist(), None)]
    frame = spark.createDataFrame(rows, "x array<double>, prediction_x array<double>").repartition(7)
    want = np.mean([safe(b[:, f], a[:, f]) if f not in (4, 7) else 0.0 for f in range(p)])
    judge = PredictionEvaluator(outcomeCol="x")
    assert judge.evaluate(frame) == pytest.approx(want, rel=1e-7)
    assert "Generate" not in judge.metric(frame)._jdf.queryExecution().executedPlan().toString()
    assert judge.metric(frame.limit(0)).first()[0] is None
    for bad in ([(a[0].tolist(), b[0].tolist()[1:])], [([None, 1.0], [1.0, 2.0])]):
        with pytest.raises(PySparkException):
            judge.evaluate(spark.createDataFrame(bad, frame.schema))


def test_correlations_and_evaluators(fitted, data):
    model, df = fitted
    scores, predictions = expected(data, dense(model))
    got = {tuple(r)[:3]: r["corr"] for r in model.canonical_correlations(cells_from_arrays(df, "row_id", COLS)).collect()}
    assert len(got) == 2 * 9
    frame_form = {tuple(r)[:3]: r["corr"] for r in model.canonical_correlations_frame(df).collect()}
    assert frame_form.keys() == got.keys() and all(frame_form[key] == pytest.approx(v) for key, v in got.items())
    for (c, i, j), value in got.items():
        assert value == pytest.approx(1.0 if i == j else np.corrcoef(scores[i][:, c], scores[j][:, c])[0, 1])
    out = model.transform(df)
    judge = CanonicalCorrelationEvaluator(inputCols=COLS)
    assert judge.evaluate(out) == pytest.approx(np.mean(list(got.values())))
    off = [v for (_, i, j), v in got.items() if i != j]
    assert judge.setOffDiagonalOnly(True).evaluate(out) == pytest.approx(np.mean(off))
    for o in range(3):
        want = np.mean([safe(predictions[o][:, f], data[o][:, f]) for f in range(data[o].shape[1])])
        assert PredictionEvaluator(outcomeCol=f"v{o}").evaluate(out) == pytest.approx(want)
    swap = PredictionEvaluator(outcomeCol="v0")
    want = PredictionEvaluator(outcomeCol="v1").evaluate(out)
    assert swap.evaluate(out, {swap.outcomeCol: "v1"}) == pytest.approx(want)
    assert swap.isLargerBetter()


def test_vector_columns_and_long_fit_agree(spark, fitted):
    model, df = fitted
    vectors = df.select("row_id", *[array_to_vector(c).alias(c) for c in COLS])
    cca = MultiViewCCA(inputCols=COLS, k=2, rhos=[0.3])
    other = cca.fit(vectors)
    long = cca.fit_cells(cells_from_arrays(df, "row_id", COLS))
    for a, b, c in zip(dense(model), dense(other), dense(long)):
        assert np.abs(a - b).max() < 1e-10 and np.abs(a - c).max() < 1e-10
    p = [r["prediction_v2"] for r in other.transform(vectors).orderBy("row_id").collect()]
    q = [r["prediction_v2"] for r in model.transform(df).orderBy("row_id").collect()]
    assert np.allclose(p, q)


def test_absent_cells_count_as_zero(spark):
    xs = [np.where(x > 3, x, 0) for x in correlated(20, (6, 7), seed=11)]
    xs[0][4] = xs[1][4] = 0
    df = frame(spark, xs)
    cells = cells_from_arrays(df, "row_id", ["v0", "v1"]).filter("value != 0")
    want = dense(MultiViewCCA(inputCols=["v0", "v1"], maxIter=3).fit(df))
    ids = spark.range(20).select(F.col("id").alias("row_id"))
    for plan in ("covariance", "gram", "sparse"):
        got = dense(MultiViewCCA(plan=plan, maxIter=3).fit_cells(cells, ids, [6, 7]))
        assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(want, got))


def test_save_and_load(fitted, tmp_path):
    model, df = fitted
    path = str(tmp_path / "model")
    model.save(path)
    again = MultiViewCCAModel.load(path)
    assert again.uid == model.uid and again.getK() == 2 and again.getInputCols() == COLS
    assert all((a == b).all() for a, b in zip(dense(model), dense(again)))
    assert sorted(again.sigma.collect()) == sorted(model.sigma.collect())
    a = model.transform(df).orderBy("row_id").collect()
    b = again.transform(df).orderBy("row_id").collect()
    assert np.allclose([r["prediction_v0"] for r in a], [r["prediction_v0"] for r in b])
    model.write().overwrite().save(path)
    cca = MultiViewCCA(inputCols=COLS, k=3, rhos=[0.2, 0.3, 0.4])
    cca.save(str(tmp_path / "estimator"))
    assert MultiViewCCA.load(str(tmp_path / "estimator")).getRhos() == [0.2, 0.3, 0.4]


def test_cross_validation(spark, data, tmp_path):
    df = frame(spark, data).withColumn("fold", F.col("row_id").cast("int") % 3)
    cca = MultiViewCCA(inputCols=COLS, maxIter=20)
    grid = ParamGridBuilder().baseOn({cca.k: 1}).addGrid(cca.rhos, [[0.1], [0.5], [0.9]]).build()
    judge = PredictionEvaluator(outcomeCol="v0")
    found = CrossValidator(estimator=cca, estimatorParamMaps=grid, evaluator=judge,
                           numFolds=3, foldCol="fold", parallelism=3).fit(df)
    means = []
    for point in grid:
        folds = []
        for f in range(3):
            model = cca.fit(df.filter(F.col("fold") != f), point)
            folds.append(judge.evaluate(model.transform(df.filter(F.col("fold") == f))))
        means.append(np.mean(folds))
    assert np.allclose(found.avgMetrics, means)
    assert found.bestModel.getRhos() == grid[int(np.argmax(means))][cca.rhos]
    found.write().save(str(tmp_path / "cv"))
    again = CrossValidatorModel.load(str(tmp_path / "cv"))
    assert np.allclose(again.avgMetrics, means)
    assert all((a == b).all() for a, b in zip(dense(found.bestModel), dense(again.bestModel)))


def test_splits(spark):
    ids = spark.range(1000).select(F.col("id").alias("row_id"))
    folds = ids.withColumn("f", fold_column("row_id", 4, seed=5))
    counts = {r["f"]: r["count"] for r in folds.groupBy("f").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and min(counts.values()) > 150
    assert sorted(folds.collect()) == sorted(folds.repartition(3).collect())
    train, test = holdout_split(ids, "row_id", 800)
    assert train.count() == 800 and test.agg(F.min("row_id")).first()[0] == 800


def test_kth_key(spark):
    rng = np.random.default_rng(8)
    for keys in ([5], [-(1 << 63), 0, (1 << 63) - 1], [int(x) for x in rng.choice(10**6, 300, replace=False)],
                 [int(x) for x in np.unique(rng.integers(-(1 << 62), 1 << 62, 200))]):
        frame = spark.createDataFrame([(k, 1) for k in keys], "key long, other int")
        ranked = sorted(keys)
        for k in {0, len(keys) // 2, len(keys) - 1}:
            assert kth_key(frame, "key", k, 16) == ranked[k]
        assert kth_key(frame, "key", len(keys)) is None
        train, test = holdout_split(frame, "key", len(keys) // 3)
        assert sorted(r.key for r in train.collect()) == ranked[:len(keys) // 3]
        assert sorted(r.key for r in test.collect()) == ranked[len(keys) // 3:]
    assert holdout_split(frame.limit(0), "key", 3)[0].count() == 0
