"""The same input contract for every fitting plan."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import direct
from polyview import MultiViewCCA, PredictionEvaluator
from polyview.session import ensure_checkpoint_dir
from polyview.sources.views import match_subjects

PLANS = ["covariance", "gram", "sparse"]
WIDTHS = [6, 5]
CELLS = "view_idx int, row_id long, feature_id long, value double"


def views(n=24):
    rng = np.random.default_rng(7)
    return [np.round(rng.normal(size=(n, w)), 3) for w in WIDTHS]


def rows_of(xs):
    return [(v, r, f, float(x[r, f])) for v, x in enumerate(xs) for r in range(len(x)) for f in range(x.shape[1])]


def loadings(model):
    out = [np.zeros(w) for w in WIDTHS]
    for r in model.loadings.collect():
        out[r["view_idx"]][r["feature_id"]] = r["loading"]
    return out


def fit(spark, rows, plan, subjects=None):
    cells = spark.createDataFrame(rows, CELLS)
    return MultiViewCCA(plan=plan, maxIter=3, tol=0.0).fit_cells(cells, subjects, widths=WIDTHS)


@pytest.mark.parametrize("plan", PLANS)
def test_only_listed_subjects_count(spark, plan):
    xs = views()
    listed = [r for r in range(len(xs[0])) if r % 3]
    got = loadings(fit(spark, rows_of(xs), plan, spark.createDataFrame([(r,) for r in listed], "row_id long")))
    want, _ = direct.fit([x[listed] for x in xs], 1, (0.1, 0.1), cap=3, tol=0.0)
    assert all(np.abs(a - b).max() < 1e-8 for a, b in zip(got, want[0], strict=True))


FAULTS = {
    "repeated": (0, 1, 1, 2.0), "null, NaN": (0, 1, 1, None), "infinite": (0, 99, 1, float("inf")), "NaN": (0, 99, 1, float("nan")),
    "outside": (0, 1, 6, 1.0), "outside the views": (2, 1, 0, 1.0), "null key": (0, None, 1, 1.0),
}


@pytest.mark.parametrize("plan", PLANS)
def test_faults_raise(spark, plan):
    rows = rows_of(views(8))
    for fault, extra in FAULTS.items():
        kept = [r for r in rows if fault != "null, NaN" or r[:3] != extra[:3]]
        with pytest.raises(ValueError, match=fault):
            fit(spark, [*kept, extra], plan)
    for bad, words in (([(1,), (1,)], "repeated"), ([(None,)], "null")):
        with pytest.raises(ValueError, match=words):
            fit(spark, rows, plan, spark.createDataFrame(bad, "row_id long"))


@pytest.mark.parametrize("plan", PLANS)
def test_faults_of_wide_frames_raise(spark, plan):
    xs = views(8)
    rows = [(r, xs[0][r].tolist(), xs[1][r].tolist()) for r in range(8)]
    schema = "row_id long, a array<double>, b array<double>"
    cca = MultiViewCCA(inputCols=["a", "b"], plan=plan, maxIter=3)
    with pytest.raises(ValueError, match="no column"):
        cca.fit(spark.createDataFrame(rows, schema).drop("row_id"))
    with pytest.raises(ValueError, match="repeated"):
        cca.fit(spark.createDataFrame([*rows, rows[0]], schema))


def test_plans_set_by_hand_are_bounded(spark):
    rows = rows_of(views(8))
    cells = spark.createDataFrame(rows, CELLS)
    with pytest.raises(ValueError, match="wider"):
        MultiViewCCA(plan="covariance", maxCovarianceFeatures=5).fit_cells(cells, widths=WIDTHS)
    with pytest.raises(ValueError, match="more subjects"):
        MultiViewCCA(plan="gram", maxGramSubjects=5).fit_cells(cells, widths=WIDTHS)


def test_converged_fit(spark):
    xs = views(40)
    model = MultiViewCCA().fit_cells(spark.createDataFrame(rows_of(xs), CELLS), widths=WIDTHS)
    want, _ = direct.fit(xs, 1, (0.1, 0.1))
    assert all(np.abs(a - b).max() < 1e-8 for a, b in zip(loadings(model), want[0], strict=True))


def test_many_views_match(spark):
    cells = spark.createDataFrame([(v, r, 0, 1.0) for v in range(70) for r in (1, 2) if r == 1 or v < 69], CELLS)
    assert {r.row_id for r in match_subjects(cells, 70).collect()} == {1}


def test_scoring_refuses_nulls_and_default_outcome(spark):
    xs = views(12)
    rows = [(r, xs[0][r].tolist(), xs[1][r].tolist()) for r in range(12)]
    schema = "row_id long, a array<double>, b array<double>"
    frame = spark.createDataFrame(rows, schema)
    model = MultiViewCCA(inputCols=["a", "b"], maxIter=3).fit(frame)
    scored = model.transform(frame)
    assert PredictionEvaluator().evaluate(scored) == PredictionEvaluator(outcomeCol="a").evaluate(scored)
    with pytest.raises(Exception, match="null array or entry"):
        model.transform(spark.createDataFrame([*rows, (99, None, rows[0][2])], schema)).collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
