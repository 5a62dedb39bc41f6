import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import direct
from polyview import MultiViewCCA
from polyview.plans import gram, sparse
from polyview.plans.common import FitOptions, Progress
from polyview.plans.covariance import power_pair
from polyview.sources import cells_from_arrays, read_matrix_text

PLANS = ["covariance", "gram", "sparse"]


def frame(spark, xs, ids=None):
    n = len(xs[0])
    ids = range(n) if ids is None else ids
    rows = [(int(r), *[x[p].tolist() for x in xs]) for p, r in enumerate(ids)]
    cols = ", ".join(f"v{i} array<double>" for i in range(len(xs)))
    return spark.createDataFrame(rows, f"row_id bigint, {cols}")


def dense(model):
    out = [np.zeros((model.getK(), w)) for w in model.widths]
    for r in model.loadings.collect():
        out[r["view_idx"]][r["component"], r["feature_id"]] = r["loading"]
    return out


def correlated(n, widths, seed=0):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(n, 3))
    return [u @ (rng.normal(size=(3, p)) * (rng.uniform(size=p) < 0.5)) + 0.5 * rng.normal(size=(n, p)) + 3
            for p in widths]


CASES = [
    (plan, *case)
    for plan in ("covariance", "gram")
    for case in [
        ((12, 9), 2, (0.2, 0.4), False, 1000),
        ((8, 11, 6), 3, (0.1, 0.3, 0.2), False, 1000 if plan == "covariance" else 5),
        ((8, 11, 6), 3, (0.3, 0.3, 0.3), True, 5),
    ]
] + [
    ("sparse", (8, 11, 6), 2, (0.1, 0.3, 0.2), False, 3),
    ("sparse", (9, 7), 3, (0.3, 0.3), True, 3),
]


@pytest.mark.parametrize("plan,widths,k,rhos,full,cap", CASES)
def test_plans_match_direct_form(spark, plan, widths, k, rhos, full, cap):
    xs = correlated(40, widths)
    want, sigma = direct.fit(xs, k, rhos, full=full, cap=cap)
    model = MultiViewCCA(
        inputCols=[f"v{i}" for i in range(len(widths))], k=k, rhos=rhos, plan=plan,
        fullDeflation=full, maxIter=cap,
    ).fit(frame(spark, xs))
    got = dense(model)
    for c in range(k):
        for i in range(len(widths)):
            assert np.abs(got[i][c] - want[c][i]).max() < 1e-8
    for r in model.sigma.collect():
        if r["view_i"] != r["view_j"]:
            assert r["sigma"] == pytest.approx(sigma[r["component"]][r["view_i"], r["view_j"]], abs=1e-7)
        else:
            assert r["sigma"] == 0
    means = {(i, c): xs[i].mean(0) @ want[c][i] for i in range(len(widths)) for c in range(k)}
    for c, i, m in model._result.score_means:
        assert m == pytest.approx(means[i, c], abs=1e-7)


@pytest.mark.parametrize("plan", PLANS)
def test_without_centring(spark, plan):
    xs = correlated(30, (7, 8), seed=3)
    want, _ = direct.fit(xs, 1, (0.1, 0.1), centered=False, cap=3)
    model = MultiViewCCA(
        inputCols=["v0", "v1"], standardization=False, plan=plan, maxIter=3).fit(frame(spark, xs))
    for i, z in enumerate(dense(model)):
        assert np.abs(z[0] - want[0][i]).max() < 1e-8


# A published single-pair example with two matrices on 5 subjects.
LEFT = np.array([
    [0.005146443, 0.022261778, -1.539553e-04, -0.004892040, 0.034279120,
     0.019231456, 0.0033527404, -0.007459772, 0.007264192, -0.024504849],
    [-0.004373749, -0.018919362, 1.308402e-04, 0.004157542, -0.029132402,
     -0.016344016, -0.0028493550, 0.006339751, -0.006173536, 0.020825654],
    [0.002724898, 0.011786992, -8.151504e-05, -0.002590199, 0.018149839,
     0.010182520, 0.0017751827, -0.003949742, 0.003846187, -0.012974635],
    [-0.001299829, -0.005622623, 3.888425e-05, 0.001235575, -0.008657825,
     -0.004857259, -0.0008467965, 0.001884103, -0.001834706, 0.006189152],
    [0.003203071, 0.013855403, -9.581951e-05, -0.003044734, 0.021334819,
     0.011969375, 0.0020866962, -0.004642852, 0.004521126, -0.015251457],
])
RIGHT = np.array([
    [-0.019976273, 0.017104130, 0.019716665, -3.778085e-04, 0.0030775849, -0.010618072, -0.012964638],
    [0.016977005, -0.014536090, -0.016756376, 3.210838e-04, -0.0026155117, 0.009023859, 0.011018108],
    [-0.010576880, 0.009056160, 0.010439425, -2.000391e-04, 0.0016294955, -0.005621974, -0.006864415],
    [0.005045377, -0.004319964, -0.004979808, 9.542251e-05, -0.0007773009, 0.002681790, 0.003274459],
    [-0.012432938, 0.010645358, 0.012271362, -2.351424e-04, 0.0019154435, -0.006608532, -0.008069000],
])
RIGHT_WEIGHTS = [0.55190880, -0.46373971, -0.54393937, 0.0, -0.03315256, 0.26463059, 0.33666552]
LEFT_WEIGHTS = [0.03808095, 0.41733973, 0.0, -0.03244362, 0.68363205, 0.35019080, 0.0,
                -0.08934201, 0.08500815, -0.46704394]


def test_single_pair_values():
    opts = FitOptions()
    z2, r2, _ = power_pair(RIGHT.T @ LEFT, 0.1, opts)
    z2 = direct.unit(direct.shrink(z2, r2))
    assert np.abs(z2 - RIGHT_WEIGHTS).max() < 1e-7
    keep = np.flatnonzero(z2)
    z1, r1, _ = power_pair(LEFT.T @ RIGHT[:, keep], 0.1, opts)
    assert np.abs(direct.unit(direct.shrink(z1, r1)) - LEFT_WEIGHTS).max() < 1e-7


def test_single_pair_values_on_spark(spark):
    """The same two pairs through the distributed steps of both long plans."""
    opts = FitOptions(centered=False)
    cells = cells_from_arrays(frame(spark, [RIGHT, LEFT]), "row_id", ["v0", "v1"]).persist()
    parts = [cells.filter(F.col("view_idx") == i).select("row_id", "feature_id", "value") for i in (0, 1)]
    ms = [sparse.Matrix(c, 5, w, False, 4, 50) for c, w in zip(parts, (7, 10))]
    right, left = (sparse.Side(m, []) for m in ms)

    def run(a, b, width):
        raw, bound, _ = sparse._power_pair(a, b, np.zeros(0), 0.1, opts)
        z = np.zeros(width)
        for r in raw.collect():
            z[r["feature_id"]] = r["value"]
        return direct.unit(direct.shrink(z, bound))

    z2 = run(left, right, 7)
    assert np.abs(z2 - RIGHT_WEIGHTS).max() < 1e-7
    support = spark.createDataFrame([(int(f),) for f in np.flatnonzero(z2)], "feature_id bigint")
    z1 = run(sparse.Side(ms[0].restrict(support, 6), []), left, 10)
    assert np.abs(z1 - LEFT_WEIGHTS).max() < 1e-7


GOLDEN = os.environ.get("POLYVIEW_GOLDEN_DIR")


@pytest.mark.skipif(not GOLDEN, reason="POLYVIEW_GOLDEN_DIR is not set")
@pytest.mark.parametrize("plan", PLANS)
def test_golden_three_views(spark, plan):
    """X1..X3 in, first column of Z1..Z3 out, all whitespace-separated files."""
    cells = None
    for i in range(3):
        part = read_matrix_text(spark, f"{GOLDEN}/X{i + 1}.tsv", i)
        cells = part if cells is None else cells.unionByName(part)
    model = MultiViewCCA(plan=plan).fit_cells(cells.persist())
    for i, z in enumerate(dense(model)):
        want = np.loadtxt(f"{GOLDEN}/Z{i + 1}.tsv")[:, 0]
        assert np.abs(z[0] - want).max() < 1e-8


@pytest.mark.parametrize("losses, limit, reason", [
    ([1.0], 2, None), ([0.0], 9, None), ([1.0, 0.0], 9, "zero"), ([1.0, 1.00001], 9, "converged"), ([1.0, 2.0], 3, "limit"),
    ([1.0, 2.0], 4, None), ([1.0, 2.0], 2, None), ([0.0, 2.0], 9, None), ([float("nan")] * 4, 5, "limit"), ([-1.0, -1.0], 9, "converged"),
])
def test_course_of_losses(losses, limit, reason):
    course = Progress(FitOptions(max_iter=limit, tol=1e-4))
    for loss in losses:
        assert course.reason is None
        course.step(loss)
    assert course.reason == reason and course.steps == len(losses)


@pytest.mark.parametrize("plan", ["covariance", "gram"])
def test_order_and_partitions_do_not_matter(spark, plan):
    xs = correlated(30, (9, 7), seed=5)
    base = frame(spark, xs)
    a = dense(MultiViewCCA(inputCols=["v0", "v1"], plan=plan).fit(base))
    b = dense(MultiViewCCA(inputCols=["v0", "v1"], plan=plan).fit(base.orderBy(F.desc("row_id")).repartition(3)))
    assert all(np.abs(x - y).max() < 1e-9 for x, y in zip(a, b))
    assert all(abs(np.linalg.norm(z[0]) - 1) < 1e-12 for z in a)


@pytest.mark.parametrize("plan", PLANS)
def test_zero_view_and_full_shrinkage(spark, plan):
    xs = correlated(20, (5, 6, 4), seed=1)
    xs[2] = np.zeros_like(xs[2])
    model = MultiViewCCA(inputCols=["v0", "v1", "v2"], plan=plan, maxIter=3).fit(frame(spark, xs))
    got = dense(model)
    want, _ = direct.fit(xs[:2], 1, (0.1, 0.1), cap=3)
    assert not got[2].any()
    assert np.abs(got[0][0] - want[0][0]).max() < 1e-8
    none = MultiViewCCA(inputCols=["v0", "v1"], plan=plan, rhos=[1.0], maxIter=3).fit(frame(spark, xs[:2]))
    assert np.isfinite(np.concatenate([z.ravel() for z in dense(none)])).all()


@pytest.mark.parametrize("plan", ["covariance", "gram"])
def test_equal_columns_take_the_first(spark, plan):
    xs = correlated(25, (6, 5), seed=2)
    xs[0][:, 3] = xs[0][:, 1]
    xs[0][:, 1] *= 1.0
    want, _ = direct.fit(xs, 1, (0.3, 0.3))
    got = dense(MultiViewCCA(inputCols=["v0", "v1"], rhos=[0.3], plan=plan).fit(frame(spark, xs)))
    for i in range(2):
        assert np.abs(got[i][0] - want[0][i]).max() < 1e-8


def test_strongest_column_is_exact(spark):
    """The bounded search against brute force, with many small batches."""
    rng = np.random.default_rng(8)
    for seed in range(2):
        xs = [rng.normal(size=(30, p)) * (rng.uniform(size=(30, p)) < 0.3) for p in (15, 90)]
        xs[1][:, 40] = xs[1][:, 20] = xs[1][:, 20] * 4
        cells = cells_from_arrays(frame(spark, xs), "row_id", ["v0", "v1"]).filter("value != 0")
        ms = [
            sparse.Matrix(cells.filter(F.col("view_idx") == i).select("row_id", "feature_id", "value"),
                          30, p, True, 4, 500)
            for i, p in enumerate((15, 90))]
        sides = [sparse.Side(m, []) for m in ms]
        top, best, column, evaluated = sparse.strongest_column(*sides, np.zeros(0), batch=2, direct=0)
        cov = (xs[0] - xs[0].mean(0)).T @ (xs[1] - xs[1].mean(0))
        norms = np.linalg.norm(cov, axis=0)
        assert top == pytest.approx(norms.max(), rel=1e-10)
        assert best == int(np.argmax(np.round(norms, 9)))
        got = np.zeros(15)
        for r in column.collect():
            got[r["feature_id"]] = r["value"]
        assert np.abs(got - cov[:, best]).max() < 1e-9
        bounds = {r["feature_id"]: r["bound"] for r in sparse.column_bounds(*sides, np.zeros(0)).collect()}
        assert all(bounds[f] >= norms[f] - 1e-9 for f in bounds)


def test_heavy_subject_is_spread(spark):
    """One subject with most of the cells goes through the spread path."""
    rng = np.random.default_rng(4)
    xs = [np.zeros((40, 1500)), np.zeros((40, 1400))]
    for x in xs:
        x[0] = rng.normal(size=x.shape[1]) * 3
        for r in range(1, 40):
            x[r, rng.choice(x.shape[1], 20)] = rng.normal(size=20)
    cells = None
    for i, x in enumerate(xs):
        r, f = np.nonzero(x)
        part = spark.createDataFrame(
            [(i, int(a), int(b), float(x[a, b])) for a, b in zip(r, f)],
            "view_idx int, row_id bigint, feature_id bigint, value double")
        cells = part if cells is None else cells.unionByName(part)
    cells = cells.persist()
    one = cells.filter("view_idx = 0").select("row_id", "feature_id", "value")
    assert sparse.Placed(one, "row_id", 8, one.count()).heavy is not None
    models = [
        MultiViewCCA(plan=p, maxIter=3, tol=0.0).fit_cells(cells, widths=[1500, 1400])
        for p in ("gram", "sparse")]
    a, b = (dense(m) for m in models)
    assert all(np.abs(x - y).max() < 1e-8 for x, y in zip(a, b))


@pytest.mark.parametrize("plan", ["gram", "sparse"])
def test_vectors_too_large_to_broadcast(spark, monkeypatch, plan):
    """With a tiny broadcast bound every lookup moves both sides instead."""
    from polyview import session
    for module in (session, gram, sparse):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 3)
    xs = correlated(30, (9, 7), seed=12)
    want, _ = direct.fit(xs, 2, (0.1, 0.1), cap=3)
    model = MultiViewCCA(inputCols=["v0", "v1"], k=2, plan=plan, maxIter=3).fit(frame(spark, xs))
    got = dense(model)
    assert all(np.abs(got[i][c] - want[c][i]).max() < 1e-8 for i in range(2) for c in range(2))


def test_parameters(spark):
    cca = MultiViewCCA()
    assert (cca.getK(), cca.getMaxIter(), cca.getRhos(), cca.getTol()) == (1, 1000, [0.1], 1e-4)
    assert cca.getStandardization() and not cca.getVerbose()
    assert cca.setK(2).setRhos([0.2]).setTol(0.1).setMaxIter(9).getK() == 2
    for bad in (lambda: cca.setK(0), lambda: cca.setRhos([1.5]), lambda: MultiViewCCA(rhos=[-0.1])):
        with pytest.raises(ValueError):
            bad()
    df = frame(spark, correlated(10, (3, 4)))
    with pytest.raises(ValueError):
        MultiViewCCA(inputCols=["v0"]).fit(df)
    with pytest.raises(ValueError):
        MultiViewCCA(inputCols=["v0", "v1"], rhos=[0.1, 0.2, 0.3]).fit(df)
    base = MultiViewCCA(inputCols=["v0", "v1"])
    models = base.fit(df, [{base.rhos: [0.1]}, {base.rhos: [0.6], base.k: 2}])
    assert [m.getK() for m in models] == [1, 2]
    assert models[1].getRhos() == [0.6]


def test_auto_plan(spark):
    cca = MultiViewCCA(maxCovarianceFeatures=10, maxGramSubjects=50)
    assert cca._choose([5, 5], lambda: 10**9) == "covariance"
    assert cca._choose([50, 5], lambda: 50) == "gram"
    assert cca._choose([50, 5], lambda: 51) == "sparse"
    assert gram.fit is not sparse.fit
