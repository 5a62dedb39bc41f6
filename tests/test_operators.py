import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyview import operators as ops
from polyview.functions import safe_corr, soft_threshold, sparse_dot
from polyview.operators import scoring
from polyview.sources import (
    cells_from_arrays, cells_from_columns, cells_from_facts, dense_index, feature_vectors,
    feature_vectors_from_arrays, fill_missing, low_rank_cells, match_subjects, matrix_rows,
    ordered_cells, read_matrix_text, vector_table,
)

CELLS = "view_idx int, row_id bigint, feature_id bigint, value double"


def cells_of(spark, x, view=0, drop_zeros=False):
    rows = [(view, r, f, float(v)) for (r, f), v in np.ndenumerate(np.asarray(x, float))
            if v or not drop_zeros]
    return spark.createDataFrame(rows, CELLS)


def vector(spark, values, key="feature_id"):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"{key} bigint, value double")


def array(df, rows, cols, shape, value="value"):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple([r[rows], r[cols]] if cols else [r[rows]])] = r[value]
    return out


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(12, 7)) + 2


def test_left_multiply_integers(spark):
    x = [[1, 2, 3, 4, 5, 6, 7, 8, 9]] * 3
    m = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]])
    matrix = spark.createDataFrame(
        [(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "out_row bigint, row_id bigint, value double")
    for width in (32, 3):
        got = ops.left_multiply(matrix, cells_of(spark, x), width)
        assert (array(got, "out_row", "feature_id", (4, 9)) == m @ np.array(x)).all()


def test_largest_column_integers(spark):
    x = [[1, 2, 3, 4, 5, 6, 7, 8, 10, 9, 10],
         [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10],
         [1, 2, 3, 4, 5, 6, 7, 8, 11, 9, 10]]
    got = ops.max_l2_column(cells_of(spark, x)).orderBy("row_id").collect()
    assert got[0]["norm"] == np.sqrt(302) and [r["value"] for r in got] == [10, 9, 11]
    rows = spark.createDataFrame([(0,), (1,)], "row_id bigint")
    got = ops.max_l2_column(cells_of(spark, x), rows).orderBy("row_id").collect()
    assert got[0]["norm"] == np.sqrt(200) and [r["value"] for r in got] == [10, 10]
    tied = ops.max_l2_column(cells_of(spark, [[1, 3, 3], [2, 4, 4]])).collect()
    assert {r["feature_id"] for r in tied} == {1}
    with pytest.raises(ValueError):
        ops.max_l2_column(cells_of(spark, x), rows.filter("row_id < 0"))


def test_subtract_outer_integers(spark):
    x = np.array([[1, 2, 3, 4, 5, 6, 7, 8, 9]] * 3)
    got = ops.subtract_outer(cells_of(spark, x), vector(spark, [1, 1, 1], "row_id"), vector(spark, range(1, 10)))
    assert (array(got, "row_id", "feature_id", (3, 9)) == 0).all() and got.count() == 27


def test_column_power_sums(spark):
    x = np.vstack([np.arange(1, 7).reshape(2, 3).T, np.arange(13, 19).reshape(2, 3).T])
    wide = np.hstack([x, np.vstack([np.arange(7, 13).reshape(2, 3).T, np.arange(19, 25).reshape(2, 3).T])])
    got = ops.column_power_sums(cells_of(spark, wide)).orderBy("feature_id").collect()
    assert [r["total"] for r in got] == [48, 66, 84, 102]
    got = ops.column_power_sums(cells_of(spark, wide), 2).orderBy("feature_id").collect()
    assert [r["total"] for r in got] == list((wide ** 2).sum(0))


def test_products_match_numpy(spark, x):
    y = np.random.default_rng(1).normal(size=(12, 40))
    cx, cy = cells_of(spark, x), cells_of(spark, y)
    got = ops.cross_covariance(cx, cy, width=8)
    assert np.allclose(array(got, "left_feature", "right_feature", (7, 40)), x.T @ y)
    z, u = np.arange(7.0), np.arange(12.0)
    assert np.allclose(array(ops.matvec(cx, vector(spark, z)), "row_id", None, (12,)), x @ z)
    assert np.allclose(array(ops.matvec_t(cx, vector(spark, u, "row_id")), "feature_id", None, (7,)), x.T @ u)
    lz, rz, s = np.random.default_rng(2).normal(size=(2, 7)), np.random.default_rng(3).normal(size=(2, 40)), [2.0, -1.0]
    load = [spark.createDataFrame([(c, f, float(v)) for (c, f), v in np.ndenumerate(m)],
                                  "component int, feature_id bigint, loading double") for m in (lz, rz)]
    sig = spark.createDataFrame(list(enumerate(s)), "component int, sigma double")
    got = ops.deflated_matvec(cx, cy, vector(spark, z), *load, sig)
    want = y.T @ (x @ z) - rz.T @ (np.array(s) * (lz @ z))
    assert np.allclose(array(got, "feature_id", None, (40,)), want)
    cov = ops.cross_covariance(cx, cy)
    got = ops.deflate_covariance(cov, vector(spark, lz[0]), vector(spark, rz[0]), 3.0)
    assert np.allclose(array(got, "left_feature", "right_feature", (7, 40)), x.T @ y - 3 * np.outer(lz[0], rz[0]))


def test_projections_match_numpy(spark, x):
    c = cells_of(spark, x)
    full = lambda df: array(df, "row_id", "feature_id", x.shape)
    assert np.allclose(full(ops.center_columns(c, 7)), x - x.mean(0))
    assert np.allclose(full(ops.standardize_scalar(c, 1, 2)), (x - 1) / 2)
    stats = spark.createDataFrame([(0, f, float(f), float(f + 1)) for f in range(7)],
                                  "view_idx int, feature_id bigint, center double, scale double")
    assert np.allclose(full(ops.standardize_columns(c, stats)), (x - np.arange(7)) / np.arange(1, 8))
    assert np.allclose(array(ops.get_column(c, 3, 2), "row_id", "feature_id", (12, 1)), x[:, [3]] / 2)
    assert np.allclose(array(ops.get_columns(c, [5, 0, 5]), "row_id", "feature_id", (12, 3)), x[:, [5, 0, 5]])
    v = np.array([3.0, -0.5, 0.0, -4.0])
    got = array(ops.soft_threshold_vector(vector(spark, v), 1.0), "feature_id", None, (4,))
    assert (got == [2, 0, 0, -3]).all()
    assert np.allclose(array(ops.l2_normalize(vector(spark, v)), "feature_id", None, (4,)), v / np.linalg.norm(v))
    assert (array(ops.l2_normalize(vector(spark, [0, 0])), "feature_id", None, (2,)) == 0).all()
    assert {r[0] for r in ops.support(vector(spark, v)).collect()} == {0, 1, 3}
    kept = ops.restrict_support(c, spark.createDataFrame([(2,), (4,)], "feature_id bigint"))
    assert {r["feature_id"] for r in kept.select("feature_id").distinct().collect()} == {2, 4}
    with pytest.raises(ValueError):
        ops.restrict_support(c, spark.createDataFrame([], "feature_id bigint"))


def test_scalar_functions(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, [1.0, 2.0, 3.0]), (2.0, 4.5, 5.0, [0.0, 1.0, 0.0])],
                               "a double, b double, k double, v array<double>")
    row = df.agg(safe_corr(F.col("a"), F.col("b")).alias("ab"), safe_corr(F.col("a"), F.col("k")).alias("ak")).first()
    assert row["ab"] == pytest.approx(1.0) and row["ak"] == 0
    assert df.filter("a > 9").agg(safe_corr(F.col("a"), F.col("b"))).first()[0] == 0
    assert [r[0] for r in df.orderBy("a").select(sparse_dot(F.col("v"), [0, 2], [2.0, 1.0])).collect()] == [5.0, 0.0]
    assert df.select(soft_threshold(F.lit(-3.0), 1)).first()[0] == -2


def test_loaders(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0], [3.0]), (9, [4.0, 5.0], [6.0])], "k bigint, a array<double>, b array<float>")
    got = {tuple(r) for r in cells_from_arrays(df, "k", ["a", "b"]).collect()}
    assert got == {(0, 7, 0, 1.0), (0, 7, 1, 2.0), (1, 7, 0, 3.0), (0, 9, 0, 4.0), (0, 9, 1, 5.0), (1, 9, 0, 6.0)}
    wide = spark.createDataFrame([(1, 2, 3.5)], "k int, p int, q double")
    assert {tuple(r) for r in cells_from_columns(wide, "k", [["p"], ["q"]]).collect()} == {(0, 1, 0, 2.0), (1, 1, 0, 3.5)}
    for bad in ([1.0, None], [1.0, float("nan")], None):
        broken = spark.createDataFrame([(1, bad, [1.0]), (2, [1.0, 2.0], [2.0])], "k bigint, a array<double>, b array<double>")
        with pytest.raises(PySparkException):
            cells_from_arrays(broken, "k", ["a", "b"]).collect()
        kept = cells_from_arrays(broken, "k", ["a", "b"], how="drop")
        assert {r["row_id"] for r in kept.collect()} == {2}
    facts = spark.createDataFrame([(1, "x", 2.0), (1, "x", 3.0), (2, "y", 1.0)], "k int, n string, v double")
    names = dense_index(facts.select(F.col("n").alias("name")).distinct(), ["name"], "feature_id")
    got = {tuple(r) for r in cells_from_facts(facts, "k", "n", F.col("v"), 3, names, 2).collect()}
    assert got == {(3, 1, 0, 5.0), (3, 2, 1, 1.0)}


def test_subjects_are_matched_by_key(spark):
    cells = spark.createDataFrame([(0, 1, 0, 1.0), (1, 1, 0, 2.0), (0, 2, 0, 3.0), (1, 3, 0, 4.0)], CELLS)
    assert {r["row_id"] for r in match_subjects(cells, 2).collect()} == {1}
    ids = spark.createDataFrame([(1,), (2,)], "row_id bigint")
    full = fill_missing(cells, ids, [2, 1])
    assert full.count() == 6 and full.agg(F.sum("value")).first()[0] == 6.0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_dense_index(spark, bound):
    ids = spark.range(0, 3000, 3).select((F.col("id") * 7919 % 100003).alias("row_id")).repartition(5)
    got = dense_index(ids, ["row_id"], "row_idx", single_task_rows=bound).collect()
    assert [r["row_id"] for r in sorted(got, key=lambda r: r["row_idx"])] == sorted(r["row_id"] for r in got)
    assert sorted(r["row_idx"] for r in got) == list(range(1000))


def test_dense_forms(spark, x):
    sparse = np.where(x > 2, x, 0)
    cells = cells_of(spark, sparse, drop_zeros=True)
    ids = spark.range(12).select(F.col("id").alias("row_id"), F.col("id").alias("row_idx"))
    got = np.zeros(x.shape)
    for r in feature_vectors(cells, ids, 12, chunk_rows=5).collect():
        got[r["chunk"] * 5:r["chunk"] * 5 + len(r["vec"]), r["feature_id"]] = r["vec"]
        assert len(r["vec"]) == (2 if r["chunk"] == 2 else 5)
    assert (got == sparse).all()
    got = np.zeros(x.shape)
    for r in matrix_rows(cells, 7, chunk_cols=4).collect():
        got[r["row_id"], r["chunk"] * 4:r["chunk"] * 4 + len(r["vec"])] = r["vec"]
    assert (got == sparse).all()
    flat = [r["value"] for r in ordered_cells(cells_of(spark, x)).collect()]
    assert np.allclose(flat, x.ravel())
    assert [r["value"] for r in vector_table(spark, [1, 2]).orderBy("feature_id").collect()] == [1, 2]


def test_vectors_from_arrays(spark, x):
    df = spark.createDataFrame([(r * 3, v.tolist(), v[:2].tolist()) for r, v in enumerate(x)],
                               "k bigint, a array<double>, b array<double>")
    ids = dense_index(df.select(F.col("k").alias("row_id")), ["row_id"], "row_idx")
    out = feature_vectors_from_arrays(df.repartition(5), "k", [F.col("a"), F.col("b")], ids, 12, chunk_cols=3)
    got = {(r["view_idx"], r["feature_id"]): r["vec"] for r in out.collect()}
    assert len(got) == 9
    assert all(got[0, f] == x[:, f].tolist() for f in range(7)) and got[1, 1] == x[:, 1].tolist()
    broken = df.withColumn("b", F.when(F.col("k") != 3, F.col("b")))
    with pytest.raises(PySparkException):
        feature_vectors_from_arrays(broken, "k", [F.col("a"), F.col("b")], ids, 12).collect()


def test_text_matrix(spark, tmp_path, x):
    np.savetxt(tmp_path / "m.txt", x)
    got = array(read_matrix_text(spark, str(tmp_path / "m.txt"), 1), "row_id", "feature_id", x.shape)
    assert (got == x).all()
    keyed = np.hstack([np.arange(12)[:, None] * 5, x])
    np.savetxt(tmp_path / "k.txt", keyed, fmt=["%d"] + ["%.18e"] * 7)
    rows = {r["row_id"] for r in read_matrix_text(spark, str(tmp_path / "k.txt"), 0, row_id_first=True).collect()}
    assert rows == set(range(0, 60, 5))


def test_lines_of_many_files_and_splits(spark, tmp_path):
    """Files of several splits, some empty, with blank lines; packed into tasks together."""
    rng, want = np.random.default_rng(5), []
    for name in range(7):
        rows = rng.integers(0, 100, (0 if name == 3 else 40 * name + 1, 3))
        want += rows.tolist()
        (tmp_path / f"part-{name}").write_text("".join(
            ("\n  \n" if i % 9 == 4 else "") + "  ".join(map(str, r)) + " \n" for i, r in enumerate(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = array(read_matrix_text(spark, str(tmp_path), 0), "row_id", "feature_id", (len(want), 3))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got.tolist() == want
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty").write_text("\n \n")
    assert read_matrix_text(spark, str(tmp_path / "none"), 0).collect() == []


def test_low_rank_data(spark):
    ids = spark.range(30).select(F.col("id").alias("row_id"))
    cells = low_rank_cells(ids, [20, 10], [0.2, 0.4], eps=0.1, seed=3)
    a = array(cells.filter("view_idx = 0"), "row_id", "feature_id", (30, 20))
    b = array(cells.filter("view_idx = 1"), "row_id", "feature_id", (30, 10))
    assert np.linalg.matrix_rank(np.hstack([a, b]), tol=1e-9) == 1
    again = array(low_rank_cells(ids.repartition(7), [20, 10], [0.2, 0.4], eps=0.1, seed=3)
                  .filter("view_idx = 0"), "row_id", "feature_id", (30, 20))
    assert (a == again).all()
    plain = array(low_rank_cells(ids, [20], [0.2], eps=0.0).filter("row_id = 4"), "row_id", "feature_id", (30, 20))[4]
    assert (np.sign(plain[:2]) == -np.sign(plain[2:4])).all() and not plain[4:].any()


def test_predictions_of_few_chunks_are_spread(spark):
    """One chunk of one view: the joined keys are (chunk, block) pairs, none with more than its share."""
    n, width = 4000, 10
    blocks = scoring.subject_blocks(spark, [width, width], 1024)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert blocks * 2 >= 4 * parts and scoring.subject_blocks(spark, [1 << 30], 1024) == 1
    sums = spark.range(n).select(
        F.lit(1).alias("view_idx"), F.col("id").alias("row_id"),
        F.array(F.struct(F.lit(0).alias("component"), (F.col("id") / 8).alias("score"))).alias("s"))
    weights = spark.createDataFrame([(1, 0, f, f + 0.5) for f in range(0, width, 3)], "view_idx int, component int, feature_id bigint, weight double")
    out = scoring.predict_cells(sums, weights, [width, width], dense=False)
    got = {(r.row_id, r.feature_id): r.prediction for r in out.collect()}
    assert got == {(r, f): r / 8 * (f + 0.5) for r in range(n) for f in range(0, width, 3)}
    share = sums.groupBy(F.pmod(F.xxhash64("row_id"), F.lit(blocks))).count().agg(F.max("count")).first()[0]
    assert share <= 1.3 * n / blocks
