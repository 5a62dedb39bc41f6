"""The plan for many subjects: cells packed once, products without joins; the tests build their own rows."""

import numpy as np
import pytest

import direct
from catalog import queries, views
from catalog.views import document_cells, document_runs
from polyview import MultiViewCCA
from polyview.plans import blocks, sparse
from polyview.sources.views import CELL_COLUMNS, NULL_KEY, REPEATED

SCHEMA = "view_idx int, row_id bigint, feature_id bigint, value double"


def data(seed, n, widths, counts):
    rng = np.random.default_rng(seed)
    base = rng.poisson(2.0, (n, 1))
    draw = (lambda w: rng.poisson(base * rng.random(w))) if counts else (lambda w: base * rng.normal(size=w) + rng.normal(size=(n, w)))
    return [draw(w).astype(float) for w in widths]


def cells_of(spark, xs, parts=4):
    rows = [(v, r * 7 - 50, f, float(x[r, f])) for v, x in enumerate(xs) for r in range(len(x)) for f in range(x.shape[1])]
    np.random.default_rng(1).shuffle(rows)
    return spark.createDataFrame([(int(v), int(r), int(f), float(x)) for v, r, f, x in rows], SCHEMA).repartition(parts)


def loadings(model, widths, k):
    out = [[np.zeros(w) for w in widths] for _ in range(k)]
    for r in model.loadings.collect():
        out[r["component"]][r["view_idx"]][r["feature_id"]] = r["loading"]
    return out


@pytest.mark.parametrize("panel, block", [(1 << 22, 1 << 16), (64, 5)])
@pytest.mark.parametrize("counts", [True, False])
def test_agrees_with_dense_fit(spark, monkeypatch, panel, block, counts):
    monkeypatch.setattr(blocks, "PANEL", panel)
    monkeypatch.setattr(blocks, "BLOCK", block)
    xs = data(3, 40, (8, 11, 6), counts)
    want, _ = direct.fit(xs, 2, (0.1, 0.3, 0.2), cap=4)
    model = MultiViewCCA(plan="sparse", k=2, maxIter=4, rhos=[0.1, 0.3, 0.2]).fit_cells(cells_of(spark, xs), widths=[8, 11, 6])
    got = loadings(model, (8, 11, 6), 2)
    assert all(np.abs(got[c][i] - want[c][i]).max() < 1e-8 for c in range(2) for i in range(3))


def test_strongest_column_by_bounds_is_the_maximum(spark):
    xs = data(5, 60, (30, 50), False)
    xs[1][:, 41] = xs[1][:, 17] = 9 * xs[0][:, 3]
    packed = blocks.Blocks(cells_of(spark, xs), [30, 50])
    facts = [packed.facts(v) for v in (0, 1)]
    left, right = (blocks.Side(packed, v, 60, facts[v], True, [], {}) for v in (0, 1))
    norms = np.linalg.norm(direct_cov(xs), axis=0)
    assert (blocks.column_bounds(left, right, []) >= norms * (1 - 1e-9)).all()
    top, best, column, evaluated = blocks.strongest_column(left, right, [], batch=2, direct=0)
    assert best == 17 and abs(top - norms[17]) < 1e-8 * top and np.abs(column - direct_cov(xs)[:, 17]).max() < 1e-8 * top
    assert evaluated < 50 and (facts[1][2:, 41] == facts[1][2:, 17]).all()
    packed.release()


def direct_cov(xs):
    a, b = (x - x.mean(axis=0) for x in xs)
    return a.T @ b


def test_cells_are_read_once(spark, monkeypatch):
    """However many steps a fit takes, and with its subjects counted, a cell is read once."""
    monkeypatch.setattr(sparse, "fit", None)
    xs = data(4, 30, (9, 7), True)
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    cells = cells_of(spark, xs).mapInArrow(noted, SCHEMA)
    MultiViewCCA(maxCovarianceFeatures=4, maxGramSubjects=4, maxIter=6, tol=0.0).fit_cells(cells, widths=[9, 7])
    assert read.value == sum(x.size for x in xs)


def test_repeats_and_subjects_without_values(spark):
    rows = [(0, r, f, float(r * (f + 1) % 5)) for r in range(12) for f in range(3)] + [
        (1, r, f, float(r * (f + 2) % 7)) for r in range(12) for f in range(3)]
    zeros = [(0, 99, 1, 0.0), (0, 99, 1, 0.0)]
    packed = blocks.Blocks(spark.createDataFrame(rows + zeros, SCHEMA), [3, 3])
    assert packed.subjects() == 13  # repeats of 0 are harmless, and their subject counts
    packed.release()
    with pytest.raises(ValueError, match=REPEATED):
        MultiViewCCA(plan="sparse").fit_cells(spark.createDataFrame([*rows, (1, 3, 2, 4.0)], SCHEMA).repartition(3), widths=[3, 3])


def test_document_runs_are_the_document_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "DOCUMENTS", 2)
    rows = [(1, "Ab abé \U0001f600x"), (1, "ab"), (2, ""), (3, None), (5, "q"), (4, "a\x1cb a\x0bc"),
            (6, "".join(map(chr, range(300, 900)))), (7, "aé " * 300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cells, widths = document_cells(spark, str(tmp_path))
    want = sorted(tuple(r[c] for c in CELL_COLUMNS) for r in cells.collect())
    got = []
    for r in document_runs(spark, str(tmp_path)).collect():
        features = np.frombuffer(r["features"], np.uint16)
        values = np.frombuffer(r["cells"], blocks.VALUES[len(r["cells"]) // len(features)])
        got += [(r["view_idx"], r["row_id"], int(f), float(v)) for f, v in zip(features, values)]
    order = [CELL_COLUMNS.index(c) for c in ("view_idx", "row_id", "feature_id", "value")]
    assert sorted(got) == sorted(tuple(w[i] for i in order) for w in want)


def test_document_without_key_fails_the_fit(spark, tmp_path):
    spark.createDataFrame([(None, "q r s"), (1, "ab c")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(ValueError, match=NULL_KEY):
        queries.fit_documents(spark, str(tmp_path)).collect()
