"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import direct
from __spark_entry__ import entry, oracle_sql, queries
from catalog.views import document_cells
from polyview import MultiViewCCA

FOLDER = Path("/root/testdata/sf0.001")
SQL = oracle_sql()
# Minutes long or far larger than the others; tools/check.py runs them.
SLOW = {"fit_documents", "fit_two_view_sparse", "fit_customer_views_sparse", "fit_cells_subset_subjects", "l1_power_iteration"}

needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def close(a, b):
    if isinstance(a, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    if isinstance(a, float):
        return bool(np.isclose(a, float(b), rtol=1e-9, atol=2e-6))
    return a == b


@needs_tables
@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_matches_sql(spark, db, name):
    df = queries()[name](spark, str(FOLDER))
    got = db.execute(SQL[name])
    cols = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(plain(v) for v in r) for r in got.fetchall())
    have = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert len(have) == len(want)
    assert all(map(close, have, want))


def test_registry():
    assert set(SQL) <= set(queries())
    own = {q for q in queries() if not q.startswith("op") and q != "pipeline"}
    assert own - set(SQL) == {"lowrank_cells", "fit_documents", "fit_two_view_converged", "fit_three_view_converged"}


@needs_tables
def test_entry(spark):
    assert entry(spark).count() > 0


def test_document_fit_by_brute_force(spark, tmp_path):
    """The wide document views on a few whole texts, against dense matrices."""
    rng = np.random.default_rng(6)
    words = ["ab", "cde", "fgh i", "é o", "kl", "mnop", "q\nr"]
    texts = [" ".join(rng.choice(words, size=rng.integers(3, 30))) for _ in range(25)] + ["x"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    cells, widths = document_cells(spark, str(tmp_path), buckets=64)
    rows = cells.collect()
    xs = [np.zeros((len(texts), w)) for w in widths]
    for r in rows:
        xs[r["view_idx"]][r["row_id"], r["feature_id"]] = r["value"]
    assert xs[0].sum() == sum(len(t.split()) for t in texts)
    assert xs[1].sum() == sum(max(len(t) - 2, 0) for t in texts)
    want, _ = direct.fit(xs, 1, (0.1, 0.1), cap=4)
    for plan in ("covariance", "gram"):
        model = MultiViewCCA(plan=plan, maxIter=4).fit_cells(cells, widths=widths)
        got = [np.zeros(w) for w in widths]
        for r in model.loadings.collect():
            got[r["view_idx"]][r["feature_id"]] = r["loading"]
        assert all(np.abs(a - b).max() < 1e-8 for a, b in zip(got, want[0]))
