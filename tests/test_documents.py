"""The registered document fit at its full width, run until it converges."""

import numpy as np

import direct
from catalog.queries import fit_documents
from catalog.views import document_cells


def test_registered_document_fit_converges(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = ["ab", "cde", "fgh i", "é o", "kl", "mnop", "q\nr"]
    texts = [" ".join(rng.choice(words, size=rng.integers(3, 30))) for _ in range(25)] + ["x"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    cells, _ = document_cells(spark, str(tmp_path))
    rows = cells.collect()
    places = [sorted({r["feature_id"] for r in rows if r["view_idx"] == v}) for v in (0, 1)]
    xs = [np.zeros((len(texts), len(p))) for p in places]  # columns without cells have no part in the fit
    for r in rows:
        xs[r["view_idx"]][r["row_id"], places[r["view_idx"]].index(r["feature_id"])] = r["value"]
    want, _ = direct.fit(xs, 1, (0.1, 0.1))
    cut, _ = direct.fit(xs, 1, (0.1, 0.1), tol=0.0, cap=4)
    got = [np.zeros(len(p)) for p in places]
    for r in fit_documents(spark, str(tmp_path)).collect():
        got[r["view_idx"]][places[r["view_idx"]].index(r["feature_id"])] = r["loading"]
    assert all(np.abs(a - b).max() < 2e-6 for a, b in zip(got, want[0]))
    assert any(np.abs(a - b).max() > 2e-6 for a, b in zip(got, cut[0]))
