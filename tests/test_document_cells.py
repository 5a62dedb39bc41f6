"""Word and gram counts of whole texts; the test builds its own rows."""

import re
from hashlib import md5

from catalog import views
from catalog.views import document_cells


def test_document_cells_add_up_texts_of_one_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "DOCUMENTS", 2)
    rows = [(1, "Ab abé \U0001f600x"), (1, "ab"), (2, ""), (3, None), (None, "q r s"), (None, "q"), (4, "a\x1cb a\x0bc")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for key, text in rows:
        text = (text or "").lower()
        for v, tokens in enumerate([[w for w in re.split("[ \t\n\x0b\f\r]+", text) if w],
                                    [text[i:i + 3] for i in range(len(text) - 2)]]):
            for t in tokens:
                at = v, key, int(md5(t.encode()).hexdigest()[:8], 16) % 16384
                want[at] = want.get(at, 0.0) + 1.0
    cells, _ = document_cells(spark, str(tmp_path))
    assert {(r["view_idx"], r["row_id"], r["feature_id"]): r["value"] for r in cells.collect()} == want
    assert cells.rdd.getNumPartitions() == 4
