"""Queries on more vectors than the given tables hold; the tests build their own rows."""

import numpy as np
import pytest

from catalog.queries import fit_two_view, fit_two_view_gram, restrict_support


def write_vectors(spark, folder, x):
    spark.createDataFrame(
        [(i, i % 5, [float(v) for v in row]) for i, row in enumerate(x)],
        "vec_id bigint, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("large", [[], [3, 40]])
def test_restrict_support_keeps_no_rows_where_no_mean_is_large(spark, tmp_path, large):
    x = np.tile([[1.0], [-1.0]], (3, 64))
    x[:, large] += 0.5
    write_vectors(spark, tmp_path, x)
    got = restrict_support(spark, str(tmp_path)).select("view_idx", "feature_id").distinct().collect()
    assert {r["view_idx"] * 32 + r["feature_id"] for r in got} == set(large)


def test_gram_query_fits_more_subjects_than_the_gram_plan_takes(spark, tmp_path):
    rng = np.random.default_rng(3)
    hidden = rng.normal(size=(2100, 1))
    write_vectors(spark, tmp_path, hidden * rng.normal(size=64) + rng.normal(size=(2100, 64)))
    want = {r[:3]: r["loading"] for r in fit_two_view(spark, str(tmp_path)).collect()}
    got = {r[:3]: r["loading"] for r in fit_two_view_gram(spark, str(tmp_path)).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
