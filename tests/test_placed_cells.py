"""Large views move once: counts of shuffles and bounds of tasks; the tests build their own rows."""

import pytest

from catalog.queries import cross_covariance_centered
from catalog.views import customer_cells
from polyview import session
from polyview.plans import sparse
from polyview.plans.common import FitOptions


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("part", [(i, f"b{i % 3}", f"t{i % 4}") for i in range(12)] + [(12, None, "t0")],
          "p_partkey bigint, p_brand string, p_type string")
    write("orders", [(i, i % 7 if i != 5 else None, f"p{i % 2}") for i in range(40)] + [(40, 1, None)],
          "o_orderkey bigint, o_custkey bigint, o_orderpriority string")
    write("lineitem", [(i % 41, (i * 5) % 13, float(i), 0.5) for i in range(300)],
          "l_orderkey bigint, l_partkey bigint, l_extendedprice double, l_discount double")
    return str(tmp_path)


def expected():
    out = {}
    for o in range(41):
        cust = None if o == 5 else 1 if o == 40 else o % 7
        if o < 40:
            out[2, cust, o % 2 + 1] = out.get((2, cust, o % 2 + 1), 0.0) + 1.0
        for i in range(o, 300, 41):
            p = (i * 5) % 13
            cells = [(1, cust, 0 if p == 12 else p % 4)] + ([(0, cust, p % 3 + 1)] if p < 12 else [])
            for c in cells:
                out[c] = out.get(c, 0.0) + i * 0.5
    return out


@pytest.mark.parametrize("rows", [1_000_000, 20])
def test_customer_cells_are_whole_and_stay_in_bounded_parts(spark, folder, monkeypatch, rows):
    monkeypatch.setattr(session.task_parts, "__defaults__", (rows,))
    cells, widths = customer_cells(spark, folder)
    assert widths == [4, 4, 3]
    assert {(r["view_idx"], r["row_id"], r["feature_id"]): r["value"] for r in cells.collect()} == expected()
    assert cells.rdd.getNumPartitions() == max(3, 300 // rows)
    cells.unpersist()


def test_centred_product_moves_no_cell_again(spark, folder):
    plan = cross_covariance_centered(spark, folder)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    outside = text.split("Initial Plan")[0]
    # Cells lie with their customer, so no exchange by customer follows the one that places them.
    assert outside.count("hashpartitioning(row_id") <= outside.count("REPARTITION_BY_NUM")


def test_sparse_plan_gives_a_task_a_bounded_number_of_cells(spark, monkeypatch):
    seen = []
    placed = sparse.Placed.__init__

    def noted(self, cells, key, parts, n_cells):
        placed(self, cells, key, parts, n_cells)
        seen.append(self.light.rdd.getNumPartitions())

    monkeypatch.setattr(session.task_parts, "__defaults__", (50,))
    monkeypatch.setattr(sparse.Placed, "__init__", noted)
    monkeypatch.setattr(sparse, "solve", lambda matrices, opts: ([], [], {}))
    cells = spark.createDataFrame(
        [(v, r, f, float((r * (f + 2) + v * f) % 7)) for v in (0, 1) for r in range(60) for f in range(4)],
        "view_idx int, row_id bigint, feature_id bigint, value double")
    sparse.fit(cells, 60, [4, 4], FitOptions(rhos=(0.1, 0.1)))
    assert seen == [5, 5]
