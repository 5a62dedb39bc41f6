from polyview.sources.generate import low_rank_cells, weight_pattern  # noqa: F401
from polyview.sources.text import read_matrix_text  # noqa: F401
from polyview.sources.views import (  # noqa: F401
    cells_from_arrays,
    cells_from_columns,
    cells_from_facts,
    dense_index,
    feature_vectors,
    feature_vectors_from_arrays,
    fill_missing,
    match_subjects,
    matrix_rows,
    ordered_cells,
    vector_table,
)
