from polyview.functions.scalar import (  # noqa: F401
    array_literal,
    safe_corr,
    safe_divide,
    soft_threshold,
    sparse_dot,
)
