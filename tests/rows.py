"""Comparing the rows of two results."""

import pandas as pd


def same(spark_df, duck_df) -> str:
    """'' if both have the same rows, whatever their order; else what differs."""
    a, b = spark_df.toPandas(), duck_df
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    cols = sorted(a.columns)

    def norm(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return tuple(map(norm, v))
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return round(float(v), 6) + 0.0
        return str(v)

    x, y = (sorted((tuple(map(norm, r)) for r in df[cols].itertuples(index=False)), key=repr) for df in (a, b))
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    for p, q in zip(x, y):
        if p != q:
            return f"{dict(zip(cols, p))}\n{dict(zip(cols, q))}"
    return ""
