"""Digest functions on columns and, once registered, in SQL."""

from millstone.functions.columns import (
    add_values,
    add_weighted_values,
    cast_precision,
    cdf,
    digest_mean,
    from_bytes,
    from_centroids,
    infer_column_precision,
    median,
    merge_tdigests,
    quantile,
    register,
    scale_values,
    scale_weights,
    tdigest,
    tdigest_of_array,
    tdigest_weighted,
    tdigest_summary,
    to_bytes,
    trimmed_mean,
    wire_precision,
)

__all__ = [
    "add_values", "add_weighted_values", "cast_precision", "cdf", "digest_mean", "from_bytes", "from_centroids", "infer_column_precision", "median", "merge_tdigests", "quantile", "register",
    "scale_values", "scale_weights", "tdigest", "tdigest_of_array", "tdigest_summary", "tdigest_weighted", "to_bytes", "trimmed_mean", "wire_precision",
]
