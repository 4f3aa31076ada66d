"""Operators on DataFrames."""

from millstone.operators.build import digest_by, merge_by, rollup_by, with_digest
from millstone.operators.probe import cdf_by, cdf_column, quantiles_by

__all__ = ["cdf_by", "cdf_column", "digest_by", "merge_by", "quantiles_by", "rollup_by", "with_digest"]
