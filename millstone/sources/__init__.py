"""Readers of training values and probes, and files of digests."""

from millstone.sources.digests import read_digest_files, write_digest_files
from millstone.sources.values import detect_format, infer_precision, read_values

__all__ = ["detect_format", "infer_precision", "read_digest_files", "read_values", "write_digest_files"]
