"""Mergeable quantile sketches on Spark: digests as ordinary columns."""

from millstone.config import (
    DecodeError, DigestConfig, DigestError, IncompatibleMerge, InvalidProbe, InvalidScale, InvalidTrainingData
)
from millstone.digest import Digest

__all__ = [
    "DecodeError",
    "Digest",
    "DigestConfig",
    "DigestError",
    "IncompatibleMerge",
    "InvalidProbe",
    "InvalidScale",
    "InvalidTrainingData",
]
