"""Quantiles and shares per group, in long form; shares of a column of values by one digest."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millstone import functions as M
from millstone import kernel
from millstone.config import InvalidProbe, probability
from millstone.digest import Digest
from millstone.schema import precision_of


def quantiles_by(digests: DataFrame, probes: Sequence[float], digest: str = "digest") -> DataFrame:
    """A row per group and probe: all other columns, ``q`` and ``value`` (float of f32 digests); the digest is read once
    per group."""
    qs = [probability(q) for q in probes]
    precision = precision_of(digests.schema[digest].dataType) or "f64"
    pairs = F.arrays_zip(
        F.array(*[F.lit(q) for q in qs]).alias("q"), M.quantile(digest, qs, precision=precision).alias("value")
    )
    others = [c for c in digests.columns if c != digest]
    return digests.select(*others, F.explode(pairs).alias("__p")).select(
        *others, F.col("__p.q").alias("q"), F.col("__p.value").alias("value")
    )


def cdf_by(digests: DataFrame, probes: Sequence[float], digest: str = "digest") -> DataFrame:
    """A row per group and probe: all other columns, ``x`` and ``share``."""
    xs = F.array(*[F.lit(float(x)) for x in probes])
    pairs = F.arrays_zip(xs.alias("x"), M.cdf(digest, list(probes)).alias("share"))
    others = [c for c in digests.columns if c != digest]
    return digests.select(*others, F.explode(pairs).alias("__p")).select(
        *others, F.col("__p.x").alias("x"), F.col("__p.share").alias("share")
    )


def cdf_column(
    values: DataFrame, column: str, digests: DataFrame, digest: str = "digest", *, alias: str | None = None
) -> DataFrame:
    """``values`` with ``<column>_cdf``: the share of each value by the one non-empty digest of ``digests``.

    That digest is read when the plan is made (one digest is bounded by its size, two are an error) and goes
    to the tasks once, not with every row. Floats give floats. NaN where there is no digest; null values
    are errors.
    """
    given = digests.where(F.col(digest)["count"] > 0)
    found = Digest.collected(given.select(digest).limit(2), digest)
    if len(found) > 1:
        raise ValueError("a column of values needs one digest; there are more")
    parts = found[0].parts if found else kernel.empty()
    kind = "float" if values.schema[column].dataType.typeName() == "float" else "double"

    @arrow_udf(kind)
    def share(x: pa.Array) -> pa.Array:
        if x.null_count:
            raise InvalidProbe("a probe of a cdf must not be null")
        return pa.array(
            kernel.cdf(parts, np.asarray(x.cast(pa.float64()))), pa.float32() if kind == "float" else pa.float64()
        )

    return values.withColumn(alias or f"{column}_cdf", share(F.col(column)))
