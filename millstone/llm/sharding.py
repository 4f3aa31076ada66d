"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are put in a seeded random order; a row's fractional rank is
(rank - 1/2) / rows of its source. All rows are sorted by fractional rank and cut into
``shards`` runs whose row counts differ by one at most, so each run holds every source in
its proportion of the whole (to within one row at either end).

Neither ranking gathers a source: a row's rank is the count of rows in lower buckets of
its source (a small grouped count, summed along the buckets) plus its rank within its
bucket, and buckets are cut by the uniform random key so that each holds about
``bucket_rows`` rows whatever the source's share. The same holds for the global order,
whose buckets are cut by the fractional rank itself.

Nulls: a null source is a source; a null text has size 1 and checksum 0; null ids take
part. Repeated rows are counted first, and each copy has a random key of its own, so that however
many they are they spread over buckets (they are interchangeable). An empty table gives no rows.
Other columns of the input are not read, whatever their names. A text is only measured and summed
where it is read, and never moved, so a long one costs no more than its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millstone.llm.shared import copies_of, running_sum, stored

#: Rows of a bucket that is ranked by one task.
BUCKET_ROWS = 4000
#: Sources whose counts are broadcast at most.
BROADCAST_SOURCES = 50_000


def _unit(key: Column) -> Column:
    """A 64-bit key as a number in [0, 1)."""
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def interleaved(
    docs: DataFrame,
    *,
    shards: int = 16,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, source, size, text_crc32, rank (from 0, over all), shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = copies_of(rows)
    # A null source would not join with itself, so strata are told apart by a struct.
    rows = rows.withColumn(
        "stratum", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    )
    rows = rows.withColumn("key", F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed), "copy"))
    # Buckets of about bucket_rows rows in every source: as many in all as the rows ask for, however many sources there
    # are.
    totals = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("of_source"))
    total = docs.count()
    few = totals.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(totals) if few else totals, "stratum").withColumn(
        "bucket", F.floor(_unit(F.col("key")) * F.floor(F.col("of_source") / bucket_rows + 1))
    )

    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    strata = running_sum(counts, ["stratum"], "bucket", "n").drop("n")
    # Keys are unsigned, as their buckets are.
    within = Window.partitionBy("stratum", "bucket").orderBy(F.col("key") < 0, "key", "doc_id", "size", "text_crc32")
    # Dealt by both columns, else a join by source alone would keep a source together.
    ranked = rows.repartition("stratum", "bucket").join(strata, ["stratum", "bucket"]).withColumn(
        "r", F.row_number().over(within) + F.col("before")
    )
    ranked = ranked.withColumn("fraction", (F.col("r") - 0.5) / F.col("of_source"))
    buckets = total // bucket_rows + 1
    ranked = stored(
        ranked.select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            "key",
            "r",
            "fraction",
            F.floor(F.col("fraction") * buckets).alias("bucket"),
        ),
        "interleaved",
    )

    cuts = running_sum(ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), [], "bucket", "n").select(
        "bucket", "before"
    )
    order = Window.partitionBy("bucket").orderBy("fraction", "key", "source", "r", "doc_id")
    placed = ranked.join(cuts, "bucket").withColumn("rank", F.row_number().over(order) + F.col("before") - 1)
    shard = F.expr(f"(rank * {shards}L) div {max(total, 1)}L")
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - start).select(
        "doc_id", "source", "size", "text_crc32", "rank", "shard", "slot"
    )
