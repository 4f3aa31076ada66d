"""A training-data pipeline of four stages over ``documents``.

Toxic documents go; of each group of near duplicates one document stays; documents that
hold benchmark passages go, or lose the passages where they are a small part; what is left
is packed into sequences. Each stage's result is written as Parquet in the shared folder
and read again as the next one's ``docs``.

Null and empty texts are never toxic, copies or contaminated, and are packed as their end token
alone; rows without an id are judged like others. Repeated rows are one document from the second
stage on. Extra columns pass through all stages but the last, whatever their names. An empty table
gives no rows. What a long text costs is stated by the operator of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millstone.llm import decontam, packing, shingles, toxicity
from millstone.llm.shared import stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, learnt from the labelled ones among them."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model, threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 0.8): the one with the smallest id.

    A document is what repeats both id and text, so texts that share an id are judged one by one; of
    those in a component the one with the smallest hash stays. Rows without an id come after all
    others. Texts without words link with nothing.
    """
    key, copy = ("key" + "_" * max(map(len, docs.columns)), "copy" + "_" * max(map(len, docs.columns)))
    fields = {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "text": F.xxhash64("text")}
    dealt = [f"{key}{name}" for name in fields]
    given = docs.select("*", *[x.alias(name) for x, name in zip(fields.values(), dealt, strict=True)])
    keyed = given.select(
        F.struct(*[F.col(name).alias(field) for name, field in zip(dealt, fields, strict=True)]).alias("doc_id"),
        "text",
    )
    found = shingles.linked_components(keyed, k=5, percent=80)
    others = found.where("doc_id <> component_id").select(
        *[F.col(f"doc_id.{field}").alias(name) for name, field in zip(dealt, fields, strict=True)]
    ).distinct()
    # The join has dealt rows by key already.
    same = Window.partitionBy(*dealt).orderBy("text")
    kept = given.join(others, dealt, "left_anti")
    return kept.withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1).select(*docs.columns)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth is benchmark passages go; passages are cut from the others."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=13, share=20)


def into_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: pack, bin and place; bins are of the permitted lengths."""
    return packing.packed(packing.byte_lengths(docs))


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", one_of_each),
    ("decontamination", benchmark_out),
    ("packing", into_bins),
]

#: Training and packing can't be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
