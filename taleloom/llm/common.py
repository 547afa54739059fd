"""What the corpus operators share: table access, shared storage, checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taleloom.sources.shared import new_path

#: Rows up to which an id or fingerprint list may be broadcast (8-byte keys: about 100 MB as a hash relation).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and the loss
    of an executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows (counted); else as it is, and Spark
    shuffles both sides and splits skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def squeeze(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, under fixed types: other columns, whatever their names, stay out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
