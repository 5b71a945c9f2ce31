"""Immutable segments: Parquet files by generation, with a manifest of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, generation: int) -> None:
    df.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("generation").parquet(path)


def read(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if up_to is None else df.where(F.col("generation") <= up_to)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """path, status of each file against a manifest: ok, corrupt, missing or orphan."""
    have = manifest(spark, path).select("path", F.col("digest").alias("have"))
    both = expected.select("path", F.col("digest").alias("want")).join(have, "path", "full_outer")
    status = F.when(F.col("want").isNull(), "orphan").when(F.col("have").isNull(), "missing").when(F.col("want") != F.col("have"), "corrupt").otherwise("ok")
    return both.select("path", status.alias("status"))
