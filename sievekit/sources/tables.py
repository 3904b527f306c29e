"""Reading the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions.spelling import plain_digest


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_plain(df: DataFrame, into: str = "plain") -> DataFrame:
    """``df`` with the plain form of its ``digest``, NULL where there is none."""
    return df.withColumn(into, plain_digest(F.col("algo"), F.col("digest")))
