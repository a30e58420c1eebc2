"""Reading the input tables, whatever columns they come with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Only ``spark.read`` touches the path: the inputs may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
