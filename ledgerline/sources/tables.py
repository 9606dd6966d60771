"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as written."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tolerant(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """[S3] The wanted columns in that order; one that the table lacks is NULL of its type, one of another type is cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`").cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()])


def once(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns (all, if none is named) with a row repeated in full kept once."""
    return (df.select(*columns) if columns else df).distinct()


def widened(stored: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """[S10] stored with the wanted columns that it lacks, NULL of their type; what it has stays as it is, other columns too."""
    have = set(stored.columns)
    return stored.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in have})
