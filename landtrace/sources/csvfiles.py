"""Delimited text with a header, ``NA`` for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landtrace.spec import CLASS_SCHEMA

OBSERVATION_SCHEMA = "sample_id int, cell_id bigint, forest_year int, agri_year int, c_length int"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed read: ``NA`` is missing and blanks around values are dropped."""
    return spark.read.csv(
        path, schema=schema, header=True, nullValue="NA",
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST",
    )


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CLASS_SCHEMA)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, OBSERVATION_SCHEMA)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a result table, one part per task, each with a header."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA", emptyValue="")
