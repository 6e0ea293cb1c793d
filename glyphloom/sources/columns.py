"""Where columns come from: tables, files and in-memory lists, reduced to distinct values with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST


class ProfileError(ValueError):
    """Raised for input that can't be profiled; ``reason`` names why."""

    reason = "invalid"

    def __init__(self, detail: str = ""):
        super().__init__(f"Failed to profile: {self.reason}" + (f" ({detail})" if detail else ""))


class EmptyInputError(ProfileError):
    reason = "empty_input"


class NonStringValuesError(ProfileError):
    reason = "non_string_values"


class NotAColumnError(ProfileError, TypeError):
    reason = "not_a_list"


def from_list(spark: SparkSession, values: list) -> DataFrame:
    if not isinstance(values, list | tuple):
        raise NotAColumnError(type(values).__name__)
    if any(not isinstance(v, str) for v in values):
        raise NonStringValuesError
    return spark.createDataFrame([(v,) for v in values], "value string")


def read(spark: SparkSession, path: str, column: str, fmt: str = "parquet", **options) -> DataFrame:
    """One column of a file in any format Spark reads; only that column is scanned where the format allows."""
    return spark.read.format(fmt).options(**options).load(path).select(F.col(column).alias("value"))


def value_counts(df: DataFrame, column: str = "value") -> DataFrame:
    """(value, cnt): every later decision needs no more than distinct values and their counts."""
    if not isinstance(df, DataFrame) or column not in df.columns:
        raise NotAColumnError(column)
    if not isinstance(df.schema[column].dataType, ST.StringType):
        raise NonStringValuesError(df.schema[column].dataType.simpleString())
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))
