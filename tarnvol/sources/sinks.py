"""Result tables: rounded CSV without an index, and the data behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def write_results(df: DataFrame, path: str, places: int = 5) -> None:
    """One CSV file with a header; results are a few rows a study."""
    rounded(df, places).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def confidence_bounds(df: DataFrame, value: str, se: str, z: float = 1.96) -> DataFrame:
    return df.withColumns({"ci_low": F.col(value) - z * F.col(se), "ci_high": F.col(value) + z * F.col(se)})
