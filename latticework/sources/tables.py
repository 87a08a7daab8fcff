"""Vectors and matrices from Parquet tables, and plain sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(df: DataFrame, row_id: str, columns: list[str] | str) -> DataFrame:
    """A row matrix (row_id, v array<double>) from numeric columns or one array column."""
    v = F.transform(columns, lambda x: x.cast("double")) if isinstance(columns, str) else F.array(*(F.col(c).cast("double") for c in columns))
    return df.select(F.col(row_id).cast("long").alias("row_id"), v.alias("v"))


def coo(df: DataFrame, i: str, j: str, v: str) -> DataFrame:
    """A sparse matrix (i, j, v) from three columns."""
    return df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.col(v).cast("double").alias("v"))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """``kind``: parquet, json, csv (with a header)."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
