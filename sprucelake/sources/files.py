"""Reading and writing files in Spark's formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true"}, "xml": {"rowTag": "row"}}


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """df in one of FORMATS below path; partition columns become folders."""
    df.write.format(fmt).options(**FORMATS[fmt]).mode(mode).partitionBy(*(partition_by or [])).save(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Files below path; csv, json and xml want a schema, which saves a pass over the data."""
    reader = spark.read.format(fmt).options(**FORMATS[fmt])
    return (reader.schema(schema) if schema else reader).load(path)


def round_trip(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """df written and read again with its own schema."""
    write(df, path, fmt)
    return read(df.sparkSession, path, fmt, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
