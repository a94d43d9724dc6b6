"""Reading the tables by name, with the columns a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_fixtures(spark: SparkSession, path: str, name: str = "vessel_name", number: str = "voyage_no") -> DataFrame:
    """A fixture sheet saved as CSV: column names in lower case, NaN and empty cells as null, with a key from name and number."""
    from pyspark.sql import functions as F

    from halyard.functions.text import name_key

    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    df = df.select([F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
    return df.withColumn("voyage_key", name_key(F.col(name), F.col(number).cast("int")))
