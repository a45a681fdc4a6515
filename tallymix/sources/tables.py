"""Tables in and out, always with a declared schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A Parquet (or other columnar) table; columns are read as declared."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    rename: Mapping[str, str] | None = None,
    missing: str = "NA",
) -> DataFrame:
    """CSV with a header; the missing token becomes NULL. Names are repaired here, once."""
    df = (
        spark.read.option("header", True)
        .option("nullValue", missing)
        .option("enforceSchema", True)
        .schema(schema)
        .csv(path)
    )
    return df.withColumnsRenamed(dict(rename)) if rename else df


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), missing: str = "NA"
) -> None:
    """Write a table. Partition large study tables by year to prune year ranges."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", missing)
    writer.save(path)


def save_fit(coefficients: DataFrame, draws: DataFrame, path: str) -> None:
    """Keep a fit: point coefficients and bootstrap draws, as Parquet."""
    write_table(coefficients, f"{path}/coefficients")
    write_table(draws, f"{path}/draws")


def load_fit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    coefficients = read_table(
        spark, f"{path}/coefficients", "category string, term string, estimate double"
    )
    draws = read_table(
        spark, f"{path}/draws", "draw int, category string, term string, estimate double"
    )
    return coefficients, draws


def head(df: DataFrame, order_by, n: int = 6) -> DataFrame:
    """First n rows of an ordering (a top-n plan, no full sort)."""
    return df.orderBy(*[F.col(c) if isinstance(c, str) else c for c in order_by]).limit(n)
