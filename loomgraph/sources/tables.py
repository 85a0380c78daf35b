"""Reading and writing vertex and edge tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.names import DST, SRC


def frame(spark: SparkSession, columns: dict[str, Iterable], schema: str | T.StructType | None = None) -> DataFrame:
    """A literal table from columns. Empty columns need a schema, or become bigint."""
    lists = {k: list(v) for k, v in columns.items()}
    rows = list(zip(*lists.values()))
    if schema is None and not rows:
        schema = ", ".join(f"`{c}` bigint" for c in lists)
    return spark.createDataFrame(rows, schema if schema is not None else list(lists))


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """A table of any format that the session knows: parquet, orc, csv, json, iceberg, ..."""
    return spark.read.format(format).options(**options).load(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", partition_by: Iterable[str] = (), **options: str) -> None:
    df.write.format(format).mode(mode).partitionBy(*partition_by).options(**options).save(path)


def read_catalog(spark: SparkSession, table: str) -> DataFrame:
    """A table of the session's catalogs, such as an Iceberg table."""
    return spark.table(table)


def read_edge_list(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Edges from text lines of two integers, as in SNAP's files (also gzipped); comments and blank lines are skipped."""
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith(comment))
    return lines.select(fields[0].cast("bigint").alias(SRC), fields[1].cast("bigint").alias(DST))
