"""Readers: Parquet tables of a data directory, CSV files, catalog tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One Parquet table ``{data_dir}/{name}.parquet`` (lazy; columns pruned by the plan)."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV scan with a header row.

    With ``schema`` the file is read once; without it Spark infers types in an
    extra pass over the data (the behaviour of a plain inferring read).
    """
    reader = spark.read.option("header", header)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_catalog_table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """Whole-table scan of a catalog table, qualified by database (no session-wide ``USE``)."""
    return spark.table(f"{database}.{name}" if database else name)


def query_view(df: DataFrame, sql: str) -> DataFrame:
    """Run SQL text over ``df``, which the text calls ``{view}``, through a temporary view of a new name.

    The result is materialised lazily like any plan: the view name is resolved
    when the SQL is analysed, so dropping it afterwards is safe.
    """
    spark, view = df.sparkSession, f"view_{uuid.uuid4().hex}"
    df.createTempView(view)
    try:
        return spark.sql(sql.replace("{view}", view))
    finally:
        spark.catalog.dropTempView(view)


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows (a bounded look, no full collect)."""
    return df.limit(n)
