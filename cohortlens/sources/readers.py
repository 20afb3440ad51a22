"""Sources: table scans, CSV ingest, JDBC, SQL text.

Reads are lazy and schema-explicit where a schema is known; column pruning
and predicate pushdown reach the parquet scan because callers select and
filter on the returned DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Full (lazy) scan of one parquet table."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None,
             fmt: str = "parquet", **options) -> DataFrame:
    """Raw-table scan with an explicit schema (S1, S5 CSV import).

    Codes stay text because the schema says so; nothing is inferred.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        options.setdefault("header", "true")
        # Raw text is kept exactly as delivered; stripping is a cleaning rule.
        options.setdefault("ignoreLeadingWhiteSpace", "false")
        options.setdefault("ignoreTrailingWhiteSpace", "false")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None,
              fetch_size: int = 10_000) -> DataFrame:
    """Parallel JDBC scan split on a numeric key range (S1 against a database)."""
    props = dict(properties or {})
    props.setdefault("fetchsize", str(fetch_size))
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions, properties=props)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Projected scan (S3): only these columns reach the file reader."""
    return df.select(*columns)
