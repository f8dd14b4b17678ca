"""Sources and sinks: raw CSV load, mart reads and writes.

Raw CSVs are read with an explicit schema, by header name and FAILFAST (zero bad
records); quoted newlines are allowed where a file has free text. Marts are
Parquet; CSV is an export format only.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shopsight.sources.schemas import MULTILINE_TABLES, POSITIONAL_TABLES, RAW_FILES, RAW_SCHEMAS

log = logging.getLogger(__name__)

# Marts written for serving (the small aggregate marts plus the cluster assignments).
SERVING_MARTS = (
    "monthly_revenue",
    "customer_cohorts",
    "customer_rfm",
    "revenue_by_state",
    "category_performance",
    "customer_clusters",
)
# Marts exported as CSV snapshots.
EXPORT_MARTS = (
    "dim_customers",
    "dim_products",
    "fct_orders",
    "monthly_revenue",
    "customer_rfm",
    "customer_cohorts",
    "revenue_by_state",
    "category_performance",
)
# Aggregate marts whose size is bounded by calendar months / states / categories;
# only these are written as a single CSV file.
SMALL_MARTS = ("monthly_revenue", "customer_cohorts", "revenue_by_state", "category_performance")


def load_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """src_csv: read one raw CSV with its fixed schema.

    Columns are found by the header's names, in any order; an unknown, missing or
    repeated column is a ValueError. Every file must have the header of the
    first. A bad field fails when its column is read, so a load that must be
    valid is stored (:func:`write_table`), which reads them all.
    """
    schema = RAW_SCHEMAS[table]
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", table in MULTILINE_TABLES)
    if table not in POSITIONAL_TABLES:
        header = [c.strip() for c in reader.option("inferSchema", False).csv(path).columns]
        if sorted(header) != sorted(schema.names):
            raise ValueError(f"{path}: columns {header} are not those of {table}: {schema.names}")
        schema = T.StructType([schema[c] for c in header])
    rows = (
        reader.schema(schema)
        .option("enforceSchema", table in POSITIONAL_TABLES)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    return rows.select(*RAW_SCHEMAS[table].names)


def load_raw_csv(spark: SparkSession, folder: str, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """src_map: file -> table registry; a missing file is logged and skipped."""
    files = files or RAW_FILES
    out: dict[str, DataFrame] = {}
    for table, fname in files.items():
        path = os.path.join(folder, fname)
        if not _exists(spark, path):
            log.warning("skip %s: %s not found", table, path)
            continue
        out[table] = load_csv(spark, path, table)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """sink_table: truncate-and-write Parquet; returns the row count (src_count).

    The count reads the written files, which Parquet answers from its footers
    (no column data is decoded).
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """sink_csv: overwrite a CSV export with header (idempotent)."""
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def read_mart(spark: SparkSession, name: str, folder: str, source: str = "parquet") -> DataFrame:
    """src_mart / src_parquet: read a stored mart by name.

    source is 'parquet' (the mart folder), 'csv' (the exports) or 'table' (catalog).
    An unknown source raises ValueError; a missing mart raises FileNotFoundError.
    """
    if source == "table":
        return spark.table(name)
    if source not in ("parquet", "csv"):
        raise ValueError(f"Unknown source: {source!r}. Use 'parquet', 'csv' or 'table'.")
    path = os.path.join(folder, name)
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} not found; build the marts first.")
    if source == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
