"""The warehouse job: raw tables -> staging -> marts, and its stored form.

``Warehouse`` wires the lazy frames of one input (the test binding, or raw CSV
frames); ``build`` writes the marts as Parquet. ``fct_orders`` is written once,
partitioned by ``purchased_month`` (three analytic marts group by month), and
the analytic marts are built from the written table, not from its lineage.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shopsight.operators import marts
from shopsight.operators.staging import Staging
from shopsight.sources.binding import bind_raw
from shopsight.sources.io import EXPORT_MARTS, SMALL_MARTS, load_raw_csv, write_csv, write_table


class Warehouse:
    """Lazy staging and marts over one set of raw tables."""

    def __init__(self, raw, spark: SparkSession | None = None):
        self.raw = raw
        self.stg = Staging(raw)
        self.spark = spark

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str, store: str, files: dict[str, str] | None = None) -> Warehouse:
        """The warehouse of a folder of raw CSV files, stored as Parquet first, which parses every field."""
        raw = {}
        for name, df in load_raw_csv(spark, folder, files).items():
            write_table(df, os.path.join(store, name))
            raw[name] = spark.read.parquet(os.path.join(store, name))
        return cls(raw, spark)

    @classmethod
    def from_test_tables(cls, spark: SparkSession, sf_dir: str) -> Warehouse:
        return cls(bind_raw(spark, sf_dir), spark)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.stg)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return marts.dim_customers(self.stg)

    @cached_property
    def dim_products(self) -> DataFrame:
        return marts.dim_products(self.stg)

    def with_fact(self, fact: DataFrame) -> Warehouse:
        """This warehouse with a stored order fact: the analytic marts start from it."""
        self.__dict__["fct_orders"] = fact
        return self

    def monthly_revenue(self) -> DataFrame:
        return marts.monthly_revenue(self.fct_orders)

    def revenue_by_state(self) -> DataFrame:
        return marts.revenue_by_state(self.fct_orders)

    def category_performance(self) -> DataFrame:
        return marts.category_performance(self.stg, self.fct_orders)

    def customer_cohorts(self) -> DataFrame:
        return marts.customer_cohorts(self.fct_orders)

    def rfm_base(self) -> DataFrame:
        return marts.rfm_base(self.fct_orders)

    def customer_rfm(self, **opts) -> DataFrame:
        return marts.customer_rfm(self.fct_orders, **opts)


def build(wh: Warehouse, out_dir: str, export_csv_dir: str | None = None) -> dict[str, int]:
    """Write all eight marts as Parquet (and CSV exports); returns row counts.

    fct_orders is written first and re-read, so the five analytic marts start
    from a short lineage and a month-partitioned table.
    """
    counts: dict[str, int] = {}
    fct_path = os.path.join(out_dir, "fct_orders")
    # Range-partition on (month, order) before the month-partitioned write: each
    # task holds a contiguous key range and writes one or two month folders,
    # so files ~ tasks (not tasks x months), and no month lands in one task.
    n_parts = int(wh.spark.conf.get("spark.sql.shuffle.partitions"))
    fct = wh.fct_orders.repartitionByRange(n_parts, "purchased_month", "order_id")
    counts["fct_orders"] = write_table(fct, fct_path, partition_by=["purchased_month"])
    stored = Warehouse(wh.raw, wh.spark).with_fact(wh.spark.read.parquet(fct_path))
    frames = {
        "dim_customers": wh.dim_customers,
        "dim_products": wh.dim_products,
        "monthly_revenue": stored.monthly_revenue(),
        "revenue_by_state": stored.revenue_by_state(),
        "category_performance": stored.category_performance(),
        "customer_cohorts": stored.customer_cohorts(),
        "customer_rfm": stored.customer_rfm(),
    }
    # the seven marts are independent once the fact is stored: submit their writes together
    with ThreadPoolExecutor(max_workers=4) as pool:
        futures = {
            name: pool.submit(write_table, marts.to_output(df), os.path.join(out_dir, name)) for name, df in frames.items()
        }
        counts.update({name: f.result() for name, f in futures.items()})
    if export_csv_dir:
        for name in EXPORT_MARTS:
            df = wh.spark.read.parquet(os.path.join(out_dir, name))
            write_csv(marts.to_output(df), os.path.join(export_csv_dir, name), single_file=name in SMALL_MARTS)
    return counts
