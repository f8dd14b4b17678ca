"""Sources and sinks: raw schemas, the test-table binding, CSV/Parquet I/O."""

from shopsight.sources.binding import RawTables, bind_raw
from shopsight.sources.schemas import RAW_SCHEMAS, RAW_TABLES

__all__ = ["RAW_SCHEMAS", "RAW_TABLES", "RawTables", "bind_raw"]
