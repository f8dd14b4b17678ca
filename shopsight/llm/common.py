"""Helpers shared by the operators: table access, word patterns, stored steps."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import shopsight
from shopsight.session import ensure_checkpoint_dir

#: A word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The same six characters, for ``translate``.
WORD_SPACES = " \t\n\x0b\f\r"

#: Columns of the ``documents`` table, which every filtering stage returns.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows that go to a Python worker at once; whole texts may be long.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Session state that every query needs: the shared checkpoint folder, workers that find this package where the driver has it, and batches of few whole texts."""
    ensure_checkpoint_dir(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(shopsight.__file__).resolve().parent.parent))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text of a row, a missing one counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def seeded_hash(*parts: Column | str) -> Column:
    """A non-negative 60-bit hash that other SQL engines can reproduce (the head of an md5)."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
