"""Distributed global ranking: row_number, ntile and prefix sums over a total order.

A window with ``orderBy`` and no ``partitionBy`` plans as ``Exchange
SinglePartition``: every row goes through one task. Here the order is split
into P contiguous range buckets instead:

1. Sample the sort key, sort the sample, keep P-1 cut points. The sample, about
   40 keys per bucket of two million rows, is all that reaches the driver.
2. The bucket of a row is a pure function of its key (a binary search over the
   literal cut points), so a recomputed stage yields the same buckets.
3. ``row_number`` (or a running sum) per bucket, in parallel.
4. Per-bucket counts (P rows) -> exclusive prefix sum -> broadcast join of the
   P offsets -> global rank = offset + local rank.

Keys must end with a unique column so the order is total: then heavy ties
(most people have frequency 1) cannot pile up in one bucket, and the result is
deterministic. Sort keys are normalised into one ascending struct column with
explicit NULL placement, so comparisons and sorting agree on the order.

Tiles and top fractions need only a few keys of the order; :func:`keys_at` selects
them without buckets (see ``select``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsight.operators.select import rows_at

KeySpec = tuple[str, str, str]  # (column, 'asc'|'desc', 'first'|'last')

DEFAULT_ROWS_PER_BUCKET = 2_000_000
SAMPLES_PER_BUCKET = 40
_SK = "_rank_sort_key"
_BKT = "_rank_bucket"


def _norm(key) -> KeySpec:
    if isinstance(key, str):
        return (key, "asc", "first")
    name, direction, *rest = key
    nulls = rest[0] if rest else ("first" if direction == "asc" else "last")
    return (name, direction, nulls)


def sort_key(df: DataFrame, keys: Sequence) -> Column:
    """One ascending struct encoding (direction, NULL placement) of every key."""
    fields = []
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    for i, key in enumerate(keys):
        name, direction, nulls = _norm(key)
        c = F.col(name)
        flag = c.isNotNull() if nulls == "first" else c.isNull()
        if direction == "desc":
            if not isinstance(types[name], T.NumericType):
                raise ValueError(f"descending key {name!r} must be numeric")
            value = -c
        else:
            value = c
        fields += [flag.alias(f"n{i}"), value.alias(f"v{i}")]
    return F.struct(*fields)


def _struct_literal(row, struct_type: T.StructType) -> Column:
    return F.struct(*[F.lit(row[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(struct_type.fields)])


def _bucket_of(key: Column, cuts: list[Column]) -> Column:
    """Number of cut points strictly below ``key``: a binary search over one literal array.

    The array is padded with NULL to a power of two less one, so each step adds
    its jump if the cut there exists and lies below the key.
    """
    steps = len(cuts).bit_length()
    spare = [F.lit(None)] * (2**steps - 1 - len(cuts))
    arr = F.array(*cuts, *spare)
    jumps = F.array(*[F.lit(2**i) for i in reversed(range(steps))])
    return F.aggregate(jumps, F.lit(0), lambda p, j: p + F.when(F.get(arr, p + j - 1) < key, j).otherwise(0))


class RangeBuckets:
    """Cut points of one total order, computed once from a (materialised) frame."""

    def __init__(
        self,
        stats: DataFrame,
        keys: Sequence,
        n_rows: int | None = None,
        rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
        min_buckets: int | None = None,
        seed: int = 17,
    ):
        self.keys = [_norm(k) for k in keys]
        self.n_rows = stats.count() if n_rows is None else n_rows
        if min_buckets is None:
            min_buckets = 2 * stats.sparkSession.sparkContext.defaultParallelism
        # Always split, so the plan has the same shape at every scale; buckets grow
        # in number with the rows, not in size.
        n_buckets = max(min_buckets, math.ceil(self.n_rows / max(1, rows_per_bucket)))
        keyed = stats.select(sort_key(stats, self.keys).alias(_SK))
        self.struct_type = keyed.schema[_SK].dataType
        self.cuts: list[Column] = []
        if n_buckets > 1:
            fraction = min(1.0, SAMPLES_PER_BUCKET * n_buckets / max(1, self.n_rows))
            sample = [r[0] for r in keyed.sample(False, fraction, seed).orderBy(_SK).collect()]
            if sample:
                picks = sorted({min(len(sample) - 1, (i * len(sample)) // n_buckets) for i in range(1, n_buckets)})
                self.cuts = [_struct_literal(sample[i], self.struct_type) for i in picks]
        self.n_buckets = len(self.cuts) + 1

    def bucket(self, df: DataFrame) -> Column:
        if not self.cuts:
            return F.lit(0)
        return _bucket_of(sort_key(df, self.keys), self.cuts)

    def offsets(self, stats: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
        """P rows: bucket, rows before it (and sums before it), total rows (and totals)."""
        aggs = [F.count(F.lit(1)).alias("_cnt")] + [c.alias(f"_sum_{k}") for k, c in (sums or {}).items()]
        per = stats.groupBy(self.bucket(stats).alias(_BKT)).agg(*aggs)
        before = Window.orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
        everything = Window.partitionBy()
        out = per.select(
            _BKT,
            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
            F.sum("_cnt").over(everything).alias("_n"),
            *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in (sums or {})],
            *[F.sum(f"_sum_{k}").over(everything).alias(f"_tot_{k}") for k in (sums or {})],
        )
        return out


def keys_at(stats: DataFrame, keys: Sequence, ranks: Sequence[int], n_rows: int | None = None, **opts) -> dict[int, Column]:
    """The sort keys at some 0-based ranks of a total order, as literals (ranks beyond the end are left out).

    Selected by narrowing intervals (``select``): one key per wanted rank, whatever the number of rows.
    """
    keys = [_norm(k) for k in keys]
    keyed = stats.select(sort_key(stats, keys).alias(_SK))
    struct_type = keyed.schema[_SK].dataType
    flags = {f"n{i}": nulls == "last" for i, (_, _, nulls) in enumerate(keys)}
    found = rows_at(keyed.select(f"{_SK}.*"), struct_type.names, ranks, flags)
    return {rank: _struct_literal(row, struct_type) for rank, row in found.items()}


def _ranked(df: DataFrame, buckets: RangeBuckets, stats: DataFrame) -> DataFrame:
    offsets = buckets.offsets(stats)
    local = Window.partitionBy(_BKT).orderBy(_SK)
    staged = df.withColumn(_SK, sort_key(df, buckets.keys)).withColumn(_BKT, buckets.bucket(df))
    staged = staged.withColumn("_local", F.row_number().over(local))
    # one row per bucket
    return staged.join(F.broadcast(offsets), _BKT).withColumn("_rank0", F.col("_off") + F.col("_local") - 1)


def global_row_number(
    df: DataFrame, keys: Sequence, out_col: str = "row_number", stats: DataFrame | None = None, **opts
) -> DataFrame:
    """1-based row number over a total order of ``keys``, computed in parallel."""
    stats = stats if stats is not None else df
    buckets = RangeBuckets(stats, keys, **opts)
    ranked = _ranked(df, buckets, stats)
    return ranked.withColumn(out_col, (F.col("_rank0") + 1).cast("long")).drop(
        _SK, _BKT, "_local", "_off", "_n", "_rank0"
    )


def tile_of(stats: DataFrame, n: int, keys: Sequence, n_rows: int | None = None, **opts) -> Column:
    """The ntile(n) of a row over a total order of ``keys``, as an expression over its columns.

    Only the first key of each tile is looked for (:func:`keys_at`); no row is shuffled.
    """
    n_rows = stats.count() if n_rows is None else n_rows
    size, larger = divmod(n_rows, n)
    starts = {j * size + min(j, larger) for j in range(1, n)}
    cuts = keys_at(stats, keys, sorted(starts), n_rows, **opts)
    key = sort_key(stats, [_norm(k) for k in keys])
    return reduce(lambda a, c: a + (key >= c).cast("int"), cuts.values(), F.lit(1))


def global_ntile(df: DataFrame, n: int, keys: Sequence, out_col: str = "ntile", **opts) -> DataFrame:
    """ntile(n) over a total order of ``keys``; equals ``F.ntile(n).over(Window.orderBy(keys))``."""
    return df.withColumn(out_col, tile_of(df, n, keys, **opts))


def in_top(df: DataFrame, keys: Sequence, top: int, n_rows: int, stats: DataFrame | None = None, **opts) -> Column:
    """Whether a row is among the first ``top`` rows of a total order (selected, not ranked)."""
    last = keys_at(stats if stats is not None else df, keys, [top - 1], n_rows, **opts)
    return sort_key(df, [_norm(k) for k in keys]) <= last[top - 1] if last else F.lit(True)


def prefix_sums(
    df: DataFrame, keys: Sequence, values: dict[str, Column], stats: DataFrame | None = None, **opts
) -> DataFrame:
    """Running (inclusive) sums of ``values`` along a total order of ``keys``.

    Adds ``cum_<name>`` per value and ``tot_<name>`` (the grand total).
    """
    stats = stats if stats is not None else df
    buckets = RangeBuckets(stats, keys, **opts)
    sums = {k: F.sum(v) for k, v in values.items()}
    offsets = buckets.offsets(stats, sums)
    local = Window.partitionBy(_BKT).orderBy(_SK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = df.withColumn(_SK, sort_key(df, buckets.keys)).withColumn(_BKT, buckets.bucket(df))
    for k, v in values.items():
        staged = staged.withColumn(f"_loc_{k}", F.sum(v).over(local))
    out = staged.join(F.broadcast(offsets), _BKT)
    for k in values:
        out = out.withColumn(f"cum_{k}", F.col(f"_off_{k}") + F.col(f"_loc_{k}")).withColumn(
            f"tot_{k}", F.col(f"_tot_{k}")
        )
    drop = [_SK, _BKT, "_off", "_n"] + [f"_{p}_{k}" for k in values for p in ("loc", "off", "tot")]
    return out.drop(*drop)
