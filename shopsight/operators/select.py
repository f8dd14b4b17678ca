"""Values and keys at given ranks, by narrowing intervals: no sort, no sample, no shuffled rows.

Each wanted rank has an interval that holds it, at first from the least to the
greatest value. A round cuts every open interval into ``BUCKETS`` by a monotone
function of the value, counts the rows of each bucket with their least and
greatest value in one aggregate (rows are combined in their tasks; the driver gets
a row for each bucket and interval, whatever the table holds), and goes on in the bucket
that holds the rank. A bucket with one value ends the search.

The function keeps rounds few: integers, dates and times take twelve bits a round;
doubles are first cut by exponent, until an interval spans a factor of ``BUCKETS``
at most, and then evenly; strings by the two characters after their common
prefix. So a 64-bit integer takes six rounds and a double seven at most.

Composite keys go column by column: the rows that equal a rank's value in the
columns before are searched in the next. Columns of a single value cost no round.

Defined cases: NaN is above all numbers, as in Spark's order; ties are ended by later columns; ranks
beyond the last row and empty tables have no value; nulls are placed by the caller
(a flag column before the value).
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096

def _spread(c: Column) -> Column:
    """A monotone function of a double that is near linear in its exponent."""
    return F.when(c > 0, F.log2(c) + 1100.0).when(c < 0, -F.log2(-c) - 1100.0).otherwise(0.0)


def _spread_of(x: float) -> float:
    return 0.0 if x == 0 else math.copysign(math.log2(abs(x)) + 1100.0, x)


def _bucket(c: Column, kind: T.DataType, lo, hi) -> Column:
    """The bucket of a value between lo and hi: never falls as the value grows, and parts lo from hi."""
    if isinstance(kind, T.StringType):
        same = 0
        while same < min(len(lo), len(hi)) and lo[same] == hi[same]:
            same += 1
        return F.substring(c, same + 1, 2)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("double")
        even = (lo > 0 and hi <= lo * BUCKETS) or (hi < 0 and lo >= hi * BUCKETS)
        if even:
            share = (c / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
        elif math.isinf(lo) or math.isinf(hi) or math.isnan(hi):
            share = F.lit(float("nan"))  # the ends first, then what is between
        else:
            share = (_spread(c) - _spread_of(lo)) / F.lit(_spread_of(hi) - _spread_of(lo))
    elif isinstance(kind, T.DecimalType):
        share = (c - F.lit(lo)).cast("double") / F.lit(float(hi - lo))
    else:
        whole = lambda x: F.unix_date(x) if isinstance(kind, T.DateType) else F.unix_micros(x.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else x.cast("long")
        gap = lambda x: whole(x).cast("decimal(20,0)") - whole(F.lit(lo)).cast("decimal(20,0)")
        share = gap(c).cast("double") / gap(F.lit(hi)).cast("double")
    inner = F.when(F.isnan(share), F.lit(1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))).cast("int"))
    return F.when(c == F.lit(lo), 0).when(c == F.lit(hi), BUCKETS - 1).otherwise(inner).cast("string")


def values_at(df: DataFrame, column: str, wanted: Sequence[tuple[Hashable, Column, int]], bounds: dict[Hashable, tuple]) -> list[tuple[object, int]]:
    """Of each wanted (name, condition, 0-based rank among the rows of the condition): the value at the rank and the number of rows before its first.

    Conditions of different names exclude one another; ``bounds`` has a least and a
    greatest value of each name's rows (or wider). ``df`` should be a stored table.
    """
    kind = df.schema[column].dataType
    c = F.col(column)
    cells = [(name, *bounds[name]) for name, _, _ in wanted]
    conditions = {name: condition for name, condition, _ in wanted}
    before, found = [0] * len(wanted), {}
    while True:
        for i, (_, lo, hi) in enumerate(cells):
            if i not in found and (lo == hi or lo != lo or lo is None):  # NaN: all are
                found[i] = lo
        still = sorted({cells[i] for i in range(len(cells)) if i not in found}, key=repr)
        if not still:
            return [(found[i], before[i]) for i in range(len(cells))]
        inside = [conditions[name] & (c >= F.lit(lo)) & (c <= F.lit(hi)) for name, lo, hi in still]
        cell = F.coalesce(*[F.when(x, F.lit(k)) for k, x in enumerate(inside)])
        bucket = F.coalesce(*[F.when(x, _bucket(c, kind, lo, hi)) for x, (_, lo, hi) in zip(inside, still)])
        counted = df.select(cell.alias("cell"), bucket.alias("bucket"), c.alias("x")).where("cell IS NOT NULL")
        counted = counted.groupBy("cell", "bucket").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        rows: dict[int, list] = {}
        for row in counted.collect():
            rows.setdefault(row["cell"], []).append(row)
        for k, of_cell in rows.items():
            if isinstance(kind, T.StringType):
                of_cell.sort(key=lambda r: r["lo"].encode())
            else:
                of_cell.sort(key=lambda r: int(r["bucket"]))
            for i, at in enumerate(cells):
                if i in found or at != still[k]:
                    continue
                low, rank = before[i], wanted[i][2]
                for row in of_cell:
                    if rank < low + row["n"]:
                        cells[i] = (at[0], row["lo"], row["hi"])
                        break
                    low += row["n"]
                else:
                    found[i] = None
                before[i] = low
        if not rows:
            return [(found.get(i), before[i]) for i in range(len(cells))]


def bounds_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """The least and the greatest value of each column, and under "" the number of rows, in one aggregate."""
    row = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for f, k in ((F.min, "lo"), (F.max, "hi"))]).first()
    return {"": (row["n"], row["n"]), **{c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(columns)}}


def rows_at(df: DataFrame, columns: Sequence[str], ranks: Sequence[int], null_flags: dict[str, bool]) -> dict[int, tuple]:
    """The values of the columns at 0-based ranks of the ascending order by all of them (ranks beyond the end are left out).

    ``null_flags`` names columns that say whether the value in the column after
    them is null, and what they hold if it is.
    """
    bounds = bounds_of(df, columns)
    ranks = sorted({r for r in ranks if 0 <= r < bounds[""][0]})
    prefix: dict[int, tuple] = {r: () for r in ranks}
    left = {r: r for r in ranks}
    for i, column in enumerate(columns):
        lo, hi = bounds[column]
        todo = []
        for r in ranks:
            if lo is None or i and columns[i - 1] in null_flags and prefix[r][-1] == null_flags[columns[i - 1]]:
                prefix[r] += (None,)
            elif lo == hi:
                prefix[r] += (lo,)
            else:
                same = [F.col(columns[k]).eqNullSafe(F.lit(v)) for k, v in enumerate(prefix[r])]
                todo.append((r, prefix[r], reduce(lambda x, y: x & y, same, F.lit(True))))
        found = values_at(df, column, [(name, condition, left[r]) for r, name, condition in todo], {name: bounds[column] for _, name, _ in todo})
        for (r, name, _), (value, before) in zip(todo, found):
            prefix[r] = (*name, value)
            left[r] -= before
    return prefix


