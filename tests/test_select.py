"""Selection by narrowing intervals against sorted lists."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsight.operators import select
from shopsight.operators.eda import exact_quantiles
from shopsight.operators.rank import keys_at, sort_key
from shopsight.operators.select import bounds_of, rows_at, values_at


def _doubles():
    rng = np.random.default_rng(3)
    some = [*rng.normal(0, 1, 300).tolist(), *(10.0 ** rng.uniform(-300, 300, 300)).tolist(), *(-(10.0 ** rng.uniform(-300, 300, 200))).tolist()]
    return [*some, 0.0, -0.0, 5e-324, 1.7976931348623157e308, math.inf, -math.inf, *[1.5] * 40, *[1.5 + 2.0**-52] * 3]


CASES = {
    "double": _doubles(),
    "long": [*np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 400).tolist(), 2**63 - 1, -(2**63), 0, *[7] * 50, 8],
    "int": [*range(300), *[5] * 200],
    "boolean": [True] * 30 + [False] * 41,
    "date": [dt.date(1970, 1, 1) + dt.timedelta(days=i * i) for i in range(200)],
    "timestamp_ntz": [dt.datetime(1950, 1, 1) + dt.timedelta(microseconds=i**5) for i in range(300)],
    "decimal(38,6)": [Decimal(i**5) / 1_000_000 for i in range(-150, 200)],
    "string": [*[f"c{i:05d}" for i in range(300)], "", "c", "c0", "é", "\U0001f642", "zz"],
}


@pytest.mark.parametrize("kind", CASES)
def test_values_at_every_kind(spark, monkeypatch, kind):
    monkeypatch.setattr(select, "BUCKETS", 16)
    values = CASES[kind]
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(3).cache()
    order = sorted(values, key=lambda v: v.encode() if isinstance(v, str) else v)
    ranks = sorted({0, 1, len(order) // 3, len(order) // 2, len(order) - 2, len(order) - 1})
    bounds = {(): bounds_of(df, ["x"])["x"]}
    got = values_at(df, "x", [((), F.lit(True), r) for r in ranks], bounds)
    assert [v for v, _ in got] == [order[r] for r in ranks]
    assert [b for _, b in got] == [order.index(order[r]) for r in ranks]


def test_rounds_of_a_double_and_nan(spark, monkeypatch):
    df = spark.createDataFrame([(v,) for v in [*_doubles(), math.nan, math.nan]], "x double").cache()
    rounds = []
    inner = select._bucket
    monkeypatch.setattr(select, "_bucket", lambda c, kind, lo, hi: rounds.append((lo, hi)) or inner(c, kind, lo, hi))
    order = sorted(_doubles())
    got = values_at(df, "x", [((), F.lit(True), 500)], {(): (-math.inf, math.nan)})
    assert got[0][0] == order[500] and len(rounds) <= 9
    assert math.isnan(values_at(df, "x", [((), F.lit(True), len(order))], {(): (-math.inf, math.nan)})[0][0])


@pytest.mark.parametrize("nulls", ["first", "last"])
def test_rows_at_composite_keys(spark, nulls):
    rng = np.random.default_rng(2)
    rows = [(None if i % 7 == 0 else int(rng.integers(0, 3)), f"p{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "v int, id string").cache()
    keys = [("v", "desc", nulls), ("id", "asc", "first")]
    order = [tuple(r[0]) for r in df.select(sort_key(df, keys).alias("k")).orderBy("k").collect()]
    found = keys_at(df, keys, [0, 70, 71, 72, 250, 499, 500])
    assert sorted(found) == [0, 70, 71, 72, 250, 499]
    got = spark.range(1).select(*[c.alias(str(r)) for r, c in found.items()]).first()
    assert {r: tuple(got[str(r)]) for r in found} == {r: order[r] for r in found}
    assert keys_at(df.limit(0), keys, [0]) == {} and rows_at(df.limit(0), ["v"], [0], {}) == {}


def test_quantiles_of_groups_move_no_row(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 701)) for x in rng.normal(size=n)] + [("d", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, "x", [0.25, 0.5, 1.0], by=["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", "c", None}
    for (g, q), value in got.items():
        assert value == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], q), abs=1e-9)
    assert exact_quantiles(df.limit(0), "x", [0.5]).count() == 0
