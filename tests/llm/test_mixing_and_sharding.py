from __future__ import annotations

import random
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from shopsight.llm import mixing, sharding

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import digest, duck_frame, spark_frame  # noqa: E402


def same_as_sql(df, documents, sql):
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    a, b = spark_frame(df), duck_frame(con, sql)
    assert len(a) == len(b) and digest(a) == digest(b)


def corpus(sizes, seed=1):
    rng = random.Random(seed)
    return [(1000 * s + i, " ".join(["w"] * rng.randint(0, 60)), "en", f"src{s}") for s, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("sizes", [[40, 40, 40], [300, 3, 5, 1], [1], [200, 1, 1, 1, 1, 1, 60]])
def test_mix_against_sql(docs_of, sizes):
    docs = docs_of(corpus(sizes))
    same_as_sql(mixing.mix_report(docs), docs, mixing.REPORT_SQL)


def water_fill(sizes):
    """Targets by clamping and resharing until nothing is above its cap."""
    total, weight = sum(sizes), [1 + i % 3 for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = total - sum(3 * sizes[i] for i in full)
        w = sum(weight[i] for i in range(len(sizes)) if i not in full)
        target = [3 * sizes[i] if i in full else left * weight[i] / w for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in full and target[i] > 3 * sizes[i]}
        if not above:
            return target
        full |= above


def test_targets_against_iteration(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = [rng.choice([1, 5, 50, 1000, 20_000]) * rng.randint(1, 9) for _ in range(9)]
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        for i, t in enumerate(water_fill(sizes)):
            assert got[f"s{i}"] == pytest.approx(t)


def test_taken_words_and_rows_agree(docs_of):
    docs = docs_of(corpus([200, 150, 90, 4]))
    report = mixing.mix_report(docs)
    for r in report.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r["k"] - r["t"]) <= 20 and r["over"] <= 0
    mix = mixing.with_size(mixing.mixed(docs)).groupBy("doc_id").agg(F.sum("size").alias("taken"))
    assert mixing.mixed(docs).columns == docs.columns
    both = report.where("taken > 0").select("doc_id", "taken").exceptAll(mix.where("taken > 0"))
    assert both.isEmpty()


def test_mix_odd_rows(odd_docs, docs_of):
    out = mixing.mix_report(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix_report(docs_of([])).count() == 0 and mixing.mixed(docs_of([])).count() == 0
    same = docs_of([(1, "a b c", "en", "s")] * 7 + [(2, "a", "en", "t")] * 2)
    assert mixing.mix_report(same).agg(F.sum("taken")).first()[0] in range(20, 27)


def test_mix_edge_bucket_is_split(docs_of, monkeypatch):
    docs = docs_of(corpus([120, 80, 10]))
    expected = sorted(map(tuple, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_BITS", 1)
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == expected


@pytest.mark.parametrize("limit", [10, 150, 4000, 10**9])
def test_shards_against_sql(docs_of, monkeypatch, limit):
    docs = docs_of([(i, "x" * (i * 37 % 101)) for i in range(300)] + [(5, "again"), (None, None)])
    monkeypatch.setattr(sharding, "ROUND_BITS", 4)
    sql = sharding.REPORT_SQL.replace(str(sharding.LIMIT), str(limit))
    # rows of one id share a shard: the SQL joins them by id
    rows = sharding.document_shards(docs, limit)
    assert rows.count() == 302
    same_as_sql(rows.distinct(), docs, f"SELECT DISTINCT * FROM ({sql})")
    fits = rows.where(~F.col("over_limit")).groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.first("shard_bytes").alias("s"))
    assert fits.where("b <> s").isEmpty() and fits.where(F.col("b") > limit).isEmpty()


def test_no_table_of_cells_is_broadcast(docs_of, monkeypatch):
    """Cells are as many as rows in the later rounds: their joins must not gather them at the driver, however small they are stored."""
    plans, write = [], sharding.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(sharding, "materialize", noted)
    found = sharding.document_shards(docs_of([(i, "a" * (i % 7)) for i in range(300)]), 100)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 300
    assert sum("SortMergeJoin" in p for p in plans) >= 2
    assert not any("BroadcastExchange" in p for p in plans)


def test_directory_covers_all_slots_once(docs_of):
    docs = docs_of([(i, "x" * (i * 37 % 101)) for i in range(300)])
    slots = sorted((r["first_slot"], r["last_slot"]) for r in sharding.directory(sharding.document_shards(docs, 400)).collect())
    assert slots[0][0] == 0 and all(a[1] < b[0] for a, b in zip(slots, slots[1:]))


def test_shards_odd_rows(odd_docs, docs_of):
    assert sharding.document_shards(odd_docs, 1000).count() == odd_docs.count()
    assert sharding.document_shards(docs_of([])).count() == 0
