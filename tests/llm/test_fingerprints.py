from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from shopsight.llm import fingerprints as fp


def vectors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["fp"] for r in fp.with_vector(df, "text", "fp").orderBy("i").collect()]


def test_lanes_are_sums_over_paragraphs(spark):
    texts = ["a b c\nd e f", "d e f\na b c", "a b c\nd e g", "a b c", "d e f", "", None]
    whole, turned, other, first, second, empty, null = vectors(spark, texts)
    assert whole == turned and whole != other and empty == null
    for i in range(fp.DIGEST_LANES):
        lanes = [int(hashlib.sha512(p.encode()).hexdigest()[8 * i : 8 * i + 8], 16) for p in ("a b c", "d e f")]
        assert whole["digest"][i] == sum(lanes) % 2**32
    assert whole["sketch"] == [a + b for a, b in zip(first["sketch"], second["sketch"])]


def test_insert_and_delete_a_paragraph(spark):
    df = spark.createDataFrame([("x y z\nq r s", "x y z", "q r s")], "whole string, one string, two string")
    for c in ("whole", "one", "two"):
        df = fp.with_vector(df, c, f"v_{c}")
    row = df.select("v_whole", fp.combine(F.col("v_one"), F.col("v_two")).alias("sum"), "v_one", fp.combine(F.col("v_whole"), F.col("v_two"), -1).alias("left")).first()
    assert row["sum"] == row["v_whole"] and row["left"] == row["v_one"]


def test_counts_in_blocks_agree(spark, monkeypatch):
    texts = ["a b. c d. e f. g h. i j. k l. m n. o"]
    whole = vectors(spark, texts)
    monkeypatch.setattr(fp, "BLOCK_RUNS", 3)
    assert vectors(spark, texts) == whole


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_edited_texts_and_likeness(docs_of, buckets):
    words = [f"w{i}" for i in range(2000)]
    rows = [(7 * i, " ".join(words[11 * i : 11 * i + 20 + i]) + (". " * (i % 3))) for i in range(60)] + [(7, "same id, other text"), (9, ""), (10, None)]
    got = {(r["doc_id"], r["n_chars"]): r for r in fp.edited_likeness(docs_of(rows), buckets).collect()}
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    for (doc_id, text), (_, after) in zip(order, [*order[1:], order[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id, len(text)]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    near = [r["near_edited"] for r in got.values() if r["n_chars"] > 100]
    assert sum(near) / len(near) > 0.3


def test_odd_rows(odd_docs, docs_of):
    out = fp.edited_likeness(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert fp.edited_likeness(docs_of([])).count() == 0
    one = fp.edited_likeness(docs_of([(1, "ab")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()


def test_runs_without_python_or_global_sort(odd_docs):
    plan = fp.edited_likeness(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
