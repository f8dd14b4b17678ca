from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from shopsight.llm import toxicity


def corpus(n=500):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = i % 7 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zzorp", "qwuzz"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(docs_of, spark):
    rows, labels = corpus()
    docs, marks = docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return docs, marks, toxicity.train(docs, marks)


def test_held_out_accuracy(fitted):
    docs, marks, _ = fitted
    out = toxicity.report(docs, marks).toPandas().merge(marks.toPandas(), on="doc_id")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and (out.predicted == (out.score >= 0.5)).all()


def test_held_out_labels_do_not_matter(fitted, spark):
    docs, marks, model = fitted
    turned = marks.rdd.map(lambda r: r).collect()
    turned = [(r[0], 1 - r[1] if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]) for r in turned]
    again = toxicity.train(docs, spark.createDataFrame(turned, "doc_id bigint, toxic int"))
    assert again.intercept == model.intercept and np.array_equal(again.table, model.table)


def test_buckets_against_plain_ngrams():
    text = "Abca bé\U0001f642"
    padded = f" {text.lower()} "
    grams = {(n, padded[i : i + n]) for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}
    found = list(toxicity.ngram_buckets(text))
    assert sum(map(len, found)) == sum(len(padded) - n + 1 for n in toxicity.ORDERS)
    assert len(toxicity.present(text)) == len(grams)


def test_class_counts(docs_of, spark):
    rows = toxicity.training_rows(docs_of([(1, "aa"), (2, "aa"), (3, "bb")]), spark.createDataFrame([(1, 1), (2, 0), (3, 0), (9, 1)], "doc_id long, toxic int"))
    counts = {r["bucket"]: (r["toxic"], r["clean"]) for r in toxicity.class_counts(rows).collect()}
    used = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    assert counts[-1] == (sum(i == 1 for i in used), sum(i != 1 for i in used))


def test_odd_rows(odd_docs, docs_of, spark, fitted):
    marks = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (6, 0)], "doc_id bigint, toxic int")
    out = toxicity.report(odd_docs, marks).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)
    none = toxicity.report(odd_docs, marks.where("false")).collect()
    assert all(r["predicted"] == 0 for r in none)
    assert toxicity.report(docs_of([]), marks).count() == 0
    clash = toxicity.scored(odd_docs.drop("source").withColumnRenamed("lang", "toxic"), fitted[2])
    assert clash.columns == ["doc_id", "text", "toxic", "n_chars", "score"] and clash.count() == odd_docs.count()


def test_indistinct_texts_score_their_share_of_toxic_rows(spark, docs_of):
    """The weight of toxic rows in the fit is taken off again."""
    rng = random.Random(5)
    docs = docs_of([(i, " ".join(rng.choice(["red", "blue", "green"]) for _ in range(12))) for i in range(400)])
    labels = spark.createDataFrame([(i, 1, int(i % 10 < 3)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.report(docs, labels).toPandas()
    assert abs(rows["score"].mean() - 0.3) < 0.06 and (rows["predicted"] == 1).mean() < 0.1


def test_without_evidence_nothing_is_toxic(spark, docs_of):
    docs = docs_of([(1, "one"), (2, "two"), (3, "three"), (4, None)])
    for rows in ([], [(1, 1, 1), (2, 1, 1), (3, 1, 1)], [(1, 1, 1), (2, 1, 0)]):
        got = toxicity.report(docs, spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")).collect()
        assert len(got) == 4 and all(r["predicted"] == 0 and 0 <= r["score"] < 0.5 for r in got)
