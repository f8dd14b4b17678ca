from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsight.llm import quality


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus(n=400, junk=12):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 300))) + ".", "en", f"s{i % 2}") for i in range(n)]
    rows += [(n + i, " ".join(rng.choice(vocabulary) + "***" for _ in range(120)), "en", f"s{i % 2}") for i in range(junk)]
    return rows


def test_counts_against_brute_force(docs_of, odd_docs):
    rng = random.Random(1)
    texts = ["a b c d e f g h a b c d e f g h", "x " * 40, "l one\nl one\n\n\nl two\n l one", "é|# <> &&", "a\x0bb\x1cc d"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    df = docs_of([(i, t) for i, t in enumerate(texts)]).unionByName(odd_docs)
    for r in quality.with_counts(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(r["text"])


def test_rejects_outliers_and_keeps_the_rest(docs_of):
    rows = corpus()
    out = {r["doc_id"]: r for r in quality.report(docs_of(rows)).collect()}
    assert all(out[i]["kept"] for i in range(400)) and not any(out[i]["kept"] for i in range(400, 412))
    kept = quality.kept_documents(docs_of(rows))
    assert {r["doc_id"] for r in kept.collect()} == set(range(400)) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_distance_against_numpy(docs_of, spark):
    names = list(quality.STATISTICS)
    stats = quality.with_counts(docs_of(corpus())).withColumn("base_failed", quality.base_failed())
    stats = quality._grouped(stats.drop("text"))
    model = {r["__g"]: r.asDict() for r in quality.estimates(stats).collect()}
    assert len(model) == 2
    rows = quality.judged(docs_of(corpus()), ["doc_id", "source"]).toPandas()
    for key, m in model.items():
        own = rows[rows.source == key[-2:]]
        low = np.array([[m.get(f"l_{a}_{b}", 0.0) if j <= i else 0.0 for j, b in enumerate(names)] for i, a in enumerate(names)])
        z = np.column_stack([(own[quality.STATISTICS[n][0]] / own[quality.STATISTICS[n][1]] - m[f"c0_{n}"]) * np.sqrt(own.n_words / (own.n_words + quality.SHRINK)) for n in names])
        y = np.linalg.solve(low, (z - [m[f"m_{n}"] for n in names]).T)
        assert np.allclose((y**2).sum(axis=0), own.distance, rtol=1e-6)


def test_small_groups_are_pooled_or_left(docs_of):
    rows = [(i, t, "en" if i % 3 else None, f"s{i}") for i, t, _, _ in corpus(90, 0)]
    out = quality.judged(docs_of(rows), ["doc_id"])
    assert out.where("distance IS NULL").count() in (0, 30) and out.where("kept").count() == 90
    assert quality.judged(docs_of(rows[:10]), ["doc_id"]).where("distance IS NULL AND kept").count() == 10


def test_odd_rows(odd_docs, docs_of):
    out = quality.report(odd_docs.withColumn("n_words", F.lit(5)).withColumn("kept", F.lit("x"))).collect()
    assert len(out) == odd_docs.count() and all(r["kept"] is not None for r in out)
    assert quality.report(docs_of([])).count() == 0 and quality.kept_documents(docs_of([])).count() == 0


def test_runs_without_python(odd_docs):
    plan = quality.report(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def with_junk(rows, junk, share, copies):
    """Rows of one group, of which the share is junk: copies of one text, or texts of their own."""
    rng = random.Random(9)
    good = [(i, text, "en", "s") for i, text, _, _ in rows]
    n = round(len(good) * share / (1 - share))
    words = [["".join(rng.choice("abcdefghij") for _ in range(5)) + ("#" if rng.random() < junk else "") for _ in range(100)] for _ in range(n)]
    return good, [(len(good) + i, " ".join(words[0 if copies else i]), "en", "s") for i in range(n)]


@pytest.mark.parametrize(("share", "copies"), [(0.26, True), (0.34, True), (0.34, False), (0.45, False), (0.6, True)])
def test_rejects_junk_that_is_a_large_part_of_a_group(docs_of, share, copies):
    good, junk = with_junk(corpus(300, 0), 0.61, share, copies)
    out = {r["doc_id"]: r["kept"] for r in quality.report(docs_of(good + junk)).collect()}
    assert not any(out[i] for i, *_ in junk) and all(out[i] for i, *_ in good)


def test_least_determinant_against_numpy(docs_of):
    """The estimate is a fixed point of concentration, and no worse than from many random starts."""
    good, junk = with_junk(corpus(119, 0), 0.61, 0.3, False)
    names = list(quality.STATISTICS)
    stats = quality._grouped(quality.with_counts(docs_of(good + junk)).withColumn("base_failed", quality.base_failed()).drop("text"))
    (m,) = [r.asDict() for r in quality.estimates(stats).collect()]
    rows = stats.toPandas()
    z = np.column_stack([(rows[quality.STATISTICS[n][0]] / rows[quality.STATISTICS[n][1]] - m[f"c0_{n}"]) * np.sqrt(rows.n_words / (rows.n_words + quality.SHRINK)) for n in names])
    floors = np.diag([quality.STATISTICS[n][2] ** 2 for n in names])
    half = (len(z) + 1) // 2

    def concentrate(centre, covariance):
        d = (z - centre) @ np.linalg.inv(covariance)
        core = z[np.argsort((d * (z - centre)).sum(axis=1), kind="stable")[:half]]
        return core.mean(axis=0), quality.CONSISTENCY * np.cov(core.T, bias=True) + floors

    low = np.array([[m.get(f"l_{a}_{b}", 0.0) for b in names] for a in names])
    found = np.array([m[f"m_{n}"] for n in names]), low @ low.T
    assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(found, concentrate(*found)))
    rng, dets = np.random.default_rng(1), []
    for _ in range(50):
        some = z[rng.choice(len(z), 7, replace=False)]
        model = some.mean(axis=0), np.cov(some.T, bias=True) + floors
        for _ in range(30):
            model = concentrate(*model)
        dets.append(np.linalg.slogdet(model[1])[1])
    assert np.linalg.slogdet(found[1])[1] <= min(dets) + 0.05
