from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from shopsight.llm import spelling as sp


def distance_is_one(a, b):
    """By all edits."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near = {w: [] for w in n}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        for k in (len(w), len(w) - 1):
            for v in by_length.get(k, []):
                if (k < len(w) or v < w) and distance_is_one(w, v):
                    near[w].append(v)
                    near[v].append(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    out = sp.variants(df)
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    rows = list(map(tuple, out.collect()))
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("branch, flush", [(20_000, 200_000), (5, 50)])
def test_against_brute_force(docs_of, monkeypatch, branch, flush):
    monkeypatch.setattr(sp, "BRANCH", branch)
    monkeypatch.setattr(sp, "FLUSH", flush)
    rng = random.Random(branch)
    letters = "aeinsréê×ß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(120)]
    for _ in range(400):
        w = list(rng.choice(words))
        at = rng.randrange(len(w))
        w[at : at + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
        words.append("".join(w))
    rows = [(i if i % 9 else None, " ".join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(words, weights=[1 + k % 50 for k in range(len(words))], k=60)) + rng.choice([".", "1", "Ā"])) for i in range(200)]
    rows.append((777, "Aaaaa" * 900 + " aaaaa" * 2000))
    assert got(docs_of(rows)) == brute(rows)


def test_documents_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(docs) == expected and any(f is not None and f != root for _, f, root, *_ in expected)


def test_a_search_enters_the_branch_of_every_near_word_once():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("aeinsrté") for _ in range(rng.randint(5, 9)))
        i = rng.randrange(len(a))
        b = a[:i] + rng.choice(["", "e", "a", "t", "é", a[i] + "n"]) + a[i + 1 :]
        assert sp.near(a, b) == distance_is_one(a, b)
        for top in (3, 7):
            found = 0
            for x, y in ((a, b), (b, a)):
                held = sp.Branch(top)
                held.add(y, 1)
                for name, surplus, deficit in sp.visits(x, top):
                    if deficit >= 0 and name == sp.branch(len(y), sp.vector(y)[:top]):
                        held.visit(x, 1, surplus, deficit)
                found += sum(t for t, _ in held.found.values())
            assert found == 2 * distance_is_one(a, b), (a, b)


def test_odd_and_empty_tables(docs_of, odd_docs):
    clash = odd_docs.unionByName(odd_docs).unionByName(odd_docs).withColumns({c: F.lit(1) for c in ("word", "n", "form", "root", "branch")})
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] * 3
    assert got(clash) == brute(rows)
    assert got(docs_of([])) == set() and got(docs_of([(1, None), (2, "")])) == set()
