from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from shopsight.llm import collocations as co


def brute(rows, least=10, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = set()
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least or any(len(q) > len(p) and b >= least and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in f.items()):
                continue
            score, k = min(((1_000_000 * a * a) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])}
    return out


def got(df, **more):
    out = co.collocations(df, **more)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in out.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return set(map(tuple, out.collect()))


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "a", "été", "x y", "b\x00c", *[f"w{i}" for i in range(12)]]
    fixed = [["New", "york"], ["new", "york", "city"], ["in", "spite", "of"], ["per", "se"]]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(vocabulary)]
        out.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for w in words), rng.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize("chunk, small, bits", [(400_000, 4096, 1 << 26), (500, 3, 64)])
def test_against_brute_force(docs_of, monkeypatch, chunk, small, bits):
    monkeypatch.setattr(co, "BITS", bits)
    monkeypatch.setattr(co, "CHUNK", chunk)
    monkeypatch.setattr(co, "SMALL", small)
    rows = texts(small, 120)
    docs = docs_of([(i, t, lang, None) for i, (t, lang) in enumerate(rows)])
    assert got(docs) == brute(rows)
    assert got(docs, least=4, top=7) == brute(rows, 4, 7)


def test_oracle_on_the_test_tables(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(co.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    expected = {tuple(dict(zip(names, r))[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in cursor.fetchall()}
    assert expected and got(spark.read.parquet(path)) == expected


def test_partitions_are_counts_and_light_ones_are_abandoned(monkeypatch):
    monkeypatch.setattr(co, "SMALL", 2)
    rng = np.random.default_rng(1)
    for least in (1, 5):
        keys = rng.integers(1, 9, (3, 800)).astype(np.uint64)
        keys[2][rng.random(800) < 0.2] = 0
        weights = rng.integers(1, 4, 800)
        expected = {}
        for depth in (1, 2, 3):
            sums = Counter()
            for k, w in zip(keys[:depth].T.tolist(), weights.tolist()):
                if k[-1]:
                    sums[tuple(k)] += w
            expected |= {k: w for k, w in sums.items() if w >= least}
        found = [(tuple(keys[:d, p].tolist()), w) for d, ps, ws in co.partitions(keys, weights, least) for p, w in zip(ps.tolist(), ws.tolist())]
        assert len(found) == len(dict(found)) and dict(found) == expected


def test_scores_past_64_bits(spark):
    big = 4_000_000_000_000
    row = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long").select(co._score("a", "l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_odd_and_empty_tables(docs_of, odd_docs):
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("rank", "phrase", "n", "word", "h1", "depth", "part")})
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    assert got(clash, least=2) == brute(rows, 2)
    assert got(docs_of([])) == set() and got(docs_of([(1, None), (2, "")])) == set()
