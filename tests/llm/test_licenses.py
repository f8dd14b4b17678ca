from __future__ import annotations

import random
import re

import pytest
from shopsight.llm import licenses


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))


def test_words():
    text = "Ab-1 é漢\x80\x7f_ [x]\x00y{z}^`~"
    assert [w.decode() for w in licenses.words_of_text(text)] == words(text)


def test_statistics_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 15))] for _ in range(3)]
        machine = licenses.Automaton(sequences)
        stream = [rng.randint(0, 4) for _ in range(40)]
        for i, (length, state) in enumerate(machine.statistics(stream)):
            ends = lambda n: {(t, j) for t, s in enumerate(sequences) for j in range(len(s)) if j - n + 1 >= 0 and s[j - n + 1 : j + 1] == stream[i - n + 1 : i + 1]}  # noqa: E731, B023
            assert length == max((n for n in range(1, i + 2) if ends(n)), default=0)
            if length:
                assert set(machine.ends[state]) == ends(length)


def test_whole_templates_are_found(scanner):
    for label, text in licenses.TEMPLATES:
        n, _, spans = scanner.scan(f"some words before {text} and some after")
        assert n == len(words(text)) + 6
        assert any(s.label == label and s.share == 1.0 and s.first == 3 for s in spans)


def test_altered_template_is_chained(scanner):
    label, text = licenses.TEMPLATES[0]
    cut = text.split()
    cut[20] = "CHANGED"
    cut[60:64] = []
    _, _, spans = scanner.scan(" ".join(cut))
    assert [s.label for s in spans] == [label] and spans[0].share > 0.9 and spans[0].first == 0


def test_no_label_from_a_shared_beginning(scanner):
    assert {s.label for s in scanner.scan("This work is licensed under the GNU General Public License, version 3.")[2]} == {"gpl"}
    assert scanner.scan("permission to use the work is granted by the authors")[2] == []


def test_base_against_brute_force(docs_of, odd_docs):
    rng = random.Random(2)
    pool = "gnu general public license apache mit cc by x LICENSE Cc-BY".split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(60))) for i in range(60)]
    for r in licenses.scanned(docs_of(rows)).collect():
        w = words(rows[r["doc_id"]][1])
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    odd = licenses.scanned(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r["n_base"] == 0 and r["labels"] == "" for r in odd)
    assert licenses.scanned(docs_of([])).count() == 0
