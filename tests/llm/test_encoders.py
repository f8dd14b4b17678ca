from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest

from shopsight.llm import bpe, token_counts

TEXTS = [
    "",
    "  ",
    "<|endoftext|>x<|startoftext|>Y <|endoftext",
    "it's we'll I'D 'S ''s 're123½ΣΑΣ İstanbul ǅ ﬁ é Å Å",
    "a" * 3000,
    "ab" * 2000,
    "\x00a\x00",
    "\u0085 a\x1cb\x1db",
    "a՘b \U000323b0 Ᲊ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.vocabulary_path("word_bpe_49k.json"))


def samples():
    rng = random.Random(1)
    out = ["".join(rng.choice("abcdeinrsthgo ") for _ in range(300)) for _ in range(200)]
    out += ["".join(rng.choice("aeinst'0 é!?.,ßçñ€漢字\U0001f642̧́σΣ") for _ in range(200)) for _ in range(200)]
    return out + ["the" * k for k in range(40)] + ["ingtion" * k + "s" for k in range(40)]


def test_encodes_and_decodes_as_the_library(own, library):
    for text in TEXTS + samples():
        ids = library.encode(text, add_special_tokens=False).ids
        codes = own.encode(text)
        assert np.frombuffer(codes, "<u4").tolist() == ids, text[:60]
        assert own.decode(codes).decode() == library.decode(ids, skip_special_tokens=False)


def test_offset_table_holds_every_token(own, library):
    pieces = own.pieces()
    assert all(pieces[i].decode() == t for t, i in library.get_vocab().items())


def test_memo_limit_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    for text in samples()[:20]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoded_rows(odd_docs, docs_of, library):
    out = bpe.encoded(odd_docs, with_ids=True).collect()
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect())
    assert len(out) == len(texts)
    for r, (_, text) in zip(sorted(out, key=lambda r: (r["doc_id"] or 0, r["n_tokens"])), texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(docs_of([])).count() == 0


def greedy(vocabulary, word):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_longest_match_against_greedy():
    rng = random.Random(2)
    for _ in range(300):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))}
        machine = token_counts.LongestMatch(sorted(vocabulary))
        for _ in range(30):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(0, 25)))
            assert machine.count(word) == greedy(vocabulary, word), (vocabulary, word)


def greedy_to_the_end(vocabulary, suffix, word):
    """Longest token at each place; the piece that ends the word carries the suffix, no other does."""
    n = at = 0
    while at < len(word):
        ends = range(len(word), at, -1)
        end = next((e for e in ends if word[at:e] + (suffix if e == len(word) else "") in vocabulary), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_longest_match_honours_the_suffix():
    rng = random.Random(3)
    built = 0
    for _ in range(600):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) + rng.choice(["", "$"]) for _ in range(rng.randint(1, 30))}
        vocabulary |= {c + "$" for c in "abc" if rng.random() < 0.7} | {c for c in "abc" if rng.random() < 0.7}
        machine = token_counts.LongestMatch(sorted(vocabulary), "$")
        for _ in range(40):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(0, 25)))
            assert machine.count(word) == greedy_to_the_end(vocabulary, "$", word), (vocabulary, word)
            built += machine.count(word) is not None
    assert built > 5_000


def test_counts_equal_greedy_over_the_files_own_vocabulary(own):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    counter, chars = token_counts.WordCounter(path), bpe.byte_characters()
    for text in TEXTS[2:5] + samples()[:150]:
        for word in set(text.lower().encode().split()):
            word = word[:300]
            expected = greedy_to_the_end(model["vocab"], model["end_of_word_suffix"], "".join(chars[b] for b in word))
            assert counter.count(word) == (1 if expected is None else expected), word


def test_counted_rows(odd_docs, docs_of):
    out = token_counts.counted(odd_docs).collect()
    assert len(out) == odd_docs.count()
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in out}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4] == (2, 2) and got[5][0] == 30_000
    assert token_counts.counted(docs_of([])).count() == 0
