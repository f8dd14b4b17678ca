"""A task sends one row to each part, whatever number of languages it reads."""

from __future__ import annotations

from shopsight.llm import collocations


def test_one_row_for_each_part():
    held = {lang: [w for i in range(300) for w in (b"w%d" % i, b"x%d" % i)] + [b"."] for lang in ("de", "en", "fr", "und")}
    sent = collocations._sent(held, 1, None, 16).to_pydict()
    assert sorted(sent["part"]) == sorted(set(sent["part"])) and len(sent["part"]) <= 16
    assert sum(len(w) for words in sent["words"] for w in words if w) == 4 * 600
