"""Byte-pair encoding by backtracking, and decoding through an offset table.

Encoder: an Aho-Corasick automaton over all tokens gives, for every place of a
word, the longest token that starts there. The encoder takes it if it can stand
beside the token before it, that is, if merging by rank would never merge across
their border (:meth:`Bpe.fits`); else it tries the next shorter token that
starts there, else it steps back one token. Places found dead are marked, so a
word takes time linear in its length. The result is exactly that of merging by
rank.

Tokens of the vocabulary are strings; those with the end-of-word suffix stand
only at a word's end. A token's id is its merge's rank plus a constant, which
:class:`Bpe` verifies.

Decoder: the token strings lie in one byte string; token ``i`` is
``blob[offsets[i]:offsets[i + 1]]``.

Texts are split at special tokens, normalised (NFC, lower case) and cut into
words as the vocabulary file says. Defined cases: a null text is empty; an empty
text has no tokens and decodes to the empty text. Each task takes whole texts in
batches; words are encoded once and kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import whole_text

#: Words whose tokens a worker keeps; the memo starts anew when it is full.
MEMO_WORDS = 400_000
#: Stands for the end-of-word suffix within a word's symbols.
END = "\x00"

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for lower-case ASCII texts.
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with its automaton, pair table and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if spec["normalizer"] != NORMALIZER or model["type"] != "BPE" or not suffix or model["ignore_merges"]:
            raise ValueError(f"{path}: not a vocabulary of the kind this encoder knows")
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}

        # splits[t]: the two tokens that merge to t; a base token is both parts of itself
        self.splits: list[tuple[int, int]] = [(i, i) for i in range(max(strings) + 1)]
        self.pairs: dict[tuple[int, int], int] = {}
        first = vocab["".join(merges[0])] if merges else 0
        for rank, (a, b) in enumerate(merges):
            merged = vocab[a + b]
            if merged != first + rank or max(vocab[a], vocab[b]) >= merged:
                raise ValueError(f"{path}: ids do not follow the merges")
            self.splits[merged] = (vocab[a], vocab[b])
            self.pairs[vocab[a], vocab[b]] = merged

        form = lambda s: s[: -len(suffix)] + END if s.endswith(suffix) else s
        self.size = [0] * len(self.splits)
        self.automaton = ahocorasick.Automaton()
        symbols = {form(s): i for s, i in vocab.items()}
        for s, i in symbols.items():
            self.size[i] = len(s)
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        # the next shorter token with the same start, -1 if there is none
        self.shorter = [-1] * len(self.splits)
        for s, i in symbols.items():
            self.shorter[i] = next((symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in symbols), -1)

        ordered = [strings.get(i, "").encode() for i in range(len(self.splits))]
        self.blob = b"".join(ordered)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in ordered])]).astype(np.int64)
        self._bytes = byte_characters()
        self._path, self._library = path, None
        self._memo: dict[str, bytes] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave these two tokens side by side.

        Walks both tokens back, the later merge first: at each step the border
        lies between a right part of ``left`` and a left part of ``right``, and a
        merge of these with a lower rank than what undoes them would have won.
        """
        bound = len(self.splits)
        while True:
            merged = self.pairs.get((left, right))
            if merged is not None and merged < bound:
                return False
            left_part, right_part = self.splits[left][1], self.splits[right][0]
            left_whole, right_whole = left_part == left, right_part == right
            if left_whole and right_whole:
                return True
            # on a tie the left token, which stands first, was merged first
            if not left_whole and (right_whole or left > right):
                bound, left = left, left_part
            else:
                bound, right = right + 1, right_part

    def encode_symbols(self, word: str) -> list[int]:
        """Tokens of one word of byte characters that ends with END."""
        n = len(word)
        longest = [0] * n
        token_at = [-1] * n
        for end, (size, token) in self.automaton.iter(word):
            start = end - size + 1
            if size > longest[start]:
                longest[start], token_at[start] = size, token
        alive = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, token_at[0]
        while at < n:
            while token >= 0:
                end = at + self.size[token]
                if alive[end] and (end == n or token_at[end] >= 0) and (not tokens or self.fits(tokens[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                tokens.append(token)
                at += self.size[token]
                token = token_at[at] if at < n else -1
            else:
                alive[at] = 0
                if not tokens:
                    raise ValueError(f"the vocabulary cannot build {word!r}")
                token = tokens.pop()
                at -= self.size[token]
        return tokens

    def _word(self, word: str) -> bytes:
        symbols = "".join(map(self._bytes.__getitem__, word.encode())) + END
        ids = np.array(self.encode_symbols(symbols), dtype="<u4").tobytes()
        if len(self._memo) >= MEMO_WORDS:
            self._memo.clear()
        self._memo[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised.

        Characters that this Python's Unicode tables do not know yet may be
        letters to the tokenizers library's newer ones: texts with such take its
        normaliser and its word split.
        """
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._library_words(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case of each character by itself
        return SPLIT.findall(text.lower())

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        text = self._library.normalizer.normalize_str(text)
        places = self._library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in places]

    def _plain(self, text: str, out: list[bytes]) -> None:
        memo, word = self._memo, self._word
        out.extend([memo.get(w) or word(w) for w in self.words(text)])

    def encode(self, text: str) -> bytes:
        """Token ids of a text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if self._cut is None or "<|" not in text:
            self._plain(text, out)
        else:
            for part in self._cut.split(text):
                if part in self.specials:
                    out.append(np.array([self.specials[part]], dtype="<u4").tobytes())
                else:
                    self._plain(part, out)
        return b"".join(out)

    def pieces(self) -> list[bytes]:
        """Each token's bytes, read through the offset table."""
        at = self.offsets.tolist()
        return [self.blob[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings, joined by spaces (the vocabulary file names no decoder), in UTF-8."""
        if not hasattr(self, "_pieces"):
            self._pieces = self.pieces()
        return b" ".join([self._pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of a file, loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(documents: DataFrame, name: str = "word_bpe_49k.json", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document: the key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary_path(name))
        for batch in batches:
            n, a, b, ids, texts = [], [], [], [], []
            for text in batch.column(1):
                codes = bpe.encode(text.as_py())
                plain = bpe.decode(codes)
                n.append(len(codes) // 4)
                a.append(hashlib.sha256(codes).hexdigest())
                b.append(hashlib.sha256(plain).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(codes, dtype="<i4"))
                    texts.append(plain.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select(key, whole_text().alias("text")).mapInArrow(run, schema)
