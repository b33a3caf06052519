"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

A byte-level BPE splits a text before any merge, and never across a space that follows a non-space. So a
text may be cut at such spaces, and the ids of the pieces put together are the ids of the whole text.
Pieces are looked up in a bounded table that a Python worker keeps over its tasks; the library encodes
those not found. A tokenizer built otherwise encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array

import numpy as np

#: Entries of a worker's table, some 200 bytes each; a full table is kept once more as the older one, then forgotten.
CACHE_ENTRIES = 400_000

_CUT = re.compile(r"(?<=\S)(?= )")
#: Letters past Latin Extended may be classed by another Unicode version in Python than in the library.
_LATIN = "\u024f"
#: White space that texts hardly hold, put between words that are cut together.
_MARK = "\x0b"
#: The pattern with which byte-level BPE cuts texts, as the tokenizer files state it.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class Encoder:
    """Texts to little-endian ids, `dtype` wide."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 0xFF00 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.between = b"\xff" * self.dtype.itemsize  # past the vocabulary, and no two ids hold these bytes
        self.limit = cache_entries
        self.words: dict[str, bytes | bool] = {}
        self.older_words: dict[str, bytes | bool] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        bpe = spec.get("model") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
            and bpe.get("type") == "BPE" and not bpe.get("continuing_subword_prefix") and not bpe.get("end_of_word_suffix")
        )
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.pretokens = regex.compile(_PRETOKEN).findall
        self.letters = _byte_letters()
        self.letters_in_lines = self.letters | {10: "\n"}
        self.marks = {c: self._plain(c) for c in string.punctuation} if self.by_piece else {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn_parts(self, parts: set[str]) -> None:
        """Parts are what the pattern cuts out: each is merged by itself."""
        if len(self.parts) > self.limit:
            self.parts, self.older_parts = {}, self.parts
        known, older, new = self.parts, self.older_parts, []
        for p in parts.difference(known):
            got = older.get(p)
            if got is None:
                new.append(p)
            else:
                known[p] = got
        tokenize, code = self.model.tokenize, self.code
        lines = [p for p in new if "\n" not in p]
        letters = "\n".join(lines).encode().decode("latin-1").translate(self.letters_in_lines).split("\n")
        for p, x in zip(lines, letters, strict=False):
            known[p] = array(code, [t.id for t in tokenize(x)]).tobytes()
        for p in new:
            if "\n" in p:
                known[p] = array(code, [t.id for t in tokenize(p.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _ids(self, piece: str) -> bytes:
        """A piece by itself."""
        if not piece:
            return b""
        if not piece.isascii() and max(piece) > _LATIN:
            return self._plain(piece)
        parts = self.pretokens(piece)
        self._learn_parts(set(parts))
        return b"".join(map(self.parts.__getitem__, parts))

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters alone: with the space before, each is one part."""
        letters = "\n ".join(words).encode().decode("latin-1").translate(self.letters_in_lines)
        tokenize, code, known = self.model.tokenize, self.code, self.words
        for w, x in zip(words, (self.letters[32] + letters).split("\n"), strict=True):
            known[w] = array(code, [t.id for t in tokenize(x)]).tobytes()

    def _learn_words(self, words: set[str]) -> None:
        """Words that follow a space. One that is empty or ends in white space may join what follows: False."""
        known, bulk, marked = self.words, [], []
        if self.older_words:
            for w in words & self.older_words.keys():
                known[w] = self.older_words[w]
                words.discard(w)
        letters = {w: None for w in words if w.isalpha() and (w.isascii() or max(w) <= _LATIN)}
        for w in words - letters.keys():
            base = w[:-1]
            if w and w[-1] in self.marks and base.isalpha() and (w.isascii() or max(w) <= _LATIN):
                marked.append((w, base))
                if base not in known and base not in letters:
                    got = self.older_words.get(base)
                    if got is None:
                        letters[base] = None
                    else:
                        known[base] = got
            elif not w or w[-1].isspace():
                known[w] = False
            elif w[0].isspace() or _MARK in w or (not w.isascii() and max(w) > _LATIN):
                known[w] = self._ids(" " + w)
            else:
                bulk.append(w)
        if letters:
            self._learn_letters(list(letters))
        for w, base in marked:
            known[w] = known[base] + self.marks[w[-1]]
        if not bulk:
            return
        parts = self.pretokens(" " + f"{_MARK} ".join(bulk))  # the mark before a space is a part of its own
        self._learn_parts(set(parts).difference(_MARK))
        found, self.parts[_MARK] = self.parts.get(_MARK), self.between
        ids = b"".join(map(self.parts.__getitem__, parts)).split(self.between)
        del self.parts[_MARK]
        if found is not None:
            self.parts[_MARK] = found
        known.update(zip(bulk, ids, strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(x.ids, dtype=self.dtype).tobytes() for x in got]
        if len(self.words) > self.limit:
            self.words, self.older_words = {}, self.words
        words: list[str] = []
        ends = []
        for text in texts:
            words += text.split(" ")
            ends.append(len(words))
        ids = list(map(self.words.get, words))
        absent = [k for k, x in enumerate(ids) if x is None]
        self._learn_words({words[k] for k in absent})
        for k in absent:
            ids[k] = self.words[words[k]]
        out, at = [], 0
        for text, end in zip(texts, ends, strict=True):
            head = words[at]
            try:
                if end == at + 1 or not head or head[-1].isspace() or any(s in text for s in self.special):
                    raise TypeError
                out.append(self._ids(head) + b"".join(ids[at + 1 : end]))
            except TypeError:  # a False among them
                out.append(self._whole(text))
            at = end
        return out

    def _whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(map(self._ids, _CUT.split(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, entries)
    _ENCODERS[path].limit = entries
    return _ENCODERS[path]


def encoded(batches, path: str, end: int, at_once: int = 200, entries: int = CACHE_ENTRIES):
    """From Arrow batches of (doc_id, text), lists of doc ids with ids as uint32 arrays, `end` appended.

    A null text counts as empty.
    """
    tail = np.array([end], dtype="<u4")
    e = encoder(path, entries)
    for batch in batches:
        for a in range(0, batch.num_rows, at_once):
            part = batch.slice(a, at_once)
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = [np.concatenate([np.frombuffer(x, dtype=e.dtype).astype("<u4"), tail]) for x in e.encode_many(texts)]
            yield part.column("doc_id").to_pylist(), ids
