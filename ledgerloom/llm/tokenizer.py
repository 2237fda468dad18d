"""Exact token ids through a per-worker cache of space-delimited chunks.

Neither public vocabulary lets a token cross from a non-space character to a space, so the ids of a text
are the ids of its chunks, one after the other; the tests hold that against whole texts. The special strings
of a vocabulary hold no space and so stay in one chunk, where the library finds them.

The word vocabulary drops white space, so its chunks are the runs between white space. In the byte vocabulary the space belongs
to the token after it, so a chunk is a run of white space with the run of other characters that follows. Its Latin texts need
no cache: a coder by rank, proven equal to the library when it is loaded, takes them whole; other chunks go to the library.
"""

from __future__ import annotations

import json
import os
import re
import sys
import threading
import time
import weakref
from array import array
from itertools import groupby

import numpy as np

CACHE_WORDS = 300_000
"""Chunks in one generation of a worker's cache. Two are kept, and what is used again moves to the younger one."""
CACHE_CHARS = 64
"""Longer chunks are encoded each time, so a worker's cache stays within a bound of bytes."""

IDLE_SECONDS = 3.0
"""A worker's caches last from task to task, and go when it has not used them for so long: its memory is then for other stages."""

_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\\[-`{-~]*)").fullmatch
_LETTERS, _GAP = "[!-;=-~À-ÖØ-öø-ÿ]", "[\n ]"
_LATIN = re.compile(f"{_GAP}{{0,500}}+(?:{_LETTERS}{{1,500}}+{_GAP}{{1,500}}+)*+{_LETTERS}{{0,500}}+").fullmatch
"""Texts of Latin letters, marks, spaces and line ends whose runs are of at most 500 characters (what codes by rank takes time in their square)."""
#: How byte-level vocabularies of this kind split a text.
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBES = ["the", "The", "THE,", "été.", "ÉTÉ", "Straße,", "zß", "a", "I.", "nonconformidades", "ñandú", "øre", "þing.", "ÿ,", "und&&&", "a_b", "x_", "the...", "of***."]

_chunkers: dict[str, Chunks] = {}


def byte_spelling() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = dict(zip(shown, map(chr, shown), strict=True))
    return spelled | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in spelled)}


def byte_letters() -> dict[int, str]:
    """The same for each character below 256: its UTF-8 bytes, spelled."""
    spelled = byte_spelling()
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(256)}


def _watch(cache: Generations) -> None:
    """Have the cache forget when it is idle, as long as it exists."""
    held = weakref.ref(cache)

    def look() -> None:
        while (c := held()) is not None:
            if c and time.monotonic() - c.used > IDLE_SECONDS:
                c.forget()
            del c
            time.sleep(IDLE_SECONDS / 3)

    threading.Thread(target=look, daemon=True).start()


class Generations(dict):
    """A bounded cache: when it is full, its entries become the old generation, and those used again come back."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old, self.used = size, {}, time.monotonic()
        _watch(self)

    def forget(self) -> None:
        """Drop what is held; what is asked for again is worked out again."""
        self.old = {}
        self.clear()

    def turn(self) -> None:
        """Make what is held the old generation."""
        self.old = dict(self)
        self.clear()


class Chunks(Generations):
    """chunk -> its ids as little-endian bytes of 2 or 4 each; a missing chunk is encoded by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(CACHE_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.drops_space = described["model"].get("end_of_word_suffix") == "</w>"
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.code = next(c for c in "HIL" if array(c).itemsize == self.width.itemsize)
        self.marks: dict[str, bytes] = {}
        self.ranked = rank_coder(self.tokenizer, described)
        probes = _PROBES if self.drops_space else [*_PROBES, *(f" {x}" for x in _PROBES), *(f"\n {x}" for x in _PROBES)]
        self.plain = self.drops_space or self.ranked is not None
        self.plain = self.plain and sys.byteorder == "little"
        self.plain = self.plain and all(self.raw(x) == self.by_library(x) for x in probes)

    def split(self, text: str) -> list[str]:
        """The chunks of a text."""
        if not self.drops_space:
            return _spaced(text)
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # Python's white space, but not the library's
            return _unspaced(text)
        return text.split()

    def by_library(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def encoded(self, chunk: str) -> bytes:
        """A chunk's ids. A word of Latin letters, with marks after it at most, goes to the library's model at once: there is nothing to normalize or split."""
        if self.ranked is not None or not (self.plain and (found := _PLAIN(chunk))):
            return self.by_library(chunk)
        word, mark = found.groups()
        own = word.lower()
        if own == chunk:
            return self.word(own)
        ids = self.get(own) or self.old.get(own)
        if ids is None:
            ids = self.word(own)
            if len(own) <= CACHE_CHARS:
                self[own] = ids
        return ids + self.mark(mark) if mark else ids

    def word(self, own: str) -> bytes:
        """The ids of a word of small Latin letters, by the library's model at once."""
        return array(self.code, [t.id for t in self.model.tokenize(own if own.isascii() else own.translate(self.letters))]).tobytes()

    def mark(self, run: str) -> bytes:
        """The ids of a run of marks, which no letter beside it changes."""
        if run not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[run] = self.by_library(run)
        return self.marks[run]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encoded(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self.size:
                self.turn()
            self[chunk] = ids
        return ids

    def raw(self, text: str | None) -> bytes:
        """The ids of a whole text, without special tokens added, as ``width`` has them; of null: none."""
        self.used = time.monotonic()
        if not text:
            return b""
        if self.ranked is None or not self.plain:
            return b"".join(map(self.__getitem__, self.split(text)))
        if _LATIN(text):
            return self.by_rank(text)
        parts = groupby(self.split(text), lambda chunk: _LATIN(chunk) is not None)
        return b"".join(self.by_rank("".join(run)) if latin else b"".join(map(self.__getitem__, run)) for latin, run in parts)

    def by_rank(self, text: str) -> bytes:
        return array(self.code, self.ranked(text)).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """The same as an array."""
        return np.frombuffer(self.raw(text), dtype=self.width)


def rank_coder(tokenizer, described: dict):
    """Texts of ``_LATIN`` to ids by merging the pair that spells the token of least id, or None where the library does otherwise.

    The library merges the pair that its list of merges names first. Both agree on every word if ids follow the list
    of merges and each token alone is one token to the library: a pair that spells a token without being its merge
    would leave that token, alone, as two. Strings that the library takes for special tokens hold a "<", and so are no Latin text.
    """
    model, splits = described["model"], described["pre_tokenizer"] or {}
    vocab, byte = model["vocab"], {c: b for b, c in byte_spelling().items()}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if (
        described["normalizer"] is not None
        or (splits.get("type"), splits.get("add_prefix_space"), splits.get("use_regex")) != ("ByteLevel", False, True)
        or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        or merged != list(range(len(vocab) - len(merged), len(vocab)))
        or any(c not in byte for t in vocab for c in t)
        or any("<" not in t["content"] for t in described["added_tokens"])
        or any([x.id for x in tokenizer.model.tokenize(t)] != [i] for t, i in vocab.items())
    ):
        return None
    from tiktoken import Encoding

    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    return Encoding("ranks", pat_str=_BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_spaced = re.compile(r"\s*\S+|\s+").findall
_unspaced = re.compile(r"[^ \t\n\r]+").findall


def chunks(path: str) -> Chunks:
    """This worker's cache for the vocabulary file at ``path``."""
    if path not in _chunkers:
        _chunkers[path] = Chunks(path)
    return _chunkers[path]
