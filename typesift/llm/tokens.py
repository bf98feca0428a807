"""Token ids of whole texts by a public tokenizer, at array speed.

Both vocabularies split a text before merging, and never across the places
where these functions cut it, so the library encodes each distinct piece once
per process and a text's ids are the ids of its pieces in order.  A piece that
is one plain word goes to the library's merge model directly; every other one
through its whole chain.  ``tests/llm`` compares with encoding whole texts.

Strings of special tokens are ordinary text, as the vocabularies' README
advises.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from typesift.llm import textbatch as tb

#: Pieces remembered per process (about 50 bytes each); beyond it the memory is emptied.
MAX_PIECES = 500_000

# Byte classes for cutting: space, other white space, ASCII letter, ASCII
# punctuation (not the apostrophe, which starts contractions), the rest.
SPACE, OTHER_SPACE, LETTER, MARK, REST = range(5)
_classes = np.full(256, REST, dtype=np.uint8)
_classes[0x20] = SPACE
_classes[0x09:0x0E] = OTHER_SPACE
_classes[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_classes[[b for b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = MARK

# First bytes of characters that are no white space in any alphabet.
_NO_SPACE_HEAD = np.ones(256, dtype=bool)
_NO_SPACE_HEAD[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = False

_WORD_CUT = np.zeros((5, 5), dtype=bool)
_WORD_CUT[LETTER, MARK] = _WORD_CUT[MARK, LETTER] = True


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_encoders: dict[tuple, PieceEncoder] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, keep_space: bool) -> PieceEncoder:
    """The process's encoder for a tokenizer file.

    keep_space: case and white space count, and a space belongs to the word
    after it (byte-level BPE); else case and white space are dropped (word BPE).
    """
    key = (path, keep_space)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, keep_space)
    return _encoders[key]


class _Table:
    """64-bit keys to numbers, open addressing in two arrays."""

    def __init__(self, size: int = 1 << 16):
        self.keys = np.zeros(size, dtype=np.uint64)  # 0: free
        self.values = np.zeros(size, dtype=np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is not there."""
        out, slot, left = np.full(len(keys), -1, dtype=np.int64), self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (there != 0)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are distinct and not there yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old, more = self.keys != 0, _Table(1 << (2 * (self.used + len(keys))).bit_length())
            more.add(self.keys[old], self.values[old])
            self.keys, self.values = more.keys, more.values
        self.used += len(keys)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot, one stays
            mine = free & (self.keys[at] == keys[left])
            self.values[at[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class PieceEncoder:
    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merger = Tokenizer(self.tokenizer.model)
        self.letters = _byte_letters()
        self.keep_space = keep_space
        self._clear()

    def _clear(self) -> None:
        self.index = _Table()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.offset = np.zeros(1 << 15, dtype=np.int64)
        self.length = np.zeros(1 << 15, dtype=np.int32)

    def _plain(self, s: str) -> bool:
        """One word of Latin letters, which neither vocabulary splits or normalises further than its case."""
        word = s[1:] if self.keep_space and s[0] == " " else s
        return word.isalpha() and (word.isascii() or max(word) <= "\u00ff")

    def _mapped(self, s: str) -> str:
        if not self.keep_space:
            s = s.lower()
        elif s[0] == " ":
            return self.letters[0x20] + self._mapped(s[1:])
        return s if s.isascii() else s.encode().decode("latin-1").translate(self.letters)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        words = [p.decode("utf-8", "replace") for p in pieces]
        plain = [self._plain(w) for w in words]
        simple = self.merger.encode_batch_fast([self._mapped(w) for w, p in zip(words, plain) if p])
        others = self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False)
        simple, others = iter(simple), iter(others)
        ids = [next(simple if p else others).ids for p in plain]
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total, at = int(n.sum()), self.index.used
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(keys) > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used:self.used + total] = np.fromiter((i for e in ids for i in e), dtype=np.uint32, count=total)
        self.length[at:at + len(keys)] = n
        self.offset[at:at + len(keys)] = self.used + np.cumsum(n) - n
        self.used += total
        self.index.add(keys, np.arange(at, at + len(keys)))

    def encode(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        starts, ends = self.pieces(block)
        first = block.first_of(starts)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(block.n, dtype=np.int64)
        values = tb.BYTE_VALUES if self.keep_space else tb.FOLDED_VALUES
        codes, keys = pd.factorize(np.maximum(block.hashes(starts, ends, values), np.uint64(1)))
        one = np.empty(len(keys), dtype=np.int64)
        one[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if self.index.used > MAX_PIECES:
            self._clear()
        found = self.index.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            raw, at, size = block.bytes, one[new], self.index.used
            self._learn(keys[new], [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            found[new] = np.arange(size, size + len(new))
        entry = found[codes]
        n = self.length[entry].astype(np.int64)
        shift = self.offset[entry] - (np.cumsum(n) - n)
        ids = self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))]
        return ids, tb.per_text(first, n)

    def pieces(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        data = block.data
        kind = _classes[data]
        cut = np.empty(len(data) + 1, dtype=bool)  # a piece may begin here
        cut[0] = cut[-1] = True
        cut[1:-1] = _WORD_CUT.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]
        blank = kind <= OTHER_SPACE
        if not self.keep_space:
            cut[1:-1] |= blank[:-1] != blank[1:]
            at = np.flatnonzero(cut)
            real = ~blank[at[:-1]]
            return at[:-1][real], at[1:][real]
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1  # of words
        # Not where the character before may be white space that is not ASCII.
        last, before, third = data[ends - 1], data[ends - 2], data[ends - 3]
        unsure = ((last >= 0x1C) & (last <= 0x1F)) | (last >= 0x80) & (
            ((before == 0xC2) & ((last == 0x85) | (last == 0xA0)))
            | ((third == 0xE2) & ((before == 0x80) | (before == 0x81)))
            | ((third == 0xE1) & (before == 0x9A))
            | ((third == 0xE3) & (before == 0x80)))
        cut[ends[~unsure]] = True
        # A single line break or tab is a piece of its own, if what follows is surely no white space.
        alone = np.flatnonzero((kind[1:-1] == OTHER_SPACE) & ~blank[:-2] & _NO_SPACE_HEAD[data[2:]]) + 1
        cut[alone[cut[alone]] + 1] = True
        between = block.bounds[1:] - 1
        cut[between] = cut[block.bounds] = True
        separator = np.zeros(len(data) + 1, dtype=bool)
        separator[between] = True
        at = np.flatnonzero(cut)
        real = ~separator[at[:-1]]
        return at[:-1][real], at[1:][real]
