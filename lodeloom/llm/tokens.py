"""Token ids of whole texts with a public vocabulary file.

The tokenizers library does all encoding. As a byte-level vocabulary splits a
text before a single space that has no white space on either side, the parts
between such spaces are encoded on their own, which gives the same ids as
encoding the whole text. Parts are found, hashed and looked up for a whole batch
at once; a worker remembers their ids under 64-bit hashes, in arrays of bounded
size.
"""

from __future__ import annotations

import os
import sys

import numpy as np
import pyarrow as pa

from . import words as w

U64 = np.uint64
#: Slots of the table of remembered parts (a power of two), and the share of them that is used before all is forgotten.
SLOTS, FULL = 1 << 21, 0.55
#: Ids of remembered parts; with the table a worker needs 24 MB of slots, 8 of places and 40 of ids at most.
POOL = 10_000_000
#: Bytes of the longest part that is remembered.
LONGEST = 128
assert sys.byteorder == "little"  # ids are written as they lie in memory


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks that form a token run of their own after a word (an apostrophe may not: it can begin a suffix).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: How the vocabulary writes a space.
SPACE = chr(256 + 32)

#: Bytes that may be white space to Python or to the vocabulary.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: White space beyond ASCII, in UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _byte_letters() -> dict[int, str]:
    """What a byte-level vocabulary writes for each byte: itself if printable, else the next letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of single spaces with no white space on either side, within one text."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~_BLANK[data[at - 1]] & ~_BLANK[data[at + 1]]]
    row = np.searchsorted(offsets, at, side="right") - 1
    at = at[(at > offsets[row]) & (at + 1 < offsets[row + 1])]
    wide = (data[at - 1] >= 0x80) | (data[at + 1] >= 0x80)
    if wide.any():
        padded = np.concatenate((np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)))
        some = np.flatnonzero(wide)
        p, blank = at[some] + 3, np.zeros(len(some), dtype=bool)
        for white in _WIDE:
            before, after = np.ones(len(p), dtype=bool), np.ones(len(p), dtype=bool)
            for k, b in enumerate(white):
                before &= padded[p - len(white) + k] == b
                after &= padded[p + 1 + k] == b
            blank |= before | after
        at = np.delete(at, some[blank])
    return at


class Encoder:
    """``encode_rows``: the ids of a column of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.line_end = self._ids("\n")
        #: Ids of runs of marks.
        self.marks: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(SLOTS, dtype=U64)
        self.place = np.zeros(SLOTS, dtype=np.int32)
        self.first = np.zeros(int(SLOTS * FULL) + 1, dtype=np.int32)
        self.pool = np.zeros(POOL, dtype=np.uint32)
        self.known, self.used = 0, 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _one_word(self, word: str, before: str = SPACE) -> list[int]:
        """Letters, after a space or not, are one word to the vocabulary: straight to its merges."""
        shown = before + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return [t.id for t in self.word(shown)]

    def _marks(self, text: str) -> list[int]:
        if not text:
            return []
        if text not in self.marks:
            if len(self.marks) >= 10_000 or len(text) > LONGEST:
                self.marks.clear()
            self.marks[text] = self._ids(text)
        return self.marks[text]

    def _part(self, text: str, before: str) -> list[int]:
        """Ids of a part; ``before``: the space before it or nothing."""
        lead = SPACE if before else ""
        if text.isalpha():
            return self._one_word(text, lead)
        core = text.rstrip(MARKS)
        if core.isalpha():
            return self._one_word(core, lead) + self._marks(text[len(core) :])
        left, line, right = text.partition("\n")
        one, two = left.rstrip(MARKS), right.rstrip(MARKS)
        if line and one.isalpha() and two.isalpha():  # the vocabulary cuts off each: word, marks, line end, word, marks
            return self._one_word(one, lead) + self._marks(left[len(one) :]) + self.line_end + self._one_word(two, "") + self._marks(right[len(two) :])
        return self._ids(before + text)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each remembered part, or -1: linear probing for all at once."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        todo = np.arange(len(hashes))
        slot = (hashes >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        while len(todo):
            held = self.slots[slot]
            same = held == hashes[todo]
            out[todo[same]] = self.place[slot[same]]
            on = ~same & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Put different new hashes into free slots."""
        slot = (hashes >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.slots[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.slots[slot[put]], self.place[slot[put]] = hashes[put], numbers[put]
            left = np.ones(len(hashes), dtype=bool)
            left[put] = False
            hashes, numbers, slot = hashes[left], numbers[left], (slot[left] + 1) & (SLOTS - 1)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after the other, and how many each has."""
        cuts = _cuts(data, offsets)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        start = np.concatenate((offsets[filled], cuts + 1))
        alone = np.concatenate((np.ones(len(filled), dtype=bool), np.zeros(len(cuts), dtype=bool)))
        order = np.argsort(start, kind="stable")
        start, alone = start[order], alone[order]
        end = np.append(start[1:], offsets[-1])
        end[:-1] -= ~alone[1:]  # the space before a part is in no other
        n = len(data)
        up, down = w._powers(1 << max(20, int(n).bit_length()))
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(w.byte_codes(False, False)[data] * up[:n], out=sums[1:])
        hashes = w.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64)) ^ np.where(alone, U64(0x5851F42D4C957F2D), U64(0))
        hashes |= U64(1)  # 0 is a free slot
        long = end - start > LONGEST
        number = self._find(hashes)
        new = np.flatnonzero((number < 0) & ~long)
        fresh, at = np.unique(hashes[new], return_index=True)
        if self.known + len(fresh) >= len(self.first) or self.used + len(fresh) * LONGEST > POOL:
            self._forget()
            number[:] = -1
            new = np.flatnonzero(~long)
            fresh, at = np.unique(hashes[new], return_index=True)
            if len(fresh) >= len(self.first) or len(fresh) * LONGEST > POOL:  # too many for the table at once
                return self._apart(data, offsets, filled, start, end, alone)
        raw = data.tobytes()
        ids, sizes = self._learn(raw, *(x[new[at]].tolist() for x in (start, end, alone)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[self.known + 1 : self.known + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self._insert(fresh, np.arange(self.known, self.known + len(fresh)))
        self.known += len(fresh)
        self.used += len(ids)
        number[new] = self._find(hashes[new])
        first = self.first[number].astype(np.int64)
        size = self.first[number + 1] - first
        pool = self.pool
        if long.any():
            ids, size[long] = self._learn(raw, *(x[long].tolist() for x in (start, end, alone)))
            first[long] = self.used + np.cumsum(size[long]) - size[long]
            pool = np.concatenate([pool[: self.used], ids])
        row = np.searchsorted(offsets[filled], start, side="right") - 1
        counts = np.zeros(len(offsets) - 1, dtype=np.int64)
        counts[filled] = np.bincount(row, weights=size, minlength=len(filled)).astype(np.int64)
        return pool[w._positions(first, size)], counts

    def _learn(self, raw: bytes, start: list[int], end: list[int], alone: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after the other, and how many each has."""
        ids, sizes, word = [], [], self.word
        for a, b, head in zip(start, end, alone, strict=True):
            part = raw[a:b]
            if not head and part.isalpha():  # bytes: ASCII letters
                own = [t.id for t in word(SPACE + part.decode("ascii"))]
            else:
                own = self._part(part.decode(), "" if head else " ")
            ids += own
            sizes.append(len(own))
        return np.array(ids, dtype=np.uint32), np.array(sizes, dtype=np.int64)

    def _apart(self, data: np.ndarray, offsets: np.ndarray, filled: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_slice`` of a text with more different parts than are remembered."""
        ids, sizes = self._learn(data.tobytes(), start.tolist(), end.tolist(), alone.tolist())
        row = filled[np.searchsorted(offsets[filled], start, side="right") - 1]
        return ids, np.bincount(row, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)

    def encode_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one after the other (unsigned 32 bits), and how many each has; a null has none."""
        data, offsets = w.raw(texts, release=False)
        parts = [self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in w.slices(offsets)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def encode(self, text: str | None) -> bytes:
        """One text's ids as little-endian bytes."""
        return self.encode_rows(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, until the worker turns to an operator on words."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
        w.RELEASE.append(_ENCODERS.clear)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids and an end id 0, and where each text ends."""
    ends = np.cumsum(counts + 1)
    out = np.zeros(len(ids) + len(counts), dtype="<u4")
    own = np.ones(len(out), dtype=bool)
    own[ends - 1] = False
    out[own] = ids
    return out, ends
