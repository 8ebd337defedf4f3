"""Sets of word shingles as sorted arrays of 64-bit hashes.

Words are maximal runs of characters other than ASCII white space, with A-Z
lowered. All words of a chunk of texts are hashed at once: a prefix sum of byte
values times powers of an odd constant gives each word's polynomial hash, which
is then mixed. A text of one to four words has its whole sequence as its only
shingle; a text without words has none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (64-bit splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
with np.errstate(over="ignore"):
    _VALUE = _mix((_FOLD.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    _ODD = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    if count > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
    return out


SLICE = 1 << 18  # bytes that are hashed at a time


def _word_end(text: bytes, high: int) -> int:
    """The first white space at or after ``high``, or the end."""
    found = _GAP.search(text, high)
    return found.start() if found else len(text)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct values of all parts, which are let go of."""
    found = np.concatenate(parts)
    parts.clear()
    found.sort()
    keep = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    return found if keep.all() else found[keep]


class Hasher:
    """Shingle sets of many texts, hashed in slices of about ``SLICE`` bytes."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, SLICE + 1), _powers(_INVERSE, SLICE + 1)

    def _words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word."""
        size = len(raw)
        up, down = self.up, self.down
        if len(up) < size + 1:  # a single word is longer than a slice
            up, down = _powers(_BASE, size + 1), _powers(_INVERSE, size + 1)
        space = _SPACE[raw]
        before = np.concatenate([[True], space[:-1]])
        after = np.concatenate([space[1:], [True]]) if size else space
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        with np.errstate(over="ignore"):
            summed = np.zeros(size + 1, np.uint64)
            np.cumsum(_VALUE[raw] * up[:size], out=summed[1:])
            return _mix((summed[ends] - summed[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts

    @staticmethod
    def _rolled(word: np.ndarray) -> np.ndarray:
        windows = max(0, len(word) - WORDS + 1)
        rolled = np.zeros(windows, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WORDS):
                rolled += word[k:k + windows] * _ODD[k]
            return _mix(rolled)

    def _long(self, text: bytes) -> np.ndarray:
        """The set of a text of many slices; a slice takes over the last four words of the one before."""
        carried, held, low, total = np.zeros(0, np.uint64), [], 0, 0
        while low < len(text):
            high = _word_end(text, min(len(text), low + SLICE))
            word = np.concatenate([carried, self._words(np.frombuffer(text, np.uint8, high - low, low))[0]])
            total += len(word) - len(carried)
            held.append(np.unique(self._rolled(word)))
            carried, low = word[1 - WORDS:], high
            if len(held) > 1 and sum(map(len, held[1:])) > max(len(held[0]), SLICE):
                held = [_merged(held)]
        if total < WORDS:
            return self._short(carried[:total])
        return _merged(held)

    @staticmethod
    def _short(word: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            whole = (word * _ODD[:len(word)]).sum(dtype=np.uint64) + np.uint64(len(word))
            return _mix(np.array([whole], np.uint64))

    def _group(self, encoded: list[bytes]) -> list[np.ndarray]:
        word, starts = self._words(np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8))
        edge = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(e) + 1 for e in encoded]))])
        rolled = self._rolled(word)
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= WORDS:
                found = np.sort(rolled[a:b - WORDS + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                out.append(found[keep])
            else:
                out.append(self._short(word[a:b]))
        return out

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for text in texts:
            encoded = (text or "").encode("utf-8", "surrogatepass")
            if group and size + len(encoded) + 1 > SLICE:
                out += self._group(group)
                group, size = [], 0
            if len(encoded) >= SLICE:
                out.append(self._long(encoded))
            else:
                group.append(encoded)
                size += len(encoded) + 1
        return out + self._group(group) if group else out


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit id of a set, as a signed long."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
