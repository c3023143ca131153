"""Hashes of all words of a batch of texts, with array operations only.

A word's hash is a polynomial over its bytes, each first replaced by a random 64-bit number, and
mixed; so is a run of words' hash over its words' hashes. Differences of prefix sums give both for
all words and for any runs at once. The numbers are fixed, so hashes agree between machines.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import xxhash

from tidewatch.llm.common import LOWER, SPACES, UPPER

ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
#: What separates words in the two kinds of texts that the contracts know: white space, or all
#: ASCII but letters and digits.
WHITE = SPACES.encode()
SIGNS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]).translate(None, UPPER.encode())
#: Bytes of text whose words are hashed at a time (a longer word goes whole): the numbers for each byte take 40 times as much.
BLOCK = 1 << 16
_RANDOM = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=11) for b in range(256)], np.uint64)
_RANDOM[list(UPPER.encode())] = _RANDOM[list(LOWER.encode())]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((ODD, INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class Sums:
    """Hashes of any ranges of an array of numbers."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Words:
    """The words of ``texts``: ``hashes``, and of text ``i`` those from ``first[i]`` to
    ``first[i + 1]``. A-Z count as a-z; a null text is empty. ``starts`` and ``ends`` are places
    in ``data``, in which the texts follow one another with a byte between."""

    def __init__(self, texts: list[bytes | None], cuts: bytes = WHITE) -> None:
        self.data = b"\n".join([t or b"" for t in texts]) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.ones(256, np.int8)
        inside[list(cuts)] = 0
        edge = np.diff(inside[raw], prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = np.empty(len(self.starts), np.uint64)
        blocks = np.searchsorted(self.starts, np.arange(0, len(raw) + BLOCK, BLOCK))
        for i, j in pairwise(blocks.tolist()):
            if i < j:  # a word's hash does not depend on where it is
                at, end = self.starts[i], self.ends[j - 1]
                self.hashes[i:j] = Sums(_RANDOM[raw[at:end]]).of(self.starts[i:j] - at, self.ends[i:j] - at)
        self.offsets = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, self.offsets)

    def runs(self, size: int) -> np.ndarray:
        """A hash for each run of ``size`` words, across texts; ``first`` says which are within."""
        n = max(0, len(self.hashes) - size + 1)
        out = np.zeros(n, np.uint64)
        up, _ = powers(size)
        for k in range(size):
            out += self.hashes[k : k + n] * up[k]
        return mix(out + np.uint64(size))

    def text_of(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].lower()
