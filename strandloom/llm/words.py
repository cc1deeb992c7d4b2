"""Words of many texts at once, with NumPy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from strandloom.llm.word_ids import utf8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: All that is neither an ASCII letter or digit nor part of a longer character.
NOT_LETTER = np.ones(256, bool)
for _first, _last in (b"az", b"AZ", b"09", (0x80, 0xFF)):
    NOT_LETTER[_first : _last + 1] = False


class Words:
    """The words of a string array, A-Z lower-cased: `code` of each in order, `edge` of each text in them, `distinct` words as bytes."""

    def __init__(self, texts: pa.Array, separator: np.ndarray):
        data, at = utf8(texts)
        data = LOWER[data]
        inside = ~separator[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        heads = at[:-1][np.diff(at) > 0]
        start[heads] = inside[heads]
        spot = np.flatnonzero(start)
        kept = np.ascontiguousarray(data[inside])
        offsets = np.append(np.cumsum(inside)[spot] - 1, len(kept)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(spot), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        self.distinct = found.dictionary.to_pylist()
        self.code = found.indices.to_numpy() if len(found) else np.zeros(0, np.int32)
        self.edge = np.searchsorted(spot, at)

    def hashes(self, cut: int | None = None) -> np.ndarray:
        """A 64-bit hash of each distinct word, or of its first `cut` bytes."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w[:cut], 1) if cut else digest(w) for w in self.distinct), np.uint64, len(self.distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
