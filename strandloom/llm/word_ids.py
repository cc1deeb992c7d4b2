"""Token ids of whole texts by way of their distinct words.

A byte-level BPE never merges across the boundaries of its pre-tokeniser, so a text's ids are
the ids of its words, one after another. Words are found with NumPy over the UTF-8 bytes of a
chunk of texts, the distinct ones are encoded once by the tokenizers library and remembered in a
bounded table, and the ids are gathered. Texts with characters outside ASCII and the Latin
letters up to U+024F, with control characters, or with the string of an added token go to the
library whole, so every result is the library's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Classes of bytes. Letters hold the lead and continuation bytes of U+00C0 to U+024F.
PUNCT, LETTER, DIGIT, SPACE, BREAK, ODD = range(6)
#: A space between two characters that are no white space; it belongs to the word after it.
LONE_SPACE = re.compile(r"\S(?= \S)")
#: Contractions of the pattern that byte-level BPE splits by (fixed values).
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")


def _classes() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[33:128] = PUNCT
    for first, last in (b"az", b"AZ"):
        kind[first : last + 1] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[32] = SPACE
    kind[[9, 10, 13]] = BREAK
    kind[0x80:0xC0] = LETTER
    kind[0xC3:0xCA] = LETTER
    return kind


KIND = _classes()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets from 0; nulls must have been filled."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(texts: pa.Array, limit: int = 2 << 20):
    """(first row, slice) of at most `limit` bytes each, a longer text alone."""
    ends = np.cumsum(np.diff(utf8(texts)[1])) if len(texts) else np.zeros(0, np.int64)
    row = 0
    while row < len(texts):
        base = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield row, texts.slice(row, stop - row)
        row = stop


def odd_texts(data: np.ndarray, at: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Which texts the word rule does not cover."""
    bad = KIND[data] == ODD
    if len(data) > 1:  # the multiplication and division signs among the Latin letters
        bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    total = np.concatenate(([0], np.cumsum(bad)))
    odd = total[at[1:]] > total[at[:-1]]
    raw = data.tobytes()
    for token in added:
        spot = raw.find(token)
        while spot >= 0:
            odd[np.searchsorted(at, spot, "right") - 1] = True
            spot = raw.find(token, spot + 1)
    return odd


def word_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets where words start, as ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` cuts them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = np.minimum(KIND[data], SPACE)  # one class for white space
    head = np.zeros(n, bool)
    head[at[:-1][np.diff(at) > 0]] = True
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~head[1:]) + 1
    start[after - 1] = True
    start[after[data[after - 1] == 32]] = False
    quote = np.flatnonzero((data == 39) & start)
    if len(quote):
        end = at[np.searchsorted(at, quote, "right")]
        peek = lambda k: np.where(quote + k < end, data[np.minimum(quote + k, n - 1)], 0)
        one, two = peek(1), peek(2)
        size = np.where(np.isin(one, list(SHORT)), 2, 0)
        for a, b in LONG:
            size = np.where((one == a) & (two == b), 3, size)
        quote, size, end = quote[size > 0], size[size > 0], end[size > 0]
        start[quote + 1] = False
        rest = (quote + size)[quote + size < end]
        start[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(start)


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Gather:
    """A table of what is known of distinct words: an array of ids for each.

    It is emptied before a chunk once it holds `limit` words or `limit_bytes` of them, so it holds no more
    than that and one chunk's words.
    """

    def __init__(self, encode_words, limit: int = 350_000, limit_bytes: int = 16 << 20):
        self.encode_words, self.limit, self.limit_bytes = encode_words, limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.first, self.used, self.bytes = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def add(self, words: list[bytes]) -> None:
        found = self.encode_words(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate([np.asarray(x, np.uint32) for x in found]) if len(found) < 64 else np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        base = len(self.slot)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while base + len(words) + 1 > len(self.first):
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[base + 1 : base + len(words) + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.bytes += sum(map(len, words))
        self.slot.update(zip(words, range(base, base + len(words)), strict=True))

    def look_up(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The slot of each word of a chunk."""
        if len(self.slot) > self.limit or self.bytes > self.limit_bytes:
            self.clear()
        ends = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if missing := [w for w in distinct if w not in self.slot]:
            self.add(missing)
        return np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]

    def ids(self, slots: np.ndarray) -> np.ndarray:
        sizes, begin = self.first[slots + 1] - self.first[slots], self.first[slots]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)]


class ByteBpe:
    """Ids and counts of whole texts as `Tokenizer.encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        before = spec.get("pre_tokenizer") or {}
        self.by_words = (
            spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and spec.get("normalizer") is None
        )
        self.cuttable = self.by_words and not any(re.search(rb"\s", t) for t in self.added)
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.words = Gather(self._encode_words)

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        split, letters, found = self.tokenizer.model.tokenize, self.letters, []
        for word in words:
            text = word.decode("latin-1")
            text = text.replace(" ", letters[32]) if word.isascii() and text.isprintable() else text.translate(letters)
            found.append([t.id for t in split(text)])
        return found

    def _whole(self, text: str) -> list[int]:
        """The ids of a text by the library, part by part: an Encoding holds far more than its ids."""
        found: list[int] = []
        for part in self._parts(text) if self.cuttable else [text]:
            found += self.tokenizer.encode(part, add_special_tokens=False).ids
        return found

    @staticmethod
    def _parts(text: str, size: int = 1 << 15) -> Iterator[str]:
        """Cuts before a single space between two characters that are no white space: a word always starts there."""
        begin = 0
        while begin < len(text):
            cut = LONE_SPACE.search(text, begin + size) if begin + size < len(text) else None
            end = cut.start() + 1 if cut else len(text)
            yield text[begin:end]
            begin = end

    def _words_of(self, texts: pa.Array):
        data, at = utf8(texts)
        odd = odd_texts(data, at, self.added) if self.by_words else np.ones(len(texts), bool)
        if odd.any():
            keep = np.repeat(~odd, np.diff(at))
            data, sizes = data[keep], np.where(odd, 0, np.diff(at))
            at = np.concatenate(([0], np.cumsum(sizes)))
        starts = word_starts(data, at)
        slots = self.words.look_up(data, starts) if len(starts) else np.zeros(0, np.int64)
        sizes = self.words.first[slots + 1] - self.words.first[slots]
        total = np.concatenate(([0], np.cumsum(sizes)))
        edge = np.searchsorted(starts, at)
        return odd, slots, total[edge[1:]] - total[edge[:-1]]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """texts: strings without nulls."""
        out = np.zeros(len(texts), np.int64)
        for row, part in chunks(texts):
            odd, _, n = self._words_of(part)
            for i in np.flatnonzero(odd):
                n[i] = len(self._whole(part[int(i)].as_py()))
            out[row : row + len(part)] = n
        return out

    def encode(self, texts: pa.Array):
        """For each chunk of texts: (number of ids of each text, all their ids in order)."""
        for _, part in chunks(texts):
            odd, slots, n = self._words_of(part)
            ids = self.words.ids(slots)
            if odd.any():
                ends, pieces = np.cumsum(n), []
                for i in range(len(part)):
                    pieces.append(np.asarray(self._whole(part[i].as_py()), np.uint32) if odd[i] else ids[ends[i] - n[i] : ends[i]])
                n, ids = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.concatenate(pieces)
            yield n, ids


_KNOWN: dict[int, ByteBpe] = {}


def byte_bpe(definition: str) -> ByteBpe:
    """One encoder for each tokenizer and Python worker; its table of words lasts over tasks."""
    key = hash(definition)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = ByteBpe(definition)
    return _KNOWN[key]
