"""Words of texts as hashes, a batch at a time: the ground of the operators on word windows and shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from scorewright.llm.common import claim, utf8

#: Bytes of a word are digits, letters and all bytes of characters beyond ASCII; A-Z become a-z, others part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | str | None) -> list[bytes]:
    """The words of a text: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` once A-Z are in lower case."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_FOLD).split()


#: Bytes that the remembered words of a worker take at most, and those of an entry besides the word's own.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 160


class _Hashes(dict):
    def __init__(self):
        super().__init__()
        self.room = CACHE_BYTES

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if (cost := len(word) + ENTRY_BYTES) <= self.room:
            self.room -= cost
            self[word] = out
        return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hashes of all words of a string column, and the len+1 offsets of its rows."""
    data, offsets = utf8(texts)
    folded = data.tobytes().translate(_FOLD)
    of, counts, parts = claim("words").setdefault("hashes", _Hashes()).__getitem__, np.zeros(len(offsets), np.int64), []
    for k in range(len(offsets) - 1):
        found = folded[offsets[k] : offsets[k + 1]].split()
        counts[k + 1] = len(found)
        parts.append(np.fromiter(map(of, found), np.uint64, len(found)))
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.cumsum(counts)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on; the last k-1 positions are left out."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mixed(out)


def batches_of(column: pa.Array, most: int = 2_000_000):
    """(start, stop) of runs of rows with about so many bytes of text, so that work arrays stay small."""
    _, offsets = utf8(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop
        start = stop
