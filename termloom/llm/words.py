"""Words, shingles and their hashes of whole Arrow batches of texts, as numpy arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Words longer than this are hashed with BLAKE2 instead of eight bytes at a time.
LONG_WORD = 256

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: _KEEP[n] keeps the lowest n bytes of a little-endian word of eight.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Odd factors that tell the places of a shingle apart.
_PLACE = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each text begins (one offset more than texts).

    A null text is an empty one.
    """
    filled = pc.fill_null(texts, "") if texts.null_count else texts
    filled = filled.cast(pa.large_string())
    _, offsets, data = filled.buffers()
    if len(filled) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    places = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts (first, past the last, bytes, offsets) of about ``limit`` bytes each, whole texts only."""
    data, offsets = utf8(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    # what earlier batches took goes back to the machine, which other workers share
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (one entry more)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z in lower case."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=low, strides=(1,))
    sizes = ends - starts
    out = mix(sizes.astype(_U) * _PLACE[0])
    out = mix(out ^ (eights[starts] & _KEEP[np.minimum(sizes, 8)]))
    rest = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    done = 8
    while len(rest):
        left = np.minimum(sizes[rest] - done, 8)
        out[rest] = mix(out[rest] ^ (eights[starts[rest] + done] & _KEEP[left]))
        done += 8
        rest = rest[sizes[rest] > done]
    for i in np.flatnonzero(sizes > LONG_WORD):
        digest = hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the first word of each text (one entry more)."""
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), first


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` words in a row; empty when there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.full(n, _U(width))
    for j in range(width):
        total += words[j : j + n] * _PLACE[j + 1]
    return mix(total)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Shingle hashes of one text: a text with fewer words is one shingle, one without words has none."""
    return window_hashes(words, min(width, len(words))) if len(words) else np.zeros(0, _U)
