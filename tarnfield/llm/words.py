"""Word and shingle hashes of many texts at once, in array operations over their bytes.

Words are the runs of anything but ASCII white space (space, tab to carriage return), as ``bytes.split()`` finds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BYTES_AT_ONCE = 1_000_000
_RANDOM = np.random.default_rng(20_240_601)
#: Words of more bytes are hashed one by one.
LONG_WORD = 4096
#: Odd multipliers for the places of a shingle; values of bytes; powers of an odd number for the places in a word.
PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
POWERS = np.cumprod(np.full(LONG_WORD, 0x9E3779B97F4A7C15 | 5, np.uint64))
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of several texts in one buffer."""

    buffer: bytes
    starts: np.ndarray  #: of each word in the buffer
    ends: np.ndarray
    hashes: np.ndarray  #: 64 bits of each word
    bounds: np.ndarray  #: text k has the words bounds[k] to bounds[k + 1]


def words_of(texts: list[bytes]) -> Words:
    buffer = b" ".join(texts) + b" "
    raw = np.frombuffer(buffer, np.uint8)
    word = IS_WORD[raw]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(buffer, starts, ends, np.zeros(0, np.uint64), bounds)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    np.minimum(place, LONG_WORD - 1, out=place)
    hashes = mix(np.add.reduceat(BYTE_VALUES[raw[word]] * POWERS[place], first) + lengths.astype(np.uint64))
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(buffer[starts[k] : ends[k]])
    return Words(buffer, starts, ends, hashes, bounds)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; of all words as one run if there are fewer; none for no words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = words[:n] * PLACES[0]
    for k in range(1, width):
        h = (h ^ (h >> np.uint64(31))) + words[k : k + n] * PLACES[k]
    return mix(h + np.uint64(width))


def portions(batch: pa.RecordBatch, text_at: int, most: int = BYTES_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``most`` bytes of text, one text at least, with their texts."""
    texts = batch.column(text_at).cast(pa.binary()).to_pylist()
    low = size = 0
    for k, t in enumerate(texts):
        if k > low and size + len(t) > most:
            yield batch.slice(low, k - low), texts[low:k]
            low, size = k, 0
        size += len(t)
    if texts:
        yield batch.slice(low), texts[low:]
