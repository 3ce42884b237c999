"""Word shingles of whole texts as sets of 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Bytes of text that are split into words at a time; longer texts are cut between words.
BLOCK_BYTES = 1 << 18
# Shingles whose hashes a signature works on at a time.
BLOCK_SHINGLES = 1 << 13

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word: the runs of bytes other than white space, A-Z lower-cased."""
    c = np.frombuffer(data, dtype=np.uint8)
    c = np.where((c >= 65) & (c <= 90), c + 32, c).astype(np.uint8)
    inside = ~((c == 32) | ((c >= 9) & (c <= 13)))
    before = np.concatenate([[False], inside[:-1]]) if len(c) else inside
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    place = np.arange(len(c)) - starts[np.maximum(np.searchsorted(starts, np.arange(len(c)), side="right") - 1, 0)]
    powers = np.cumprod(np.full(int(place[inside].max()) + 1, STEP, dtype=np.uint64))
    values = np.where(inside, BYTE_CODES[c] * powers[np.clip(place, 0, len(powers) - 1)], np.uint64(0))
    return starts, mixed(np.add.reduceat(values, starts))


def cut(data: bytes) -> Iterator[bytes]:
    """A text in parts that end at white space, each of about a block."""
    start = 0
    while len(data) - start > BLOCK_BYTES:
        end = start + BLOCK_BYTES
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def words_of(texts: Sequence[str]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; many short texts are worked on together."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        starts, hashes = word_hashes(b"\n".join(held))
        ends = np.cumsum([len(t) + 1 for t in held])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if size + len(data) > BLOCK_BYTES and held:
            yield from flush()
            held, size = [], 0
        if len(data) > BLOCK_BYTES:
            yield np.concatenate([word_hashes(part)[1] for part in cut(data)])
        else:
            held.append(data)
            size += len(data)
    if held:
        yield from flush()


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; of fewer words, one of them all."""
    if not len(words):
        return words
    size = min(width, len(words))
    n = len(words) - size + 1
    h = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        h = mixed(h * STEP + words[k : k + n])
    return np.unique(h)


def multipliers(count: int) -> np.ndarray:
    random = np.random.Generator(np.random.PCG64(7))
    return random.integers(1, 2**63, size=count, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16 bits of the least shingle under each of the hash functions ``factors`` give."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), BLOCK_SHINGLES):
        h = factors[:, None] * shingles[None, at : at + BLOCK_SHINGLES]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, h.min(axis=1), out=least)
    return (least >> np.uint64(8)).astype(np.uint16)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    first = int(shingles.sum(dtype=np.uint64)) if len(shingles) else 0
    second = int(mixed(shingles * STEP).sum(dtype=np.uint64)) if len(shingles) else 0
    return first - (1 << 63), second - (1 << 63)
