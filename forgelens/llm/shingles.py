"""Hashed word shingles of texts, for Arrow functions on executors."""

import numpy as np
import xxhash

WORDS = 5
LONGEST = 255  # bytes of a word that is hashed along with all others
BATCH_BYTES = 1 << 20
_ODD = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
)]


def _byte_tables():
    """White space, a random number per byte (A-Z as a-z), a multiplier per place."""
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    random = np.random.default_rng(20240602)
    values = random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values ^= np.arange(256, dtype=np.uint64) << np.uint64(1)
    values[65:91] = values[97:123]
    values[space] = 0
    places = random.integers(1, 1 << 63, LONGEST + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    return space, values, places


_SPACE, _BYTES, _PLACES = _byte_tables()


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _word_hashes(data: bytes):
    """(first byte, hash) of every word."""
    d = np.frombuffer(data, np.uint8)
    space = _SPACE[d]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(d)) - np.repeat(
        np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(d)]]))
    )
    long = (place == LONGEST) & ~space
    np.minimum(place, LONGEST, out=place)
    hashes = mixed(np.add.reduceat(_BYTES[d] * _PLACES[place], starts))
    if long.any():
        ends = np.append(starts[1:], len(d))
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(long), side="right") - 1).tolist():
            (word,) = data[starts[i] : ends[i]].split()
            hashes[i] = xxhash.xxh3_64_intdigest(word.lower())
    return starts, hashes


def _shingles(w: np.ndarray, size: int) -> np.ndarray:
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h += w[i : i + n] * _ODD[i]
        h ^= h >> np.uint64(29)
    return mixed(h)


def shingle_hashes(texts: list):
    """For each text the 64-bit hashes of its five-word shingles, in order, repeated ones too.

    A-Z count as lower case; words stand between spaces and control spaces.  With
    fewer than five words the whole sequence is one shingle; without words, or for a
    null text, none.
    """
    some, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        some.append(raw)
        size += len(raw)
        if size > BATCH_BYTES:
            yield from _together(some)
            some, size = [], 0
    yield from _together(some)


def _together(raw: list[bytes]):
    starts, w = _word_hashes(b" ".join(raw))
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    upto = np.searchsorted(starts, ends).tolist()
    h = _shingles(w, WORDS) if len(w) >= WORDS else w[:0]
    begin = 0
    for end in upto:
        n = end - begin
        yield h[begin : end - WORDS + 1] if n >= WORDS else _shingles(w[begin:end], n) if n else w[:0]
        begin = end


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct hashes, ascending."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingle_sets(texts: list):
    return map(distinct, shingle_hashes(texts))
