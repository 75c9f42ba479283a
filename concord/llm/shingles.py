"""Word shingles of whole texts and their MinHash signatures, as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
#: Entries of the word memo of a task, after which it starts anew.
MEMO = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


def shingle_sets(texts: list[bytes], memo: WordHashes) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of every text.

    A-Z are lower-cased; words are runs of bytes other than space and \\x09-\\x0D. A text with one to four words has
    their whole sequence as its only shingle, a text without words has none.
    """
    sets = []
    for text in texts:
        if len(memo) > MEMO:
            memo.clear()
        words = text.lower().split()
        if not words:
            sets.append(np.empty(0, np.uint64))
            continue
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = len(words) - WORDS + 1
        if n < 1:
            short = xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(words))
            sets.append(np.array([short], np.uint64))
            continue
        total = hashes[:n] * _SPREAD[0]
        for i in range(1, WORDS):
            total = mixed(total) + hashes[i : i + n] * _SPREAD[i]
        sets.append(np.unique(mixed(total)))
    return sets


def coordinates(size: int, seed: int = 20240501) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of `size` hash functions."""
    random = np.random.Generator(np.random.PCG64(seed))
    factors = random.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, random.integers(0, 2**63, size, dtype=np.uint64)


def signatures(sets: list[np.ndarray], functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Upper 32 bits of the least hash per function; one row per non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.empty((0, len(functions[0])), np.uint32)
    values = np.concatenate(full)
    starts = np.cumsum([0] + [len(s) for s in full[:-1]])
    out = np.empty((len(full), len(functions[0])), np.uint32)
    for i, (factor, offset) in enumerate(zip(*functions)):
        out[:, i] = np.minimum.reduceat(values * factor + offset, starts) >> np.uint64(32)
    return out
