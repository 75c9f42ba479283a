"""Minimal perfect hash of a set of 64-bit keys: every key gets its own slot 0..n-1, by hash and displace."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Keys per bucket on average.
LOAD = 3
#: Marks a bucket of one key, whose number is the slot itself.
DIRECT = np.uint32(1 << 31)

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_ALL = (1 << 64) - 1


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _A
    values = (values ^ (values >> np.uint64(27))) * _B
    return values ^ (values >> np.uint64(31))


class PerfectHash(NamedTuple):
    """`displace` holds a number per bucket; the slot of a key is its mix with the number of its bucket, modulo n. The
    number of a bucket of one key holds the slot itself."""

    n: int
    displace: np.ndarray  # uint32

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key. A key that isn't in the set gets some slot, too; compare a fingerprint."""
        keys = keys.astype(np.uint64, copy=False)
        if not self.n:
            return np.zeros(len(keys), np.int64)
        bucket = (_mix(keys) >> np.uint64(32)) % np.uint64(len(self.displace))
        return _slots(keys, self.displace[bucket.astype(np.int64)], self.n)

    def slot(self, key: int) -> int:
        """`slots` of one key."""
        number = int(self.displace[(_mix_one(key) >> 32) % len(self.displace)])
        if number & int(DIRECT):
            return number ^ int(DIRECT)
        return _mix_one((key + (number + 1) * int(_B)) & _ALL) % self.n


def _mix_one(value: int) -> int:
    value = ((value ^ (value >> 30)) * int(_A)) & _ALL
    value = ((value ^ (value >> 27)) * int(_B)) & _ALL
    return value ^ (value >> 31)


def _slots(keys: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    hashed = (_mix(keys + (displace.astype(np.uint64) + np.uint64(1)) * _B) % np.uint64(n)).astype(np.int64)
    return np.where(displace >= DIRECT, (displace & ~DIRECT).astype(np.int64), hashed)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key that its slot doesn't use."""
    return (_mix(keys.astype(np.uint64, copy=False) ^ _A) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> PerfectHash:
    """The perfect hash of different keys.

    Buckets are placed in order of falling size. For a bucket, the first displacement is taken that puts all its keys on
    free slots; buckets of one size try their displacements at the same time, and where two want the same slot the first
    of them gets it. Buckets of one key share out the slots that are left.
    """
    keys = np.asarray(keys).astype(np.uint64, copy=False)
    n = len(keys)
    if len(np.unique(keys)) != n:
        raise ValueError("keys of a perfect hash must differ")
    buckets = max(1, -(-n // LOAD))
    displace = np.zeros(buckets, np.uint32)
    if not n:
        return PerfectHash(0, displace)
    bucket = ((_mix(keys) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, bucket = keys[order], bucket[order]
    starts = np.searchsorted(bucket, np.arange(buckets))
    sizes = np.diff(np.append(starts, n))
    taken = np.zeros(n, bool)
    for size in sorted(set(sizes.tolist()) - {0, 1}, reverse=True):
        waiting = np.flatnonzero(sizes == size)
        while len(waiting):
            members = keys[starts[waiting][:, None] + np.arange(size)]
            slots = _slots(members.ravel(), np.repeat(displace[waiting], size), n).reshape(-1, size)
            ordered = np.sort(slots, axis=1)
            fit = np.flatnonzero(~taken[slots].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1))
            # of buckets that want the same slot the first gets it
            _, at = np.unique(slots[fit].ravel(), return_index=True)
            first = np.zeros(len(fit) * size, bool)
            first[at] = True
            won = fit[first.reshape(-1, size).all(1)]
            taken[slots[won].ravel()] = True
            left = np.ones(len(waiting), bool)
            left[won] = False
            waiting = waiting[left]
            displace[waiting] += np.uint32(1)
    single = np.flatnonzero(sizes == 1)
    displace[single] = np.flatnonzero(~taken).astype(np.uint32) | DIRECT
    return PerfectHash(n, displace)
