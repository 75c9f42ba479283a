"""Byte-level BPE by the ranks of a public vocabulary: a perfect hash for whole pre-tokens, merges of many short ones at once, a
heap for the rest."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark.sql import DataFrame

from concord.llm import mph
from concord.llm.common import frugal, slices

#: Pre-tokens that a worker remembers, after which it keeps those of the texts at hand.
MEMO = 400_000
#: Bytes up to which pre-tokens are merged many at once, by classes of length, and so many of a class.
LENGTHS = (8, 16, 32)
AT_ONCE = 1 << 14
#: Text bytes that are encoded at once.
SLICE = 4 << 20
#: Rank of a pair that is no token.
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (`base64 rank` per line), by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class ByteBpe:
    """Encoder and decoder. Goes to the tasks by broadcast: its size is that of the vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens, self.pattern = tokens, pattern
        keys = [xxhash.xxh3_64_intdigest(t) for t in tokens]
        self.hash = mph.build(np.array(keys, np.uint64))
        self.at = [0] * len(tokens)
        for rank, key in enumerate(keys):
            self.at[self.hash.slot(key)] = rank
        # every pair of tokens that is a token: a perfect hash to the pair and its rank
        ranks = {token: rank for rank, token in enumerate(tokens)}
        halves = ((ranks.get(t[:i]), ranks.get(t[i:]), rank) for rank, t in enumerate(tokens) for i in range(1, len(t)))
        pairs = np.array([h for h in halves if h[0] is not None and h[1] is not None], np.int64).reshape(-1, 3)
        keys = (pairs[:, 0] << 32 | pairs[:, 1]).astype(np.uint64)
        self.pair_hash = mph.build(keys)
        slots = self.pair_hash.slots(keys)
        self.pairs, self.pair_ranks = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int32)
        self.pairs[slots], self.pair_ranks[slots] = keys, pairs[:, 2]
        self._start()

    def _start(self) -> None:
        self.ranks = {token: rank for rank, token in enumerate(self.tokens)}
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.find = regex.compile(self.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}  # ids of pre-tokens

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "bytes", "find", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def whole(self, piece: bytes) -> int | None:
        """Rank of a pre-token that is a token itself: one probe and one comparison."""
        rank = self.at[self.hash.slot(xxhash.xxh3_64_intdigest(piece))] if self.at else None
        return rank if rank is not None and self.tokens[rank] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Ranks of a pre-token after merging, always the pair of least rank and among equals the leftmost.

        Parts are linked both ways by their first byte; the heap holds pairs, and a pair whose parts have changed since
        is passed over. O(n log n) in the bytes.
        """
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 when it was merged into the part before
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (rank, left, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of tokens, `NONE` if it is no token."""
        if not len(self.pairs):
            return np.full(left.shape, NONE)
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self.pair_hash.slots(keys)
        return np.where(self.pairs[slots] == keys, self.pair_ranks[slots], NONE)

    def merged_together(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """`merged` of pre-tokens of up to `LENGTHS[-1]` bytes, a merge of each at a time. A row holds the parts of a pre-token
        and, beside them, the ranks of the pairs that they begin."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(size.max()) + 1
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        column = np.arange(width)
        part = self.bytes[text]
        if (part[column < size[:, None]] < 0).any():
            return [tuple(self.merged(p)) for p in pieces]  # the vocabulary lacks a byte
        pair = np.full(part.shape, NONE)
        there = column < size[:, None] - 1
        row, at = np.nonzero(there)
        pair[there] = self._rank(part[row, at], part[row, at + 1])
        done: list[tuple[int, ...]] = [()] * len(pieces)
        number = np.arange(len(pieces))  # of the rows that are left
        while len(number):
            at = pair.argmin(1)  # the first of the least
            row = np.arange(len(number))
            rank = pair[row, at]
            ended = rank == NONE
            if ended.any():
                for n, parts, k in zip(number[ended].tolist(), part[ended].tolist(), size[ended].tolist()):
                    done[n] = tuple(parts[:k])
                left = ~ended
                number, part, pair, size, at, rank = (x[left] for x in (number, part, pair, size, at, rank))
                row = np.arange(len(number))
            after = np.minimum(column + (column > at[:, None]), width - 1)
            part, pair = np.take_along_axis(part, after, 1), np.take_along_axis(pair, after, 1)
            part[row, at] = rank
            size = size - 1
            for first, has in ((at - 1, at > 0), (at, at < size - 1)):
                row, first = np.flatnonzero(has), first[has]
                pair[row, first] = self._rank(part[row, first], part[row, first + 1])
            row = np.flatnonzero(at == size - 1)
            pair[row, at[row]] = NONE
        return done

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pre-tokens."""
        data = [p.encode() for p in pieces]
        slots = self.hash.slots(np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data))).tolist()
        ranks = [self.at[s] for s in slots] if self.at else [0] * len(data)
        whole = [bool(self.at) and self.tokens[r] == d for r, d in zip(ranks, data)]
        self.memo.update((p, (r,)) for p, r, w in zip(pieces, ranks, whole) if w)
        rest = [(p, d) for p, d, w in zip(pieces, data, whole) if not w]
        shortest = 0
        for longest in LENGTHS:
            some = [x for x in rest if shortest < len(x[1]) <= longest]
            for at in range(0, len(some), AT_ONCE):
                few = some[at : at + AT_ONCE]
                self.memo.update(zip([p for p, _ in few], self.merged_together([d for _, d in few])))
            shortest = longest
        self.memo.update((p, tuple(self.merged(d))) for p, d in rest if len(d) > shortest)

    def encode_all(self, texts: list[str]) -> pa.Array:
        """Ids of every text (lists of int32); its different pre-tokens are looked up once, new ones are learned together."""
        found = [self.find(t) for t in texts]
        matches = np.cumsum([0, *map(len, found)])
        column = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        used, number = column.dictionary.to_numpy(zero_copy_only=False).tolist(), column.indices.to_numpy()
        if len(self.memo) > MEMO:
            self.memo = {p: self.memo[p] for p in used if p in self.memo}
        self._learn([p for p in used if p not in self.memo])
        known = list(map(self.memo.__getitem__, used))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        ids = np.fromiter(chain.from_iterable(known), np.int32, int(sizes.sum()))
        stops = np.append(0, np.cumsum(sizes[number]))  # of the pre-tokens' ids in the texts
        shift = (np.cumsum(sizes) - sizes)[number] - stops[:-1]
        every = ids[np.repeat(shift, sizes[number]) + np.arange(stops[-1])]
        return pa.ListArray.from_arrays(pa.array(stops[matches], pa.int32()), pa.array(every, pa.int32()))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].as_py()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, bpe: ByteBpe, text: str = "text", to: str = "ids") -> DataFrame:
    """`docs` with column `text` replaced by the ids of the whole text in column `to` (array of int).

    Every match of the pattern is encoded by itself; special tokens are ordinary text. A null or empty text has no ids.
    Other columns and repeated rows stay as they are; a column that is called `to` already is replaced. An empty table
    gives an empty result.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, to)]
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for part in slices(batches, text, SLICE):
            texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            ids = bpe.encode_all(texts)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*names, to])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{to}` array<int>"])
    rows = docs.select(*[docs[n] for n in names], docs[text].cast("string").alias(text))
    return rows.mapInArrow(frugal(run), schema)


def decode(encoded: DataFrame, bpe: ByteBpe, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`encoded` with a column `to`: the bytes that its ids stand for; null and empty ids give no bytes."""
    kept = [f for f in encoded.schema.fields if f.name != to]
    shared = encoded.sparkSession.sparkContext.broadcast(bpe)
    names = [f.name for f in kept]
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                column = part.column(at)
                every = column.flatten().to_numpy().tolist()
                ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()).tolist()
                data = pa.array([bpe.decode(every[i:j]) for i, j in zip([0, *ends], ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], [*names, to])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{to}` binary"])
    return encoded.select(*names).mapInArrow(frugal(run), schema)
