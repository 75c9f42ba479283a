"""Token ids of whole texts in binary shards with a perfect hash index.

A shard holds documents in ascending order of their key. Its file, all numbers little-endian:

    8 bytes   magic CONCIDS1
    uint64    width of an id in bytes (2 or 4), documents, ids, buckets, keys
    uint32    per bucket: displacement of the perfect hash
    uint32    per slot: fingerprint of the key
    uint32    per slot: number of the document in the shard
    int64     per document: key
    uint8     per document: 1 if it has a key
    uint64    per document and one more: offset of its first id
    raw ids

A key is found by one probe of the hash, a comparison of the fingerprint and one read of the payload, at any shard size.
Files are written by the tasks into the shared folder under names that no other attempt uses; the manifest, a table that
Spark commits, lists those of the attempts that count. A task that is run again leaves an unlisted file and no harm.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from concord.llm import mph
from concord.llm.common import slices
from concord.session import scratch_path, stored

MAGIC = b"CONCIDS1"
#: Bytes of raw ids after which a task starts another shard. A longer document is a shard of its own.
SHARD = 32 << 20
#: Text bytes for one task of the writer.
TASK = 64 << 20
#: Words that a worker remembers, after which it keeps those of the texts at hand.
MEMO = 800_000
#: Signs that often end a word.
SIGNS = (",", ".")
#: Words that are encoded at once.
GROUP = 200
#: Text bytes and rows that are taken apart at once: the more, the fewer words are looked up twice.
SLICE = 8 << 20
ROWS = 4096
#: Line ends with more white space around them: a text that has any is taken apart at its spaces only.
BLANKS = ("\n\n", "\r\n", "\t\n", "\n\t")


class Coder:
    """Byte-level tokenizer of the `tokenizers` library with the ids of words remembered.

    The tokenizer merges inside matches of its pattern only and cuts a match by itself in the same way, so the ids of a
    text are those of its matches one after the other. Where a space or a line end stands between two characters that aren't
    white space, a match begins: such texts are taken apart there, which is cheaper, and others by the pattern. The string of
    a special token gets that token's id, as the library does unless it is told otherwise, and what is around it is encoded by
    itself.
    """

    def __init__(self, definition: str, pattern: str) -> None:
        self.definition, self.pattern = definition, pattern
        self._start()

    @classmethod
    def read(cls, path: str, pattern: str) -> Coder:
        with open(path, encoding="utf-8") as file:
            return cls(file.read(), pattern)

    def __getstate__(self) -> dict:
        return {"definition": self.definition, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        # Spark has the cores in use already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(self.definition)
        self.tokenizer.encode_special_tokens = True  # texts are cut at their strings before
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        if any(t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens that take in what is around them are not known here")
        longest = sorted(added, key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(map(regex.escape, longest))})") if added else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special_ids = {content: i.to_bytes(self.width, "little") for content, i in added.items()}
        self.find = regex.compile(self.pattern).findall
        self.words: dict[str, bytes] = {}  # raw ids of a space and this word, or of a line end and the word behind it
        self.other: dict[str, bytes] = {}  # raw ids of matches of the pattern
        # the byte-level alphabet writes a space as U+0120 and a line end as U+010A
        self.leading = {lead: self._led_by(sign) for lead, sign in ((" ", "\u0120"), ("\n", "\u010a"))}

    def _led_by(self, sign: str) -> np.ndarray:
        """Of every id whether its token begins with a sign."""
        led = np.zeros(self.tokenizer.get_vocab_size(), bool)
        led[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(sign)]] = True
        return led

    def _raw(self, texts: list[str]) -> list[bytes]:
        kind = {2: "H", 4: "I"}[self.width]
        raw = [array(kind, coded.ids) for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in raw:
                ids.byteswap()
        return [ids.tobytes() for ids in raw]

    def _matches(self, texts: list[str]) -> list[bytes]:
        """Raw ids of texts by the matches of the pattern."""
        matches = [self.find(t) for t in texts]
        new = list(set().union(*matches).difference(self.other))
        self.other.update(zip(new, self._raw(new)))
        return [b"".join(map(self.other.__getitem__, m)) for m in matches]

    def _learn(self, words: list[str], lead: str) -> None:
        """Raw ids of words after a space or a line end, many in one text: the first token of each starts with it, no other
        does. What is learned behind a line end has it before the word."""
        for at in range(0, len(words), GROUP):
            some = words[at : at + GROUP]
            raw = self._raw(["".join(some) if lead == "\n" else lead + lead.join(some)])[0]
            starts = np.flatnonzero(self.leading[lead][np.frombuffer(raw, f"<u{self.width}")]) * self.width
            if len(starts) != len(some):
                raise ValueError("the pattern of the tokenizer doesn't cut at spaces and line ends")
            ends = np.append(starts[1:], len(raw))
            self.words.update(zip(some, [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Raw ids of every text."""
        if not self.special or not any(map(self.special.search, texts)):
            return self._encode(texts)
        pieces = [self.special.split(t) for t in texts]  # every second piece is a special token
        plain = iter(self._encode([p for each in pieces for p in each[::2]]))
        return [b"".join(self.special_ids[p] if k % 2 else next(plain) for k, p in enumerate(each)) for each in pieces]

    def _encode(self, texts: list[str]) -> list[bytes]:
        # words of all texts in one column, its different words once
        split = pa.compute.split_pattern(pa.array(map(_cut, texts), pa.string()), " ")
        starts, ends = split.offsets[:-1].to_numpy(), split.offsets[1:].to_numpy()
        flat = split.flatten()
        heads = flat.take(pa.array(starts)).to_numpy(zero_copy_only=False).tolist()
        behind = np.ones(len(flat), bool)
        behind[starts] = False
        column = flat.filter(pa.array(behind)).dictionary_encode()
        used, number = column.dictionary.to_numpy(zero_copy_only=False).tolist(), column.indices.to_numpy()
        ends = ends - np.arange(1, len(texts) + 1)  # without the heads
        starts = np.append(0, ends[:-1])

        if len(self.words) + len(self.other) > MEMO:
            self.words = {w: self.words[w] for w in used if w in self.words}
            self.other.clear()
        new = set(used).difference(self.words)
        odd = {w for w in new if not _word(w[1:] if w[:1] == "\n" else w)}
        # a sign after a letter is a match of its own, so the word before it need not be learned twice
        signed = [w for w in new if w.endswith(SIGNS) and w[-2:-1].isalpha() and w not in odd]
        whole = (new - odd).difference(signed) | {w[:-1] for w in signed}.difference(self.words)
        lines = {w for w in whole if w[:1] == "\n"}
        self._learn(list(whole - lines), " ")
        self._learn(list(lines), "\n")
        sign = dict(zip(SIGNS, self._matches(list(SIGNS))))
        self.words.update([(w, self.words[w[:-1]] + sign[w[-1]]) for w in signed])

        strange = np.append(0, np.cumsum(np.array([w in odd for w in used], bool)[number])) if odd else np.zeros(len(number) + 1)
        simple = (starts == ends) | np.array([not h or _word(h) for h in heads], bool) & (strange[starts] == strange[ends])
        first = self._matches([h if plain else t for t, h, plain in zip(texts, heads, simple.tolist())])
        raw = list(map(self.words.get, used, repeat(b"")))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.width
        ids = np.frombuffer(b"".join(raw), f"<u{self.width}")
        stops = np.append(0, np.cumsum(sizes[number]))  # of the words' ids in the texts
        shift = (np.cumsum(sizes) - sizes)[number] - stops[:-1]
        every = ids[np.repeat(shift, sizes[number]) + np.arange(stops[-1])].tobytes()
        bounds = zip((stops[starts] * self.width).tolist(), (stops[ends] * self.width).tolist())
        return [f + every[i:j] if plain else f for f, (i, j), plain in zip(first, bounds, simple.tolist())]


def _cut(text: str) -> str:
    """`text` with a space before its line ends, to be taken apart at its spaces. What begins with a line end has no space before
    it: a text in which one follows a space has an empty word instead, so that it is taken apart by the pattern."""
    if " \n" in text:
        return " "
    return text if any(map(text.__contains__, BLANKS)) else text.replace("\n", " \n")


def _word(text: str) -> bool:
    return bool(text) and text.strip() == text


def _shard_file(keys: list[int | None], payloads: list[bytes], width: int) -> bytes:
    n = len(keys)
    has = np.array([k is not None for k in keys], np.uint8)
    key = np.array([0 if k is None else k for k in keys], np.int64)
    # the index leads to the first document of a key
    known, first = np.unique(key[has == 1], return_index=True)
    number = np.flatnonzero(has)[first]
    found = mph.build(known.view(np.uint64))
    slots = found.slots(known.view(np.uint64))
    prints, numbers = np.zeros(found.n, np.uint32), np.zeros(found.n, np.uint32)
    prints[slots], numbers[slots] = mph.fingerprints(known.view(np.uint64)), number
    offsets = np.concatenate([[0], np.cumsum([len(p) // width for p in payloads])]).astype(np.uint64)
    head = np.array([width, n, offsets[-1], len(found.displace), found.n], np.uint64)
    parts = [head, found.displace, prints, numbers, key, has, offsets]
    return MAGIC + b"".join(p.astype(p.dtype.newbyteorder("<")).tobytes() for p in parts) + b"".join(payloads)


class Shard:
    """Keyed access to a shard: the index is read once, ids by one read each."""

    def __init__(self, path: str) -> None:
        system, place = _place(path)
        self.file = system.open_input_file(place)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        head = np.frombuffer(self.file.read_at(40, 8), "<u8").astype(np.int64)
        self.width, self.n_docs, self.n_ids, buckets, n = head.tolist()
        sizes = [(buckets, "<u4"), (n, "<u4"), (n, "<u4"), (self.n_docs, "<i8"), (self.n_docs, "u1"), (self.n_docs + 1, "<u8")]
        at, parts = 48, []
        for count, kind in sizes:
            size = count * np.dtype(kind).itemsize
            parts.append(np.frombuffer(self.file.read_at(size, at), kind))
            at += size
        displace, self.prints, self.numbers, self.keys, self.has_key, offsets = parts
        self.hash, self.offsets, self.payload = mph.PerfectHash(n, displace), offsets.astype(np.int64), at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of every key, -1 for a key that isn't here."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        if not self.hash.n:
            return np.full(len(keys), -1)
        slots = self.hash.slots(keys)
        numbers = self.numbers[slots].astype(np.int64)
        right = (self.prints[slots] == mph.fingerprints(keys)) & (self.keys[numbers].view(np.uint64) == keys)
        return np.where(right, numbers, -1)

    def ids(self, number: int) -> np.ndarray:
        """Ids of a document by its number in the shard."""
        start, end = self.offsets[number], self.offsets[number + 1]
        raw = self.file.read_at(int(end - start) * self.width, self.payload + int(start) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the first document of a key."""
        number = int(self.find(np.array([key]))[0])
        return None if number < 0 else self.ids(number)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pyarrow.fs.LocalFileSystem(), path


def write(docs: DataFrame, coder: Coder, folder: str, end_id: int, shard: int = SHARD, task: int = TASK) -> DataFrame:
    """Encode every whole text of `docs` (`doc_id, text`), append `end_id`, and write shards in ascending order of doc_id.

    Returns the manifest `part, shard, path, n_docs, n_ids, start`, stored in the shared folder; `start` counts the ids of
    all shards before. Null and empty texts give the end id alone. Rows with one doc_id are ordered by a hash of their text, and
    the index leads to the first; rows without doc_id come first and are in no index. An empty table gives an empty
    manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ordered = rows.repartitionByRange(-(-size // task) or 1, "doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text"
    )
    shared = spark.sparkContext.broadcast(coder)
    name = f"{folder.rstrip('/')}/ids"
    if "://" not in name and not name.startswith("file:"):
        _place(name)[0].create_dir(name)
    else:
        system, place = _place(name)
        system.create_dir(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = shared.value, TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{coder.width}").tobytes()
        keys: list[int | None] = []
        payloads: list[bytes] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            path = f"{name}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.bin"
            system, place = _place(path)
            with system.open_output_stream(place) as out:
                out.write(_shard_file(keys, payloads, coder.width))
            return pa.RecordBatch.from_pylist(
                [{"part": part, "shard": number, "path": path, "n_docs": len(keys), "n_ids": held // coder.width}], manifest
            )

        for some in slices(batches, "text", SLICE, ROWS):
            texts = [t or "" for t in some.column(1).to_pylist()]
            for key, raw in zip(some.column(0).to_pylist(), coder.encode(texts)):
                if keys and held + len(raw) > shard:
                    yield flush()
                    keys, payloads, held, number = [], [], 0, number + 1
                keys.append(key)
                payloads.append(raw + end)
                held += len(raw) + len(end)
        if keys:
            yield flush()

    manifest = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    written = stored(ordered.mapInArrow(run, "part int, shard int, path string, n_docs bigint, n_ids bigint"), "manifest")
    # one row per shard
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))


def read(manifest: DataFrame) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document of the shards, in files read back by key.

    `start` counts the ids of all documents before it; `ids_crc32` is the checksum of the ids as little-endian unsigned
    32-bit integers. A key with several documents is found once, its further documents by their number.
    """
    shards = manifest.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                numbers = np.arange(shard.n_docs)
                found = np.where(shard.has_key == 1, shard.find(shard.keys), numbers)
                if (found < 0).any() or (shard.keys[found] != shard.keys).any():
                    raise ValueError(f"index of {path} misses a key")
                numbers = np.where(np.concatenate([[True], shard.keys[1:] != shard.keys[:-1]]), found, numbers)
                crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in numbers.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.keys, mask=shard.has_key == 0),
                        pa.array(shard.offsets[numbers] + start),
                        pa.array(np.diff(shard.offsets)[numbers]),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    paths = manifest.select("path", "start").repartition(max(shards, 1))
    return paths.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def folder(spark: SparkSession) -> str:
    """A new folder for shards in the shared folder of the cluster."""
    return scratch_path(spark, "shards")
