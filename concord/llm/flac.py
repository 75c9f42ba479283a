"""FLAC streams in a column: texts stored as 8-bit mono samples, read back with all checksums verified.

A stream is the marker, a STREAMINFO block with the MD5 of the samples and frames of 192 samples. A frame holds its number,
a CRC-8 of its header, one subframe (constant, verbatim, fixed predictor of order 0 to 4, or a linear predictor with own
coefficients) and a CRC-16. Tasks work on many frames at once: numpy steps through the samples of all frames of a slice
together, so that the work per sample is a few array operations whatever the length of a text.

Streams with other block sizes, channels or sample sizes are not read: `damage` tells so.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.llm.common import slices, utf8

FRAME = 192
#: Order and bits of a coefficient of the linear predictor that the writer tries; fixed predictors go up to order 4.
LPC_ORDER, LPC_BITS = 4, 12
#: Samples of a PCM block.
PCM_BLOCK = FRAME * 64
#: Bytes of samples, or of streams, that a task holds as bits at once.
SLICE = 1 << 20

# fixed values of the format: coefficients of the fixed predictors, marker, codes of the frame header
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
MARKER = b"fLaC"
SYNC = b"\xff\xf8"
CODES = b"\x14\x02"  # 192 samples at 8 kHz; mono, 8 bits
CRC8, CRC16 = 0x07, 0x8005


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        crc = np.where(crc >> (bits - 1) & 1, (crc << 1) ^ polynomial, crc << 1) & ((1 << bits) - 1)
    return crc.astype(np.uint32)


_TABLE8, _TABLE16 = _crc_table(CRC8, 8), _crc_table(CRC16, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """Checksum of the bytes start .. start + length of every run."""
    table = _TABLE8 if bits == 8 else _TABLE16
    order = np.argsort(-length, kind="stable")
    at, sizes = start[order], length[order]
    crc = np.zeros(len(start), np.uint32)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    for step, n in enumerate(active):
        value = data[at[:n] + step]
        if bits == 8:
            crc[:n] = table[crc[:n] ^ value]
        else:
            crc[:n] = ((crc[:n] << 8) & 0xFF00) ^ table[(crc[:n] >> 8) ^ value]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    for more in range(1, 6):
        if n < 1 << (5 * more + 6):
            lead = (0xFF << (7 - more) & 0xFF) | n >> (6 * more)
            return bytes([lead, *(0x80 | n >> 6 * i & 0x3F for i in reversed(range(more)))])
    return bytes([0xFE, *(0x80 | n >> 6 * i & 0x3F for i in reversed(range(6)))])


def _signed(values: np.ndarray, bits: int) -> np.ndarray:
    return (values ^ (1 << (bits - 1))) - (1 << (bits - 1))


# -- writing ---------------------------------------------------------------------------------------------------------


def _lpc(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of every frame, by Levinson-Durbin over its autocorrelation, and the residuals."""
    x = samples.astype(np.float64)
    r = np.stack([(x[:, : FRAME - k] * x[:, k:]).sum(1) for k in range(LPC_ORDER + 1)], 1)
    r[:, 0] = r[:, 0] * 1.0001 + 1.0
    a = np.zeros((len(x), LPC_ORDER))
    error = r[:, 0].copy()
    for i in range(LPC_ORDER):
        reflect = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= reflect[:, None] * a[:, :i][:, ::-1]
        a[:, i] = reflect
        error = error * (1 - reflect**2)
    top = np.abs(a).max(1).clip(1e-9)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(top)), 0, 15).astype(np.int64)
    limit = 1 << (LPC_BITS - 1)
    coefficients = np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64)
    guess = sum(coefficients[:, j, None] * samples[:, LPC_ORDER - 1 - j : FRAME - 1 - j] for j in range(LPC_ORDER))
    return coefficients, shift, samples[:, LPC_ORDER:] - (guess >> shift[:, None])


def write_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the rows of `samples` (signed, 192 columns): their bytes one after the other, and the size of each."""
    n = len(samples)
    samples = samples.astype(np.int64)
    # residual of every predictor; the one with the least sum of magnitudes is taken
    fixed = [samples]
    for _ in range(4):
        fixed.append(np.diff(fixed[-1], axis=1))
    coefficients, shift, own = _lpc(samples)
    tried = [*fixed, own]
    orders = np.array([0, 1, 2, 3, 4, LPC_ORDER])
    side = orders * 8.0 + np.array([0, 0, 0, 0, 0, 9 + LPC_ORDER * LPC_BITS])
    folded = [(r << 1) ^ (r >> 63) for r in tried]
    mean = np.stack([u.mean(1) for u in folded], 1)
    rice = np.floor(np.log2(mean * 0.7 + 0.5)).clip(0, 14).astype(np.int64)
    cost = np.stack([(u >> rice[:, k, None]).sum(1) + (rice[:, k] + 1) * u.shape[1] for k, u in enumerate(folded)], 1)
    cost = cost + side + 10
    kind = cost.argmin(1)
    kind[cost.min(1) >= FRAME * 8] = 7  # verbatim
    kind[(samples == samples[:, :1]).all(1)] = 6  # constant
    rice = np.take_along_axis(rice, np.minimum(kind, 5)[:, None], 1)[:, 0]

    headers = [SYNC + CODES + _number(k) for k in numbers.tolist()]
    head_size = np.array([len(h) for h in headers])
    joined = np.frombuffer(b"".join(headers), np.uint8)
    head_crc = _crc(joined, np.cumsum(head_size) - head_size, head_size, 8)

    # width in bits of what follows the header, per kind
    order = np.where(kind < 6, orders[np.minimum(kind, 5)], 0)
    body = np.full(n, 8, np.int64)
    body += np.where(kind == 6, 8, np.where(kind == 7, FRAME * 8, cost[np.arange(n), np.minimum(kind, 5)].astype(np.int64)))
    sizes = head_size + 1 + (body + 7) // 8 + 2
    starts = np.cumsum(sizes) - sizes
    bits = np.zeros(int(sizes.sum()) * 8, np.uint8)

    def put(position: np.ndarray, value: np.ndarray, width: int | np.ndarray) -> None:
        most = int(np.max(width)) if np.size(width) else 0
        for b in range(most):
            chosen = slice(None) if np.isscalar(width) else width > b
            at = position + width - 1 - b
            bits[at[chosen]] = (value[chosen] >> b) & 1

    at = (starts + head_size + 1) * 8
    # fixed values of the format: type of the subframe
    types = np.array([8, 9, 10, 11, 12, 32 + LPC_ORDER - 1, 0, 1])
    put(at, types[kind] << 1, 8)
    at = at + 8
    for k in range(8):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        here, some = at[rows], samples[rows]
        warm = {6: 1, 7: FRAME}.get(k, int(orders[min(k, 5)]))
        if warm:
            position = here[:, None] + np.arange(warm) * 8
            put(position.ravel(), (some[:, :warm] & 0xFF).ravel(), 8)
            here = here + warm * 8
        if k > 5:
            continue
        if k == 5:
            put(here, np.full(len(rows), LPC_BITS - 1), 4)
            put(here + 4, shift[rows], 5)
            position = here[:, None] + 9 + np.arange(LPC_ORDER) * LPC_BITS
            put(position.ravel(), (coefficients[rows] & ((1 << LPC_BITS) - 1)).ravel(), LPC_BITS)
            here = here + 9 + LPC_ORDER * LPC_BITS
        # one partition with four-bit parameters: six zero bits and the parameter
        put(here + 6, rice[rows], 4)
        here = here + 10
        u, p = folded[k][rows], rice[rows][:, None]
        high = u >> p
        step = high + 1 + p
        position = here[:, None] + np.cumsum(step, 1) - step + high
        for parameter in np.unique(p):
            same = np.flatnonzero(p[:, 0] == parameter)
            value = (u[same] & ((1 << int(parameter)) - 1)) | (1 << int(parameter))
            put(position[same].ravel(), value.ravel(), int(parameter) + 1)
    data = np.packbits(bits)
    for step in range(int(head_size.max())):
        rows = np.flatnonzero(head_size > step)
        data[starts[rows] + step] = joined[(np.cumsum(head_size) - head_size)[rows] + step]
    data[starts + head_size] = head_crc
    crc = _crc(data, starts, sizes - 2, 16)
    data[starts + sizes - 2], data[starts + sizes - 1] = crc >> 8, crc & 0xFF
    return data, sizes


def _stream_head(samples: bytes, n: int, sizes: np.ndarray) -> bytes:
    """Marker and STREAMINFO: block and frame sizes, 8 kHz, mono, 8 bits, number of samples, MD5 of the signed samples."""
    rate = 8000 << 44 | 0 << 41 | 7 << 36 | n
    info = FRAME.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += rate.to_bytes(8, "big") + hashlib.md5(samples).digest()
    return MARKER + b"\x80" + len(info).to_bytes(3, "big") + info


def write_streams(payloads: list[bytes]) -> list[bytes]:
    """A stream per payload; sizes must be positive multiples of 192. Payload bytes are unsigned 8-bit PCM."""
    streams = []
    for group in _groups([len(p) for p in payloads]):
        some = [payloads[i] for i in group]
        counts = [len(p) // FRAME for p in some]
        numbers = np.concatenate([np.arange(c) for c in counts])
        every = np.frombuffer(b"".join(some), np.uint8).astype(np.int16).reshape(-1, FRAME) - 128
        # a long payload is written in several pieces
        pieces = [write_frames(every[at : at + SLICE // FRAME], numbers[at : at + SLICE // FRAME]) for at in range(0, len(every), SLICE // FRAME)]
        data, sizes = np.concatenate([p[0] for p in pieces]).tobytes(), np.concatenate([p[1] for p in pieces])
        end, frame = 0, 0
        for payload, count in zip(some, counts):
            own = sizes[frame : frame + count]
            signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
            size = int(own.sum())
            streams.append(_stream_head(signed, len(payload), own) + data[end : end + size])
            end, frame = end + size, frame + count
    return streams


def _groups(sizes: list[int]) -> Iterator[range]:
    """Runs of items that hold at most `SLICE` bytes together, or one item."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > SLICE:
            yield range(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield range(start, len(sizes))


# -- reading ---------------------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """A stream that fails a check."""


def _find_frames(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and header size of the frames in `data` from `base` on.

    Frames start with the sync code; bytes inside a frame can look like one. A start counts if its header has the right
    checksum and the number that is next.
    """
    body = data[base:]
    hits = np.flatnonzero((body[:-5] == SYNC[0]) & (body[1:-4] == SYNC[1]) & (body[2:-3] == CODES[0]) & (body[3:-2] == CODES[1]))
    starts, heads, wanted = [], [], 0
    raw = body.tobytes()
    for at in hits.tolist():
        number = _number(wanted)
        size = 4 + len(number)
        if raw[at + 4 : at + size] != number or at + size >= len(raw):
            continue
        crc = 0
        for byte in raw[at : at + size]:
            crc = int(_TABLE8[crc ^ byte])
        if crc == raw[at + size]:
            starts.append(at)
            heads.append(size + 1)
            wanted += 1
    begin = np.array(starts, np.int64) + base
    return begin, np.append(begin[1:], len(data)), np.array(heads, np.int64)


def read_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Samples of the frames at `start` .. `end`, 192 signed numbers each. Raises `Damaged`."""
    n = len(start)
    out = np.zeros((n, FRAME), np.int64)
    if not n:
        return out
    if (end - start < head + 3).any():
        raise Damaged("short frame")
    crc = _crc(data, start, end - start - 2, 16)
    if (crc != (data[end - 2].astype(np.uint32) << 8 | data[end - 1])).any():
        raise Damaged("frame checksum")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    window = sum(padded[k : len(data) + k + 1].astype(np.uint32) << (24 - 8 * k) for k in range(4))
    bits = np.unpackbits(padded)
    ahead = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    next_one = np.minimum.accumulate(ahead[::-1])[::-1]
    last_bit = len(data) * 8

    def take(position: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        position = np.minimum(position, last_bit)
        value = window[position >> 3].astype(np.int64)
        return (value << (position & 7) & 0xFFFFFFFF) >> (32 - width)

    at = (start + head) * 8
    types = take(at, 8) >> 1
    if (take(at, 8) & 0x81).any():
        raise Damaged("subframe header")
    at = at + 8
    for code in np.unique(types).tolist():
        rows = np.flatnonzero(types == code)
        here = at[rows]
        if code == 0:
            out[rows] = _signed(take(here, 8), 8)[:, None]
        elif code == 1:
            out[rows] = _signed(take(here[:, None] + np.arange(FRAME) * 8, 8), 8)
        elif 8 <= code <= 12:
            order = code - 8
            weights = np.tile(np.array(FIXED[order], np.int64), (len(rows), 1))
            out[rows] = _predicted(take, next_one, here, order, weights, None)
        elif code >= 32:
            order = code - 31
            after = here + order * 8
            width = take(after, 4) + 1
            shift = _signed(take(after + 4, 5), 5)
            if (width == 16).any() or (shift < 0).any():
                raise Damaged("linear predictor")
            position = after[:, None] + 9 + np.arange(order) * width[:, None]
            raw = take(position, width[:, None])
            weights = (raw ^ (1 << (width - 1))[:, None]) - (1 << (width - 1))[:, None]
            out[rows] = _predicted(take, next_one, here, order, weights, shift, 9 + order * width)
        else:
            raise Damaged("subframe type")
    if (out < -128).any() or (out > 127).any():
        raise Damaged("sample out of range")
    return out


def _predicted(take, next_one, here, order, weights, shift, skip=0) -> np.ndarray:
    """Samples of predicted subframes: warm-up, Rice residuals, prediction."""
    n = len(here)
    x = np.zeros((FRAME, n), np.int64)
    for i in range(order):
        x[i] = _signed(take(here + i * 8, 8), 8)
    at = here + order * 8 + skip
    method, parts = take(at, 2), take(at + 2, 4)
    if (method > 1).any() or (FRAME % (1 << parts) != 0).any() or (FRAME >> parts < order).any():
        raise Damaged("residual header")
    at = at + 6
    width = 4 + method
    escape = (1 << width) - 1
    columns = [weights[:, j] for j in range(order)]
    limit = len(next_one) - 1
    sizes = FRAME >> parts
    starts_at = {i for s in np.unique(sizes).tolist() for i in range(0, FRAME, s)}
    parameter = np.zeros(n, np.int64)
    raw = np.full(n, -1, np.int64)  # width of samples that are stored as they are, -1: Rice codes
    for i in range(order, FRAME):
        if i == order or i in starts_at:
            fresh = np.ones(n, bool) if i == order else i % sizes == 0
            if i == order and order and (sizes == order).any():
                # the first partition holds warm-up samples only
                empty = sizes == order
                at = np.where(empty, at + width + np.where(take(at, width) == escape, 5, 0), at)
            read = take(at, width)
            parameter = np.where(fresh, read, parameter)
            at = at + np.where(fresh, width, 0)
            plain = fresh & (read == escape)
            raw = np.where(fresh, np.where(plain, take(at, 5), -1), raw)
            at = at + np.where(plain, 5, 0)
        one = next_one[np.minimum(at, limit)].astype(np.int64)
        low = take(one + 1, parameter)
        u = ((one - at) << parameter) | low
        residual = (u >> 1) ^ -(u & 1)
        after = one + 1 + parameter
        if (raw >= 0).any():
            w = np.maximum(raw, 1)
            value = take(at, w)
            value = np.where(raw > 0, (value ^ (1 << (w - 1))) - (1 << (w - 1)), 0)
            residual, after = np.where(raw >= 0, value, residual), np.where(raw >= 0, at + raw, after)
        at = after
        if order:
            guess = columns[0] * x[i - 1]
            for j in range(1, order):
                guess = guess + columns[j] * x[i - 1 - j]
            residual = residual + (guess if shift is None else guess >> shift)
        x[i] = residual
    return x.T


def read_streams(streams: list[bytes | None]) -> list[bytes | str]:
    """Per stream its samples as unsigned 8-bit PCM, or the reason why it can't be read as a `str`."""
    results: list[bytes | str] = []
    for group in _groups([len(s or b"") for s in streams]):
        for tries in (group, *([range(i, i + 1) for i in group] if len(group) > 1 else [])):
            # frames of the whole group together; if one is damaged, the streams one by one
            try:
                found = _read_group([streams[i] for i in tries])
            except Damaged as reason:
                if len(tries) > 1:
                    continue
                found = [str(reason)]
            results += found
            if len(tries) == len(group):
                break
    return results


def _read_group(streams: list[bytes | None]) -> list[bytes | str]:
    found, heads, frames = [], [], []
    base = 0
    for stream in streams:
        if stream is None or stream[:4] != MARKER or len(stream) < 42 or stream[4] & 0x7F:
            raise Damaged("no stream")
        at, last = 4, False
        while not last:
            if at + 4 > len(stream):
                raise Damaged("metadata")
            last, size = bool(stream[at] & 0x80), int.from_bytes(stream[at + 1 : at + 4], "big")
            at += 4 + size
        info = stream[8:42]
        rate = int.from_bytes(info[10:18], "big")
        if info[:4] != FRAME.to_bytes(2, "big") * 2 or rate >> 36 & 0xFF != 7:
            raise Damaged("not mono with 8 bits in frames of 192")
        begin, end, head = _find_frames(np.frombuffer(stream, np.uint8), at)
        if len(begin) * FRAME != rate & (1 << 36) - 1 or (len(begin) and begin[0] != at):
            raise Damaged("frames missing")
        frames.append((begin + base, end + base, head))
        heads.append((len(begin), info[18:34]))
        base += len(stream)
    data = np.frombuffer(b"".join(streams), np.uint8)
    start, end, head = (np.concatenate([f[k] for f in frames]) for k in range(3))
    step = SLICE // FRAME
    parts = []
    for k in range(0, len(start), step):
        low, high = int(start[k]), int(end[min(k + step, len(start)) - 1])
        some = slice(k, k + step)
        parts.append(read_frames(data[low:high], start[some] - low, end[some] - low, head[some]).astype(np.int8))
    samples = np.concatenate(parts) if parts else np.zeros((0, FRAME), np.int8)
    at = 0
    for count, md5 in heads:
        own = samples[at : at + count].tobytes()
        if hashlib.md5(own).digest() != md5:
            raise Damaged("samples checksum")
        found.append((np.frombuffer(own, np.uint8) ^ 0x80).tobytes())
        at += count
    return found


# -- DataFrames ------------------------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, media` for every row of `docs` (`doc_id, text`): the whole text as UTF-8, filled up with spaces to
    a positive multiple of 192 bytes, as a FLAC stream. Null and empty texts give 192 spaces; repeated rows give equal
    streams; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            texts = utf8(part, "text")
            padded = [t.ljust(max(1, -(-len(t) // FRAME)) * FRAME, b" ") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(write_streams(padded), pa.binary()),
                ],
                ["doc_id", "n_bytes", "media"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def feature(pcm: bytes) -> str:
    """Level, energy and crossings of the middle line, as whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)} sum={int(x.sum())} energy={int((x * x).sum())} peak={int(np.abs(x).max())} crossings={crossings}"


def load(media: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, media, blocks, payload_bytes, payload_sha256, tail_crc32, feature, damage` for every row of
    `media` (`doc_id, n_bytes, media`).

    `blocks` are PCM blocks of unsigned 8-bit samples with the offset of their first sample; the payload columns are
    computed from them. A stream that is null or fails a check has null there and the reason in `damage`.
    """
    schema = (
        "doc_id bigint, n_bytes bigint, media binary, blocks array<struct<sample_offset:bigint,pcm:binary>>, "
        "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string, damage string"
    )
    block = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))

    def cut(pcm: bytes) -> list[dict]:
        return [{"sample_offset": at, "pcm": pcm[at : at + PCM_BLOCK]} for at in range(0, len(pcm), PCM_BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", SLICE):
            found = read_streams(part.column(2).to_pylist())
            blocks = [None if isinstance(x, str) else cut(x) for x in found]
            whole = [None if b is None else b"".join(x["pcm"] for x in b) for b in blocks]
            of = lambda f, kind: pa.array([None if p is None else f(p) for p in whole], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns,
                    pa.array(blocks, block),
                    of(len, pa.int64()),
                    of(lambda p: hashlib.sha256(p).hexdigest(), pa.string()),
                    of(lambda p: zlib.crc32(p[-16:]), pa.int64()),
                    of(feature, pa.string()),
                    pa.array([x if isinstance(x, str) else None for x in found], pa.string()),
                ],
                [f.split()[0] for f in schema.replace("bigint,pcm", "").split(", ")],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
