"""FLAC for byte payloads: 8-bit mono streams, all frames of a slice encoded and decoded side by side.

A stream holds STREAMINFO with the MD5 of its samples, a SEEKTABLE with one point per frame (so that any frame can be reached
and all be decoded at once), and fixed-size frames: constant, verbatim, fixed or linear prediction with Rice-coded residuals.
The decoder checks both checksums of every frame and the MD5, and returns PCM blocks with their first sample.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boutwise.llm.common import encoded, slices

BLOCK = 576
RATE = 8_000
SLICE = 1 << 20
LPC_ORDER, LPC_BITS, LPC_SHIFT = 2, 12, 9
MOST_RICE = 14


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, dtype=np.uint16)


# The format's two checksum polynomials.
CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_FAR: dict[int, np.ndarray] = {}


def _far_table(bits: int, length: int) -> np.ndarray:
    """[d, b]: what byte b adds to the checksum when d bytes follow it; checksums are sums of such terms."""
    size = 1 << max(10, (length - 1).bit_length())
    if bits not in _FAR or len(_FAR[bits]) < size:
        base, shift, mask = (CRC8, 0, 0xFF) if bits == 8 else (CRC16, 8, 0xFFFF)
        rows = [base]
        for _ in range(size - 1):
            last = rows[-1].astype(np.uint32)
            rows.append((((last << 8) & mask) ^ base[(last >> shift) & 0xFF]).astype(np.uint16) if bits == 16 else base[last])
        _FAR[bits] = np.stack(rows)
    return _FAR[bits]


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Checksum of each data[start:start + length]; the pieces follow each other without overlap and none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    table = _far_table(bits, int(lengths.max()))
    first = np.cumsum(lengths) - lengths
    inner = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = np.repeat(starts, lengths) + inner
    return np.bitwise_xor.reduceat(table[np.repeat(lengths, lengths) - 1 - inner, data[at]], first)


def frame_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The format's variable-length numbers: bytes [n, 7] and how many of them count."""
    size = np.ones(len(numbers), dtype=np.int64)
    for k, most in enumerate((1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31), 1):
        size[numbers >= most] = k + 1
    out = np.zeros((len(numbers), 7), dtype=np.uint8)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        if n == 1:
            out[rows, 0] = numbers[rows]
            continue
        lead = (0xFF << (8 - n)) & 0xFF if n < 8 else 0xFE
        out[rows, 0] = lead | (numbers[rows] >> (6 * (n - 1)))
        for k in range(1, n):
            out[rows, k] = 0x80 | ((numbers[rows] >> (6 * (n - 1 - k))) & 0x3F)
    return out, size


def _fold(residual: np.ndarray) -> np.ndarray:
    return (residual << 1) ^ (residual >> 31)


def _predict(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, folded residuals, LPC coefficients) of each row of samples; kind 0 to 2: fixed of that order, 3: LPC."""
    n = len(x)
    options = [x.copy()]
    for _ in range(2):
        d = options[-1].copy()
        d[:, 1:] -= options[-1][:, :-1]
        options.append(d)
    f = x.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, k:], f[:, :BLOCK - k]).astype(np.float64) for k in range(3))
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 0, det, 1)
    a = np.stack([np.where(det > 0, r1 * (r0 - r2) / safe, 0), np.where(det > 0, (r0 * r2 - r1 * r1) / safe, 0)], axis=1)
    most = (1 << (LPC_BITS - 1)) - 1
    coefficients = np.clip(np.rint(a * (1 << LPC_SHIFT)), -most - 1, most).astype(np.int32)
    lpc = x.copy()
    lpc[:, 2:] -= (coefficients[:, :1] * x[:, 1:-1] + coefficients[:, 1:] * x[:, :-2]) >> LPC_SHIFT
    options.append(lpc)
    costs = np.stack([np.abs(o[:, 2:]).sum(axis=1) for o in options])
    kind = costs.argmin(axis=0)
    residual = np.stack(options)[kind, np.arange(n)]
    return kind, _fold(residual), coefficients


ORDER = np.array([0, 1, 2, LPC_ORDER])


class _Bits:
    """Fields of up to 32 bits, given by their end in one long bit string, added up in 32-bit words."""

    def __init__(self, bits: int):
        self.words = np.zeros(bits // 32 + 2, dtype=np.float64)

    def add(self, end: np.ndarray, width, value: np.ndarray) -> None:
        start = end - width
        word, shifted = start >> 5, value.astype(np.uint64) << (64 - (start & 31) - width).astype(np.uint64)
        high, low = shifted >> np.uint64(32), shifted & np.uint64(0xFFFFFFFF)
        some = low != 0
        self.words += np.bincount(word, high.astype(np.float64), len(self.words))
        if some.any():
            self.words += np.bincount(word[some] + 1, low[some].astype(np.float64), len(self.words))

    def bytes(self) -> np.ndarray:
        return self.words.astype(np.uint64).astype(">u4").view(np.uint8)


def encode(payloads: list[bytes], partition_order: int = 0) -> list[bytes]:
    """One FLAC stream for each payload, a positive multiple of 576 bytes; a byte is a sample plus 128."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    if any(len(p) % BLOCK or not len(p) for p in payloads):
        raise ValueError("payloads are positive multiples of the block size")
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32).reshape(-1, BLOCK) - 128
    n, parts = len(x), 1 << partition_order
    kind, folded, coefficients = _predict(x)
    order = ORDER[kind]
    warm = np.arange(BLOCK)[None, :] < order[:, None]
    part_size = BLOCK // parts
    by_part = np.where(warm, 0, folded).reshape(n, parts, part_size)
    in_part = np.full((n, parts), part_size)
    in_part[:, 0] -= order
    sums = by_part.sum(axis=2)
    guess = np.floor(np.log2(np.maximum(sums / in_part, 1))).astype(np.int64)
    best_k, best_bits = None, None
    for step in (-1, 0, 1):
        k = np.clip(guess + step, 0, MOST_RICE)
        bits = (by_part >> k[:, :, None]).sum(axis=2) + in_part * (k + 1)
        best_k = k if best_k is None else np.where(bits < best_bits, k, best_k)
        best_bits = bits if best_bits is None else np.minimum(bits, best_bits)
    lpc_bits = np.where(kind == 3, 9 + LPC_ORDER * LPC_BITS, 0)
    body = 8 + 8 * order + lpc_bits + 6 + 4 * parts + best_bits.sum(axis=1)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (body >= 8 + 8 * BLOCK)
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, body))
    coded = ~constant & ~verbatim

    number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    number_bytes, number_size = frame_numbers(number)
    header = 5 + number_size  # sync and codes, the number, the checksum of both
    length = header + (body + 7) // 8 + 2
    starts = np.cumsum(length) - length
    out = _Bits(int(length.sum()) * 8)
    at = (starts + header) * 8  # of the subframe
    subframe = np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 3, 32 + LPC_ORDER - 1, 8 + order)))
    out.add(at + 8, 8, subframe << 1)
    out.add(at[constant] + 16, 8, x[constant, 0] & 0xFF)
    plain = np.flatnonzero(verbatim)
    out.add((at[plain, None] + 16 + 8 * np.arange(BLOCK)).ravel(), 8, (x[plain] & 0xFF).ravel())
    for k in range(2):
        rows = np.flatnonzero(coded & (order > k))
        out.add(at[rows] + 16 + 8 * k, 8, x[rows, k] & 0xFF)
    place = at + 8 + 8 * order
    rows = np.flatnonzero(coded & (kind == 3))
    out.add(place[rows] + 9, 9, np.full(len(rows), (LPC_BITS - 1) << 5 | LPC_SHIFT))
    for k in range(LPC_ORDER):
        out.add(place[rows] + 9 + (k + 1) * LPC_BITS, LPC_BITS, coefficients[rows, k] & ((1 << LPC_BITS) - 1))
    rows = np.flatnonzero(coded)
    place = place[rows] + lpc_bits[rows] + 6
    out.add(place, 6, np.full(len(rows), partition_order))
    k = best_k[rows]
    widths = (by_part[rows] >> k[:, :, None]) + k[:, :, None] + 1
    widths.reshape(len(rows), BLOCK)[warm[rows]] = 0
    # Each partition starts with its parameter; its codes follow.
    ends = place[:, None] + np.cumsum(widths.reshape(len(rows), BLOCK), axis=1) + 4 * (np.arange(BLOCK)[None, :] // part_size + 1)
    before = ends.reshape(len(rows), parts, part_size)[:, :, 0] - widths[:, :, 0]
    out.add(before.ravel(), 4, k.ravel())
    each = np.broadcast_to(k[:, :, None], widths.shape).reshape(len(rows), BLOCK)
    real = ~warm[rows]
    each, value = each[real], by_part[rows].reshape(len(rows), BLOCK)[real]
    out.add(ends[real], each + 1, (1 << each) | (value & ((1 << each) - 1)))

    data = out.bytes().copy()
    data[starts], data[starts + 1] = 0xFF, 0xF8
    data[starts + 2], data[starts + 3] = 0x20, 0x02  # 576 samples, rate as in the header; mono, 8 bits
    for k in range(7):
        rows = np.flatnonzero(number_size > k)
        data[starts[rows] + 4 + k] = number_bytes[rows, k]
    data[starts + header - 1] = checksums(data, starts, header - 1, 8)
    crc = checksums(data, starts, length - 2, 16)
    data[starts + length - 2], data[starts + length - 1] = crc >> 8, crc & 0xFF
    return _streams(payloads, counts, data, starts, length)


def _streams(payloads, counts, data, starts, length) -> list[bytes]:
    out, frame = [], 0
    for payload, count in zip(payloads, counts.tolist(), strict=True):
        mine = slice(frame, frame + count)
        sizes = length[mine]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        # Points in one table up to the most its length field allows; several tables would need several blocks.
        table = np.zeros(count, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        table["sample"], table["offset"], table["size"] = np.arange(count) * BLOCK, starts[mine] - starts[frame], BLOCK
        tables = [table[k:k + MOST_POINTS].tobytes() for k in range(0, count, MOST_POINTS)]
        head = b"fLaC\x00" + len(info).to_bytes(3, "big") + info
        for k, points in enumerate(tables):
            head += bytes([3 | (0x80 if k + 1 == len(tables) else 0)]) + len(points).to_bytes(3, "big") + points
        end = frame + count - 1
        out.append(head + data[starts[frame]:starts[end] + length[end]].tobytes())
        frame += count
    return out


MOST_POINTS = (1 << 24) // 18 - 1


def _metadata(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, frame offsets from the first frame, place of the first frame)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, samples, md5, tables = 4, 0, b"", []
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1:at + 4], "big")
        body = stream[at + 4:at + 4 + size]
        if kind & 0x7F == 0:
            samples, md5 = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34]
        elif kind & 0x7F == 3:
            tables.append(np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
        at += 4 + size
        if kind & 0x80:
            break
    points = np.concatenate(tables) if tables else np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    if len(points) * BLOCK != samples or (points["size"] != BLOCK).any() or (points["sample"] != np.arange(len(points)) * BLOCK).any():
        raise ValueError("the seek table does not name every frame")
    return samples, md5, points["offset"].astype(np.int64), at


class _Reader:
    """A bit cursor for each frame over one shared byte string."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        self.windows = np.zeros(len(data) + 8, dtype=np.uint64)
        for k in range(8):
            self.windows |= padded[k:k + len(self.windows)] << np.uint64(56 - 8 * k)
        self.at = at

    def peek(self, rows) -> np.ndarray:
        at = self.at[rows]
        return self.windows[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, rows, bits: np.ndarray) -> np.ndarray:
        """`bits` (0 to 32) for each of `rows`, unsigned."""
        got = (self.peek(rows) >> np.uint64(1)) >> (63 - bits).astype(np.uint64)
        self.at[rows] += bits
        return got.astype(np.int64)

    def unary(self, rows) -> np.ndarray:
        """Zeros before the next one, which is taken too."""
        zeros = np.zeros(len(self.at[rows]), dtype=np.int64)
        rows = np.arange(len(self.at))[rows]
        todo = np.arange(len(rows))
        while len(todo):
            top = (self.peek(rows[todo]) >> np.uint64(11)).astype(np.int64)
            lead = 1075 - (top.astype(np.float64).view(np.int64) >> 52)  # of 53 bits; beyond 53 where all are zero
            none = top == 0
            lead[none] = 53
            zeros[todo] += lead
            self.at[rows[todo]] += np.where(none, 53, lead + 1)
            todo = todo[none]
        return zeros


def _signed(value: np.ndarray, bits) -> np.ndarray:
    return value - ((value >> (bits - 1)) << bits)


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # fixed values: the format's predictors


def decode(streams: list[bytes]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """Payloads, the seekable frame offsets of each stream, and the subframe codes; raises where a checksum is wrong."""
    heads = [_metadata(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])[:-1]
    data = np.frombuffer(b"".join(streams), np.uint8)
    counts = np.array([len(h[2]) for h in heads])
    starts = np.concatenate([b + h[3] + h[2] for b, h in zip(base, heads, strict=True)]) if len(heads) else np.zeros(0, np.int64)
    last = np.cumsum(counts) - 1
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:]
    stops[last] = base + np.array([len(s) for s in streams], dtype=np.int64)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    want, size = frame_numbers(number)
    header = 5 + size
    if (stops - starts < header + 3).any() or (starts < 0).any():
        raise ValueError("the seek table points outside its stream")
    good = (data[starts] == 0xFF) & (data[starts + 1] == 0xF8) & (data[starts + 2] == 0x20) & (data[starts + 3] == 0x02)
    for k in range(7):
        good &= (data[np.minimum(starts + 4 + k, len(data) - 1)] == want[:, k]) | (size <= k)
    good &= checksums(data, starts, header - 1, 8) == data[starts + header - 1]
    good &= checksums(data, starts, stops - starts - 2, 16) == (data[stops - 2].astype(np.uint16) << 8 | data[stops - 1])
    if not good.all():
        raise ValueError(f"{int((~good).sum())} frames fail their checksum or header")
    x, code = _subframes(_Reader(data, (starts + header) * 8), len(starts))
    pcm = (x + 128).astype(np.uint8).tobytes()
    out, at = [], 0
    for samples, md5, _, _ in heads:
        payload = pcm[at:at + samples]
        if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the samples do not have the stream's MD5")
        out.append(payload)
        at += samples
    return out, [h[2] for h in heads], code


def _subframes(bits: _Reader, n: int) -> tuple[np.ndarray, np.ndarray]:
    everything = np.arange(n)
    code = bits.take(everything, np.full(n, 8)) >> 1
    x = np.zeros((BLOCK, n), dtype=np.int32)  # sample by sample, so that a step touches one row
    rows = np.flatnonzero(code == 0)
    x[:, rows] = _signed(bits.take(rows, np.full(len(rows), 8)), 8)
    rows = np.flatnonzero(code == 1)
    for t in range(BLOCK if len(rows) else 0):
        x[t, rows] = _signed(bits.take(rows, np.full(len(rows), 8)), 8)
    fixed, lpc = (code >= 8) & (code <= 12), code >= 32
    if (~(fixed | lpc | (code < 2))).any():
        raise ValueError("a reserved subframe type")
    order = np.where(fixed, code - 8, np.where(lpc, code - 31, 0))
    rows = np.flatnonzero(fixed | lpc)
    if len(rows):
        _predicted(bits, x, rows, order[rows], lpc[rows])
    return x.T, code


def _predicted(bits: _Reader, x: np.ndarray, rows: np.ndarray, order: np.ndarray, lpc: np.ndarray) -> None:
    for t in range(int(order.max())):
        mine = rows[order > t]
        x[t, mine] = _signed(bits.take(mine, np.full(len(mine), 8)), 8)
    weights, shift = np.zeros((int(order.max()), len(rows)), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for o in np.unique(order[~lpc]):
        for k, w in enumerate(FIXED[o]):
            weights[k, ~lpc & (order == o)] = w
    some = np.flatnonzero(lpc)
    if len(some):
        width = bits.take(rows[some], np.full(len(some), 4)) + 1
        shift[some] = _signed(bits.take(rows[some], np.full(len(some), 5)), 5)
        for k in range(int(order[some].max())):
            has = order[some] > k
            weights[k, some[has]] = _signed(bits.take(rows[some[has]], width[has]), width[has])
    method = bits.take(rows, np.full(len(rows), 2))
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    part_size = BLOCK >> bits.take(rows, np.full(len(rows), 4))
    wide = 4 + method
    rice, raw = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1)
    y = np.zeros((BLOCK, len(rows)), dtype=np.int64)
    y[: len(weights)] = x[: len(weights), rows]
    for t in range(BLOCK):
        fresh = np.flatnonzero((t == order) | ((t % part_size == 0) & (t > order)))
        if len(fresh):
            rice[fresh] = bits.take(rows[fresh], wide[fresh])
            escape = rice[fresh] == (1 << wide[fresh]) - 1
            raw[fresh] = -1
            raw[fresh[escape]] = bits.take(rows[fresh[escape]], np.full(int(escape.sum()), 5))
        now = np.flatnonzero((t >= order) & (raw < 0)) if (t < len(weights) or (raw >= 0).any()) else slice(None)
        value = bits.unary(rows[now]) << rice[now]
        value |= bits.take(rows[now], rice[now])
        residual = np.zeros(len(rows), dtype=np.int64)
        residual[now] = (value >> 1) ^ -(value & 1)
        unpacked = np.flatnonzero((t >= order) & (raw >= 0)) if (raw >= 0).any() else []
        if len(unpacked):
            residual[unpacked] = _signed(bits.take(rows[unpacked], raw[unpacked]), np.maximum(raw[unpacked], 1))
        guess = np.zeros(len(rows), dtype=np.int64)
        for k in range(min(t, len(weights))):
            guess += weights[k] * y[t - 1 - k]
        y[t] = np.where(t >= order, residual + (guess >> shift), y[t])
    x[:, rows] = y


def payload_of(raw: bytes) -> bytes:
    """The text's bytes, filled up with bytes 255 to a positive multiple of the block size."""
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a FLAC stream) for every row of `docs` (doc_id, text, ...); NULL counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            raws = encoded(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, raws), pa.int64()), pa.array(encode([payload_of(r) for r in raws]), pa.binary())],
                names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, first_sample, frame_offset, pcm: the decoded blocks of every stream, each seekable on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE):
            payloads, offsets, _ = decode(batch.column("media").to_pylist())
            for doc_id, payload, places in zip(batch.column("doc_id"), payloads, offsets, strict=True):
                n = len(places)
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_id.as_py()] * n, doc_id.type), pa.array(np.arange(n)), pa.array(np.arange(n) * BLOCK), pa.array(places),
                    pa.array([payload[k * BLOCK:(k + 1) * BLOCK] for k in range(n)], pa.binary())],
                    names=["doc_id", "block", "first_sample", "frame_offset", "pcm"])

    return media.mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, block long, first_sample long, frame_offset long, pcm binary")


DIGESTS = ("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
           "feature string, n_frames long")


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored streams hold, read back: sizes, digests of payload and stream, and a loudness feature.

    feature: mean level, mean change from sample to sample, and the share of predicted frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE):
            streams = batch.column("media").to_pylist()
            payloads, offsets, codes = decode(streams)
            out, at = [], 0
            for stream, payload, places in zip(streams, payloads, offsets, strict=True):
                pcm = np.frombuffer(payload, np.uint8).astype(np.int64)
                mine = codes[at:at + len(places)]
                at += len(places)
                feature = f"{pcm.sum() / len(pcm):.4f}|{np.abs(np.diff(pcm)).sum() / (len(pcm) - 1):.4f}|{(mine >= 8).sum() / len(mine):.4f}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, len(places)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))],
                names=["doc_id", *(f.split()[0] for f in DIGESTS.split(", "))])

    return media.mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, {DIGESTS}")
