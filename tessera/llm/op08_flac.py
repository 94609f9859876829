"""Media columns: lossless FLAC streams of 8-bit samples, encoded and decoded in Arrow batches.

A stream has STREAMINFO (with the MD5 of the samples), a SEEKTABLE with a point every SEEK_FRAMES
frames, and frames of 192 samples: mono, 8 bits, a constant, verbatim, fixed or quantised linear
predictor subframe (of LPC_ORDER coefficients), Rice-coded residuals, CRC-8 of the header and CRC-16
of the frame. Of the subframes the smallest is written, a quantised predictor only where it saves a
sixteenth; of equal ones the simplest. The decoder also
reads linear predictors of any order, partitioned Rice residuals and parameters of 5 bits. All frames of a batch are
handled together: the encoder packs bits by position, and the decoder walks the Rice codes of all
seek points side by side, so one very long stream costs no more steps than many short ones.

Streams are stored as a table of media; reading gives PCM blocks, each of which begins at a seek
point and is decoded from there alone, and everything that is known of the samples comes from them.

Defined results: null and empty texts become one block of spaces; repeated rows give repeated
rows; an empty table gives an empty result; a damaged stream raises an error that names the
checksum; other columns are ignored. A text of any length is one stream in one task, at some 100
bytes of memory for each of its bytes while it is encoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import flat, slices
from .common import kept, small_batches, stash

BLOCK = 192
SEEK_FRAMES = 8
RATE = 8000
#: Bytes of samples worked on at once within a batch.
SLICE_BYTES = 1_000_000
#: Coefficients of the linear predictors that are written, their bits, and the right shift of a prediction.
LPC_ORDER, LPC_BITS, LPC_SHIFT = 2, 8, 6


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _table(0x07, 8).astype(np.uint8), _table(0x8005, 16).astype(np.uint16)
#: Leading zeros of 16-bit values.
_ZEROS = np.array([16, *(16 - int(i).bit_length() for i in range(1, 1 << 16))], np.int64)


def _right(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spans side by side, ending together; zeros in front. A checksum that starts from zero passes over those."""
    most = int(sizes.max(initial=0))
    at = ends[None, :] - most + np.arange(most)[:, None]
    return np.where(at >= (ends - sizes)[None, :], data[np.maximum(at, 0)], 0).astype(np.uint8)


def crc8(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(ends), np.uint8)
    for row in _right(data, ends, sizes):
        crc = _CRC8[crc ^ row]
    return crc


def crc16(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ends), np.uint16)
    for part in range(0, len(ends), 16384):
        crc = np.zeros(len(ends[part : part + 16384]), np.uint16)
        for row in _right(data, ends[part : part + 16384], sizes[part : part + 16384]):
            crc = (crc << np.uint16(8)) ^ _CRC16[(crc >> np.uint16(8)) ^ row]
        out[part : part + 16384] = crc
    return out


def _coded_number(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 form: up to 6 bytes each in columns, and how many."""
    size = 1 + (number >= 0x80) + (number >= 0x800) + (number >= 0x10000) + (number >= 0x200000) + (number >= 0x4000000)
    out = np.zeros((6, len(number)), np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])[size]
    for k in range(6):
        rest = np.maximum(0, size - 1 - k)
        bits = number >> (6 * rest)
        out[k] = np.where(k >= size, 0, np.where(k == 0, lead | bits, 0x80 | (bits & 0x3F)))
    return out, size


def linear_weights(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of the linear predictor of each column of samples, newest sample first."""
    f = x.astype(np.float32)
    r0, r1, r2 = (f * f).sum(0), (f[1:] * f[:-1]).sum(0), (f[2:] * f[:-2]).sum(0)
    det = r0 * r0 - r1 * r1
    safe = np.where(np.abs(det) > 1e-3, det, np.inf)
    found = np.stack([r1 * (r0 - r2) / safe, (r0 * r2 - r1 * r1) / safe])
    most = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(found * (1 << LPC_SHIFT)), -most, most - 1).astype(np.int32)


def rice(u: np.ndarray, order: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Rice parameter for each column of folded residuals, and the bits they take with it."""
    count = BLOCK - order
    coded = np.arange(BLOCK)[:, None] >= order[None, :]
    guess = np.clip(np.log2(np.maximum(1, cost / count * 0.7)).astype(np.int64), 0, 13)
    bits = [np.where(coded, u >> g, 0).sum(0) + count * (g + 1) for g in (guess, np.minimum(guess + 1, 14))]
    return np.where(bits[1] < bits[0], np.minimum(guess + 1, 14), guess), np.minimum(*bits)


def encode_frames(blocks: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of one frame per row of signed samples, and where each frame begins (one more than frames)."""
    n = len(blocks)
    x = blocks.T.astype(np.int32)  # sample by sample, so that steps over samples are contiguous
    fold = lambda r: (r << 1) ^ (r >> 31)
    row = np.arange(BLOCK)[:, None]
    # Fixed predictors of orders 0 to 2 are differences; the linear one solves its normal equations.
    order = np.zeros(n, np.int64)
    cost, residual, past = fold(x).sum(0), fold(x), x
    for o in (1, 2):
        past = np.concatenate([past[:1] * 0, np.diff(past, axis=0)])
        past[:o] = 0
        u = fold(past)
        c = u.sum(0)
        better = c < cost
        residual = np.where(better, u, residual)
        cost, order = np.where(better, c, cost), np.where(better, o, order)
    weights = linear_weights(x)
    guess = (weights[0] * x[1:-1] + weights[1] * x[:-2]) >> LPC_SHIFT
    u = np.concatenate([np.zeros((LPC_ORDER, n), np.int32), fold(x[LPC_ORDER:] - guess)])
    k, bits = rice(residual, order, cost)
    lpc_k, lpc_bits = rice(u, np.full(n, LPC_ORDER), u.sum(0))
    # Streams are compressed again where they are stored; small savings here cost more there.
    lpc = 16 * (lpc_bits + 9 + (LPC_BITS + 8) * LPC_ORDER) < 15 * (bits + 8 * order)
    residual, order, k = np.where(lpc, u, residual), np.where(lpc, LPC_ORDER, order), np.where(lpc, lpc_k, k)
    extra = np.where(lpc, 9 + LPC_ORDER * LPC_BITS, 0)
    payload = np.where(lpc, lpc_bits, bits) + 8 * order + 10 + extra
    constant = (x == x[:1]).all(0)
    verbatim = ~constant & (payload >= 8 * BLOCK)
    plain = constant | verbatim
    payload = np.where(constant, 8, np.where(verbatim, 8 * BLOCK, payload))
    numbers, size = _coded_number(number)
    head = 5 + size
    length = head + 1 + (payload + 7) // 8 + 2
    begin = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(begin[-1], np.uint8)
    at = begin[:-1]
    # Header: sync and fixed block size; 192 samples at 8 kHz; mono, 8 bits.
    for i, b in enumerate((0xFF, 0xF8, 0x14, 0x02)):
        out[at + i] = b
    for i in range(6):
        has = size > i
        out[at[has] + 4 + i] = numbers[i][has]
    out[at + head - 1] = crc8(out, at + head - 1, head - 1)
    out[at + head] = np.where(constant, 0, np.where(verbatim, 2, np.where(lpc, (31 + order) << 1, (8 + order) << 1)))
    body = at + head + 1
    out[body[constant]] = (x[0, constant] & 255).astype(np.uint8)
    if verbatim.any():
        out[body[verbatim][None, :] + row] = (x[:, verbatim] & 255).astype(np.uint8)
    warm = ~plain & (order > 0)
    out[body[warm]] = (x[0, warm] & 255).astype(np.uint8)
    warm = ~plain & (order > 1)
    out[body[warm] + 1] = (x[1, warm] & 255).astype(np.uint8)
    coded_frames = np.flatnonzero(~plain)
    if len(coded_frames):
        o, kk = order[coded_frames], k[coded_frames]
        start = (body[coded_frames] + o) * 8
        own = lpc[coded_frames]
        if own.any():
            # Four bits of precision less one, five of the shift, then the coefficients.
            code = np.int64(LPC_BITS - 1) << 5 | LPC_SHIFT
            for i in range(LPC_ORDER):
                code = code << LPC_BITS | (weights[i][coded_frames[own]].astype(np.int64) & ((1 << LPC_BITS) - 1))
            wide = 9 + LPC_ORDER * LPC_BITS
            code = code << (-wide % 8)
            for i in range((wide + 7) // 8):
                out[(start[own] >> 3) + i] |= (code >> (8 * ((wide + 7) // 8 - 1 - i)) & 255).astype(np.uint8)
            start = start + np.where(own, wide, 0)
        # Coding method 0 and partition order 0 are six zero bits; then the parameter's four bits.
        code = kk << (14 - (start & 7))
        for i, shift in enumerate((16, 8, 0)):
            out[(start >> 3) + i] |= (code >> shift & 255).astype(np.uint8)
        u = residual[:, coded_frames].astype(np.int64)
        coded = row >= o[None, :]
        width = np.where(coded, (u >> kk) + 1 + kk, 0)
        end = start[None, :] + 10 + np.cumsum(width, axis=0)
        value = ((1 << kk) | (u & ((1 << kk) - 1))) << (7 - ((end - 1) & 7))
        value, last = value[coded], ((end - 1) >> 3)[coded]
        for shift in (0, 8, 16):
            part = value >> shift & 255
            has = np.flatnonzero(part)
            if len(has):
                out += np.bincount(last[has] - shift // 8, part[has], len(out)).astype(np.uint8)
    tail = begin[1:]
    crc = crc16(out, tail - 2, length - 2)
    out[tail - 2], out[tail - 1] = crc >> 8, crc & 255
    return out, begin


def encode(payloads: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for each payload; every payload is a positive multiple of BLOCK bytes."""
    frames = np.diff(offsets) // BLOCK
    number = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
    data, begin = encode_frames(payloads.reshape(-1, BLOCK).astype(np.int16) - 128, number)
    raw, out, f = data.tobytes(), [], 0
    sizes = np.diff(begin)
    for i, n in enumerate(frames.tolist()):
        own = sizes[f : f + n]
        samples = (payloads[offsets[i] : offsets[i + 1]] - np.uint8(128)).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(samples).digest()
        points = b"".join(struct.pack(">QQH", j * BLOCK, int(begin[f + j] - begin[f]), BLOCK) for j in range(0, n, SEEK_FRAMES))
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[begin[f] : begin[f + n]])
        f += n
    return out


def read_head(stream: bytes) -> tuple[int, bytes, int, list[tuple[int, int]]]:
    """Samples, MD5, where the frames begin, and (first sample, offset) of the seek points."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", [(0, 0)]
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body, last, at = stream[at + 4 : at + 4 + size], bool(kind & 128), at + 4 + size
        if kind & 127 == 0:
            rest = int.from_bytes(body[10:18], "big")
            if rest >> 36 & 31 != 7 or rest >> 41 & 7 or body[:2] != body[2:4] or body[:2] != struct.pack(">H", BLOCK):
                raise ValueError("only mono streams of 8 bits in blocks of 192 samples are read")
            total, md5 = rest & ((1 << 36) - 1), body[18:34]
        elif kind & 127 == 3:
            points = [p[:2] for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
    return total, md5, at, points


def decode_frames(data: np.ndarray, at: np.ndarray, count: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Signed samples of `count` successive frames from each byte position `at`, as rows, run by run.

    number: of the first frame of each run. Checks sync, numbers and both checksums of every frame.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.zeros(len(data) + 8, np.uint64)
    for i in range(8):
        window |= padded[i : i + len(window)].astype(np.uint64) << np.uint64(56 - 8 * i)
    peek = lambda pos: window[pos >> 3] << (pos & 7).astype(np.uint64)
    row_of = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), BLOCK), np.int16)
    begins, ends = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    pos = at.astype(np.int64).copy()
    for turn in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > turn)
        p, rows = pos[live], row_of[live] + turn
        numbers, size = _coded_number(number[live] + turn)
        good = (data[p] == 0xFF) & (data[p + 1] == 0xF8) & (data[p + 2] == 0x14) & (data[p + 3] == 0x02)
        for i in range(6):
            good &= (size <= i) | (padded[p + 4 + i] == numbers[i])
        head = 4 + size
        if not (good & (crc8(padded, p + head, head) == padded[p + head])).all():
            raise ValueError("a FLAC frame header or its CRC-8 is wrong")
        kind = data[p + head + 1] >> 1
        bit = (p + head + 2) * 8
        n = len(live)
        x = np.zeros((BLOCK, n), np.int32)
        flat_kind, raw_kind = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        signed = lambda b: b.astype(np.int8).astype(np.int32)
        x[:, flat_kind] = signed(data[bit[flat_kind] >> 3])
        bit[flat_kind] += 8
        if len(raw_kind):
            x[:, raw_kind] = signed(data[(bit[raw_kind] >> 3)[None, :] + np.arange(BLOCK)[:, None]])
            bit[raw_kind] += 8 * BLOCK
        lpc = kind >= 32
        fixed = (kind >= 8) & (kind <= 12)
        if not (lpc | fixed | (kind < 2)).all():
            raise ValueError("a FLAC subframe type is not known")
        coded = np.flatnonzero(lpc | fixed)
        if len(coded):
            order = np.where(lpc, kind.astype(np.int64) - 31, kind.astype(np.int64) - 8)[coded]
            b = bit[coded]
            for i in range(int(order.max())):
                has = order > i
                x[i, coded[has]] = signed(data[(b[has] >> 3) + i])
            b += 8 * order
            weights = shifts = None
            if lpc.any():
                own = lpc[coded]
                precision = np.where(own, (peek(b) >> np.uint64(60)).astype(np.int64) + 1, 0)
                shifts = np.where(own, (peek(b + 4) >> np.uint64(59)).astype(np.int64), 0)
                b += np.where(own, 9, 0)
                weights = np.zeros((32, len(coded)), np.int64)
                for i in range(int(order.max())):
                    has = own & (order > i)
                    got = (peek(b) >> np.uint64(49)).astype(np.int64) >> np.maximum(0, 15 - precision)
                    weights[i] = np.where(has, got - ((got >> np.maximum(0, precision - 1) & 1) << precision), 0)
                    b += np.where(has, precision, 0)
            top = (peek(b) >> np.uint64(58)).astype(np.int64)
            if (top >> 5).any():
                raise ValueError("a FLAC residual's coding method is not known")
            # Method 0 has parameters of four bits, method 1 of five; each part of the block has its own.
            wide, parts = 4 + (top >> 4), BLOCK >> (top & 15)
            if (parts << (top & 15) != BLOCK).any() or (parts < order).any():
                raise ValueError("a FLAC residual's parts do not fit its block")
            b += 6
            k = low = None
            single = (parts == BLOCK).all()
            u = np.zeros((BLOCK, len(coded)), np.int64)
            for i in range(BLOCK):
                if i == 0 or not single:
                    fresh = np.ones(len(coded), bool) if i == 0 else i % parts == 0
                    if fresh.any():
                        got = (peek(b) >> (64 - wide).astype(np.uint64)).astype(np.int64)
                        k = got if k is None else np.where(fresh, got, k)
                        if (fresh & (k == (1 << wide) - 1)).any():
                            raise ValueError("escaped FLAC residuals are not read")
                        b += np.where(fresh, wide, 0)
                        low = (63 - k).astype(np.uint64)
                w = window[b >> 3] << (b & 7).astype(np.uint64)
                q = _ZEROS[w >> np.uint64(48)]
                if (q == 16).any():
                    far, more = np.flatnonzero(q == 16), 16
                    while len(far):
                        z = _ZEROS[peek(b[far] + more) >> np.uint64(48)]
                        q[far] = more + z
                        far, more = far[z == 16], more + 16
                        if more > 1 << 15:
                            raise ValueError("a FLAC residual is too long")
                    w = peek(b + q) << np.uint64(1)
                    rest = w >> np.uint64(1) >> low
                else:
                    rest = w << (q + 1).astype(np.uint64) >> np.uint64(1) >> low
                step = q + 1 + k
                if i < 32 and (skip := order > i).any():
                    step[skip] = 0
                    q[skip] = 0
                    rest[skip] = 0
                u[i] = q << k | rest.astype(np.int64)
                b += step
            bit[coded] = b
            r = ((u >> 1) ^ -(u & 1)).astype(np.int32)
            for o in range(int(order.max()) + 1):
                own = np.flatnonzero((order == o) & ~lpc[coded])
                if len(own):
                    part = r[:, own]
                    # Differences of the first samples take the place of the missing residuals; then sum up o times.
                    warm = x[:o, coded[own]]
                    for j in range(o):
                        part[j] = np.diff(warm, n=j, axis=0)[0]
                    for j in range(o - 1, -1, -1):
                        part[j:] = np.cumsum(part[j:], axis=0)
                    x[:, coded[own]] = part
            if weights is not None:
                own = np.flatnonzero(lpc[coded])
                mine, depth, part = order[own], int(order[own].max()), r[:, own]
                w, down = weights[:depth, own].astype(np.int32), shifts[own].astype(np.int32)
                past = x[:, coded[own]]
                for i in range(int(mine.min()), BLOCK):
                    guess = sum(w[j] * past[i - 1 - j] for j in range(min(i, depth)))
                    value = part[i] + (guess >> down)
                    past[i] = value if i >= depth else np.where(mine <= i, value, past[i])
                x[:, coded[own]] = past
        stop = (bit + 7) // 8
        out[rows] = x.T
        begins[rows], ends[rows] = p, stop
        pos[live] = stop + 2
    crc = crc16(padded, ends, ends - begins)
    if (crc != (padded[ends].astype(np.uint16) << np.uint16(8) | padded[ends + 1])).any():
        raise ValueError("a FLAC frame's CRC-16 is wrong")
    return out


def pad(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payloads (texts with spaces up to a positive multiple of BLOCK), their offsets, and the sizes before."""
    data, offsets = flat(texts)
    size = np.diff(offsets)
    ends = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // BLOCK)) * BLOCK)])
    out = np.full(ends[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(ends[:-1] - offsets[:-1], size)] = data
    return out, ends, size


def encode_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a FLAC stream."""

    def run(batches):
        kept("op8")
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                payloads, offsets, size = pad(batch.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "media": pa.array(encode(payloads, offsets), pa.binary())})

    source = documents.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def pcm_runs(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks (first sample, unsigned samples), each decoded from a seek point alone."""
    runs, heads, base = [], [], 0
    for stream in streams:
        total, md5, start, points = read_head(stream)
        heads.append((total, md5, [p[0] for p in points]))
        stops = [p[0] for p in points[1:]] + [total]
        runs += [(base + start + offset, (stop - first) // BLOCK, first // BLOCK) for (first, offset), stop in zip(points, stops)]
        base += len(stream)
    at, count, number = (np.array(c, np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    samples = decode_frames(np.frombuffer(b"".join(streams), np.uint8), at, count, number)
    raw, unsigned, out, done = samples.astype(np.int8).tobytes(), (samples + 128).astype(np.uint8).tobytes(), [], 0
    for total, md5, firsts in heads:
        if hashlib.md5(raw[done : done + total]).digest() != md5:
            raise ValueError("the MD5 of a FLAC stream's samples is wrong")
        out.append([(a, unsigned[done + a : done + b]) for a, b in zip(firsts, [*firsts[1:], total])])
        done += total
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The samples of each stream as unsigned bytes."""
    return [b"".join(pcm for _, pcm in blocks) for blocks in pcm_runs(streams)]


class Feature:
    """Length, mean, mean square, sign changes around 64 and largest step of samples that come block by block."""

    def __init__(self):
        self.n = self.total = self.square = self.crossings = self.step = 0
        self.last = None

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.uint8).astype(np.int64)
        joined = x if self.last is None else np.concatenate([[self.last], x])
        up = joined >= 64
        self.n, self.total, self.square = self.n + len(x), self.total + int(x.sum()), self.square + int((x * x).sum())
        self.crossings += int((up[1:] != up[:-1]).sum())
        self.step, self.last = max(self.step, int(np.abs(np.diff(joined)).max(initial=0))), x[-1]

    def __str__(self) -> str:
        return f"n={self.n};mean={self.total / self.n:.6f};square={self.square / self.n:.6f};crossings={self.crossings};step={self.step}"


def describe(media: DataFrame) -> DataFrame:
    """Reads the PCM blocks of each stream, checks all sums, and describes the samples."""

    def run(batches):
        kept("op8")
        for whole in batches:
            for batch in slices(whole, "media", SLICE_BYTES):
                streams = batch.column("media").to_pylist()
                rows = []
                for blocks in pcm_runs(streams):
                    digest, feature, tail = hashlib.sha256(), Feature(), b""
                    for first, pcm in blocks:
                        if first != feature.n:
                            raise ValueError("PCM blocks do not follow each other")
                        digest.update(pcm)
                        feature.add(pcm)
                        tail = pcm[-16:]
                    rows.append((feature.n, digest.hexdigest(), zlib.crc32(tail), str(feature)))
                n, digests, tails, features = zip(*rows) if rows else ((),) * 4
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": batch.column("n_bytes"),
                    "payload_bytes": pa.array(n, pa.int64()),
                    "payload_sha256": pa.array(digests, pa.string()),
                    "tail_crc32": pa.array(tails, pa.int64()),
                    "media_bytes": pa.array(map(len, streams), pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
                    "feature": pa.array(features, pa.string()),
                })

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, first_sample, pcm: decoded samples in blocks that can be looked up by their first sample."""

    def run(batches):
        kept("op8")
        for whole in batches:
            for batch in slices(whole, "media", SLICE_BYTES):
                rows = [(d, first, pcm) for d, blocks in zip(batch.column("doc_id").to_pylist(), pcm_runs(batch.column("media").to_pylist())) for first, pcm in blocks]
                ids, first, pcm = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, batch.column("doc_id").type), "first_sample": pa.array(first, pa.int64()), "pcm": pa.array(pcm, pa.binary())})

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, first_sample long, pcm binary")


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    # The streams are stored, compressed once more by the file format, and read back.
    return describe(stash(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), "zstd"))
