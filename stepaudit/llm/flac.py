"""Media columns: FLAC streams written and read by numpy, many frames at a time.

Reading decodes constant, verbatim, fixed and linear-predictor subframes with Rice residuals
(both methods, any partition order, escapes) of one channel. Frames are found by their sync codes
and header checksums, checked by their own checksums and the stream's MD5, and decoded in step: the
j-th sample of all frames at once. Writing takes, for each frame of 192 samples, the shortest of a
constant, a verbatim, a fixed and a fourth-order linear-predictor subframe.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepaudit.llm.arrow import flat, pieces

BLOCK = 192
ORDER = 4
PRECISION = 12
RATE = 8000
#: Samples in a PCM block of :func:`pcm_blocks`.
PCM_BLOCK = 4096
#: Bytes of text that are coded at once.
CHUNK = 1 << 19


def _crc_table(poly: int, width: int) -> np.ndarray:
    c = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        c = np.where(c >> (width - 1) & 1, (c << 1) ^ poly, c << 1) & ((1 << width) - 1)
    return c


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc16(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Checksums of the ranges [start, stop) of ``data``, a byte of each at a time."""
    order = np.argsort(start - stop, kind="stable")  # longest first
    a, size = start[order], (stop - start)[order]
    crc = np.zeros(len(a), np.int64)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for j, n in enumerate(live):
        c = crc[:n]
        crc[:n] = (c << 8 & 0xFFFF) ^ _CRC16[(c >> 8) ^ data[a[:n] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized fourth-order coefficients and shifts of each row, by the Levinson recursion."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : f.shape[1] - k]).sum(1) for k in range(ORDER + 1)], 1)
    err, a = r[:, 0] + 1e-9, np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, i - 1 :: -1][:, :i] if i else 0
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(top)), 0, 15).astype(np.int64)
    lim = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * 2.0 ** shift[:, None]), -lim, lim - 1).astype(np.int64), shift


def _rice(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row of zigzag residuals, and its bits."""
    z = z.astype(np.int32)  # residuals of 8-bit samples
    bits = np.stack([(z >> k).sum(1) + z.shape[1] * (k + 1) for k in range(11)], 1)
    k = bits.argmin(1)
    return k, bits[np.arange(len(z)), k]


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 63)


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of rows of BLOCK 8-bit samples: their bytes, one after another, and n + 1 offsets."""
    n = len(x)
    x = x.astype(np.int64)
    coef, shift = _predictors(x)
    guess = sum(coef[:, [i]] * x[:, ORDER - 1 - i : BLOCK - 1 - i] for i in range(ORDER)) >> shift[:, None]
    z0, z4 = _zigzag(x), _zigzag(x[:, ORDER:] - guess)
    k0, b0 = _rice(z0)
    k4, b4 = _rice(z4)
    same = (x == x[:, :1]).all(1)
    cost = np.stack([np.where(same, 8, 1 << 30), np.full(n, 8 * BLOCK), b0 + 10, b4 + 10 + 8 * ORDER + 9 + PRECISION * ORDER], 1)
    kind = cost.argmin(1)  # constant, verbatim, fixed order 0, linear predictor
    const, verb, lpc = kind == 0, kind == 1, kind == 3
    k, rice = np.where(lpc, k4, k0), kind >= 2

    head, u = 4, np.zeros((n, 4), np.int64)
    ulen = 1 + (number >= 0x80) + (number >= 0x800) + (number >= 0x10000)
    for m, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        w = ulen == m
        for i in range(m):
            u[w, i] = (number[w] >> (6 * (m - 1 - i)) & 0x3F | 0x80) if i else (lead | number[w] >> (6 * (m - 1)))
    value, size = np.zeros((n, 24 + BLOCK), np.int64), np.zeros((n, 24 + BLOCK), np.int64)
    value[:, :head], size[:, :head] = (0xFF, 0xF8, 0x14, 0x02), 8
    value[:, 4:8], size[:, 4:8] = u, 8 * (np.arange(4) < ulen[:, None])
    crc = np.zeros(n, np.int64)
    for i in range(8):
        crc = np.where(size[:, i] > 0, _CRC8[crc ^ value[:, i]], crc)
    value[:, 8], size[:, 8] = crc, 8
    value[:, 9], size[:, 9] = np.array([0x00, 0x02, 0x10, (32 + ORDER - 1) << 1])[kind], 8
    for i in range(ORDER):
        value[:, 10 + i], size[:, 10 + i] = x[:, i] & 0xFF, 8 * lpc
        value[:, 16 + i], size[:, 16 + i] = coef[:, i] & ((1 << PRECISION) - 1), PRECISION * lpc
    value[:, 14], size[:, 14] = PRECISION - 1, 4 * lpc
    value[:, 15], size[:, 15] = shift, 5 * lpc
    value[:, 20], size[:, 20] = k, 10 * rice  # method 0, partition order 0, parameter
    z = z0.copy()
    z[lpc, ORDER:] = z4[lpc]
    body, bsize = value[:, 24:], size[:, 24:]
    body[:] = np.where(verb[:, None], x & 0xFF, (1 << k[:, None]) | (z & ((1 << k[:, None]) - 1)))
    bsize[:] = np.where(verb[:, None], 8, (z >> k[:, None]) + 1 + k[:, None])
    bsize[lpc, :ORDER] = 0
    body[const, 0], bsize[const, 0], bsize[const, 1:] = x[const, 0] & 0xFF, 8, 0

    ends = np.cumsum(size, 1)
    whole = (ends[:, -1] + 7) // 8 + 2
    offsets = np.concatenate([[0], np.cumsum(whole)])
    bits = np.zeros(int(offsets[-1]) * 8, np.uint8)
    ends += offsets[:-1, None] * 8
    live = size > 0
    v, e = value[live], ends[live]
    for b in range(int(v.max(initial=1)).bit_length()):
        bits[e[(v >> b & 1).astype(bool)] - 1 - b] = 1
    data = np.packbits(bits)
    c = crc16(data, offsets[:-1], offsets[1:] - 2)
    data[offsets[1:] - 2], data[offsets[1:] - 1] = c >> 8, c & 0xFF
    return data, offsets


def stream_head(samples: bytes, frames: np.ndarray, n: int) -> bytes:
    """Marker and stream description: ``samples`` as signed bytes, sizes of ``frames``, n samples."""
    low, high = (int(frames.min()), int(frames.max())) if len(frames) else (0, 0)
    packed = (RATE << 44) | (0 << 41) | (7 << 36) | n
    body = BLOCK.to_bytes(2) * 2 + low.to_bytes(3) + high.to_bytes(3) + packed.to_bytes(8) + hashlib.md5(samples).digest()
    return b"fLaC" + bytes([0x80]) + len(body).to_bytes(3) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload; its length must be a positive multiple of BLOCK."""
    frames = np.array([len(p) // BLOCK for p in payloads])
    raw = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    ends = np.concatenate([[0], np.cumsum(frames)])
    data, at = encode_frames(raw.reshape(-1, BLOCK), np.arange(ends[-1]) - np.repeat(ends[:-1], frames))
    out, sizes, joined = [], np.diff(at), data.tobytes()
    for i, p in enumerate(payloads):
        a, b = ends[i], ends[i + 1]
        out.append(stream_head(raw[a * BLOCK : b * BLOCK].tobytes(), sizes[a:b], len(p)) + joined[at[a] : at[b]])
    return out


_BLOCKS = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_RATE_BYTES = {12: 1, 13: 2, 14: 2}


def _header(d: bytes, i: int, bps: int) -> tuple[int, int, int, int] | None:
    """(number, block size, bits, header length) of a frame that begins at i, or None."""
    if i + 6 > len(d):
        return None
    code, rate, channel, bits = d[i + 2] >> 4, d[i + 2] & 15, d[i + 3] >> 4, d[i + 3] >> 1 & 7
    if code == 0 or rate == 15 or channel or bits in (3, 7) or d[i + 3] & 1:
        return None
    first = d[i + 4]
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    if first >= 0x80 and not 1 <= more <= 6:
        return None
    number, j = (first, i + 5) if not more else (first & (0x3F >> more), i + 5)
    for _ in range(more):
        if j >= len(d) or d[j] >> 6 != 2:
            return None
        number, j = number << 6 | d[j] & 0x3F, j + 1
    block = _BLOCKS.get(code, 0)
    if code in (6, 7):
        block, j = int.from_bytes(d[j : j + code - 5]) + 1, j + code - 5
    j += _RATE_BYTES.get(rate, 0)
    if j >= len(d):
        return None
    crc = 0
    for b in d[i:j]:
        crc = _CRC8_LIST[crc ^ b]
    return (number, block, _BITS.get(bits, bps), j + 1 - i) if crc == d[j] else None


def _frames(d: bytes, strict: bool = False) -> tuple[list[tuple[int, int, int, int, int]], bytes, int]:
    """(start, stop, body, block size, bits) of a stream's frames, its MD5 and its number of samples.

    ``strict`` also asks that a frame's checksum holds where the next is taken to begin, which
    tells a chance sync code within a frame from a true one.
    """
    if d[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    i, info = 4, b""
    while True:
        if i + 4 > len(d):
            raise ValueError("the metadata is cut off")
        last, kind, size = d[i] >> 7, d[i] & 0x7F, int.from_bytes(d[i + 1 : i + 4])
        if kind == 0:
            info = d[i + 4 : i + 4 + size]
        i += 4 + size
        if last:
            break
    packed = int.from_bytes(info[10:18])
    bps, total, step = (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), int.from_bytes(info[:2])
    if packed >> 41 & 7:
        raise ValueError("more than one channel")
    found, at, count, samples = [], d.find(b"\xff", i), 0, 0
    while 0 <= at < len(d) - 5:
        if d[at + 1] in (0xF8, 0xF9) and (h := _header(d, at, bps)) and h[0] == (samples if d[at + 1] & 1 else count):
            if found and (found[-1][2] + 2 > at or (strict and not _sealed(d, found[-1][0], at))):
                at = d.find(b"\xff", at + 1)
                continue
            if not found and at != i:
                raise ValueError("the first frame is not where it belongs")
            found.append([at, len(d), at + h[3], h[1], h[2]])
            if len(found) > 1:
                found[-2][1] = at
            count, samples = count + 1, samples + h[1]
            at += 4
        at = d.find(b"\xff", at + 1)
    if samples != total or step == 0:
        raise ValueError(f"{samples} samples found, {total} expected")
    return [tuple(f) for f in found], info[18:34], total


def _sealed(d: bytes, start: int, stop: int) -> bool:
    """Whether the last two bytes of [start, stop) are the checksum of those before."""
    part = np.frombuffer(d, np.uint8)[start:stop]
    return int(crc16(part, np.array([0]), np.array([len(part) - 2]))[0]) == int.from_bytes(d[stop - 2 : stop])


class _Bits:
    """Reads at many bit positions at once; all positions are in ``at``."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        w = padded.astype(np.uint64)
        self.word = sum(w[i : len(data) + 8 + i] << np.uint64(8 * (7 - i)) for i in range(8))
        spots = np.flatnonzero(np.unpackbits(padded))
        self.spots, self.end = spots, len(padded) * 8
        count = np.zeros(self.end + 1, np.int32)
        count[spots + 1] = 1
        self.rank = np.cumsum(count, dtype=np.int32)

    def take(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The n bits (0 to 56) at each position, as a number."""
        n = np.broadcast_to(np.asarray(n, np.uint64), at.shape)
        x = self.word[at >> 3] << (at & 7).astype(np.uint64)
        return np.where(n > 0, x >> (np.uint64(64) - np.maximum(n, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def one(self, at: np.ndarray) -> np.ndarray:
        """The first set bit at or after each position."""
        k = self.rank[at]
        if (k >= len(self.spots)).any():
            raise ValueError("a residual runs past the data")
        return self.spots[k]


def _signed(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    n = np.asarray(n, np.int64)
    return np.where(n > 0, x - ((x >> np.maximum(n - 1, 0) & 1) << n), 0)


_FIXED = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)]


def decode_frames(data: np.ndarray, frames: np.ndarray) -> list[np.ndarray]:
    """Samples of frames (start, stop, body, block size, bits), after a check of their checksums."""
    start, stop, body, block, bits = (np.ascontiguousarray(c) for c in frames.T)
    want = data[stop - 2].astype(np.int64) << 8 | data[stop - 1]
    if (crc16(data, start, stop - 2) != want).any():
        raise ValueError("a frame's checksum is wrong")
    r, at, f = _Bits(data), body * 8, len(frames)
    head = r.take(at, 8)
    kind, waste = head >> 1 & 63, np.zeros(f, np.int64)
    at = at + 8
    if (w := (head & 1).astype(bool)).any():
        one = r.one(at[w])
        waste[w], at[w] = one - at[w] + 1, one + 1
    depth = bits - waste
    const, verb, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (const | verb | fixed | lpc).all():
        raise ValueError("a reserved subframe type")
    order = np.where(verb, block, np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0)))
    size = int(block.max(initial=0))
    width = int(order[~verb].max(initial=0))
    out, coef, shift = np.zeros((f, width + size), np.int64), np.zeros((f, max(width, 1)), np.int64), np.zeros(f, np.int64)
    warm = int(order.max(initial=0))
    for j in range(warm):  # warm-up samples and verbatim ones
        m = np.flatnonzero(order > j)
        out[m, width + j] = _signed(r.take(at[m], depth[m]), depth[m])
        at[m] += depth[m]
    if const.any():
        m = np.flatnonzero(const)
        out[m, width:] = _signed(r.take(at[m], depth[m]), depth[m])[:, None]
    for o in range(1, 5):
        coef[np.ix_(fixed & (order == o), range(o))] = _FIXED[o]
    if lpc.any():
        m = np.flatnonzero(lpc)
        precision = r.take(at[m], 4) + 1
        shift[m] = _signed(r.take(at[m] + 4, 5), 5)
        at[m] += 9
        for i in range(int(order[m].max())):
            h = order[m] > i
            coef[m[h], i] = _signed(r.take(at[m[h]], precision[h]), precision[h])
            at[m[h]] += precision[h]
    rows = np.flatnonzero(fixed | lpc)
    if len(rows):
        at, order, block, depth, coef, shift = at[rows], order[rows], block[rows], depth[rows], coef[rows], shift[rows]
        wide = 4 + (r.take(at, 2) == 1)
        parts = 1 << r.take(at + 2, 4)
        at += 6
        left, k, raw = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        first = np.ones(len(rows), bool)
        for j in range(int(order.min()), size):
            on = (j >= order) & (j < block)
            new = on & (left == 0)
            if new.any():
                k[new] = r.take(at[new], wide[new])
                at[new] += wide[new]
                esc = new & (k == (1 << wide) - 1)
                raw[new] = -1
                if esc.any():
                    raw[esc] = r.take(at[esc], 5)
                    at[esc] += 5
                left[new] = block[new] // parts[new] - np.where(first[new], order[new], 0)
                first &= ~new
            every = bool(on.all())
            a = at if every else at[on]
            plain = raw < 0
            kk, g = (k, raw) if every else (k[on], raw[on])
            if plain.all():
                one = r.one(a)
                z = (one - a) << kk | r.take(one + 1, kk)
                e, a = (z >> 1) ^ -(z & 1), one + 1 + kk
            else:
                p = g < 0
                e = np.zeros(len(a), np.int64)
                one = r.one(a[p])
                z = (one - a[p]) << kk[p] | r.take(one + 1, kk[p])
                e[p] = (z >> 1) ^ -(z & 1)
                e[~p] = _signed(r.take(a[~p], g[~p]), g[~p])
                a = a + g
                a[p] = one + 1 + kk[p]
            who = rows if every else rows[on]
            c = coef if every else coef[on]
            guess = (out[who, width + j - width : width + j][:, ::-1] * c[:, :width]).sum(1) if width else 0
            out[who, width + j] = e + (guess >> (shift if every else shift[on]) if width else 0)
            if every:
                at, left = a, left - 1
            else:
                at[on] = a
                left[on] -= 1
    return [row[width : width + n] << s for row, n, s in zip(out, frames[:, 3], waste, strict=True)]


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream, checked against its frames' checksums and its MD5."""
    try:
        return _decode(streams, False)
    except ValueError:  # a chance sync code, or damage
        return _decode(streams, True)


def _decode(streams: list[bytes], strict: bool) -> list[np.ndarray]:
    parsed, base, rows = [_frames(s, strict) for s in streams], 0, []
    for s, (found, _, _) in zip(streams, parsed, strict=True):
        rows += [(a + base, b + base, c + base, n, w) for a, b, c, n, w in found]
        base += len(s)
    data = np.frombuffer(b"".join(streams), np.uint8)
    made = iter(decode_frames(data, np.array(rows, np.int64)) if rows else [])
    out = []
    for found, md5, _ in parsed:
        x = np.concatenate([next(made) for _ in found]) if found else np.zeros(0, np.int64)
        width = (found[0][4] + 7) // 8 if found else 1
        raw = x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        if md5 != bytes(16) and hashlib.md5(raw).digest() != md5:
            raise ValueError("the samples' digest is wrong")
        out.append(x)
    return out


def _payload(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        raw = data.tobytes()
        for i, j in pieces(offsets, CHUNK):
            streams = encode([_payload(raw[offsets[d] : offsets[d + 1]]) for d in range(i, j)])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(offsets[i : j + 1])), pa.array(streams, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text, padded with spaces to blocks, as a FLAC stream.

    Defined cases: those of :func:`digests`; equal texts give equal streams; no rows give none.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(_media, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, list[bytes], list[np.ndarray]]]:
    for batch in batches:
        media = batch.column(batch.num_columns - 1)
        offsets = np.concatenate([[0], np.cumsum([len(m.as_buffer()) for m in media])])
        for i, j in pieces(offsets, CHUNK):
            streams = media[i:j].to_pylist()
            yield batch, i, j, streams, decode(streams)


def _pcm(x: np.ndarray, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """Offsets in samples, and blocks of at most PCM_BLOCK of them; an empty stream has none."""
    x = x.astype(kind)
    for at in range(0, len(x), PCM_BLOCK):
        yield at, x[at : at + PCM_BLOCK]


def feature(blocks: list[np.ndarray]) -> str:
    """Energy, peak and sign changes of a stream of PCM blocks, as whole numbers."""
    energy = peak = crossings = 0
    last = None
    for b in blocks:
        w, low = b.astype(np.int64), b < 0
        energy, peak = energy + int((w * w).sum()), max(peak, int(np.abs(w).max(initial=0)))
        crossings += int((low[1:] != low[:-1]).sum()) + int(last is not None and last != low[0])
        last = low[-1]
    return f"energy={energy};peak={peak};crossings={crossings}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, j, streams, samples in _read(batches):
        rows = []
        for x in samples:
            blocks = [b for _, b in _pcm(x, "i1")]
            payload = b"".join((b.view(np.uint8) ^ 0x80).tobytes() for b in blocks)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature(blocks)))
        size, sha, crc, seen = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0)[i:j], "n_bytes": batch.column(1)[i:j],
                "payload_bytes": pa.array(size, pa.int64()), "payload_sha256": pa.array(sha, pa.string()), "tail_crc32": pa.array(crc, pa.int64()),
                "media_bytes": pa.array([len(s) for s in streams], pa.int64()), "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
                "feature": pa.array(seen, pa.string()),
            }
        )


def digests(media: DataFrame) -> DataFrame:
    """What the stored streams of :func:`to_media` hold when they are read back in PCM blocks.

    Defined cases: a null text is an empty one, whose payload is one block of spaces; rows that
    repeat an id each give a row; a null id stays null; a damaged stream raises.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, j, _, samples in _read(batches):
        for d, x in zip(range(i, j), samples, strict=True):
            cut = list(_pcm(x, "<i4"))
            at, parts = [a for a, _ in cut], [b for _, b in cut]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([batch.column(0)[d].as_py()] * len(at), pa.int64()), "sample_offset": pa.array(at, pa.int64()),
                    "n_samples": pa.array([len(p) for p in parts], pa.int64()), "pcm": pa.array([p.tobytes() for p in parts], pa.binary()),
                }
            )


def pcm_blocks(media: DataFrame) -> DataFrame:
    """``doc_id, sample_offset, n_samples, pcm``: blocks of 32-bit little-endian samples, to be sought by offset.

    Defined cases: a null stream and one without samples have no blocks; rows that repeat an id each give
    their blocks; a null id stays null; a damaged stream raises.
    """
    return media.select("doc_id", "media").where("media IS NOT NULL").mapInArrow(_cut, "doc_id long, sample_offset long, n_samples long, pcm binary")
