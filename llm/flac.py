"""Media columns: FLAC streams of 8-bit mono samples, coded and decoded in numpy.

All frames of a batch advance together: step s reads or predicts sample s of
every frame at once. Subframes are fixed predictors of order 0 to 4 or
quantised linear predictors, with Rice coded residuals; the decoder also
reads constant and verbatim subframes and partitioned residuals. Frame
headers' CRC-8, frames' CRC-16 and the stream's MD5 are verified. Each frame
holds BLOCK samples, so sample offset = BLOCK x frame; byte offsets found on
decoding make the PCM blocks seekable.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import base, documents, pieces

BLOCK = 576
RATE = 8000
LPC_ORDER, LPC_PRECISION = 4, 10
MAX_FIXED = 2  # the highest fixed order that the coder tries; the decoder reads all
MAX_K = 14
BATCH_FRAMES = 4096


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[start : start + length] for all frames at once; the longest go last so that each step works on a suffix."""
    order = np.argsort(length, kind="stable")
    s, n, crc = start[order], length[order], np.zeros(len(start), np.uint32)
    done = np.searchsorted(n, np.arange(int(n[-1]) if len(n) else 0), side="right")
    table, mask = (CRC8, 0xFF) if bits == 8 else (CRC16, 0xFFFF)
    for i, d in enumerate(done.tolist()):
        c = crc[d:]
        crc[d:] = ((c << np.uint32(8)) & np.uint32(mask)) ^ table[(c >> np.uint32(bits - 8)) ^ data[s[d:] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead = 0x3F >> len(tail)
        if n <= lead:
            return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


def _residuals(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Residuals of the fixed predictors of order 0 to ``most``; the first ones of each are unused."""
    out = [x]
    for _ in range(most):
        d = np.zeros_like(x)
        np.subtract(out[-1][:, 1:], out[-1][:, :-1], out=d[:, 1:])
        out.append(d)
    return out


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x LPC_ORDER) and shifts, by Levinson-Durbin for all frames at once."""
    # a window of whole numbers: the sums are exact, so equal frames get equal predictors in any batch
    f = x.astype(np.float64) * np.rint(np.hanning(BLOCK + 2)[1:-1] * 64)
    r = np.stack([np.einsum("ij,ij->i", f[:, : BLOCK - k], f[:, k:]) for k in range(LPC_ORDER + 1)])
    a, err = np.zeros((LPC_ORDER, len(x))), np.maximum(r[0], 1e-9) * (1 + 1e-9)
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / err
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(0), 1e-9)
    shift = np.clip(LPC_PRECISION - 2 - (np.frexp(top)[1].astype(np.int64) - 1), 0, 15)
    limit = 1 << (LPC_PRECISION - 1)
    q = np.clip(np.rint(a * 2.0**shift), -limit, limit - 1).astype(np.int64)
    return q.T.astype(np.int32), shift.astype(np.int32)


def _rice_bits(folded: np.ndarray, refine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each frame a Rice parameter by its mean (the best of that one and its neighbours if ``refine``), and the bits it takes."""
    mean = np.maximum(folded.sum(1) / folded.shape[1] * 0.7, 1e-3)
    near = np.clip(np.frexp(mean)[1].astype(np.int32) - 1, 0, MAX_K)
    best = k_best = None
    for d in (0, -1, 1) if refine else (0,):
        k = np.clip(near + d, 0, MAX_K)
        bits = (folded >> k[:, None]).sum(1) + folded.shape[1] * (1 + k)
        if best is None:
            best, k_best = bits, k
        else:
            k_best, best = np.where(bits < best, k, k_best), np.minimum(bits, best)
    return k_best, best


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames' bytes one after another, and each frame's length. samples: frames x BLOCK, of -128 to 127."""
    x = samples.astype(np.int32)
    n = len(x)
    fixed = _residuals(x, MAX_FIXED)
    coef, shift = _lpc(x)
    guess = np.zeros_like(x)
    for j in range(LPC_ORDER):
        guess[:, LPC_ORDER:] += coef[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    tries = [(o, r) for o, r in enumerate(fixed)] + [(LPC_ORDER, x - (guess >> shift[:, None]))]
    folds = [_fold(r) for _, r in tries]
    side_bits = LPC_ORDER * LPC_PRECISION + 9
    cost = np.stack([_rice_bits(f[:, o:])[1] + 8 * o for (o, _), f in zip(tries, folds, strict=True)])
    cost[-1] += side_bits
    pick = cost.argmin(0)
    linear = pick == len(fixed)
    order = np.where(linear, LPC_ORDER, pick)
    folded = folds[0]
    for i in range(1, len(tries)):
        m = np.flatnonzero(pick == i)
        folded[m] = folds[i][m]
    warm = np.arange(BLOCK)[None, :] < order[:, None]
    folded[warm] = 0
    k = _rice_bits(folded, True)[0]
    quotient = folded >> k[:, None]
    value = np.where(warm, x & 0xFF, (1 << k)[:, None] | (folded & ((1 << k) - 1)[:, None]))
    width = np.where(warm, 8, 1 + k[:, None])
    heads = [b"\xff\xf8" + bytes([0x20, 0x02]) + _utf8_number(int(i)) for i in numbers]
    head_len = np.array([len(h) for h in heads], np.int64)
    side = np.where(linear, side_bits, 0)
    # the subframe: 8 bits of header, warm-up samples, predictor, 10 bits of residual header, codes
    room = quotient + width
    start = np.cumsum(room, 1) - room  # bits from the subframe's first sample
    start += np.where(warm, 0, (side + 10)[:, None])
    body = 8 + start[:, -1] + room[:, -1]
    length = head_len + 1 + (body + 7) // 8 + 2
    at = np.cumsum(length) - length
    total = int(length.sum())
    first = (at + head_len + 1) * 8
    # fields of up to 16 bits at bit positions never overlap, so sums of their bytes are unions
    bit = (first[:, None] + 8 + start + quotient).ravel()
    byte = bit >> 3
    shifted = value.ravel() << (24 - (bit & 7) - width.ravel())
    out = np.bincount(byte, weights=shifted >> 16, minlength=total + 8)
    out[1:] += np.bincount(byte, weights=shifted >> 8 & 0xFF, minlength=total + 7)[: total + 7]
    late = np.flatnonzero(shifted & 0xFF)
    out[2:] += np.bincount(byte[late], weights=shifted[late] & 0xFF, minlength=total + 6)[: total + 6]

    def put(bit: np.ndarray, width: int, value: np.ndarray) -> None:
        """One field a frame."""
        v = value.astype(np.int64) << (24 - (bit & 7) - width)
        for j in range(3):
            np.add.at(out, (bit >> 3) + j, v >> (16 - 8 * j) & 0xFF)

    put(first, 8, np.where(linear, (32 + LPC_ORDER - 1) << 1, (8 + order) << 1))
    after_warm = first + 8 + 8 * order
    lin = np.flatnonzero(linear)
    put(after_warm[lin], 4, np.full(len(lin), LPC_PRECISION - 1))
    put(after_warm[lin] + 4, 5, shift[lin])
    for j in range(LPC_ORDER):
        put(after_warm[lin] + 9 + j * LPC_PRECISION, LPC_PRECISION, coef[lin, j] & ((1 << LPC_PRECISION) - 1))
    put(after_warm + side, 10, k)  # method 0, partition order 0 (six zero bits), parameter
    data = out.astype(np.uint8)
    for h, p in zip(heads, at.tolist(), strict=True):
        data[p : p + len(h)] = np.frombuffer(h, np.uint8)
    data[at + head_len] = _crc(data, at, head_len, 8)
    crc = _crc(data, at, length - 2, 16)
    data[at + length - 2], data[at + length - 1] = crc >> 8, crc & 0xFF
    return data[:total].tobytes(), length


def stream_header(n_samples: int, md5: bytes, frame_lengths: np.ndarray) -> bytes:
    """fLaC and STREAMINFO, the only and last metadata block."""
    packed = RATE << 44 | 0 << 41 | (8 - 1) << 36 | n_samples
    lo, hi = int(frame_lengths.min()), int(frame_lengths.max())
    info = BLOCK.to_bytes(2, "big") * 2 + lo.to_bytes(3, "big") + hi.to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info


class _Bits:
    """Bit readers for many frames at once over one byte array."""

    def __init__(self, data: np.ndarray, bit: np.ndarray) -> None:
        pad = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
        word = np.zeros(len(pad) - 7, np.uint64)
        for j in range(8):
            word = (word << np.uint64(8)) | pad[j : len(word) + j]
        self.word, self.bit = word, bit.astype(np.int64)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more of each reader, from the top of a 64-bit word."""
        return self.word[np.minimum(at >> 3, len(self.word) - 1)] << (at & 7).astype(np.uint64)

    def take(self, width: np.ndarray | int, who: np.ndarray | slice = slice(None)) -> np.ndarray:
        at = self.bit[who]
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        v = np.where(width > 0, self.peek(at) >> (64 - np.maximum(width, 1)).astype(np.uint64), 0)
        self.bit[who] = at + width
        return v.astype(np.int64)

    def rice(self, k: np.ndarray, who: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A folded Rice code of each reader."""
        at = self.bit[who]
        top = self.peek(at)
        zeros = _leading_zeros(top >> np.uint64(32))
        long = np.flatnonzero(zeros == 32)
        if len(long):  # a run of zeros beyond what one look shows
            q, spot = zeros.copy(), at.copy()
            while len(long):
                spot[long] += 32
                z = _leading_zeros(self.peek(spot[long]) >> np.uint64(32))
                if (spot[long] >> 3 >= len(self.word)).any():
                    raise ValueError("a frame ends inside a residual")
                q[long] += z
                long = long[z == 32]
            rest = self.peek(at + q + 1)
            zeros = q
        else:
            rest = self.peek(at + zeros + 1)
        low = (rest >> np.uint64(1)) >> (63 - k).astype(np.uint64)
        self.bit[who] = at + zeros + 1 + k
        return (zeros << k) | low.astype(np.int64)


def _leading_zeros(v: np.ndarray) -> np.ndarray:
    """Of 32-bit numbers held in 64 bits; exact, as doubles hold them whole."""
    return 32 - np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _signed(v: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    half = np.left_shift(1, np.asarray(bits, np.int64) - 1)
    return (v ^ half) - half


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The samples (frames x BLOCK) of the frames at data[start:end]; raises ValueError where a header or checksum is wrong."""
    n = len(start)
    if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 2] != 0x20).any() or (data[start + 3] != 0x02).any():
        raise ValueError("not a frame of this stream")
    lead = data[start + 4].astype(np.int64)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    got = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(1, 7):
        got = np.where(more >= j, got << 6 | data[np.minimum(start + 4 + j, len(data) - 1)] & 0x3F, got)
    if (got != numbers).any():
        raise ValueError("frames out of order")
    head = 5 + more
    if (_crc(data, start, head, 8) != data[start + head]).any():
        raise ValueError("a header's CRC-8 is wrong")
    if (_crc(data, start, end - start - 2, 16) != data[end - 2].astype(np.uint32) << 8 | data[end - 1]).any():
        raise ValueError("a frame's CRC-16 is wrong")
    bits = _Bits(data, (start + head + 1) * 8)
    kind = bits.take(8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits aren't used in these streams")
    kind >>= 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    plain = (kind == 0) | (kind == 1)
    if not (fixed | linear | plain).all():
        raise ValueError("a reserved subframe type")
    x = np.zeros((BLOCK, n), np.int64)
    for i in np.flatnonzero(plain).tolist():
        width = 1 if kind[i] == 0 else BLOCK
        at = int(bits.bit[i])
        raw = np.packbits(np.unpackbits(data[at >> 3 : (at >> 3) + width + 1])[at & 7 :][: 8 * width])
        x[:, i] = raw.view(np.int8)
    who = np.flatnonzero(~plain)
    if not len(who):
        return x.T
    order = np.where(linear, kind - 31, kind - 8)[who]
    for s in range(int(order.max())):
        w = who[order > s]
        x[s, w] = _signed(bits.take(8, w), 8)
    lin = who[linear[who]]
    coef, shift = np.zeros((32, n), np.int64), np.zeros(n, np.int64)
    if len(lin):
        precision = bits.take(4, lin) + 1
        shift[lin] = _signed(bits.take(5, lin), 5)
        for j in range(int(order.max())):
            m = kind[lin] - 31 > j
            coef[j, lin[m]] = _signed(bits.take(precision[m], lin[m]), precision[m])
    method, parts = bits.take(2, who), bits.take(4, who)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    per = BLOCK >> parts
    k_bits = 4 + method
    k, raw_bits = np.zeros(len(who), np.int64), np.full(len(who), -1, np.int64)
    res = np.zeros((BLOCK, len(who)), np.int64)
    low = int(order.min())
    uniform = int(parts.max()) == 0
    for s in range(BLOCK):
        if s <= 32 or not uniform:
            fresh = np.flatnonzero((s == 0) | (s % per == 0)) if s == 0 or not uniform else np.empty(0, np.int64)
            if len(fresh):
                v = bits.take(k_bits[fresh], who[fresh])
                raw = v == (1 << k_bits[fresh]) - 1
                k[fresh], raw_bits[fresh] = np.where(raw, 0, v), -1
                if raw.any():
                    raw_bits[fresh[raw]] = bits.take(5, who[fresh[raw]])
        if s < low:
            continue
        if s < 32 or (raw_bits >= 0).any():
            live = order <= s
            rice = np.flatnonzero(live & (raw_bits < 0))
            u = bits.rice(k[rice], who[rice])
            res[s, rice] = (u >> 1) ^ -(u & 1)
            esc = np.flatnonzero(live & (raw_bits >= 0))
            if len(esc):
                v = bits.take(raw_bits[esc], who[esc])
                res[s, esc] = np.where(raw_bits[esc] > 0, _signed(v, np.maximum(raw_bits[esc], 1)), 0)
        else:
            u = bits.rice(k, who)
            res[s] = (u >> 1) ^ -(u & 1)
    where = np.zeros(n, np.int64)
    where[who] = np.arange(len(who))
    for o in range(5):
        w = who[(kind[who] - 8 == o)]
        if not len(w):
            continue
        r = res[:, where[w]]
        if o == 0:
            x[:, w] = r
            continue
        # the o-th differences are the residuals: sum them up o times from the warm-up's own differences
        d = [x[:o, w]]
        for _ in range(o - 1):
            d.append(np.diff(d[-1], axis=0))
        cur = r[o:]
        for lev in range(o - 1, -1, -1):
            cur = d[lev][-1][None, :] + np.cumsum(cur, axis=0)
        x[o:, w] = cur
    for o in sorted(set((kind[lin] - 31).tolist())):
        w = lin[kind[lin] - 31 == o]
        c, sh, y, r = coef[:o, w], shift[w], np.ascontiguousarray(x[:, w]), res[:, where[w]]
        for s in range(o, BLOCK):
            guess = (c * y[s - o : s][::-1]).sum(0)
            y[s] = r[s] + (guess >> sh)
        x[:, w] = y
    if (bits.bit + 7 >> 3 > end - 2)[who].any():
        raise ValueError("a frame is longer than its bytes")
    return x.T


def encode_payloads(payloads: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """FLAC streams of the payloads (each a positive multiple of BLOCK bytes) and their frames' lengths."""
    n = np.array([len(p) // BLOCK for p in payloads], np.int64)
    signed = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    numbers = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    frames = signed.reshape(-1, BLOCK)
    parts, lengths = [], []
    for at in range(0, len(frames), BATCH_FRAMES):
        data, length = encode_frames(frames[at : at + BATCH_FRAMES], numbers[at : at + BATCH_FRAMES])
        parts.append(data)
        lengths.append(length)
    data, length = b"".join(parts), np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(length)))
    out, f = [], 0
    for p, m in zip(payloads, n.tolist(), strict=True):
        own = length[f : f + m]
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        out.append((stream_header(len(p), md5, own) + data[ends[f] : ends[f + m]], own))
        f += m
    return out


def decode_streams(streams: list[bytes], lengths: list[np.ndarray]) -> list[bytes]:
    """Payloads of streams made by :func:`encode_payloads`, read back and verified. lengths: bytes of each frame, the seek index."""
    n_samples = []
    for s in streams:
        if s[:8] != b"fLaC\x80\x00\x00\x22":
            raise ValueError("not a stream of this kind")
        n_samples.append(int.from_bytes(s[18:26], "big") & (1 << 36) - 1)
    all_len = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    n = np.array([len(x) for x in lengths], np.int64)
    head = np.cumsum([0] + [len(s) for s in streams])[:-1] + 42
    inner = np.concatenate([np.cumsum(x) - x for x in lengths]) if lengths else np.empty(0, np.int64)
    start = np.repeat(head, n) + inner
    numbers = np.arange(len(all_len)) - np.repeat(np.cumsum(n) - n, n)
    data = np.frombuffer(b"".join(streams), np.uint8)
    parts = []
    for at in range(0, len(start), BATCH_FRAMES):
        s, e = start[at : at + BATCH_FRAMES], start[at : at + BATCH_FRAMES] + all_len[at : at + BATCH_FRAMES]
        lo = int(s[0])
        hi = int(e[-1])
        parts.append(decode_frames(data[lo:hi], s - lo, e - lo, numbers[at : at + BATCH_FRAMES]).astype(np.int8))
    samples = np.concatenate(parts).view(np.uint8) ^ 0x80 if parts else np.empty(0, np.uint8)
    flat, out, f = samples.reshape(-1), [], 0
    for s, m, total in zip(streams, n.tolist(), n_samples, strict=True):
        payload = flat[f * BLOCK : (f + m) * BLOCK].tobytes()
        f += m
        if len(payload) != total or hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != s[26:42]:
            raise ValueError("the samples' MD5 is wrong")
        out.append(payload)
    return out


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b"\xff" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def features(payload: bytes) -> str:
    """Integer features of the samples: count, sum, sum of squares, least, greatest, sign changes."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"n={len(s)};sum={int(s.sum())};sq={int((s * s).sum())};min={int(s.min())};max={int(s.max())};zc={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"


def media(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_bytes, media (a FLAC stream) and frame_bytes (its frames' lengths) of each row of :func:`llm.common.base`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            texts = batch.column("text").to_pylist()
            coded = encode_payloads([payload_of(t) for t in texts])
            size = pa.array([len((t or "").encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), size, pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.list_(pa.int32()))], ["rid", "doc_id", "n_bytes", "media", "frame_bytes"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n_bytes long, media binary, frame_bytes array<int>")


def pcm_blocks(coded: DataFrame) -> DataFrame:
    """A row for each frame of :func:`media`: rid, doc_id, sample_offset, byte_offset in the stream, pcm (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20, "media"):
            streams, lengths = batch.column("media").to_pylist(), [np.array(x, np.int64) for x in batch.column("frame_bytes").to_pylist()]
            for rid, doc_id, payload, own in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), decode_streams(streams, lengths), lengths, strict=True):
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int64) * BLOCK), pa.array(42 + np.cumsum(own) - own), pa.array([payload[i * BLOCK : (i + 1) * BLOCK] for i in range(n)], pa.binary())],
                    ["rid", "doc_id", "sample_offset", "byte_offset", "pcm"],
                )

    return coded.mapInArrow(run, "rid long, doc_id long, sample_offset long, byte_offset long, pcm binary")


def read_back(coded: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digests and features of the payloads that :func:`media`'s streams hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20, "media"):
            streams, lengths = batch.column("media").to_pylist(), [np.array(x, np.int64) for x in batch.column("frame_bytes").to_pylist()]
            back = decode_streams(streams, lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()),
                    pa.array([len(s) for s in streams], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                    pa.array([features(p) for p in back]),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return coded.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(media(base(documents(spark, sf_dir))))
