"""FLAC media columns: texts as 8-bit samples, and a decoder of FLAC with checks and seekable blocks.

The decoder reads frames of one or more channels (independent, left/side, right/side, mid/side) with
constant, verbatim, fixed and linear-predictor subframes and Rice-coded residuals of both methods,
checks the header's CRC-8 and the frame's CRC-16, and gives PCM blocks, each with the number of its
first sample. The encoder writes a SEEKTABLE with the place of every frame, so ``pcm`` reads the samples from any
offset on without the frames before it; streams without one are walked frame by frame.

Residuals are decoded without a loop over samples: every one-bit of a partition knows which one-bit ends
the next code if a code ends with it, and doubling such jumps lists the ends of all codes.

The encoder takes the bytes of a text as samples of one channel. Letters are few of the 256 levels and
far from zero, so levels are first renumbered by how often the text has them (0, -1, 1, -2, ...); the
table is in an APPLICATION block. Each block of samples takes the smallest of: constant, verbatim,
fixed predictors of orders 0 to 2 and a linear predictor of order 4.

Defined results: a null text is an empty one, whose payload is 64 zero bytes; equal texts have equal
media; a payload is stored whole, whatever its length; an empty table gives no rows. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens

UNIT = 64
BLOCK = 4096
RATE = 8000
#: Fixed values of the format.
MAGIC = b"fLaC"
APPLICATION = b"tmLV"
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
SEEK = 3
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]

_crc: dict[tuple[int, int], np.ndarray] = {}


class FlacError(ValueError):
    pass


def crc(data: bytes, bits: int, poly: int) -> int:
    """CRC, first bit highest, from 0. A byte's part in it depends on its value and its distance from
    the end; a table of these parts makes it a sum without carries over all bytes."""
    mask, table = (1 << bits) - 1, _crc.get((bits, poly))
    if table is None or len(table) < len(data):
        row = np.arange(256, dtype=np.uint32) << (bits - 8)
        for _ in range(8):
            row = ((row << 1) ^ np.where(row >> (bits - 1) & 1, poly, 0)).astype(np.uint32) & mask
        rows, first = [row], row
        for _ in range(max(len(data), BLOCK + 64)):
            row = first[row >> (bits - 8)] ^ (row << 8 & mask)
            rows.append(row)
        table = _crc[bits, poly] = np.array(rows, np.uint16)
    some = np.frombuffer(data, np.uint8)
    return int(np.bitwise_xor.reduce(table[np.arange(len(some) - 1, -1, -1), some])) if len(some) else 0


# bits


def put_bits(parts: list[tuple[int, int]]) -> np.ndarray:
    """(value, width) pairs as an array of bits."""
    return np.array([v >> (w - 1 - i) & 1 for v, w in parts for i in range(w)], np.uint8)


def utf8_number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            break
    return bytes([(0xFF << (7 - len(tail)) & 0xFF) | n, *reversed(tail)])


def rice_bits(u: np.ndarray, k: int) -> np.ndarray:
    """Codes of folded residuals: a quotient in zeros and a one, then k bits."""
    ends = np.cumsum((u >> k) + 1 + k)
    bits = np.zeros(int(ends[-1]) if len(u) else 0, np.uint8)
    bits[ends - 1 - k] = 1
    for j in range(k):
        bits[ends - 1 - j] = u >> j & 1
    return bits


def rice_decode(bits: np.ndarray, ones: np.ndarray, rank: np.ndarray, at: int, n: int, k: int) -> tuple[np.ndarray, int]:
    """n folded residuals that begin at bit ``at``, and where they end. ``ones``: places of all one-bits;
    ``rank``: how many there are up to each place."""
    if not n:
        return np.zeros(0, np.int64), at
    base = int(rank[at - 1]) if at else 0
    near = ones[base : base + n * (k + 1) + 1]  # codes hold n to n (k + 1) one-bits
    jump = np.append(np.minimum(rank[np.minimum(near + k, len(rank) - 1)] - base, len(near)), len(near))
    ends = np.zeros(1, np.int64)
    while len(ends) < n:
        ends = np.concatenate([ends, jump[ends[: n - len(ends)]]])
        if len(ends) < n:
            jump = jump[jump]
    if len(near) == 0 or ends[-1] >= len(near):
        raise FlacError("residuals run over the frame")
    stop = near[ends]
    u = np.diff(stop, prepend=at - k - 1) - k - 1
    for j in range(k):
        u = u << 1 | bits[stop + 1 + j]
    return u, int(stop[-1]) + 1 + k


def unfold(u: np.ndarray) -> np.ndarray:
    return u >> 1 ^ -(u & 1)


def fold(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


# encoding


def best_rice(u: np.ndarray) -> tuple[int, int]:
    """(bits, k) of the cheapest code, k of 0 to 14."""
    if not len(u):
        return 0, 0
    around = max(0, int(u.mean() * 0.7).bit_length() - 1)
    return min((int((u >> k).sum()) + len(u) * (k + 1), k) for k in range(max(0, around - 1), min(14, around + 2) + 1))


def lpc(x: np.ndarray, order: int = 4, shift: int = 10) -> list[int]:
    """Coefficients, for ``shift`` bits after the point, from autocorrelation."""
    y = x.astype(np.float64)
    auto = np.array([y[: len(y) - i] @ y[i:] for i in range(order + 1)])
    if auto[0] <= 0:
        return [0] * order
    lags = auto[np.abs(np.subtract.outer(range(order), range(order)))] + np.eye(order) * auto[0] * 1e-9
    return [int(c) for c in np.clip(np.round(np.linalg.solve(lags, auto[1:]) * (1 << shift)), -2048, 2047)]


def subframe(x: np.ndarray, depth: int) -> np.ndarray:
    """The smallest coding of a block of samples, as bits."""
    n, mask = len(x), (1 << depth) - 1
    if (x == x[0]).all():
        return put_bits([(0, 8), (int(x[0]) & mask, depth)])
    options = [(8 + n * depth, "verbatim", 0, None, 0)]
    r = x
    # Where neighbours are unlike, a predictor of order 1 or more adds their noise to the sample's.
    alike = n > 1 and 2 * int(x[1:] @ x[:-1]) > int(x @ x) * 0.8
    for order in range(3 if alike else 1):
        if n > order:
            bits, k = best_rice(fold(r))
            options.append((8 + order * depth + 10 + bits, "fixed", order, r, k))
            r = np.diff(r)
    if n > 32 and alike:
        order, shift = 4, 10
        coef = lpc(x, order, shift)
        guess = sum(c * x[order - 1 - i : n - 1 - i] for i, c in enumerate(coef)) >> shift
        r = x[order:] - guess
        bits, k = best_rice(fold(r))
        options.append((8 + order * depth + 9 + order * 12 + 10 + bits, "lpc", order, (r, coef, shift), k))
    _, kind, order, r, k = min(options, key=lambda o: (o[0], o[1], o[2]))
    values = (x & mask).astype(np.int64)
    raw = lambda v: (v[:, None] >> np.arange(depth - 1, -1, -1) & 1).astype(np.uint8).ravel()
    if kind == "verbatim":
        return np.concatenate([put_bits([(2, 8)]), raw(values)])
    head = [put_bits([((8 | order) << 1, 8)])] if kind == "fixed" else [put_bits([((32 | order - 1) << 1, 8)])]
    head.append(raw(values[:order]))
    if kind == "lpc":
        r, coef, shift = r
        head.append(put_bits([(11, 4), (shift, 5), *[(c & 4095, 12) for c in coef]]))
    return np.concatenate([*head, put_bits([(0, 2), (0, 4), (k, 4)]), rice_bits(fold(r), k)])


def encode(samples: np.ndarray, depth: int = 8, levels: bytes | None = None, block: int = BLOCK) -> bytes:
    """A FLAC stream of one channel."""
    n = len(samples)
    digest = hashlib.md5(samples.astype("i1" if depth == 8 else "<i2").tobytes()).digest()
    info = np.packbits(put_bits([(block, 16), (block, 16), (0, 24), (0, 24), (RATE, 20), (0, 3), (depth - 1, 5), (n, 36)])).tobytes() + digest
    frames, seek, place = [], [], 0
    for number, start in enumerate(range(0, n, block)):
        x = samples[start : start + block].astype(np.int64)
        code = {8: 1, 16: 4}[depth]
        head = bytes([0xFF, 0xF8, 0x70, code << 1]) + utf8_number(number) + (len(x) - 1).to_bytes(2, "big")
        head += bytes([crc(head, 8, 0x07)])
        frame = head + np.packbits(subframe(x, depth)).tobytes()
        seek.append(start.to_bytes(8, "big") + place.to_bytes(8, "big") + len(x).to_bytes(2, "big"))
        place += len(frame) + 2
        frames += [frame, crc(frame, 16, 0x8005).to_bytes(2, "big")]
    head = [(0, info), (SEEK, b"".join(seek)), *([(2, APPLICATION + levels)] if levels else [])]
    out = [bytes([kind | 0x80 * (i == len(head) - 1)]) + len(body).to_bytes(3, "big") + body for i, (kind, body) in enumerate(head)]
    return b"".join([MAGIC, *out, *frames])


# decoding


class Reader:
    def __init__(self, bits: np.ndarray):
        self.bits, self.at, self.ones, self.rank = bits, 0, np.flatnonzero(bits), np.cumsum(bits, dtype=np.int64)

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def many(self, count: int, n: int) -> np.ndarray:
        part = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64)
        self.at += count * n
        value = part @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64)) if n else np.zeros(count, np.int64)
        return np.where(value >> (n - 1) & 1, value - (1 << n), value) if n else value

    def unary(self) -> int:
        stop = int(self.ones[np.searchsorted(self.ones, self.at)])
        zeros, self.at = stop - self.at, stop + 1
        return zeros


def read_residual(r: Reader, n: int, order: int) -> np.ndarray:
    method = r.take(2)
    if method > 1:
        raise FlacError("unknown residual coding")
    width = 4 + method
    parts, out = 1 << r.take(4), []
    for p in range(parts):
        count, k = n // parts - (order if p == 0 else 0), r.take(width)
        if k == (1 << width) - 1:
            out.append(r.many(count, r.take(5)))
        else:
            u, r.at = rice_decode(r.bits, r.ones, r.rank, r.at, count, k)
            out.append(unfold(u))
    return np.concatenate(out)


def predict(start: np.ndarray, residual: np.ndarray, coef: list[int], shift: int) -> np.ndarray:
    """Samples from their first ones, the coefficients (latest sample first) and the residual."""
    order = len(coef)
    if not order or not any(coef):
        return np.concatenate([start, residual])
    if shift == 0 and coef == FIXED[min(order, 4)]:
        x = residual
        for i in range(order - 1, -1, -1):  # undo one difference after the other
            x = np.diff(start, i)[-1] + np.cumsum(x)
        return np.concatenate([start, x])
    out = start.tolist()
    back = coef[::-1]
    for e in residual.tolist():
        out.append(e + (sum(c * s for c, s in zip(back, out[-order:])) >> shift))
    return np.array(out, np.int64)


def read_subframe(r: Reader, n: int, depth: int) -> np.ndarray:
    if r.take(1):
        raise FlacError("a subframe begins with 1")
    kind, wasted = r.take(6), 0
    if r.take(1):
        wasted = r.unary() + 1
        depth -= wasted
    if kind == 0:
        x = np.full(n, r.signed(depth), np.int64)
    elif kind == 1:
        x = r.many(n, depth)
    elif 8 <= kind <= 12:
        start = r.many(kind - 8, depth)
        x = predict(start, read_residual(r, n, kind - 8), FIXED[kind - 8], 0)
    elif kind >= 32:
        order = kind - 31
        start = r.many(order, depth)
        width, shift = r.take(4) + 1, r.signed(5)
        coef = [r.signed(width) for _ in range(order)]
        x = predict(start, read_residual(r, n, order), coef, shift)
    else:
        raise FlacError(f"unknown subframe {kind}")
    return x << wasted


def read_metadata(data: bytes) -> tuple[dict, int]:
    """What STREAMINFO, the SEEKTABLE and our APPLICATION block say, and where the frames begin."""
    if data[:4] != MAGIC:
        raise FlacError("no FLAC stream")
    at, info, last = 4, {"levels": None, "seek": []}, False
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info |= {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == SEEK:
            points = np.frombuffer(body, [("first", ">u8"), ("place", ">u8"), ("n", ">u2")])
            info["seek"] = [(int(p["first"]), int(p["place"])) for p in points if p["first"] != 2**64 - 1]  # others are placeholders
        elif kind == 2 and body[:4] == APPLICATION:
            info["levels"] = body[4:]
    return info, at


def read_frame(data: bytes, at: int, info: dict) -> tuple[np.ndarray, int, int]:
    """Samples (channels x n), number of the first one, and the end of the frame that begins at ``at``."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should begin")
    varying, sizes, rates = data[at + 1] & 1, data[at + 2] >> 4, data[at + 2] & 15
    mode, depths = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    p = at + 4
    more = max(0, 7 - (data[p] ^ 0xFF).bit_length() - 1) if data[p] >= 0xC0 else 0
    number = data[p] & (0x7F >> (more + 1 if more else 0))
    for b in data[p + 1 : p + 1 + more]:
        number = number << 6 | b & 0x3F
    p += 1 + more
    if sizes in (6, 7):
        n, p = int.from_bytes(data[p : p + sizes - 5], "big") + 1, p + sizes - 5
    else:
        n = SIZES[sizes]
    p += {12: 1, 13: 2, 14: 2}.get(rates, 0)
    if crc(data[at:p], 8, 0x07) != data[p]:
        raise FlacError("CRC-8 of a frame header")
    p += 1
    depth, channels = DEPTHS.get(depths) or info["depth"], mode + 1 if mode < 8 else 2
    most = p + channels * (n * (depth + 1) // 8 + 64) + 16
    r = Reader(np.unpackbits(np.frombuffer(data[p:most], np.uint8)))
    x = [read_subframe(r, n, depth + ((mode, c) in ((8, 1), (9, 0), (10, 1)))) for c in range(channels)]
    end = p + -(-r.at // 8)
    if crc(data[at:end], 16, 0x8005) != int.from_bytes(data[end : end + 2], "big"):
        raise FlacError("CRC-16 of a frame")
    if mode == 8:
        x[1] = x[0] - x[1]
    elif mode == 9:
        x[0] = x[0] + x[1]
    elif mode == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [mid + x[1] >> 1, mid - x[1] >> 1]
    return np.stack(x), number if varying else number * info["block"], end + 2


def decode_blocks(data: bytes, since: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first sample, samples as channels x n) of every frame, after its checks, from the one that
    holds sample ``since`` on, as far as the SEEKTABLE tells."""
    info, at = read_metadata(data)
    places = [p for p in info["seek"] if p[0] <= since]
    if places:
        wanted, place = places[-1]
        at += place
    while at < len(data):
        x, first, at = read_frame(data, at, info)
        if places and wanted not in (None, first):
            raise FlacError("the seek table names another sample")
        wanted = None
        yield first, x


def pcm(data: bytes, since: int, count: int) -> np.ndarray:
    """``count`` samples (channels x n) from sample ``since`` on; the frames before it are not read."""
    parts, upto = [np.zeros((read_metadata(data)[0]["channels"], 0), np.int64)], since + count
    for first, x in decode_blocks(data, since) if count > 0 else ():
        if first >= upto:
            break
        parts.append(x[:, max(0, since - first) : upto - first])
        if first + x.shape[1] >= upto:
            break
    return np.concatenate(parts, axis=1)


def decode(data: bytes) -> np.ndarray:
    """All samples of a stream, checked against its MD5."""
    info, _ = read_metadata(data)
    blocks = [x for _, x in decode_blocks(data)]
    x = np.concatenate(blocks, axis=1) if blocks else np.zeros((info["channels"], 0), np.int64)
    wide = {8: "i1", 16: "<i2"}.get(info["depth"])
    if x.shape[1] != info["samples"] or wide and any(info["md5"]) and hashlib.md5(x.T.astype(wide).tobytes()).digest() != info["md5"]:
        raise FlacError("the samples differ from what the stream says")
    return x


# texts


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT if data else UNIT), len(data)


def levels_of(data: np.ndarray) -> np.ndarray:
    """The byte values that occur, the most frequent first."""
    counts = np.bincount(data, minlength=256)
    used = np.flatnonzero(counts)
    return used[np.lexsort((used, -counts[used]))].astype(np.uint8)


def encode_payload(data: bytes) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    levels = levels_of(raw)
    to = np.zeros(256, np.int64)
    to[levels] = unfold(np.arange(len(levels), dtype=np.int64))
    return encode(to[raw], 8, levels.tobytes())


def payload_block(x: np.ndarray, levels: bytes) -> bytes:
    return np.frombuffer(levels, np.uint8)[fold(x)].tobytes()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tokens.some_at_a_time(texts):
                pairs = [payload_of(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([n for _, n in pairs], pa.int64()), pa.array([encode_payload(p) for p, _ in pairs], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored_blocks(data: bytes) -> list[tuple[int, bytes]]:
    """(first sample, payload bytes) of each block, all checked: frames by their sums, the whole by its MD5."""
    info, _ = read_metadata(data)
    blocks = [(first, x[0]) for first, x in decode_blocks(data)]
    whole = np.concatenate([x for _, x in blocks]) if blocks else np.zeros(0, np.int64)
    if len(whole) != info["samples"] or hashlib.md5(whole.astype("i1").tobytes()).digest() != info["md5"]:
        raise FlacError("the samples differ from what the stream says")
    return [(first, payload_block(x, info["levels"])) for first, x in blocks]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, first_sample, pcm: the payload's bytes by frame, each row a place to begin reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks = stored_blocks(data)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(blocks), pa.int64()), pa.array([f for f, _ in blocks], pa.int64()), pa.array([p for _, p in blocks], pa.binary())], ["doc_id", "first_sample", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, first_sample long, pcm binary")


def feature(payload: bytes) -> str:
    """Samples, mean level, root mean square and crossings of the middle level of a payload's 8-bit samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={int((np.diff(x >= 0)).sum())}"


def describe(media: DataFrame) -> DataFrame:
    """Read the stored bytes back block by block: digests of the payload and of the media, a feature, the number of
    PCM blocks and the CRC of their sample offsets (little-endian, 64 bits each)."""
    more = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pcm_blocks": pa.int64(), "offsets_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                blocks = stored_blocks(data)
                payload, offsets = b"".join(p for _, p in blocks), np.array([f for f, _ in blocks], "<u8")
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload), len(blocks), zlib.crc32(offsets.tobytes())))
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(more), more.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", *more])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, " + ", ".join(f"{n} {kinds[k]}" for n, k in more.items()))
