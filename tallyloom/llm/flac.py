"""FLAC media columns: 8-bit mono streams written and read with numpy, many frames at a time.

Encoding picks, for each frame, the shortest of a constant, verbatim samples, and the fixed predictors of order 0 to 2 with Rice
coded residuals. Decoding takes constant, verbatim, fixed (order 0 to 4) and linear-predictor subframes with either Rice method
and escaped partitions, and verifies the header's CRC-8 and the frame's CRC-16. A seek table has every frame, so that
frames are found without decoding those before them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ids_and_text, materialize

FRAME, PARTITION_ORDER, RATE = 4096, 3, 8000
#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Samples that are coded at a time.
TOGETHER = 1 << 19
#: Coded bytes that are read at a time; steps are shared by all frames.
READ_TOGETHER = 1 << 20
LARGEST_K = 14


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    v = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        v = np.where(v >> (bits - 1) & 1, v << 1 ^ polynomial, v << 1) & (1 << bits) - 1
    return v


_CRC8, _CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def _distances(n: int) -> np.ndarray:
    """What a byte adds to the CRC-16, by its distance from the end of the data."""
    rows = [_CRC16]
    for _ in range(n - 1):
        v = rows[-1]
        rows.append((v << 8 & 0xFFFF) ^ _CRC16[v >> 8])
    return np.array(rows, np.uint16)


_BY_DISTANCE: list[np.ndarray] = [_distances(64)]


def crc16s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for ascending, touching or separate, non-empty spans."""
    longest = int((ends - starts).max())
    if longest > len(_BY_DISTANCE[0]):
        _BY_DISTANCE[0] = _distances(max(longest, FRAME + 64))
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first - starts, size)
    left = np.repeat(ends, size) - 1 - at
    return np.bitwise_xor.reduceat(_BY_DISTANCE[0][left, data[at]], first)


def _number(n: int) -> bytes:
    """A frame number in the UTF-8-like code."""
    if n < 128:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    head = (0xFF << (7 - more) & 0xFF) | n >> 6 * more
    return bytes([head, *(0x80 | n >> 6 * k & 0x3F for k in range(more - 1, -1, -1))])


def _frame_header(number: int, n: int) -> bytes:
    head = b"\xff\xf8" + bytes([(0xC0 if n == FRAME else 0x70) | 0x04, 0x02]) + _number(number)
    head += b"" if n == FRAME else (n - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    """Write values of `width` bits, highest first, at bit positions."""
    for k in range(width):
        bits[at + k] = values >> (width - 1 - k) & 1


def encode_frames(numbers: list[int], frames: list[np.ndarray]) -> list[bytes]:
    """One coded frame for each array of signed samples; lengths are multiples of UNIT up to FRAME."""
    n = np.array([len(f) for f in frames], np.int64)
    x = np.concatenate(frames).astype(np.int32)
    first = np.cumsum(n) - n
    parts = 1 << PARTITION_ORDER
    each = n // parts
    at_part = (first[:, None] + each[:, None] * np.arange(parts)).ravel()
    in_frame = np.arange(len(x)) - np.repeat(first, n)
    best, order = 8 * n, np.full(len(n), -1)  # verbatim
    chosen = np.zeros(len(x), np.int32)
    chosen_k = np.zeros(len(at_part), np.int64)
    r = x
    for o in range(3):
        if o:
            r = np.concatenate(([0], r[1:] - r[:-1]))
        u = np.where(in_frame < o, 0, (r << 1) ^ (r >> 31))
        some = np.repeat(each, parts)
        some[::parts] -= o
        costs = [np.add.reduceat(u >> k, at_part) + some * (1 + k) for k in range(9)]
        k = np.argmin(costs, axis=0)
        total = np.min(costs, axis=0).reshape(-1, parts).sum(1) + 8 * o + 6 + 4 * parts
        better = total < best
        best, order = np.where(better, total, best), np.where(better, o, order)
        chosen = np.where(np.repeat(better, n), u, chosen)
        chosen_k = np.where(np.repeat(better, parts), k, chosen_k)
    constant = (np.maximum.reduceat(x, first) == np.minimum.reduceat(x, first)).nonzero()[0]
    order[constant], best[constant] = -2, 8
    heads = [_frame_header(a, b) for a, b in zip(numbers, n.tolist())]
    head_size = np.array([len(h) for h in heads])
    size = head_size + 1 + (best + 7) // 8 + 2
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    body = 8 * (start + head_size + 1)  # after the subframe header
    raw = x & 0xFF
    plain = np.repeat(order == -1, n)
    where = np.repeat(body, n) + 8 * in_frame
    _put(bits, where[plain], raw[plain], 8)
    _put(bits, body[constant], raw[first[constant]], 8)
    rice = order >= 0
    warm = np.repeat(rice, n) & (in_frame < np.repeat(order, n))
    _put(bits, where[warm], raw[warm], 8)
    _put(bits, (body + 8 * order)[rice] + 2, np.full(int(rice.sum()), PARTITION_ORDER), 4)
    coded = np.repeat(rice, n) & ~warm
    part_of = np.repeat(np.arange(len(at_part)), np.repeat(each, parts))
    k_of = chosen_k[part_of]
    length = np.where(coded, (chosen >> k_of) + 1 + k_of, 0)
    run = np.cumsum(length) - length
    within = run - np.repeat(run[first], n)
    base = np.repeat(body + 8 * np.maximum(order, 0) + 6, n) + 4 * (part_of % parts + 1)
    spot = base + within
    heads_at = (np.repeat(body + 8 * np.maximum(order, 0) + 6, parts) + 4 * (np.arange(len(at_part)) % parts) + within[at_part])[np.repeat(rice, parts)]
    _put(bits, heads_at, chosen_k[np.repeat(rice, parts)], 4)
    u, k, p = chosen[coded], k_of[coded], spot[coded] + (chosen >> k_of)[coded]
    bits[p] = 1
    for j in range(int(k.max()) if len(k) else 0):
        has = k > j
        bits[p[has] + 1 + j] = u[has] >> (k[has] - 1 - j) & 1
    data = np.packbits(bits)
    kinds = np.where(order == -2, 0, np.where(order == -1, 1 << 1, (8 + order) << 1))
    data[start + head_size] = kinds
    for s, h in zip(start.tolist(), heads):
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16s(data, start, start + size - 2)
    data[start + size - 2], data[start + size - 1] = crc >> 8, crc & 0xFF
    buffer = data.tobytes()
    return [buffer[a:b] for a, b in zip(start.tolist(), (start + size).tolist())]


def stream(payload: bytes, frames: list[bytes]) -> bytes:
    """A FLAC file of coded frames: stream info, a seek point for every frame, frames."""
    n = len(payload)
    digest = hashlib.md5(np.bitwise_xor(np.frombuffer(payload, np.uint8), 0x80).tobytes(), usedforsecurity=False).digest()
    sizes = [len(f) for f in frames]
    info = (FRAME).to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + digest
    points, at = [], 0
    for k, s in enumerate(sizes):
        points.append((k * FRAME).to_bytes(8, "big") + at.to_bytes(8, "big") + min(FRAME, n - k * FRAME).to_bytes(2, "big"))
        at += s
    table = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload; sizes are positive multiples of UNIT. Byte b is the sample b - 128."""
    out: list[list[bytes]] = [[] for _ in payloads]
    numbers, frames, owner, held = [], [], [], 0

    def flush():
        if frames:
            for k, f in zip(owner, encode_frames(numbers, frames)):
                out[k].append(f)
        for x in (numbers, frames, owner):
            x.clear()

    for k, payload in enumerate(payloads):
        samples = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
        for number, at in enumerate(range(0, len(samples), FRAME)):
            numbers.append(number)
            frames.append(samples[at : at + FRAME])
            owner.append(k)
            held += len(frames[-1])
            if held >= TOGETHER:
                flush()
                held = 0
    flush()
    return [stream(p, f) for p, f in zip(payloads, out)]


class Reader:
    """Metadata of one FLAC file."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            last, block = bool(data[at] & 0x80), data[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.samples, self.depth, self.channels, self.rate = packed & (1 << 36) - 1, (packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1, packed >> 44
                self.md5 = block[18:34]
            elif kind == 3:
                points = [block[i : i + 18] for i in range(0, size, 18)]
                self.points = [(int.from_bytes(p[:8], "big"), int.from_bytes(p[8:16], "big"), int.from_bytes(p[16:], "big")) for p in points if p[:8] != b"\xff" * 8]
        self.data, self.start = data, at
        if self.channels != 1 or self.depth != 8:
            raise ValueError("only 8-bit mono streams are read")

    def frames(self) -> list[tuple[int, int]]:
        """Byte spans of all frames, by the seek table."""
        starts = [self.start + p[1] for p in self.points]
        return list(zip(starts, [*starts[1:], len(self.data)]))

    def block(self, sample: int) -> tuple[int, np.ndarray]:
        """The PCM block that holds a sample: its first sample's number and its samples, decoding no other frame."""
        k = max(i for i, p in enumerate(self.points) if p[0] <= sample)
        a, b = self.frames()[k]
        return self.points[k][0], decode_frames([self.data[a:b]])[0]


def _parse_header(frame: bytes) -> tuple[int, int]:
    """Samples of a frame and the size of its header, whose CRC-8 is verified."""
    if len(frame) < 6 or frame[0] != 0xFF or frame[1] & 0xFC != 0xF8:
        raise ValueError("no frame sync")
    code, at = frame[2] >> 4, 5
    lead = frame[4]
    while lead & 0xC0 == 0xC0:
        at, lead = at + 1, lead << 1 & 0xFF
    if code == 6:
        n, at = frame[at] + 1, at + 1
    elif code == 7:
        n, at = int.from_bytes(frame[at : at + 2], "big") + 1, at + 2
    elif code >= 8:
        n = 256 << (code - 8)
    else:
        n = 192 if code == 1 else 576 << (code - 2)
    at += {12: 1, 13: 2, 14: 2}.get(frame[2] & 15, 0)
    if crc8(frame[:at]) != frame[at]:
        raise ValueError("header CRC-8 does not match")
    return n, at + 1


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of each frame. Rice codes of all frames are read in step; both checksums of every frame are verified."""
    if not frames:
        return []
    size = np.array([len(f) for f in frames], np.int64)
    data = np.frombuffer(b"".join(frames), np.uint8)
    start = np.cumsum(size) - size
    crc = crc16s(data, start, start + size - 2)
    if (crc != (data[start + size - 2].astype(np.uint16) << 8 | data[start + size - 1])).any():
        raise ValueError("frame CRC-16 does not match")
    bits = np.unpackbits(data)
    ones = np.flatnonzero(bits).astype(np.int32)
    out: list[np.ndarray | None] = [None] * len(frames)
    waiting = []
    for f, frame in enumerate(frames):
        n, at = _parse_header(frame)
        kind, wasted = frame[at] >> 1 & 63, frame[at] & 1
        if wasted:
            raise ValueError("wasted bits are not used at 8 bits")
        at, base = at + 1, int(start[f])
        if kind == 0:
            out[f] = np.full(n, np.int8(np.uint8(frame[at]).astype(np.int8)), np.int32)
        elif kind == 1:
            out[f] = np.frombuffer(frame[at : at + n], np.int8).astype(np.int32)
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm = np.frombuffer(frame[at : at + order], np.int8).astype(np.int32)
            bit, coefficients, shift = 8 * (base + at + order), None, 0
            if kind >= 32:
                precision, shift = _take(bits, bit, 4) + 1, _signed(_take(bits, bit + 4, 5), 5)
                coefficients = [_signed(_take(bits, bit + 9 + precision * i, precision), precision) for i in range(order)]
                bit += 9 + precision * order
            wide = 5 if _take(bits, bit, 2) == 1 else 4
            waiting.append((f, n, order, warm, coefficients, shift, wide, _take(bits, bit + 2, 4), bit + 6))
        else:
            raise ValueError("reserved subframe type")
    if waiting:
        residuals = _read_rice(data, bits, ones, waiting)
        for (f, n, order, warm, coefficients, shift, *_), r in zip(waiting, residuals):
            out[f] = _predict(warm, r, order, coefficients, shift)
    return out


def _take(bits: np.ndarray, at: int, width: int) -> int:
    v = 0
    for b in bits[at : at + width].tolist():
        v = v << 1 | b
    return v


def _signed(v: int, width: int) -> int:
    return v - (1 << width) if v >> (width - 1) else v


def _read_rice(data: np.ndarray, bits: np.ndarray, ones: np.ndarray, waiting: list[tuple]) -> list[np.ndarray]:
    """Residuals of frames, partition by partition: each step finds the end of one unary part in every frame; values follow at once."""
    n, order, wide, level, at = (np.array([w[i] for w in waiting], np.int64) for i in (1, 2, 6, 7, 8))
    per, out = n >> level, [np.zeros(int(c), np.int64) for c in n - order]
    next_one = np.full(len(bits) + 1, len(bits), np.int32)
    next_one[ones] = ones
    next_one = np.minimum.accumulate(next_one[::-1])[::-1]
    padded = np.concatenate((data, np.zeros(5, np.uint8)))
    words = np.zeros(len(data) + 1, np.int64)  # 40 bits from each byte
    for j in range(5):
        words = words << 8 | padded[j : j + len(words)]

    def field(position: np.ndarray, width: np.ndarray) -> np.ndarray:
        return words[position >> 3] >> (40 - (position & 7) - width) & ((1 << width) - 1)

    filled = np.zeros(len(waiting), np.int64)
    for q in range(1 << int(level.max())):
        has = (q < 1 << level).nonzero()[0]
        count = per[has] - (order[has] if q == 0 else 0)
        k = field(at[has], wide[has])
        at[has] += wide[has]
        for f, c in zip(has[k == (1 << wide[has]) - 1].tolist(), count[k == (1 << wide[has]) - 1].tolist()):  # an escaped partition
            width = int(field(at[f : f + 1], np.array([5]))[0])
            v = field(at[f] + 5 + width * np.arange(c), np.full(c, width))
            out[f][filled[f] : filled[f] + c] = v - ((v >> max(width - 1, 0) & 1) << width) if width else 0
            at[f] += 5 + width * c
            filled[f] += c
        coded = (k < (1 << wide[has]) - 1) & (count > 0)
        has, count, k = has[coded], count[coded], k[coded]
        if not len(has):
            continue
        longest = np.argsort(-count, kind="stable")
        has, count, k = has[longest], count[longest], k[longest]
        top, skip, p = int(count[0]), k + 1, at[has]
        stops, begins = np.zeros((top, len(has)), np.int64), np.zeros((top, len(has)), np.int64)
        active = np.searchsorted(-count, -np.arange(top), side="left").tolist()
        for i, a in enumerate(active):
            begins[i, :a] = p[:a]
            stop = next_one[p[:a]]
            stops[i, :a] = stop
            np.add(stop, skip[:a], out=p[:a])
        at[has] = p
        value = (stops - begins) << k | field(np.minimum(stops + 1, len(bits)), k)
        value = (value >> 1) ^ -(value & 1)
        for j, (f, c) in enumerate(zip(has.tolist(), count.tolist())):
            out[f][filled[f] : filled[f] + c] = value[:c, j]
        filled[has] += count
    return out


def _predict(warm: np.ndarray, residual: np.ndarray, order: int, coefficients: list[int] | None, shift: int) -> np.ndarray:
    """Samples from warm-up samples and residuals."""
    if coefficients is None:
        r = residual.astype(np.int64)
        for o in range(order, 0, -1):  # sums of differences, from the highest order down
            last = np.diff(warm, o - 1)[-1] if o > 1 else warm[-1]
            r = np.cumsum(r) + last
        return np.concatenate((warm, r)).astype(np.int32)
    out = warm.tolist()
    back = coefficients
    for e in residual.tolist():
        out.append(e + (sum(c * out[-1 - i] for i, c in enumerate(back)) >> shift))
    return np.array(out, np.int32)


def decode(files: list[bytes]) -> list[bytes]:
    """The payloads of FLAC files; checksums of frames and the stream's MD5 are verified."""
    readers = [Reader(f) for f in files]
    out: list[list[np.ndarray]] = [[] for _ in files]
    owner, held, size = [], [], 0

    def flush():
        for k, x in zip(owner, decode_frames(held)):
            out[k].append((x + 128).astype(np.uint8))
        owner.clear()
        held.clear()

    for k, r in enumerate(readers):
        for a, b in r.frames():
            owner.append(k)
            held.append(r.data[a:b])
            size += b - a
            if size >= READ_TOGETHER:
                flush()
                size = 0
    flush()
    payloads = [np.concatenate(x) if x else np.zeros(0, np.uint8) for x in out]
    for r, p in zip(readers, payloads):
        if len(p) != r.samples or hashlib.md5(np.bitwise_xor(p, 0x80).tobytes(), usedforsecurity=False).digest() != r.md5:
            raise ValueError("samples do not match the stream's MD5")
    return [p.tobytes() for p in payloads]


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes and zero bytes up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8")
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def features(payload: bytes) -> str:
    """Whole-number features of the samples: sum, energy, zero crossings, least and largest, energy of differences."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    d = np.diff(x)
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()};min={x.min()};max={x.max()};change={(d * d).sum()}"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text, unpadded) and media, the FLAC file of its payload. Null texts count as empty (UNIT zero bytes)."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64())
            media = pa.array(encode([payload_of(t) for t in texts]), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, media], names=["doc_id", "n_bytes", "media"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, sample (offset of its first sample) and pcm (8-bit samples as stored bytes) of every frame."""

    def run(batches):
        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = Reader(data)
                spans = r.frames()
                for at in range(0, len(spans), 64):
                    some = decode_frames([data[a:z] for a, z in spans[at : at + 64]])
                    rows = [(doc_id, at + k, r.points[at + k][0], (x + 128).astype(np.uint8).tobytes()) for k, x in enumerate(some)]
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "block", "sample", "pcm"), x)) for x in rows], schema=pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("sample", pa.int64()), ("pcm", pa.binary())]))

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample long, pcm binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Every row's payload stored as FLAC in the shared folder, read back from the stored table, checked and described.

    Null texts count as empty, whose payload is UNIT zero bytes. Equal texts have equal values, repeated rows each have a row, an
    empty table gives an empty table, other columns are ignored. Long texts are coded in bounded groups of frames. The stored table
    stays until what is around calls discard() or ends its scratch().
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            doc_ids, sizes, media = (c.to_pylist() for c in b.columns)
            rows = [
                (d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), features(p))
                for d, n, m, p in zip(doc_ids, sizes, media, decode(media))
            ]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    stored = materialize(store_media(docs), "media", codec="zstd")  # Rice codes leave equal files of equal texts to the table's codec
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
