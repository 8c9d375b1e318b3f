"""Operator 7, media columns: FLAC streams, written and read in numpy.

``FlacWriter`` turns bytes into mono 8-bit FLAC with frames of 192 samples and a
seek table; each frame takes the smallest of constant, verbatim, fixed
predictors of order 0 to 2 and, if asked for, an LPC predictor.  ``FlacReader``
reads streams by groups of frames, long ones from one seek point to a later one,
so that what it holds does not grow with a stream.  It finds the frames of a
group by their sync codes and header checksums, verifies every frame's CRC-16
and then decodes all of them in step: Rice codes sample by sample across frames,
predictors by cumulative sums or, for LPC, by the recurrence.  A stream whose
frames can't be told apart this way, or of another shape (partitions, other
block sizes, wider samples), goes to a plain sequential decoder.  What it gives
are PCM blocks with their sample offsets; ``pcm_blocks`` writes them, and
``read_flac`` computes payloads, digests and features from them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_slices, select_exact

BLOCK, RATE = 192, 8_000
#: Frames between two points of the seek table; samples that one numpy step holds.
SEEK_EVERY, GROUP = 32, 1 << 19


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table, top, full = [], 1 << (bits - 1), (1 << bits) - 1
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & full
        table.append(crc)
    return np.array(table, np.uint16 if bits == 16 else np.uint8)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8_rows(data: np.ndarray) -> np.ndarray:
    """CRC-8 of each row of a byte matrix."""
    crc = np.zeros(len(data), np.uint8)
    for j in range(data.shape[1]):
        crc = CRC8[crc ^ data[:, j]]
    return crc


def crc16_frames(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each byte range of a buffer, all ranges in step, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    s, n = starts[order], sizes[order]
    crc = np.zeros(len(s), np.uint16)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for j, m in enumerate(live):
        c = crc[:m]
        crc[:m] = (c << np.uint16(8)) ^ CRC16[(c >> np.uint16(8)).astype(np.int64) ^ buffer[s[:m] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the UTF-8-like code of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFE ^ lead << 1 | 0) & 0xFF & ~lead | n, *reversed(tail)]) if lead != 0x3F else bytes([0xC0 | n])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _best_rice(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameter and bits of the shortest Rice code of each row."""
    n = z.shape[1]
    guess = np.clip(np.floor(np.log2(np.maximum(z.mean(axis=1), 1))), 1, 13).astype(np.int32)
    best_k, best = np.zeros(len(z), np.int32), np.full(len(z), np.iinfo(np.int64).max)
    for d in (-1, 0, 1):
        k = guess + d
        bits = (z >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (1 + k)
        better = bits < best
        best[better], best_k[better] = bits[better], k[better]
    return best_k, best


def _lpc(x: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (most recent sample first) and shifts per row, by Levinson-Durbin."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : f.shape[1] - k]).sum(axis=1) for k in range(order + 1)], axis=1)
    a = np.zeros((len(x), order))
    err = np.maximum(r[:, 0], 1e-9)
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        before = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(precision - 2 - np.ceil(np.log2(top)), 0, 14).astype(np.int64)
    limit = (1 << (precision - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


class FlacWriter:
    """Bytes to FLAC streams, a batch at a time."""

    def __init__(self, lpc_order: int = 0, precision: int = 12):
        self.lpc_order, self.precision = lpc_order, precision

    def frames(self, samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coded frames of the rows of a sample matrix: (their bytes in one buffer, the size of each)."""
        count, n = samples.shape
        x = samples.astype(np.int32)
        kind = np.full(count, -1, np.int32)  # -2 constant, -1 verbatim, else fixed order; 100: LPC
        bits, k = np.full(count, 8 * n, np.int64), np.zeros(count, np.int32)
        zz = np.zeros((count, n), np.int32)
        warm = np.zeros(count, np.int32)
        d = x
        for order in range(3):
            z = _zigzag(d)
            kk, b = _best_rice(z)
            b = b + 10 + 8 * order
            better = b < bits
            bits[better], k[better], kind[better], warm[better] = b[better], kk[better], order, order
            zz[better, order:] = z[better]
            d = np.diff(d, axis=1)
        if self.lpc_order:
            o = self.lpc_order
            coef, shift = _lpc(x, o, self.precision)
            total = sum(coef[:, j, None] * x[:, o - 1 - j : n - 1 - j] for j in range(o))
            z = _zigzag((x[:, o:] - (total >> shift[:, None])).astype(np.int32))
            kk, b = _best_rice(z)
            b = b + 10 + 8 * o + 9 + o * self.precision
            better = b < bits
            bits[better], k[better], kind[better], warm[better] = b[better], kk[better], 100, o
            zz[better, o:] = z[better]
        same = (x == x[:, :1]).all(axis=1)
        bits[same], kind[same], warm[same] = 8, -2, 0

        codes = [coded_number(int(i)) for i in numbers]
        head = np.fromiter((5 + len(c) for c in codes), np.int64, count)  # header bytes with their checksum
        body = head + 1 + (bits + 7) // 8
        sizes = body + 2
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint8)

        # Bits of Rice-coded subframes; everything before the codes is whole bytes and a few fields.
        rice = np.flatnonzero(kind >= 0)
        flat = np.zeros(8 * len(out), np.uint8)
        is_lpc = kind == 100
        first = 8 * (starts + head + 1 + warm)
        fields = first + np.where(is_lpc, 9 + self.lpc_order * self.precision, 0)
        if is_lpc.any():
            rows = np.flatnonzero(is_lpc)
            self._field(flat, first[rows], np.full(len(rows), self.precision - 1), 4)
            self._field(flat, first[rows] + 4, shift[rows], 5)
            for j in range(self.lpc_order):
                self._field(flat, first[rows] + 9 + j * self.precision, coef[rows, j] & (1 << self.precision) - 1, self.precision)
        self._field(flat, fields[rice] + 6, k[rice], 4)  # method 0 and partition order 0 are zero bits
        for kk in np.unique(k[rice]):
            for o in np.unique(warm[rice]):
                rows = rice[(k[rice] == kk) & (warm[rice] == o)]
                if not len(rows):
                    continue
                z = zz[rows, o:]
                q = z >> kk
                size = q + (1 + kk)
                at = fields[rows, None] + 10 + np.cumsum(size, axis=1) - size + q
                flat[at] = 1
                for b in range(kk):
                    flat[at + (1 + b)] = (z >> (kk - 1 - b)) & 1
        out |= np.packbits(flat)

        # Whole bytes: frame headers, subframe headers, warm-up, verbatim and constant samples.
        raw = samples.view(np.uint8)
        for size in np.unique(head):
            rows = np.flatnonzero(head == size)
            header = np.empty((len(rows), size), np.uint8)
            header[:, :4] = (0xFF, 0xF8, 0x14, 0x02)
            header[:, 4:-1] = np.frombuffer(b"".join(codes[i] for i in rows), np.uint8).reshape(len(rows), size - 5)
            header[:, -1] = crc8_rows(header[:, :-1])
            out[starts[rows, None] + np.arange(size)] = header
        out[starts + head] = np.select([kind == -2, kind == -1, is_lpc], [0x00, 0x02, (32 + self.lpc_order - 1) << 1], (8 + kind) << 1)
        for j in range(int(warm.max()) if count else 0):
            rows = np.flatnonzero(warm > j)
            out[starts[rows] + head[rows] + 1 + j] = raw[rows, j]
        rows = np.flatnonzero(kind == -2)
        out[starts[rows] + head[rows] + 1] = raw[rows, 0]
        rows = np.flatnonzero(kind == -1)
        out[(starts[rows] + head[rows] + 1)[:, None] + np.arange(n)] = raw[rows]
        crc = crc16_frames(out, starts, body)
        out[starts + body], out[starts + body + 1] = crc >> 8, crc & 0xFF
        return out, sizes

    @staticmethod
    def _field(flat: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            flat[at + b] = (value >> (width - 1 - b)) & 1

    def streams(self, payloads: list[bytes]) -> list[bytes]:
        """One FLAC stream for each payload; a payload's length is a positive multiple of BLOCK."""
        out: list[list[bytes]] = []
        sizes_of: list[list[np.ndarray]] = []
        todo, held = [], 0

        def flush() -> None:
            nonlocal todo, held
            if todo:
                samples = (np.frombuffer(b"".join(p for _, _, p in todo), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
                counts = [len(p) // BLOCK for _, _, p in todo]
                numbers = np.concatenate([np.arange(first, first + c) for (_, first, _), c in zip(todo, counts)])
                coded, sizes = self.frames(samples, numbers)
                data, ends = coded.tobytes(), np.cumsum(sizes)
                at = row = 0
                for (i, _, _), c in zip(todo, counts):
                    end = int(ends[row + c - 1])
                    out[i].append(data[at:end])
                    sizes_of[i].append(sizes[row : row + c])
                    at, row = end, row + c
            todo, held = [], 0

        for i, payload in enumerate(payloads):
            out.append([])
            sizes_of.append([])
            for at in range(0, len(payload), GROUP // BLOCK * BLOCK):
                part = payload[at : at + GROUP // BLOCK * BLOCK]
                if held + len(part) > GROUP:
                    flush()
                todo.append((i, at // BLOCK, part))
                held += len(part)
        flush()
        return [self._head(p, np.concatenate(s)) + b"".join(f) for p, s, f in zip(payloads, sizes_of, out)]

    def _head(self, payload: bytes, sizes: np.ndarray) -> bytes:
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offsets = np.cumsum(sizes) - sizes
        points = b"".join(struct.pack(">QQH", j * BLOCK, int(offsets[j]), BLOCK) for j in range(0, len(sizes), SEEK_EVERY))
        return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


class FlacError(ValueError):
    """A stream that is cut off or fails a checksum."""


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def read(self, n: int) -> int:
        if not n:
            return 0
        end = self.at + n
        if end > 8 * len(self.data):
            raise FlacError("the stream ends within a frame")
        part = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end % 8)
        self.at = end
        return part & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """(stream info, seek points (sample, byte offset after the metadata, samples), first frame's position)."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, points = 4, False, {}, []
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        data = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(data[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": data[18:34]}
        elif kind == 3:
            points = [struct.unpack(">QQH", data[i : i + 18]) for i in range(0, size, 18)]
        at += 4 + size
    return info, points, at


def decode_frame(stream: bytes, at: int, bits_default: int) -> tuple[list[int], int]:
    """Samples of the mono frame at a position and the position after it; any block size, predictor and partitioning."""
    r = _Bits(stream, at)
    if r.read(15) != 0x7FFC:
        raise FlacError(f"no frame at byte {at}")
    r.read(1)
    size_code, rate_code, channels, bits_code, _ = r.read(4), r.read(4), r.read(4), r.read(3), r.read(1)
    lead = r.read(8)
    extra = 0
    while lead & 0x80 >> extra:
        extra += 1
    for _ in range(extra - 1):
        r.read(8)
    if size_code == 1:
        n = 192
    elif size_code <= 5:
        n = 576 << size_code - 2
    elif size_code == 6:
        n = r.read(8) + 1
    elif size_code == 7:
        n = r.read(16) + 1
    else:
        n = 256 << size_code - 8
    r.read({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    here = r.at >> 3
    if crc8_rows(np.frombuffer(stream[at:here], np.uint8)[None, :])[0] != r.read(8):
        raise FlacError(f"header checksum of the frame at byte {at}")
    if channels:
        raise FlacError("only mono frames are read")
    bps = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(bits_code, bits_default)
    r.read(1)
    kind = r.read(6)
    wasted = r.unary() + 1 if r.read(1) else 0
    bps -= wasted
    if kind == 0:
        x = [r.signed(bps)] * n
    elif kind == 1:
        x = [r.signed(bps) for _ in range(n)]
    else:
        if 8 <= kind <= 12:
            order = kind - 8
            coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            x = [r.signed(bps) for _ in range(order)]
        elif kind >= 32:
            order = kind - 31
            x = [r.signed(bps) for _ in range(order)]
            precision = r.read(4) + 1
            shift = r.signed(5)
            coef = [r.signed(precision) for _ in range(order)]
        else:
            raise FlacError(f"reserved subframe type {kind}")
        width = 5 if r.read(2) else 4
        parts = r.read(4)
        for p in range(1 << parts):
            k = r.read(width)
            raw = r.read(5) if k == (1 << width) - 1 else None
            for _ in range((n >> parts) - (order if p == 0 else 0)):
                if raw is not None:
                    e = r.signed(raw)
                else:
                    z = r.unary() << k
                    z |= r.read(k)
                    e = z >> 1 ^ -(z & 1)
                x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
    x = [v << wasted for v in x]
    end = (r.at + 7) >> 3
    crc = crc16_frames(np.frombuffer(stream, np.uint8), np.array([at]), np.array([end - at]))[0]
    if crc != int.from_bytes(stream[end : end + 2], "big"):
        raise FlacError(f"checksum of the frame at byte {at}")
    return x, end + 2


def plain_blocks(stream: bytes) -> Iterator[bytes]:
    """Payload bytes of the frames of a mono 8-bit stream, one by one; checks the stream's MD5 at the end."""
    info, _, at = metadata(stream)
    digest, count = hashlib.md5(), 0
    while at < len(stream):
        x, at = decode_frame(stream, at, info["bits"])
        signed = np.array(x, np.int8)
        digest.update(signed.tobytes())
        count += len(x)
        yield (signed.view(np.uint8) ^ 0x80).tobytes()
    if count != info["samples"] or any(info["md5"]) and digest.digest() != info["md5"]:
        raise FlacError("the samples differ from the stream's MD5")


def decode_stream(stream: bytes) -> bytes:
    """Payload bytes of a mono 8-bit stream, frame by frame; checks the stream's MD5."""
    return b"".join(plain_blocks(stream))


@dataclass
class _Part:
    """A group of frames of one stream: bytes from its first frame on, and how many samples they hold."""

    stream: int
    sample: int
    data: bytes
    samples: int
    last: bool


class FlacReader:
    """PCM blocks of FLAC streams, all frames of a batch of groups in step."""

    def payloads(self, streams: list[bytes]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in streams]
        for i, _, pcm in self.blocks(streams):
            out[i].append(pcm)
        return [b"".join(parts) for parts in out]

    def blocks(self, streams: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        """(stream, sample offset, payload bytes) in order; raises FlacError before a stream's end if it is damaged."""
        batch: list[_Part] = []
        held = 0
        state: dict[int, tuple] = {}
        for i, stream in enumerate(streams):
            for part in self._parts(i, stream):
                if batch and held + len(part.data) > GROUP:
                    yield from self._batch(batch, streams, state)
                    batch, held = [], 0
                batch.append(part)
                held += len(part.data)
        yield from self._batch(batch, streams, state)

    @staticmethod
    def _parts(i: int, stream: bytes) -> Iterator[_Part]:
        """Groups of frames, cut at seek points; a stream without usable points is one group."""
        info, points, first = metadata(stream)
        cuts = [(s, first + at) for s, at, n in points if n]
        usable = cuts[:1] == [(0, first)] and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(cuts, cuts[1:])) and cuts[-1][0] < info["samples"] and cuts[-1][1] < len(stream)
        chosen = cuts[:1] if usable else [(0, first)]
        for k, (s, at) in enumerate(cuts[1:] if usable else [], 1):
            end = cuts[k + 1][1] if k + 1 < len(cuts) else len(stream)
            if end - chosen[-1][1] > GROUP:
                chosen.append((s, at))
        ends = [*chosen[1:], (info["samples"], len(stream))]
        for (s, at), (s_end, end) in zip(chosen, ends):
            yield _Part(i, s, stream[at:end], s_end - s, end == len(stream))

    def _batch(self, parts: list[_Part], streams: list[bytes], state: dict[int, tuple]) -> Iterator[tuple[int, int, bytes]]:
        """Blocks of a batch of groups; ``state`` holds the digests of streams whose groups are not all read, None for those that the plain decoder takes over."""
        if not parts:
            return
        buffer = np.frombuffer(b"".join(p.data for p in parts) + bytes(16), np.uint8)
        begin = np.cumsum([0, *(len(p.data) for p in parts)])
        found = self._frame_starts(buffer, begin, parts, [metadata(streams[p.stream])[0] for p in parts])
        starts = np.concatenate([f for f in found if f is not None] or [np.empty(0, np.int64)])
        sizes = np.concatenate([np.diff(np.append(f, begin[i + 1])) for i, f in enumerate(found) if f is not None] or [np.empty(0, np.int64)])
        samples, good = self._frames(buffer, starts, sizes)
        row = 0
        for part, f in zip(parts, found):
            i = part.stream
            x = None
            if f is not None:
                if good[row : row + len(f)].all():
                    x = samples[row : row + len(f)]
                row += len(f)
            if part.sample == 0:
                state[i] = hashlib.md5()
            if state[i] is None:
                continue
            if x is None:  # another shape of frame, or damage that the plain decoder names: it gives all that is left
                state[i], at = None, 0
                for pcm in plain_blocks(streams[i]):
                    if at + len(pcm) > part.sample:
                        yield i, max(at, part.sample), pcm[max(0, part.sample - at) :]
                    at += len(pcm)
                continue
            signed = x.tobytes()
            state[i].update(signed)
            if part.last and state.pop(i).digest() != metadata(streams[i])[0]["md5"]:
                raise FlacError("the samples differ from the stream's MD5")
            yield i, part.sample, (x.reshape(-1).view(np.uint8) ^ 0x80).tobytes()

    @staticmethod
    def _frame_starts(buffer: np.ndarray, begin: np.ndarray, parts: list[_Part], infos: list[dict]) -> list[np.ndarray | None]:
        """Positions of each group's frames by sync code and header checksum; None if their number is not as expected."""
        b = buffer
        at = np.flatnonzero((b[:-16] == 0xFF) & (b[1:-15] == 0xF8) & (b[2:-14] == 0x14) & (b[3:-13] == 0x02))
        lead = b[at + 4]
        length = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
        ok = np.zeros(len(at), bool)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            ok[rows] = crc8_rows(b[at[rows, None] + np.arange(4 + n)]) == b[at[rows] + 4 + n]
        at = at[ok]
        cut = np.searchsorted(at, begin)
        out: list[np.ndarray | None] = []
        for i, (part, info) in enumerate(zip(parts, infos)):
            own = at[cut[i] : cut[i + 1]]
            fits = info["channels"] == 1 and info["bits"] == 8 and len(own) * BLOCK == part.samples and len(own) and own[0] == begin[i]
            out.append(own if fits else None)
        return out

    def _frames(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(samples, whether the frame was verified and decoded) of frames of BLOCK samples."""
        x = np.zeros((len(starts), BLOCK), np.int32)
        stored = buffer[starts + sizes - 2].astype(np.uint16) << np.uint16(8) | buffer[starts + sizes - 1]
        good = crc16_frames(buffer, starts, sizes - 2) == stored if len(starts) else np.zeros(0, bool)
        lead = buffer[starts + 4]
        sub = starts + 6 + np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
        head = buffer[sub]
        kind = (head >> 1).astype(np.int64)
        good &= (head & 0x81) == 0
        signed = buffer.view(np.int8)
        words = np.frombuffer(buffer.tobytes(), ">u1")
        words = (words[:-3].astype(np.uint64) << np.uint64(24)) | (words[1:-2].astype(np.uint64) << np.uint64(16)) | (words[2:-1].astype(np.uint64) << np.uint64(8)) | words[3:].astype(np.uint64)
        rows = np.flatnonzero(kind == 0)
        x[rows] = signed[sub[rows] + 1][:, None]
        rows = np.flatnonzero(kind == 1)
        x[rows] = signed[(sub[rows] + 1)[:, None] + np.arange(BLOCK)]
        good &= (kind <= 1) | (kind >= 8) & (kind <= 12) | (kind >= 32)
        for t in np.unique(kind[kind >= 8]):
            order = int(t - 8 if t < 32 else t - 31)
            rows = np.flatnonzero((kind == t) & good)
            if not len(rows):
                continue
            warm = signed[(sub[rows] + 1)[:, None] + np.arange(order)].astype(np.int32)
            pos = 8 * (sub[rows] + 1 + order)
            coef = shift = None
            if t >= 32:
                precision = self._read(words, pos, np.full(len(rows), 4)) + 1
                shift = self._sign(self._read(words, pos + 4, np.full(len(rows), 5)), 5)
                pos = pos + 9
                coef = []
                for _ in range(order):
                    coef.append(self._sign(self._read(words, pos, precision), precision))
                    pos = pos + precision
            fields = self._read(words, pos, np.full(len(rows), 10))
            plain = (fields >> 4 == 0) & (fields & 15 != 15)
            good[rows[~plain]] = False
            rows, pos, warm, k = rows[plain], pos[plain] + 10, warm[plain], fields[plain] & 15
            res = self._rice(words, pos, k, BLOCK - order)
            x[rows] = self._predict(warm, res, order, None if coef is None else [c[plain] for c in coef], None if shift is None else shift[plain])
        return x.astype(np.int8), good

    @staticmethod
    def _read(words: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Fields of up to 25 bits at bit positions."""
        window = (words[pos >> 3] << (pos & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        return (window >> (32 - n).astype(np.uint64)).astype(np.int64)

    @staticmethod
    def _sign(v: np.ndarray, n) -> np.ndarray:
        return v - ((v >> (n - 1)) << n)

    @staticmethod
    def _rice(words: np.ndarray, pos: np.ndarray, k: np.ndarray, count: int) -> np.ndarray:
        """``count`` Rice codes of each frame, all frames in step."""
        out = np.empty((count, len(pos)), np.int32)
        pos = pos.astype(np.int64)
        down = (32 - k).astype(np.uint64)
        full = np.uint64(0xFFFFFFFF)
        last = len(words) - 1
        for j in range(count):
            window = (words[pos >> 3] << (pos & 7).astype(np.uint64)) & full
            q = np.zeros(len(pos), np.int64)
            while (zero := window == 0).any():  # a run of zeros longer than the window
                q[zero] += 25
                p = np.minimum((pos + q)[zero], 8 * last)
                window[zero] = (words[p >> 3] << (p & 7).astype(np.uint64)) & full
                if (pos + q >= 8 * last).any():
                    raise FlacError("the stream ends within a frame")
            lead = 1054 - (window.astype(np.float64).view(np.int64) >> 52)  # leading zeros of 32 bits
            q += lead
            pos += q + 1
            low = ((words[pos >> 3] << (pos & 7).astype(np.uint64)) & full) >> down
            pos += k
            z = (q << k) | low.astype(np.int64)
            out[j] = (z >> 1) ^ -(z & 1)
        return out.T

    @staticmethod
    def _predict(warm: np.ndarray, res: np.ndarray, order: int, coef, shift) -> np.ndarray:
        if coef is None and order <= 2:
            if order == 0:
                return res
            if order == 1:
                return np.cumsum(np.concatenate((warm, res), axis=1), axis=1, dtype=np.int32)
            slope = np.concatenate((warm[:, :1], warm[:, 1:2] - warm[:, :1], res), axis=1)
            slope[:, 1:] = np.cumsum(slope[:, 1:], axis=1)
            return np.cumsum(slope, axis=1, dtype=np.int32)
        if coef is None:
            coef, shift = [np.full(len(res), c) for c in [(3, -3, 1), (4, -6, 4, -1)][order - 3]], np.zeros(len(res), np.int64)
        x = np.concatenate((warm, np.empty_like(res)), axis=1).astype(np.int64)
        for i in range(order, x.shape[1]):
            x[:, i] = res[:, i - order] + (sum(c * x[:, i - 1 - j] for j, c in enumerate(coef)) >> shift)
        return x.astype(np.int32)


def payload_of(text: bytes | None) -> bytes:
    """A text's UTF-8 bytes, padded with spaces to a positive multiple of BLOCK."""
    data = text or b""
    return data + b" " * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


class Features:
    """Samples, mean, RMS and sign changes of a signal, with digest and tail, from its blocks in order."""

    def __init__(self):
        self.sha, self.tail, self.n, self.sum, self.squares, self.changes, self.negative = hashlib.sha256(), b"", 0, 0, 0, 0, None

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        negative = x < 0
        self.changes += int((negative[1:] != negative[:-1]).sum()) + (self.negative is not None and bool(negative[0]) != self.negative)
        self.n, self.sum, self.squares, self.negative = self.n + len(x), self.sum + int(x.sum()), self.squares + int((x * x).sum()), bool(negative[-1])
        self.sha.update(pcm)
        self.tail = (self.tail + pcm[-16:])[-16:]

    def __str__(self) -> str:
        return f"{self.n}:{self.sum / self.n:.4f}:{(self.squares / self.n) ** 0.5:.4f}:{self.changes}"


def store_flac(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lpc_order: int = 4) -> DataFrame:
    """One row per row: doc_id, n_bytes, media (a FLAC stream of the padded UTF-8 bytes).

    Null texts count as empty: one block of spaces.  Equal texts give equal
    media.  Repeated rows and null ids are carried; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = select_exact(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("binary"))

    def run(slices):
        writer = FlacWriter(lpc_order)
        for part in slices:
            yield {"doc_id": part["doc_id"], "n_bytes": [len(t or b"") for t in part["text"]], "media": writer.streams([payload_of(t) for t in part["text"]])}

    return map_slices(rows, f"doc_id {id_type}, n_bytes long, media binary", {"doc_id": "doc_id", "text": "text"}, run)


def read_flac(stored: DataFrame, media_col: str = "media", carry: tuple[str, ...] = ("doc_id",), payloads: bool = True) -> DataFrame:
    """The ``carry`` columns with payload_bytes, payload_sha256, tail_crc32, feature[, payload], read from the stored bytes block by block.

    A damaged stream raises FlacError; a null stream gives nulls.  Without
    ``payloads`` no more than a group of frames of a stream is held.
    """
    names = {f"k{i}": c for i, c in enumerate(carry)}
    fields = ", ".join(f"{n} {stored.schema[c].dataType.simpleString()}" for n, c in names.items())
    found = ["payload_bytes", "payload_sha256", "tail_crc32", "feature", *(["payload"] if payloads else [])]

    def run(slices):
        reader = FlacReader()
        for part in slices:
            out = part | {k: [None] * len(part["media"]) for k in found}
            rows = [r for r, m in enumerate(part["media"]) if m is not None]
            seen: Features | None = None
            kept: list[bytes] = []

            def close(row: int) -> None:
                values = [seen.n, seen.sha.hexdigest(), zlib.crc32(seen.tail), str(seen), b"".join(kept)]
                for k, v in zip(found, values):
                    out[k][row] = v
                kept.clear()

            row = None
            for i, offset, pcm in reader.blocks([part["media"][r] for r in rows]):
                if offset == 0:
                    if row is not None:
                        close(row)
                    row, seen = rows[i], Features()
                seen.add(pcm)
                if payloads:
                    kept.append(pcm)
            if row is not None:
                close(row)
            yield out

    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string" + (", payload binary" if payloads else "")
    out = map_slices(stored, f"{fields}, {kinds}", names | {"media": media_col}, run)
    return out.select(*(F.col(n).alias(c) for n, c in names.items()), *found)


def pcm_blocks(stored: DataFrame, samples: int = 65_536, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """PCM blocks of each stream: doc_id, sample_offset, samples, pcm; a reader seeks by sample_offset.

    Null streams have no block; null ids and repeated rows are carried; a damaged
    stream raises FlacError; no more than a group of frames and a block of a
    stream is held.
    """
    id_type = stored.schema[id_col].dataType.simpleString()

    def run(slices):
        reader = FlacReader()
        for part in slices:
            keys = [(i, m) for i, m in zip(part["doc_id"], part["media"]) if m is not None]
            now, first, held = None, 0, bytearray()

            def cut(n: int):
                nonlocal first
                yield {"doc_id": [keys[now][0]], "sample_offset": [first], "samples": [n], "pcm": [bytes(held[:n])]}
                first += n
                del held[:n]

            for i, offset, pcm in reader.blocks([m for _, m in keys]):
                if offset == 0:
                    if held:
                        yield from cut(len(held))
                    now, first = i, 0
                held += pcm
                while len(held) > samples:
                    yield from cut(samples)
            if held:
                yield from cut(len(held))

    return map_slices(stored, f"doc_id {id_type}, sample_offset long, samples long, pcm binary", {"doc_id": id_col, "media": media_col}, run)


def seek(stream: bytes, sample: int) -> tuple[int, int]:
    """(first sample, byte position) of the seek point at or before a sample."""
    _, points, first = metadata(stream)
    best = max((p for p in points if p[0] <= sample), default=(0, 0, 0))
    return best[0], first + best[1]


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_flac(documents(spark, sf_dir)).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = read_flac(stored, carry=("doc_id", "n_bytes", "media_bytes", "media_sha256"), payloads=False)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
