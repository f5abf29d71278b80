"""Baseline JPEG: a parser and entropy decoder in numpy, and a writer for lossless DC samples.

The decoder handles sequential baseline frames (8 bits, Huffman, one interleaved scan of one to four components, any
sampling factors, with or without restart intervals). It reconstructs only the first component's DC terms: a
thumbnail with one sample for each 8 x 8 block. Restart intervals are independent, so those of many images are
decoded side by side, one block of each at a time.

The writer stores bytes as the DC terms of a grey frame: with quantiser 8, a block's quantised DC term is its mean
grey level less 128, so one block holds one 8-bit sample and decoding gives it back exactly.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Blocks in a row of the frames written here; each row is a restart interval.
ROW = 64
#: Rows in a frame at most: a frame's height is a 16-bit number of pixels. Longer payloads take several frames.
FRAME_ROWS = 65535 // 8
_SHIFT = np.uint64(48)


class JpegError(ValueError):
    """Not a baseline JPEG that this decoder reads."""


#: What bytes that are no whole baseline JPEG can raise: a bad marker, a missing table, a body that is too short.
ERRORS = (JpegError, struct.error, IndexError, KeyError, ValueError)


@dataclass
class Frame:
    """What the markers of one image say, and its entropy-coded bytes by restart interval."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)  # (class, id): the 16 counts, then the symbols
    restart: int = 0
    intervals: list[np.ndarray] = field(default_factory=list)


def parse(data: bytes) -> list[Frame]:
    """The frames of one or more JPEG images that follow each other in data."""
    frames, at, frame = [], 0, None
    while at < len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at byte {at}")
        marker = data[at + 1] if at + 1 < len(data) else 0
        at += 2
        if marker == 0xFF:  # a fill byte
            at -= 1
        elif marker == 0xD8:
            frame = Frame()
        elif frame is None:
            raise JpegError("no start of image")
        elif marker == 0xD9:
            frames.append(frame)
            frame = None
        else:
            if at + 2 > len(data):
                raise JpegError("cut off")
            size = struct.unpack_from(">H", data, at)[0]
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xC0:
                bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise JpegError("only 8-bit samples")
                frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise JpegError("not a baseline frame")
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    frame.tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                frame.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                order = [c[0] for c in frame.components]
                frame.scan = [(order.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                at = _entropy(frame, data, at)
    return frames


def _entropy(frame: Frame, data: bytes, at: int) -> int:
    """Cut the scan's bytes into restart intervals and take out stuffed zeros; returns where the next marker is."""
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[ff + 1]
    stop = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))]
    end = int(stop[0]) if len(stop) else len(raw)
    here = ff < end
    ff, follow = ff[here], follow[here]
    cuts = ff[follow != 0]
    stuffed = ff[follow == 0] + 1
    keep = np.ones(end, bool)
    keep[stuffed[stuffed < end]] = False
    for a, b in zip([0, *(cuts + 2).tolist()], [*cuts.tolist(), end], strict=True):
        frame.intervals.append(raw[a:b][keep[a:b]])
    return at + end


def _lookup(table: bytes) -> np.ndarray:
    """For every 16-bit prefix: symbol << 8 | length of its code; length 0 where there is no code."""
    out = np.zeros(1 << 16, np.int64)
    code = at = 0
    for length in range(1, 17):
        for symbol in table[16 + at : 16 + at + table[length - 1]]:
            out[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
            code += 1
        at += table[length - 1]
        code <<= 1
    return out


def _whole_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For every 16-bit prefix that holds a whole block without AC terms: its DC difference << 8 | its length; else 0."""
    prefix = np.arange(1 << 16, dtype=np.int64)
    length, size = dc & 255, dc >> 8
    value = np.where(size > 0, (prefix >> np.maximum(16 - length - size, 0)) & ((1 << np.minimum(size, 16)) - 1), 0)
    value -= np.where(value < (1 << np.maximum(size - 1, 0)), (1 << size) - 1, 0) * (size > 0)
    after = ac[(prefix << np.minimum(length + size, 16)) & 0xFFFF]
    whole = length + size + (after & 255)
    fits = (length > 0) & (after & 255 > 0) & (after >> 8 == 0) & (whole <= 16)
    return np.where(fits, value << 8 | whole, 0).astype(np.int32)


def _mcu(frame: Frame) -> tuple[list[tuple[int, int, int]], int, int]:
    """Blocks of a minimum coded unit as (component's place, DC table, AC table), and units across and down."""
    if len(frame.scan) == 1:
        return frame.scan, -(-frame.width // 8), -(-frame.height // 8)
    h, v = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    blocks = [s for s in frame.scan for _ in range(frame.components[s[0]][1] * frame.components[s[0]][2])]
    return blocks, -(-frame.width // (8 * h)), -(-frame.height // (8 * v))


def dc_terms(frames: list[Frame]) -> list[np.ndarray]:
    """The quantised DC terms of each frame's first component, in scan order, before dequantising."""
    kinds: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        if not f.scan or not f.components:
            raise JpegError("no scan")
        kinds.setdefault((tuple(f.scan), tuple(f.components[1:]) and tuple(f.components), tuple(sorted(f.tables.items()))), []).append(i)
    out: list[np.ndarray | None] = [None] * len(frames)
    for same in kinds.values():
        for i, terms in zip(same, _decode([frames[i] for i in same]), strict=True):
            out[i] = terms
    return out


def _decode(frames: list[Frame]) -> list[np.ndarray]:
    """DC terms of frames that share tables and layout; all their restart intervals advance together."""
    blocks = _mcu(frames[0])[0]
    units, chunks = [], []
    for f in frames:
        total = _mcu(f)[1] * _mcu(f)[2]
        if not total:
            raise JpegError("no size")
        each = f.restart or total
        if len(f.intervals) < -(-total // each):
            raise JpegError("an interval is missing")
        counts = [min(each, total - k) for k in range(0, total, each)]
        units += counts
        chunks += f.intervals[: len(counts)]
    n = np.array(units, np.int64)
    sizes = np.array([len(c) for c in chunks], np.int64)
    if (8 * sizes < 2 * len(blocks) * n).any():  # a block has two codes; checked before room is made for the terms
        raise JpegError("an interval is cut off")
    # 24 bits from every byte on; ones beyond the end, as in the padding of an interval.
    flat = np.concatenate([*chunks, np.full(8, 255, np.uint8)])
    ahead = flat[:-7].astype(np.int32) << 16 | flat[1:-6].astype(np.int32) << 8 | flat[2:-5]
    start = (np.cumsum(sizes) - sizes) * 8
    limit = start + sizes * 8
    tables = {(c, t): _lookup(frames[0].tables[c, t]) for _, dc, ac in blocks for c, t in ((0, dc), (1, ac))}
    whole = {(dc, ac): _whole_blocks(tables[0, dc], tables[1, ac]) for _, dc, ac in blocks}
    order = np.argsort(-n, kind="stable")  # those still running are always a prefix
    n, pos, limit = n[order], start[order].copy(), limit[order]
    pred = {place: np.zeros(len(n), np.int64) for place, _, _ in blocks}
    per = sum(b[0] == blocks[0][0] for b in blocks)
    terms = np.zeros((len(n), int(n[0]) * per if len(n) else 0), np.int16)
    for unit in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -unit, "left"))
        k = 0
        for place, dc, ac in blocks:
            p = pos[:live]
            quick = whole[dc, ac][(ahead[p >> 3] >> (8 - (p & 7))) & 0xFFFF]
            pred[place][:live] += quick >> 8
            p = p + (quick & 255)
            slow = np.flatnonzero(quick == 0)
            if len(slow):
                value, p[slow] = _block(p[slow], flat, tables[0, dc], tables[1, ac])
                pred[place][slow] += value
            if (p > limit[:live]).any():
                raise JpegError("an interval is cut off")
            pos[:live] = p
            if place == blocks[0][0]:
                terms[:live, unit * per + k] = pred[place][:live]
                k += 1
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out, at = [], 0
    for f in frames:
        total = _mcu(f)[1] * _mcu(f)[2]
        each = f.restart or total
        rows = len(range(0, total, each))
        own = terms[back[at : at + rows]]
        out.append(np.concatenate([r[: units[at + i] * per] for i, r in enumerate(own)]) if rows else np.empty(0, np.int16))
        at += rows
    return out


def _ahead(p: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The 57 bits or more from each bit position on, at the top of 64."""
    at = np.minimum(p >> 3, len(flat) - 8)
    word = np.zeros(len(p), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | flat[at + j]
    return word << (p & 7).astype(np.uint64)


def _block(p: np.ndarray, flat: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The DC differences of the blocks that begin at bits p, and where each block ends."""
    w = _ahead(p, flat)
    code = dc[(w >> _SHIFT).astype(np.int64)]
    length, size = code & 255, code >> 8
    w <<= length.astype(np.uint64)
    value = ((w >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
    value -= np.where(value < (np.int64(1) << np.maximum(size - 1, 0)), (np.int64(1) << size) - 1, 0)
    p = p + length + size
    bad = (length == 0).any()
    index = np.ones(len(p), np.int64)
    more = np.arange(len(p))
    while len(more) and not bad:
        code = ac[(_ahead(p[more], flat) >> _SHIFT).astype(np.int64)]
        bad = (code & 255 == 0).any()
        s = code >> 8
        p[more] += (code & 255) + (s & 15)
        index[more] += np.where(s == 0xF0, 16, (s >> 4) + 1)
        more = more[(s != 0) & (index[more] < 64)]
    if bad:
        raise JpegError("no such code")
    return value, p


def thumbnails(images: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each byte string, its frames as (width, height, luminance thumbnail of uint8)."""
    parsed = [parse(b) for b in images]
    terms = iter(dc_terms([f for fs in parsed for f in fs]))
    return [[(f.width, f.height, _thumbnail(f, next(terms))) for f in fs] for fs in parsed]


def _thumbnail(f: Frame, terms: np.ndarray) -> np.ndarray:
    _, across, down = _mcu(f)
    q = int(f.quantisers[f.components[f.scan[0][0]][3]][0])
    levels = np.clip(np.round(terms.astype(np.int64) * q / 8) + 128, 0, 255).astype(np.uint8)
    if len(f.scan) == 1:
        return levels.reshape(down, across)
    _, h, v, _ = f.components[f.scan[0][0]]
    full = levels.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    top_h, top_v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    return full[: -(-(-(-f.height * v // top_v)) // 8), : -(-(-(-f.width * h // top_h)) // 8)]


# The writer's tables: DC sizes 0 to 8 and the single AC symbol "end of block".
_DC_TABLE = bytes([0, 0, 0, 9, *[0] * 12, *range(9)])
_AC_TABLE = bytes([1, *[0] * 15, 0])


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For every difference from -255 to 255: a block's whole code, and its length. A code of 4 bits for the size, the
    value's bits, and one bit for the end of the block."""
    diff = np.arange(-255, 256)
    size = np.array([abs(d).bit_length() for d in diff.tolist()])
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return ((size << (size + 1)) | (bits << 1)).astype(np.int32), (size + 5).astype(np.int32)


_CODE, _LENGTH = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, bytes([0, *[8] * 64])),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, b"\x00" + _DC_TABLE),
            _segment(0xC4, b"\x10" + _AC_TABLE),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def write_dc(payload: bytes) -> bytes:
    """Payload (a positive multiple of 64 bytes) as grey baseline frames with one block for each byte."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(_write_frame(samples[a : a + FRAME_ROWS]) for a in range(0, len(samples), FRAME_ROWS))


def _write_frame(samples: np.ndarray) -> bytes:
    rows = len(samples)
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1]
    diff[:, 0] -= 128
    diff += 255
    length = _LENGTH[diff]
    end = np.cumsum(length, axis=1, dtype=np.int32)
    used = end[:, -1]
    width = (used + 7) // 8
    first = np.cumsum(width, dtype=np.int64) - width
    at = end - length
    shifted = (_CODE[diff] << (24 - length - (at & 7))).ravel()
    byte = ((at >> 3) + first[:, None]).ravel()
    total = int(width.sum())
    raw = np.zeros(total + 2)
    for j in range(3):  # a code touches three bytes at most; no two codes share a bit, so sums are unions
        raw[j:] += np.bincount(byte, (shifted >> (16 - 8 * j)) & 255, total + 2 - j)[: total + 2 - j]
    raw = raw.astype(np.int32)
    last = first + width - 1
    raw[last] |= (1 << (8 * width - used)) - 1  # pad with ones
    # Stuff a zero after each 255 and put a restart marker between intervals.
    raw = raw[:total].astype(np.uint8)
    after = (raw == 255).astype(np.int64)
    after[last[:-1]] += 2
    where = np.arange(total) + np.cumsum(after) - after
    out = np.zeros(total + int(after.sum()), np.uint8)
    out[where] = raw
    ends = where[last[:-1]] + 1 + (raw[last[:-1]] == 255)
    out[ends] = 0xFF
    out[ends + 1] = 0xD0 + np.arange(rows - 1) % 8
    return _header(rows) + out.tobytes() + b"\xff\xd9"
