"""Progressive JPEG in numpy: scans are accumulated into coefficient arrays, from which RGB tensors are made.

decode_coefficients reads spectral selection and successive approximation (DC and AC, first and refining
scans, interleaved or not, restart intervals) of 8-bit images of one or three components with any integer
sampling; sequential Huffman images of one scan or several are read too. Scans whose codes follow one pattern,
and runs of blocks without new coefficients, are taken in one numpy step; anything else is walked code by code.
to_rgb dequantises, inverse-transforms, upsamples chroma by repetition and converts to full-resolution RGB.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient: along the diagonals, in turning directions."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


@cache
def _inverse() -> np.ndarray:
    """64 x 64: coefficients in zigzag order times this are the 64 samples in rows."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)  # sample x frequency
    full = np.einsum("xu,yv->uvxy", basis, basis).reshape(64, 64)
    return np.ascontiguousarray(full[ZIGZAG]).astype(np.float32)


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks of the component itself
    high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))  # padded to whole MCUs


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comments: list[bytes]
    h_max: int
    v_max: int
    layouts: dict[bytes, "_Layout"] = field(default_factory=dict)  # by the components that a scan names


@lru_cache(maxsize=64)
def _lookup(spec: bytes) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """For each 16 bits ahead, code length * 256 + symbol (0: no code); symbol -> (code, length)."""
    table, codes = [0] * 65536, {}
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            first = code << (16 - length)
            table[first : first + (1 << (16 - length))] = [length << 8 | spec[k]] * (1 << (16 - length))
            codes[spec[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return table, codes


class _Bits:
    """Bits of one entropy-coded segment, by a place that the reader moves."""

    def __init__(self, segment: bytes):
        self.data = segment.replace(b"\xff\x00", b"\xff") + b"\xff" * 4
        self.at = 0

    def ahead(self) -> int:
        k, d = self.at >> 3, self.data
        return (d[k] << 16 | d[k + 1] << 8 | d[k + 2]) >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: list[int]) -> int:
        entry = table[self.ahead()]
        if not entry or self.at >> 3 >= len(self.data) - 4:
            raise ValueError("a scan holds no valid code where one is due")
        self.at += entry >> 8
        return entry & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.ahead() >> (16 - n)
        self.at += n
        if self.at >> 3 > len(self.data) - 3:
            raise ValueError("a scan breaks off")
        return out

    def many(self, n: int) -> np.ndarray:
        """The next n bits."""
        k = self.at >> 3
        raw = np.frombuffer(self.data, np.uint8, min(len(self.data) - k, (n + 15) >> 3), k)
        out = np.unpackbits(raw)[self.at & 7 :][:n]
        if len(out) < n or self.at + n > (len(self.data) - 4) * 8:
            raise ValueError("a scan breaks off")
        self.at += n
        return out


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _uniform(bits: _Bits, table: list[int], n: int) -> tuple[int, np.ndarray] | None:
    """If the next n symbols all have the first one's code: that symbol and their additional bits (n x size)."""
    entry = table[bits.ahead()]
    length, symbol = entry >> 8, entry & 255
    size = symbol & 15
    step = length + size
    if not entry or n < 4 or bits.at + n * step > (len(bits.data) - 4) * 8:
        return None
    start = bits.at
    grid = bits.many(n * step).reshape(n, step)
    if (grid[:, :length] != grid[0, :length]).any():
        bits.at = start
        return None
    return symbol, grid[:, length:]


def _values(extra: np.ndarray) -> np.ndarray:
    size = extra.shape[1]
    v = extra[:, 0].astype(np.int16)  # sizes are below 16
    below = v - np.int16(1)  # -1 where the value is below 0
    for k in range(1, size):
        v <<= 1
        v |= extra[:, k]
    below *= np.int16((1 << size) - 1)
    v += below
    return v


def _dc_first(bits: _Bits, blocks: list[np.ndarray], owners: np.ndarray | None, tables: list[list[int]], al: int) -> None:
    """blocks: each component's blocks (k x 64) in the scan's order; owners: the component of each block, or None for one."""
    if owners is None:
        got = _uniform(bits, tables[0], len(blocks[0]))
        if got is not None and got[0] < 12:
            diffs = _values(got[1]).astype(np.int32) if got[0] else np.zeros(len(blocks[0]), np.int32)
            blocks[0][:, 0] = np.cumsum(diffs) << al
            return
    elif all(t is tables[0] for t in tables):
        start = bits.at
        if (got := _uniform(bits, tables[0], len(owners))) is not None and not got[0]:
            return  # no difference anywhere
        bits.at = start
    at, last = [0] * len(blocks), [0] * len(blocks)
    for c in owners.tolist() if owners is not None else [0] * len(blocks[0]):
        size = bits.symbol(tables[c])
        last[c] += _extend(bits.take(size), size)
        blocks[c][at[c], 0] = last[c] << al
        at[c] += 1


def _dc_refine(bits: _Bits, values: list[np.ndarray], count: int, al: int) -> None:
    """values: each component's DC coefficients. count: units of blocks, each of which has as many of a component, one
    component after another."""
    got = bits.many(sum(x.size for x in values)).astype(np.int16)
    got <<= al
    _dc_put(got, values, count)


def _dc_put(got: np.ndarray, values: list[np.ndarray], count: int) -> None:
    got = got.reshape(count, -1)
    at = 0
    for own in values:
        each = own.size // count
        own |= got[:, at : at + each].reshape(own.shape)
        at += each


def _ac_first(bits: _Bits, blocks: np.ndarray, table: list[int], ss: int, se: int, al: int) -> None:
    got = _uniform(bits, table, len(blocks) * (se - ss + 1))
    if got is not None and 0 < got[0] < 16:
        blocks[:, ss : se + 1] = (_values(got[1]) << al).reshape(len(blocks), -1)
        return
    run = 0
    k = 0
    while k < len(blocks):
        if run:
            skip = min(run, len(blocks) - k)
            run, k = run - skip, k + skip
            continue
        z = ss
        while z <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s:
                z += r
                blocks[k, z] = _extend(bits.take(s), s) * (1 << al)
                z += 1
            elif r == 15:
                z += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break
        k += 1


def _correct(bits: _Bits, part: np.ndarray, al: int, signs: dict, where: tuple) -> None:
    """One correction bit for each coefficient of part that is not 0. signs: those of parts without a 0, which corrections
    leave as they are, by where the part stands."""
    if where not in signs and part.all():
        signs[where] = np.sign(part)
    if where in signs:
        more = bits.many(part.size).reshape(part.shape).astype(np.int16)
        more <<= al
        more *= signs[where]
        part += more
    else:
        known = part != 0
        old = part[known]
        part[known] = old + (bits.many(len(old)).astype(np.int16) << al) * np.sign(old)


def _ac_refine(bits: _Bits, blocks: np.ndarray, table: list[int], ss: int, se: int, al: int, signs: dict, start: int) -> None:
    """start: the number of the first of the blocks; signs as _correct takes them."""
    k = 0
    one = 1 << al
    while k < len(blocks):
        row, z = blocks[k], ss
        while z <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if not s and r < 15:  # the end of this block's new coefficients, and of the next run - 1 blocks'
                run = min((1 << r) + bits.take(r), len(blocks) - k)
                if z == ss:
                    _correct(bits, blocks[k : k + run, ss : se + 1], al, signs, (start + k, run, ss, se))
                else:
                    _correct(bits, row[z : se + 1], al, signs, (start + k, 1, z, se))
                    _correct(bits, blocks[k + 1 : k + run, ss : se + 1], al, signs, (start + k + 1, run - 1, ss, se))
                k += run - 1
                break
            new = (one if bits.take(1) else -one) if s else 0
            while z <= se:
                if row[z]:
                    if bits.take(1):
                        row[z] += one if row[z] > 0 else -one
                elif r:
                    r -= 1
                else:
                    row[z] = new
                    z += 1
                    break
                z += 1
        k += 1


def _sequential(bits: _Bits, blocks: list[np.ndarray], owners: np.ndarray | None, dc: list, ac: list) -> None:
    at, last = [0] * len(blocks), [0] * len(blocks)
    for c in owners.tolist() if owners is not None else [0] * len(blocks[0]):
        row = blocks[c][at[c]]
        at[c] += 1
        size = bits.symbol(dc[c])
        last[c] += _extend(bits.take(size), size)
        row[0], z = last[c], 1
        while z < 64:
            rs = bits.symbol(ac[c])
            r, s = rs >> 4, rs & 15
            if not s and r < 15:
                break
            z += r
            if s:
                row[z] = _extend(bits.take(s), s)
            z += 1


class _Layout:
    """Blocks of the components that a scan names, in its order."""

    def __init__(self, image: Image, named: bytes):
        self.parts = [next(c for c in image.components if c.name == name) for name in named]
        self.owner_unit: list[int] = []
        self.signs: dict[tuple, np.ndarray] = {}
        if len(named) == 1:
            c = self.parts[0]
            self.units = c.high * c.wide
            self.dc = [c.coefficients[: c.high, : c.wide, 0]]
            self.own = c.coefficients[: c.high, : c.wide].reshape(-1, 64)
            self.copied = not np.may_share_memory(c.coefficients, self.own)
            return
        self.at, self.dc = [], []
        for k, c in enumerate(self.parts):
            rows, cols = c.coefficients.shape[0] // c.v, c.coefficients.shape[1] // c.h
            self.at.append(np.arange(rows * c.v * cols * c.h).reshape(rows, c.v, cols, c.h).transpose(0, 2, 1, 3).reshape(-1))
            self.dc.append(c.coefficients[:, :, 0].reshape(rows, c.v, cols, c.h).transpose(0, 2, 1, 3))
            self.owner_unit += [k] * (c.v * c.h)
        self.units = (self.parts[0].coefficients.shape[0] // self.parts[0].v) * (self.parts[0].coefficients.shape[1] // self.parts[0].h)

    def blocks(self, depth: int) -> list[np.ndarray]:
        """Each component's blocks (k x 64), their first `depth` coefficients where they are a copy."""
        if len(self.parts) == 1:
            c = self.parts[0]
            return [c.coefficients[: c.high, : c.wide].reshape(-1, 64) if self.copied else self.own]
        return [c.coefficients.reshape(-1, 64)[at, :depth] for c, at in zip(self.parts, self.at)]

    def put(self, lists: list[np.ndarray], depth: int) -> None:
        """Write blocks back where they are a copy."""
        if len(self.parts) > 1:
            for c, at, x in zip(self.parts, self.at, lists):
                c.coefficients.reshape(-1, 64)[at, :depth] = x
        elif self.copied:
            c = self.parts[0]
            c.coefficients[: c.high, : c.wide] = lists[0].reshape(c.high, c.wide, 64)


def _scan(image: Image, data: bytes, head: bytes, tables: dict, interval: int, progressive: bool) -> None:
    n = head[0]
    named, slots = head[1 : 1 + 2 * n : 2], head[2 : 2 + 2 * n : 2]
    ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    layout = image.layouts.get(named)
    if layout is None:
        layout = image.layouts[named] = _Layout(image, named)
    units = layout.units
    per = interval or units
    segments = _segments(data)
    if progressive and ss == 0 and ah and per >= units:  # in place
        _dc_refine(_Bits(segments[0]), layout.dc, units, al)
        return
    depth = 1 if progressive and ss == 0 else 64
    lists = layout.blocks(depth)
    if ah == 0:
        for other in image.layouts.values():
            other.signs.clear()

    def look(kind: int) -> list[list[int]]:
        specs = [tables.get((kind, slot & 15 if kind else slot >> 4)) for slot in slots]
        return [_lookup(s)[0] if s else [] for s in specs]

    for k, start in enumerate(range(0, units, per)):
        if k >= len(segments):
            raise ValueError("a scan has too few restart intervals")
        count = min(per, units - start)
        bits = _Bits(segments[k])
        own = [x[start * len(x) // units : (start + count) * len(x) // units] for x in lists]
        if progressive and ss == 0 and ah:
            _dc_refine(bits, [x[:, 0] for x in own], count, al)
        elif progressive and ss and ah:
            _ac_refine(bits, own[0], look(1)[0], ss, se, al, layout.signs, start)
        elif progressive and ss:
            _ac_first(bits, own[0], look(1)[0], ss, se, al)
        else:
            owners = np.tile(np.array(layout.owner_unit), count) if n > 1 else None
            if progressive:
                _dc_first(bits, own, owners, look(0), al)
            else:
                _sequential(bits, own, owners, look(0), look(1))
    layout.put(lists, depth)


def _refine_together(image: Image, scans: list[tuple[bytes, bytes]], tables: dict) -> bool:
    """Refining scans of the same coefficients, a bit after a bit, in one step each over all blocks; False, with nothing
    done, where they need a walk. scans: (data, head) of each."""
    head = scans[0][1]
    n = head[0]
    named, ss, se, al = head[1 : 1 + 2 * n : 2], head[1 + 2 * n], head[2 + 2 * n], scans[-1][1][3 + 2 * n] & 15
    layout = image.layouts.get(named)
    if layout is None or len(scans) > 8 or any(_RESTART.search(data) for data, _ in scans):
        return False
    if ss:
        if n > 1 or layout.copied:
            return False
        where = (0, layout.units, ss, se)
        if where not in layout.signs and not layout.own[:, ss : se + 1].all():
            return False
        count, spec = layout.units * (se - ss + 1), tables.get((1, head[2] & 15))
        if spec is None:
            return False
    else:
        count = sum(x.size for x in layout.dc)
    rows, start = [], 0
    for data, own in scans:
        bits = _Bits(data)
        if ss:
            (part,) = (x[:, ss : se + 1] for x in layout.blocks(64))  # in place, as nothing is copied
            symbol = bits.symbol(_lookup(spec)[0])
            r = symbol >> 4
            if symbol & 15 or r == 15 or (1 << r) + bits.take(r) < layout.units or rows and bits.at != start:
                return False
        start = bits.at
        if start + count > (len(bits.data) - 4) * 8:
            return False
        rows.append(bits.data[: (start + count + 7) >> 3])
    planes = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1)[:, start : start + count]
    got = planes[0].copy()
    for plane in planes[1:]:
        got <<= 1
        got |= plane
    more = got.astype(np.int16)
    more <<= al
    if not ss:
        _dc_put(more, layout.dc, layout.units)
        return True
    if where not in layout.signs:
        layout.signs[where] = np.sign(part)
    part += more.reshape(part.shape) * layout.signs[where]
    return True


def _scans(image: Image, scans: list[tuple[bytes, bytes]], tables: dict, interval: int, progressive: bool) -> None:
    if len(scans) > 1 and _refine_together(image, scans, tables):
        return
    for data, head in scans:
        _scan(image, data, head, tables, interval, progressive)


def _goes_on(last: bytes, head: bytes) -> bool:
    """Whether a scan refines the same coefficients as the last one by the next bit."""
    return last[:-1] == head[:-1] and last[-1] >> 4 and head[-1] >> 4 == last[-1] & 15 == (head[-1] & 15) + 1


_RESTART, _MARKER = re.compile(rb"\xff[\xd0-\xd7]"), re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def _segments(data: bytes) -> list[bytes]:
    return _RESTART.split(data)


def _scan_end(data: bytes, at: int) -> int:
    """Where the next marker other than a restart stands."""
    found = _MARKER.search(data, at)
    if found is None:
        raise ValueError("the image breaks off")
    return found.start()


def decode_coefficients(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that starts at a place in data, and the place after it."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at += 2
    quant, tables, comments = {}, {}, []
    image, interval, progressive = None, 0, True
    held: list[tuple[bytes, bytes]] = []  # scans that may be taken together
    while True:
        if data[at : at + 1] != b"\xff":
            raise ValueError("a marker is due")
        kind = data[at + 1]
        if held and kind != 0xDA:
            _scans(image, held, tables, interval, progressive)
            held = []
        if kind == 0xD9:
            if image is None:
                raise ValueError("the image has no frame")
            return image, at + 2
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float32)
                k += 65 + 64 * bool(wide)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k] >> 4, body[k] & 15] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            comments.append(body)
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3) or not height or not width:
                raise ValueError("only 8-bit images of one or three components are read")
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            h_max, v_max = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.wide, c.high = -(-(-(-width * c.h // h_max)) // 8), -(-(-(-height * c.v // v_max)) // 8)
                c.coefficients = np.zeros((-(-height // (8 * v_max)) * c.v, -(-width // (8 * h_max)) * c.h, 64), np.int16)
            image = Image(width, height, parts, quant, comments, h_max, v_max)
        elif kind == 0xDA:
            end = _scan_end(data, at)
            if image is None:
                raise ValueError("a scan comes before its frame")
            if held and (interval or not progressive or not _goes_on(held[-1][1], body)):
                _scans(image, held, tables, interval, progressive)
                held = []
            held.append((data[at:end], body))
            at = end
        elif not (0xE0 <= kind <= 0xEF):
            raise ValueError(f"marker {kind:#x} is not read")


def to_rgb(image: Image) -> np.ndarray:
    """height x width x 3, uint8. One component is grey; three are taken as YCbCr."""
    planes = []
    for c in image.components:
        blocks = c.coefficients[: c.high, : c.wide].reshape(-1, 64).astype(np.float32) * image.quant[c.table]
        samples = np.clip(np.rint(blocks @ _inverse()) + 128, 0, 255).astype(np.int16)
        planes.append(samples.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8))

    def full(plane: np.ndarray, h: int, v: int) -> np.ndarray:
        """A plane, or planes side by side, at the image's resolution: samples are repeated."""
        up_v, up_h = image.v_max // v, image.h_max // h
        if up_h > 1:
            plane = np.repeat(plane, up_h, axis=1)
        if up_v > 1:
            plane = np.repeat(plane, up_v, axis=0)
        return plane[: image.height, : image.width]

    first = image.components[0]
    y = full(planes[0], first.h, first.v)
    if len(planes) == 1:
        return np.repeat(y.astype(np.uint8)[:, :, None], 3, axis=2)
    blue, red = image.components[1:]
    cb, cr = planes[1] - np.int16(128), planes[2] - np.int16(128)
    if (blue.h, blue.v) != (red.h, red.v):
        cb, cr = full(cb, blue.h, blue.v), full(cr, red.h, red.v)
        blue = first
    shape = tuple(min(a, b) for a, b in zip(cb.shape, cr.shape))
    cb, cr = cb[: shape[0], : shape[1]], cr[: shape[0], : shape[1]]
    # what chroma adds to each colour is worked out before it is upsampled
    tint = np.empty((*cb.shape, 3), np.int16)
    tint[:, :, 0] = _tints()[0][cr + 128]
    tint[:, :, 1] = np.rint(_tints()[1][cb + 128] + _tints()[2][cr + 128])
    tint[:, :, 2] = _tints()[3][cb + 128]
    if blue is not first:
        tint = full(tint, blue.h, blue.v)
    out = tint + y[:, :, None]
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


@lru_cache(maxsize=1)
def _tints() -> tuple[np.ndarray, ...]:
    """For each chroma sample: what red chroma adds to red, what both take from green, what blue chroma adds to blue."""
    x = np.arange(-128, 128, dtype=np.float32)
    return np.rint(1.402 * x).astype(np.int16), -0.344136 * x, -0.714136 * x, np.rint(1.772 * x).astype(np.int16)
