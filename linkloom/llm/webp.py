"""Media columns in lossless WebP (operator 5).

The decoder reads prefix codes, back-references and the colour cache, groups
of codes chosen by an entropy image, and inverts the predictor, cross-colour,
subtract-green and palette transforms; it gives arrays of ARGB pixels. The
encoder chooses per picture the size of the colour cache, codes runs as
back-references, and can apply each of the transforms.

A text is stored as pixels of four bytes. Defined cases: a null text is empty
and stored as one unit of 64 zero bytes; payloads over ``PART_PIXELS`` are
several files one after another; repeated texts give equal media; an empty
table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import small_batches, table
from linkloom.plans.tables import materialize

SIDE = 1 << 14
PART_PIXELS = 1 << 26
_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_HASH = 0x1E35A7BD
_PLANE = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


class FormatError(ValueError):
    """The bytes are not a lossless WebP picture."""


# --- prefix codes -------------------------------------------------------------


@lru_cache(maxsize=16)
def _reversal(bits: int) -> np.ndarray:
    r = np.zeros(1 << bits, np.int64)
    for k in range(bits):
        r |= (np.arange(1 << bits) >> k & 1) << (bits - 1 - k)
    return r


@lru_cache(maxsize=512)
def _line(lengths: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Lookup by the next bits (low end first): symbols and lengths; and the mask of an index."""
    x = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(x)
    if not len(used):
        raise FormatError("a code without symbols")
    if len(used) == 1:
        return used.astype(np.int64), np.zeros(1, np.uint8), 0
    top = int(x.max())
    order = used[np.argsort(x[used], kind="stable")]
    size = np.int64(1) << (top - x[order].astype(np.int64))
    if size.sum() != 1 << top:
        raise FormatError("a code that is not complete")
    line = np.repeat(order, size)[_reversal(top)]
    return line, x[line], (1 << top) - 1


def _table(lengths: bytes, shift: int = 4) -> tuple[list[int], int]:
    """Lookup by the next bits: symbol << shift | length; and the mask of an index."""
    symbols, sizes, mask = _line(lengths)
    return (symbols << shift | sizes).tolist(), mask


def code_lengths(counts: dict[int, int], limit: int = 15) -> dict[int, int]:
    """Lengths of a prefix code that suits the counts, none above ``limit``."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    weight = counts
    while True:
        heap = [(n, s) for s, n in weight.items()]
        heapq.heapify(heap)
        parent: dict[int, int] = {}
        made = -1
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = made
            heapq.heapreplace(heap, (a[0] + b[0], made))
            made -= 1
        depth = {made + 1: 0}
        for k in range(made + 2, 0):
            depth[k] = depth[parent[k]] + 1
        out = {s: depth[parent[s]] + 1 for s in weight}
        if max(out.values()) <= limit:
            return out
        weight = {s: (n >> 2) + 1 for s, n in weight.items()}


def codewords(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed so that they are written low end first."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used):
        order = used[np.argsort(lengths[used], kind="stable")]
        top = int(lengths[order[-1]])
        width = np.int64(1) << (top - lengths[order])
        codes[order] = _reversal(top)[np.cumsum(width) - width & (1 << top) - 1]
    return codes


# --- decoder ------------------------------------------------------------------


class Reader:
    """Bits, low end first; past the end come zeros, and ``check`` tells."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data + bytes(48), 0, 0, 0
        self.size = len(data)

    def read(self, n: int) -> int:
        while self.n < n:
            self.acc |= int.from_bytes(self.data[self.at : self.at + 4], "little") << self.n
            self.at += 4
            self.n += 32
            if self.at > self.size + 12:
                raise FormatError("data end too early")
        v = self.acc & ((1 << n) - 1)
        self.acc >>= n
        self.n -= n
        return v

    def symbol(self, code: tuple[list[int], int]) -> int:
        tab, mask = code
        if self.n < 15:
            self.acc |= int.from_bytes(self.data[self.at : self.at + 4], "little") << self.n
            self.at += 4
            self.n += 32
        e = tab[self.acc & mask]
        n = e & 15
        self.acc >>= n
        self.n -= n
        return e >> 4

    def place(self) -> int:
        """Bits read so far."""
        return self.at * 8 - self.n

    def same(self, place: int, n: int) -> bool:
        """Whether the next n bits are those from ``place`` on."""
        here, mask = self.place(), (1 << n) - 1
        a, b = (int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & mask for p in (here, place))
        return a == b

    def skip(self, n: int) -> None:
        self.go(self.place() + n)

    def go(self, here: int) -> None:
        self.at, self.acc, self.n = here >> 3, 0, 0
        self.read(here & 7)


#: In the tables of a group's five codes each symbol lies where a pixel has it.
_SHIFTS = (12, 20, 4, 28, 4)


def _read_codes(r: Reader, sizes: tuple[int, ...]) -> list[bytes]:
    """Lengths of the five codes of a group."""
    out, before = [], (0, 0, 0, b"")
    for n in sizes:
        if n == before[0] and r.same(before[1], before[2]):  # equal bits are an equal code
            r.skip(before[2])
        else:
            start = r.place()
            lengths = _read_lengths(r, n)
            before = (n, start, r.place() - start, lengths)
        out.append(before[3])
    return out


def _read_lengths(r: Reader, alphabet: int) -> bytes:
    lengths = bytearray(alphabet)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise FormatError("a symbol outside the alphabet")
        for s in symbols:
            lengths[s] = 1
        return bytes(lengths)
    first = bytearray(19)
    for k in range(r.read(4) + 4):
        first[_ORDER[k]] = r.read(3)
    code = _table(bytes(first))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        n, v = (3 + r.read(2), last) if s == 16 else (3 + r.read(3), 0) if s == 17 else (11 + r.read(7), 0)
        if at + n > alphabet:
            raise FormatError("code lengths beyond the alphabet")
        lengths[at : at + n] = bytes([v]) * n
        at += n
    return bytes(lengths)


def _prefixed(r: Reader, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.read(extra) + 1


def _image(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """Pixels of an entropy-coded picture; groups of codes only in the outermost."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise FormatError("a colour cache that is too large")
    groups, choose, block, across = 1, None, 0, 0
    if top and r.read(1):
        block = r.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        choose = (_image(r, across, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).tolist()
        groups = max(choose) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [_read_codes(r, sizes) for _ in range(groups)]
    total, out = width * height, []
    if not cache_bits and choose is None and total >= 64:
        return _literals_together(r, codes[0], width, total)
    codes = [[_table(x, k) for x, k in zip(group, _SHIFTS)] for group in codes]
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    data, at, acc, n, size = r.data, r.at, r.acc, r.n, r.size + 12
    (gt, gm), (rt, rm), (bt, bm), (ht, hm), distance = codes[0]
    add, done, now, refill = out.append, 0, 0, int.from_bytes
    while done < total:
        if choose is not None:
            g = choose[(done // width >> block) * across + (done % width >> block)]
            if g != now:
                now = g
                (gt, gm), (rt, rm), (bt, bm), (ht, hm), distance = codes[g]
        if n < 60:
            acc |= refill(data[at : at + 24], "little") << n
            at += 24
            n += 192
            if at > size + 24:
                raise FormatError("data end too early")
        g = gt[acc & gm]
        k = g & 15
        if g < 1048576:  # a green value; red, blue and alpha follow
            e = rt[acc >> k & rm]
            k += e & 15
            f = bt[acc >> k & bm]
            k += f & 15
            h = ht[acc >> k & hm]
            k += h & 15
            acc >>= k
            n -= k
            p = (g | e | f | h) >> 4
            add(p)
            done += 1
            if cache_bits:
                cache[(p * 506832829 & 0xFFFFFFFF) >> shift] = p
            continue
        acc >>= k
        n -= k
        s = g >> 12
        if s >= 280:
            add(cache[s - 280])
            done += 1
            continue
        r.at, r.acc, r.n = at, acc, n
        length = _prefixed(r, s - 256)
        d = _distance(_prefixed(r, r.symbol(distance)), width)
        at, acc, n = r.at, r.acc, r.n
        if d > done or done + length > total:
            raise FormatError("a back-reference outside the picture")
        if d >= length:
            part = out[done - d : done - d + length]
        else:
            part = (out[done - d :] * (length // d + 1))[:length]
        out += part
        done += length
        if cache_bits:
            for p in part if d >= length else part[:d]:
                cache[(p * _HASH & 0xFFFFFFFF) >> shift] = p
    # what was read ahead goes back
    r.at, r.acc, r.n = at, acc, n
    return np.array(out, np.uint32)


#: Bits of the stream that ``_literals_together`` looks at in one go.
_AHEAD = 1 << 19


#: Length that stands for a symbol that is no literal.
_OTHER = 255


def _literals_together(r: Reader, group: list[bytes], width: int, total: int) -> np.ndarray:
    """Pixels of a picture with one group of codes and no colour cache.

    For every bit place the length of a literal pixel that begins there is
    looked up at once; following these jumps gives the literals between two
    back-references, whose values are then looked up together.
    """
    out, done, place = np.empty(total, np.uint32), 0, r.place()
    lines = [_line(x) for x in group[:4]]
    values = [(symbols << k - 4).astype(np.uint32) for (symbols, _, _), k in zip(lines, _SHIFTS)]
    sizes = [np.where(lines[0][0] < 256, lines[0][1], np.uint8(_OTHER)), *(x[1] for x in lines[1:])]
    masks = [x[2] for x in lines]
    green, distance = _table(group[0]), None
    lanes = np.ndarray((len(r.data) - 3,), "<u4", buffer=r.data, strides=(1,))
    while done < total:
        if place > r.size * 8:
            raise FormatError("data end too early")
        first = place >> 3
        part = lanes[first : first + (_AHEAD >> 3) + 8]
        w = ((part[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0x7FFF)).astype(np.intp).ravel()
        n = len(w) - 60
        if n <= 0:
            raise FormatError("data end too early")
        begin = sizes[0][w[:n] & masks[0]]
        special = begin == _OTHER
        jump = np.arange(n) + np.where(special, 0, begin)
        steps, seen = [jump], {}
        for x, size, mask in zip(group[1:4], sizes[1:], masks[1:]):
            if x not in seen:  # equal codes are looked up once
                seen[x] = size[w & mask]
            jump = jump + seen[x][jump]
            steps.append(jump)
        jump[special] = -1
        follow, at, places = memoryview(jump), place - first * 8, []
        add, left = places.append, total - done
        while left and at < n and (q := follow[at]) >= 0:
            add(at)
            at = q
            left -= 1
        if places:
            here = np.array(places)
            p = values[0][w[here] & masks[0]]
            for v, mask, prior in zip(values[1:], masks[1:], steps):
                p |= v[w[prior[here]] & mask]
            out[done : done + len(here)] = p
            done += len(here)
        place = first * 8 + at
        if done < total and at < n and special[at]:
            r.go(place)
            s = r.symbol(green) - 256
            if s >= 24:
                raise FormatError("a colour that is not kept")
            length = _prefixed(r, s)
            distance = distance or _table(group[4])
            d = _distance(_prefixed(r, r.symbol(distance)), width)
            if d > done or done + length > total:
                raise FormatError("a back-reference outside the picture")
            out[done : done + length] = np.resize(out[done - d : done], length) if d < length else out[done - d : done - d + length]
            done += length
            place = r.place()
    r.go(place)
    return out


def _distance(d: int, width: int) -> int:
    if d > 120:
        return d - 120
    x, y = _PLANE[d - 1]
    return max(1, x + y * width)


def _channels(p: np.ndarray) -> list[np.ndarray]:
    return [(p >> s & 0xFF).astype(np.int64) for s in (24, 16, 8, 0)]


def _argb(a, r, g, b) -> np.ndarray:
    return ((a & 0xFF) << 24 | (r & 0xFF) << 16 | (g & 0xFF) << 8 | b & 0xFF).astype(np.uint32)


def _mean(a, b):
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _bytes4(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _select(left: int, up: int, corner: int) -> int:
    pl = pt = 0
    for a, b, c in zip(_bytes4(left), _bytes4(up), _bytes4(corner)):
        pl += abs(b - c)  # distance of the estimate a + b - c from a
        pt += abs(a - c)
    return left if pl < pt else up


def _clamped(fn, *pixels: int) -> int:
    p = 0
    for parts in zip(*map(_bytes4, pixels)):
        p = p << 8 | min(255, max(0, fn(*parts)))
    return p


def predict(mode: int, left: int, up: int, right: int, corner: int) -> int:
    """A pixel from those to the left, above, above right and above left."""
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode < 5:
        return (left, up, right, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), up)
    if mode < 10:
        return _mean(*((left, corner), (left, up), (corner, up), (up, right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(up, right))
    if mode == 11:
        return _select(left, up, corner)
    if mode == 12:
        return _clamped(lambda a, b, c: a + b - c, left, up, corner)
    # the division truncates towards zero
    return _clamped(lambda a, c: a + int((a - c) / 2), _mean(left, up), corner)


def _sum(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _modes(blocks: np.ndarray, bits: int, across: int, x: int, y: int) -> int:
    return int(blocks[(y >> bits) * across + (x >> bits)]) >> 8 & 15


def _predicted(mode_at, out: list[int], width: int, i: int) -> int:
    y, x = divmod(i, width)
    if not i:
        return 0xFF000000
    if not y:
        return out[i - 1]
    if not x:
        return out[i - width]
    return predict(mode_at(x, y), out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])


def _undo_predictor(p: np.ndarray, width: int, blocks: np.ndarray, bits: int) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    mode_at = lambda x, y: _modes(blocks, bits, across, x, y)
    out: list[int] = []
    for i, res in enumerate(p.tolist()):
        out.append(_sum(res, _predicted(mode_at, out, width, i)))
    return np.array(out, np.uint32)


def _cross(p: np.ndarray, width: int, blocks: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Cross-colour transform; sign 1 undoes it."""
    i = np.arange(len(p))
    across = (width + (1 << bits) - 1) >> bits
    e = blocks[(i // width >> bits) * across + (i % width >> bits)]
    signed = lambda v: (v & 0xFF).astype(np.int8).astype(np.int64)
    to_red, to_blue, red_blue = signed(e), signed(e >> 8), signed(e >> 16)
    a, r, g, b = _channels(p)
    green = signed(g)
    red = r + sign * (to_red * green >> 5)
    known = red if sign > 0 else r
    b = b + sign * (to_blue * green >> 5) + sign * (red_blue * signed(known) >> 5)
    return _argb(a, red, g, b)


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels (height x width, ARGB as 32-bit numbers) of one file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
        raise FormatError("not a lossless WebP file")
    (size,) = struct.unpack_from("<I", data, 16)
    r = Reader(data[21 : 20 + size])
    width, height, _, version = r.read(14) + 1, r.read(14) + 1, r.read(1), r.read(3)
    if version:
        raise FormatError("unknown version")
    undo, w, seen = [], width, set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise FormatError("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            bits = r.read(3) + 2
            blocks = _image(r, (w + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
            undo.append((kind, w, blocks, bits))
        elif kind == 2:
            undo.append((2, w, None, 0))
        else:
            n = r.read(8) + 1
            steps = _image(r, n, 1, False)
            colours = _argb(*(np.cumsum(c) for c in _channels(steps)))
            bits = _palette_bits(n)
            undo.append((3, w, colours, bits))
            w = (w + (1 << bits) - 1) >> bits
    p = _image(r, w, height, True)
    for kind, wide, extra, bits in reversed(undo):
        if kind == 0:
            p = _undo_predictor(p, wide, extra, bits)
        elif kind == 1:
            p = _cross(p, wide, extra, bits, 1)
        elif kind == 2:
            a, red, g, b = _channels(p)
            p = _argb(a, red + g, g, b + g)
        else:
            index = (p >> 8 & 0xFF).astype(np.int64).reshape(height, -1)
            if bits:
                x = np.arange(wide)
                each = 8 >> bits
                index = index[:, x >> bits] >> ((x & ((1 << bits) - 1)) * each) & ((1 << each) - 1)
            full = np.zeros(256, np.uint32)  # indices beyond the palette are transparent black
            full[: len(extra)] = extra
            p = full[index].ravel()
    return p.reshape(height, width)


# --- encoder ------------------------------------------------------------------


class Writer:
    def __init__(self) -> None:
        self.acc, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.acc |= v << self.n
        self.n += n


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        wide = used[0] > 1
        w.put(wide, 1)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    items: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    end = used[-1] + 1
    edges = np.flatnonzero(np.diff(lengths[:end])) + 1
    starts = [0, *edges.tolist()]
    for v, run in zip(lengths[starts].tolist(), np.diff(starts, append=end).tolist()):
        if v:
            items.append((v, 0, 0))
            run -= 1
            while run >= 3:
                n = min(run, 6)
                items.append((16, n - 3, 2))
                run -= n
            items += [(v, 0, 0)] * run
        else:
            while run >= 11:
                n = min(run, 138)
                items.append((18, n - 11, 7))
                run -= n
            if run >= 3:
                items.append((17, run - 3, 3))
                run = 0
            items += [(0, 0, 0)] * run
    counts = Counter([s for s, _, _ in items])
    if len(counts) == 1:
        counts[0 if 0 not in counts else 1] += 0
    first = code_lengths(dict(counts), 7)
    x = np.zeros(19, np.int64)
    for s, n in first.items():
        x[s] = n
    codes = codewords(x)
    last = max(k for k in range(19) if x[_ORDER[k]])
    n = max(4, last + 1)
    w.put(0, 1)
    w.put(n - 4, 4)
    for k in range(n):
        w.put(int(x[_ORDER[k]]), 3)
    if end == len(lengths):
        w.put(0, 1)
    else:  # so many items are all
        need = max(2, (len(items) - 2).bit_length())
        need += need & 1
        w.put(1, 1)
        w.put((need - 2) // 2, 3)
        w.put(len(items) - 2, need)
    word, size, acc, at = codes.tolist(), x.tolist(), 0, 0
    for s, v, bits in items:
        acc |= (word[s] | v << size[s]) << at
        at += size[s] + bits
    w.put(acc, at)


def _lengths_array(counts: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    used = np.flatnonzero(counts)
    got = code_lengths(dict(zip(used.tolist(), counts[used].tolist())), 10 if len(used) <= 300 else 15)  # short codes make small tables
    for s, n in got.items():
        out[s] = n
    return out


def _put_image(w: Writer, p: np.ndarray, top: bool, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Write the head of a picture; give values and lengths of its bits."""
    n = len(p)
    same = np.zeros(n + 1, np.int8)
    same[1:n] = p[1:] == p[:-1]
    edge = np.diff(same, prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= 4
    begin, end = begin[long], end[long]
    run = np.zeros(n, bool)  # pixels that a run's back-reference gives
    for b, e in zip(begin.tolist(), end.tolist()):
        run[b:e] = True
    copies = [(b + k, min(4096, e - b - k)) for b, e in zip(begin.tolist(), end.tolist()) for k in range(0, e - b, 4096)]
    green = (p >> 8 & 0xFF).astype(np.int64)
    hit = np.zeros(n, bool)
    if cache_bits:
        slot = ((p.astype(np.uint64) * np.uint64(_HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        o = np.argsort(slot, kind="stable")
        again = (slot[o[1:]] == slot[o[:-1]]) & (p[o[1:]] == p[o[:-1]])
        hit[o[1:][again]] = True
    literal = ~hit & ~run
    symbol = np.where(hit, 280 + (slot if cache_bits else 0), green)
    starts = np.array([s for s, _ in copies], np.int64)
    token = ~run
    token[starts] = True
    extra_v, extra_n = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if copies:
        size = np.array([c for _, c in copies], np.int64) - 1
        big = size >= 4
        high = np.where(big, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64), 0)
        second = np.where(big, size >> np.maximum(high - 1, 0) & 1, 0)
        code = np.where(big, 2 * high + second, size)
        extra_n[starts] = np.where(big, high - 1, 0)
        extra_v[starts] = np.where(big, size & ((np.int64(1) << np.maximum(high - 1, 0)) - 1), 0)
        symbol[starts] = 256 + code
        literal[starts] = False
    gl = _lengths_array(np.bincount(symbol[token], minlength=1), 280 + (1 << cache_bits if cache_bits else 0))
    rest = [(p[literal] >> s & 0xFF).astype(np.int64) for s in (16, 0, 24)]
    joint = _lengths_array(np.bincount(np.concatenate(rest), minlength=1), 256)  # one code for red, blue and alpha
    dl = np.zeros(40, np.int64)
    dl[1] = bool(copies)  # distance 1 is number 2 of the near ones, symbol 1
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)
    if np.count_nonzero(gl) == 1 and np.flatnonzero(gl)[0] >= 256:
        gl[0] = 1
    _put_code(w, gl)
    once = Writer()
    _put_code(once, joint)
    for _ in range(3):
        w.put(once.acc, once.n)
    _put_code(w, dl)
    gc, jc = codewords(gl), codewords(joint)
    if np.count_nonzero(gl) == 1:
        gl = np.zeros_like(gl)
        gc = np.zeros_like(gc)
    if np.count_nonzero(joint) == 1:
        joint, jc = np.zeros_like(joint), np.zeros_like(jc)
    values, bits = gc[symbol], gl[symbol]
    values = values | extra_v << bits
    bits = bits + extra_n
    for c in rest:
        values[literal] |= jc[c] << bits[literal]
        bits[literal] += joint[c]
    return values[token], bits[token]


def _joined(w: Writer, values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, int]:
    """The writer's bits and then all values, as 64-bit words, and the number of bits."""
    total = w.n + int(bits.sum())
    words = np.zeros((total >> 6) + 2, np.uint64)
    if len(values):
        at = w.n + np.cumsum(bits) - bits
        v, place, shift = values.astype(np.uint64), at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        words[place[first]] |= np.bitwise_or.reduceat(v << shift, first)
        words[place[first] + 1] |= np.bitwise_or.reduceat(np.where(shift > 0, v >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)), first)
    lead = np.frombuffer(w.acc.to_bytes(((w.n >> 6) + 1) * 8, "little"), "<u8")
    words[: len(lead)] |= lead
    return words, total


def _flat(w: Writer, p: np.ndarray, top: bool = False, cache_bits: int = 0) -> None:
    words, total = _joined(w, *_put_image(w, p, top, cache_bits))
    w.acc, w.n = int.from_bytes(words.tobytes(), "little"), total


def encode(p: np.ndarray, cache_bits: int | None = None, transforms: tuple = ()) -> bytes:
    """A file of pixels (height x width).

    ``transforms``, in order: ("predictor", bits, blocks), ("cross", bits,
    blocks), ("green",), ("palette",); blocks are the pixels of the transform's
    own picture.
    """
    height, width = p.shape
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    q, wide = p.astype(np.uint32).ravel(), width
    for t in transforms:
        w.put(1, 1)
        if t[0] == "predictor":
            _, bits, blocks = t
            across = (wide + (1 << bits) - 1) >> bits
            flat = q.tolist()
            mode_at = lambda x, y, b=blocks, k=bits, a=across: _modes(b, k, a, x, y)
            pred = [_predicted(mode_at, flat, wide, i) for i in range(len(flat))]
            q = _argb(*(a - b for a, b in zip(_channels(q), _channels(np.array(pred, np.uint32)))))
            w.put(0, 2)
            w.put(bits - 2, 3)
            _flat(w, blocks)
        elif t[0] == "cross":
            _, bits, blocks = t
            q = _cross(q, wide, blocks, bits, -1)
            w.put(1, 2)
            w.put(bits - 2, 3)
            _flat(w, blocks)
        elif t[0] == "green":
            a, r, g, b = _channels(q)
            q = _argb(a, r - g, g, b - g)
            w.put(2, 2)
        else:
            colours, index = np.unique(q, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            w.put(3, 2)
            w.put(len(colours) - 1, 8)
            _flat(w, _argb(*(np.diff(c, prepend=0) for c in _channels(colours))))
            bits = _palette_bits(len(colours))
            index = index.reshape(height, wide)
            new = (wide + (1 << bits) - 1) >> bits
            packed = np.zeros((height, new << bits), np.int64)
            packed[:, :wide] = index
            packed = packed.reshape(height, new, 1 << bits)
            g = sum(packed[:, :, k] << (k * (8 >> bits)) for k in range(1 << bits))
            q, wide = (g.ravel() << 8 | 0xFF000000).astype(np.uint32), new
    w.put(0, 1)
    if cache_bits is None:
        cache_bits = 0
    values, bits = _put_image(w, q, True, cache_bits)
    words, total = _joined(w, values, bits)
    data = b"\x2f" + words.tobytes()[: (total + 7) >> 3]
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


# --- media column -------------------------------------------------------------


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def smallest(p: np.ndarray) -> bytes:
    """The smallest file of a picture; where pixels recur, a palette and a colour cache are tried too."""
    plain = encode(p)
    colours = len(np.unique(p))
    if colours * 3 > p.size:
        return plain
    made = [plain]
    if colours <= 256:
        made.append(encode(p, transforms=(("palette",),)))
    if colours <= 2048:
        made.append(encode(p, max(1, min(11, (2 * colours - 1).bit_length()))))
    return min(made, key=len)


def store(payload: bytes) -> bytes:
    """One file for each ``PART_PIXELS`` pixels of the payload."""
    p = np.frombuffer(payload, "<u4")
    out = []
    for at in range(0, len(p), PART_PIXELS):
        part = p[at : at + PART_PIXELS]
        width = 16
        while -(-len(part) // width) > SIDE:
            width *= 2
        height = -(-len(part) // width)
        full = np.zeros(width * height, np.uint32)
        full[: len(part)] = part
        out.append(smallest(full.reshape(height, width)))
    return b"".join(out)


def load(media: bytes) -> list[np.ndarray]:
    """The pictures of files that lie one after another."""
    out, at = [], 0
    while at < len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        out.append(decode(media[at : at + 8 + size]))
        at += 8 + size
    return out


def feature(pictures: list[np.ndarray]) -> str:
    """Height, width, mean of each channel in hundredths, and how often neighbours in a row are equal."""
    h, w = sum(p.shape[0] for p in pictures), pictures[0].shape[1]
    n = sum(p.size for p in pictures)
    means = [sum(int((p >> s & 0xFF).sum(dtype=np.int64)) for p in pictures) * 100 // n for s in (24, 16, 8, 0)]
    equal = sum(int((p[:, 1:] == p[:, :-1]).sum()) for p in pictures)
    return f"{h}x{w}:{','.join(map(str, means))}:{equal}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and media (the stored files) of every document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes, full, media = [], [], []
            for t in b.column("text").to_pylist():
                n, payload = payload_of(t)
                sizes.append(n)
                full.append(len(payload))
                media.append(store(payload))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(full, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Decode a media column; digests and a feature of what was read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            shas, tails, sizes, own, features = [], [], [], [], []
            for m, n in zip(b.column("media").to_pylist(), b.column("payload_bytes").to_pylist()):
                pictures = load(m)
                payload = b"".join(p.astype("<u4").tobytes() for p in pictures)[:n]
                shas.append(hashlib.sha256(payload).hexdigest())
                tails.append(zlib.crc32(payload[-64:]))
                sizes.append(len(m))
                own.append(hashlib.sha256(m).hexdigest())
                features.append(feature(pictures))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), b.column("payload_bytes"), pa.array(shas, pa.string()), pa.array(tails, pa.int64()), pa.array(sizes, pa.int64()), pa.array(own, pa.string()), pa.array(features, pa.string())],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return media_digests(materialize(media_column(table(spark, sf_dir, "documents")), "media"))
