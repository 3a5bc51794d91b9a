"""Progressive JPEG in numpy: many images at once, coefficient-exact both ways.

Reading follows the standard: spectral selection and successive approximation of all scans of a file are
gathered in arrays of coefficients. The entropy-coded stretches between restart markers don't depend on each other, so those
of all images of a batch are decoded in lockstep, one symbol (or coefficient) of each at a time. Sums are
of whole numbers throughout, so a result doesn't depend on what else is in the batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: The zigzag order, by its rule.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else i % 8)))
_COSINE = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) / 2 * (np.sqrt(0.5) if u == 0 else 1) for x in range(8)] for u in range(8)])
#: The transform's factors as whole numbers; products of them and coefficients are exact in double precision.
_SCALE = 4096
_MATRIX = np.rint(_COSINE * _SCALE)

# Huffman codes


def code_lengths(weights: dict[int, float], longest: int = 16) -> dict[int, int]:
    """Lengths of a prefix code of bounded length (package-merge); one more code, all ones, stays free as the format wants."""
    items = sorted([(w, (s,)) for s, w in weights.items()] + [(0.0, (-1,))])
    level: list = []
    for _ in range(longest):
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(items + packages)
    lengths = dict.fromkeys([*weights, -1], 0)
    for _, symbols in level[: 2 * len(items) - 2]:
        for s in symbols:
            lengths[s] += 1
    lengths[max(weights, key=lambda s: (lengths[s], s))], lengths[-1] = lengths[max(weights, key=lambda s: (lengths[s], s))], lengths[-1]
    del lengths[-1]
    return lengths


def table_bytes(lengths: dict[int, int]) -> bytes:
    """The body of a table in a DHT segment: how many codes of each length, and the symbols."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order)


def codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, length = np.zeros(256, np.uint32), np.zeros(256, np.int64)
    value, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            code[table[at]], length[table[at]] = value, n
            value += 1
            at += 1
        value <<= 1
    return code, length


def lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: symbol + 256 * length."""
    out = np.zeros(65536, np.int32)
    code, length = codes(table)
    for s in np.flatnonzero(length):
        a = int(code[s]) << (16 - int(length[s]))
        out[a : a + (1 << (16 - int(length[s])))] = s + 256 * length[s]
    return out


# Files


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[bytes, bytes]]
    start: int
    stop: int
    high: int
    low: int
    restart: int
    parts: list[bytes]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[bytes] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


_DATA_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at, quant, tables, restart, ids, which = Image(), 2, {}, {}, 0, [], []
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = body[1 : 65 + 64 * wide] if not wide else np.frombuffer(body[1:129], ">u2").astype("<u2").tobytes()
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xC2:
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                c = body[6 + 3 * k : 9 + 3 * k]
                ids.append(c[0])
                out.sampling.append((c[1] >> 4, c[1] & 15))
                which.append(c[2])
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            n = body[0]
            comps = [ids.index(body[1 + 2 * k]) for k in range(n)]
            own = [(tables.get(body[2 + 2 * k] >> 4, b""), tables.get(16 | body[2 + 2 * k] & 15, b"")) for k in range(n)]
            m = _DATA_END.search(data, at)
            end = m.start() if m else len(data)
            parts = [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(data[at:end])]
            a, b, c = body[1 + 2 * n : 4 + 2 * n]
            out.scans.append(Scan(comps, own, a, b, c >> 4, c & 15, restart, parts))
            at = end
    out.quant = [quant[w] for w in which]
    return out


# Decoding


class _Bits:
    """The bytes of many stretches side by side, read at many places at once."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], np.int64) + 8
        b = np.frombuffer(b"".join(p + b"\0" * 8 for p in parts) + b"\0" * 8, np.uint8).astype(np.uint32)
        self.words = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        self.begin = (np.cumsum(sizes) - sizes) * 8
        self.last = 8 * (len(self.words) - 8)

    def peek16(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits (16 at most) of each."""
        return (self.peek16(at) >> (16 - n).astype(np.uint32)).astype(np.int64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 3] >> (31 - (at & 7)).astype(np.uint32)) & np.uint32(1)).astype(np.int64)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def _dc(coef: np.ndarray, bits: _Bits, table: np.ndarray, first: np.ndarray, count: np.ndarray, slots: list[int], luts: list[np.ndarray], high: int, low: int) -> None:
    """A scan of first coefficients. ``table`` has the blocks of all stretches; slots: the component of each block of an MCU."""
    at, n = bits.begin.copy(), len(first)
    if high:  # one bit a block
        lane = np.repeat(np.arange(n), count)
        j = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
        where = table[np.repeat(first, count) + j] * 64
        coef[where] |= (bits.bit(np.minimum(at[lane] + j, bits.last)) << low).astype(coef.dtype)
        return
    last = np.zeros((n, max(slots) + 1), np.int64)
    alive = np.arange(n)
    for j in range(int(count.max(initial=0))):
        alive = alive[count[alive] > j]
        c = slots[j % len(slots)]
        got = luts[c][bits.peek16(np.minimum(at[alive], bits.last))]
        p, size = at[alive] + (got >> 8), (got & 255).astype(np.int64)
        last[alive, c] += _extend(bits.take(np.minimum(p, bits.last), size), size)
        at[alive] = p + size
        coef[table[first[alive] + j] * 64] = last[alive, c] << low


def _ac_first(coef: np.ndarray, bits: _Bits, table: np.ndarray, first: np.ndarray, count: np.ndarray, lut: np.ndarray, start: int, stop: int, low: int) -> None:
    at, j, k, end, base = bits.begin.copy(), np.zeros(len(first), np.int64), np.full(len(first), start, np.int64), count.copy(), first.copy()
    step = 0
    while True:
        if step % 16 == 0:
            alive = j < end
            if not alive.all():
                at, j, k, end, base = at[alive], j[alive], k[alive], end[alive], base[alive]
            if not len(at):
                return
        step += 1
        at = np.minimum(at, bits.last)
        got = lut[bits.peek16(at)]
        run, size = (got >> 4) & 15, (got & 15).astype(np.int64)
        at = at + (got >> 8)
        eob = (size == 0) & (run < 15)
        v = bits.take(np.minimum(at, bits.last), np.where(eob, run, size))
        at = at + np.where(eob, run, size)
        k = k + run
        put = np.flatnonzero((size > 0) & (j < end) & (k <= stop))
        coef[table[base[put] + j[put]] * 64 + k[put]] = _extend(v[put], size[put]) << low
        k = k + 1
        over = eob | (k > stop)
        j = j + np.where(eob, (1 << run) + v, over)
        k = np.where(over, start, k)


def _ac_refine(coef: np.ndarray, bits: _Bits, table: np.ndarray, first: np.ndarray, count: np.ndarray, lut: np.ndarray, start: int, stop: int, low: int) -> None:
    n, one = len(first), 1 << low
    at, j, k, end, base = bits.begin.copy(), np.zeros(n, np.int64), np.full(n, start, np.int64), count.copy(), first.copy()
    run, new, skip = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)  # run -1: a symbol is due; skip: blocks left of an end-of-band run
    block = table[np.minimum(base, len(table) - 1)] * 64
    step = 0
    while True:
        if step % 16 == 0:
            alive = j < end
            if not alive.all():
                at, j, k, end, base, run, new, skip, block = (x[alive] for x in (at, j, k, end, base, run, new, skip, block))
            if not len(at):
                return
        step += 1
        at = np.minimum(at, bits.last)
        due = np.flatnonzero((run < 0) & (skip == 0))
        if len(due):
            p = at[due]
            got = lut[bits.peek16(p)]
            r, size = ((got >> 4) & 15).astype(np.int64), (got & 15).astype(np.int64)
            p = p + (got >> 8)
            eob = (size == 0) & (r < 15)
            v = bits.take(np.minimum(p, bits.last), np.where(eob, r, size))
            at[due] = p + np.where(eob, r, size)
            skip[due] = np.where(eob, (1 << r) + v, 0)
            run[due] = np.where(eob, -1, r)
            new[due] = np.where(size > 0, np.where(v > 0, one, -one), 0)
        at = np.minimum(at, bits.last)
        where = block + k
        c = coef[where].astype(np.int64)
        old = c != 0
        ended = j >= end
        fix = old & (bits.bit(at) > 0) & ((np.abs(c) & one) == 0)
        at = at + old
        c = c + np.where(fix, np.where(c > 0, one, -one), 0)
        zero = ~old & (skip == 0)
        place = zero & (run == 0)
        c = np.where(place, new, c)
        keep = np.flatnonzero((fix | place) & ~ended)
        coef[where[keep]] = c[keep]
        run = run - zero
        k = k + 1
        over = np.flatnonzero(k > stop)
        if len(over):
            k[over] = start
            j[over] += 1
            run[over] = -1
            skip[over] = np.maximum(skip[over] - 1, 0)
            block[over] = table[np.minimum(base[over] + j[over], len(table) - 1)] * 64


def _layout(image: Image) -> list[tuple[int, int, int, int]]:
    """Of each component: blocks across and down as stored (whole MCUs), and as coded in scans of their own."""
    mw, mh = image.grid()
    h, v = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
    return [(mw * a, mh * b, -(-(-(-image.width * a // h)) // 8), -(-(-(-image.height * b // v)) // 8)) for a, b in image.sampling]


def coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image and component the quantised coefficients: blocks down, across, 64 in zigzag order."""
    out: list[list[np.ndarray]] = [[] for _ in images]
    groups: dict = {}
    for i, im in enumerate(images):
        groups.setdefault((tuple(im.sampling), tuple((tuple(s.components), tuple(s.tables), s.start, s.stop, s.high, s.low) for s in im.scans)), []).append(i)
    for members in groups.values():
        _group([images[i] for i in members], [out[i] for i in members])
    return out


def _group(images: list[Image], out: list[list[np.ndarray]]) -> None:
    layouts = [_layout(im) for im in images]
    offsets, total = [], 0
    for lay in layouts:
        offsets.append([])
        for a, b, _, _ in lay:
            offsets[-1].append(total)
            total += a * b
    coef = np.zeros(total * 64, np.int16)
    luts: dict[bytes, np.ndarray] = {}
    places: dict = {}
    lut = lambda t: luts.setdefault(t, lookup(t)) if t else np.zeros(65536, np.int32)
    for s in range(len(images[0].scans)):
        scan = images[0].scans[s]
        comps = scan.components
        parts, tables, counts, slots = [], [], [], [0]
        for im, lay, off in zip(images, layouts, offsets, strict=True):
            own = im.scans[s]
            blocks, unit, slots = places.get((id(im), tuple(comps)), (None, 1, [comps[0]]))
            if blocks is not None:
                pass
            elif len(comps) > 1:
                mw, mh = im.grid()
                cells = []
                slots = []
                for c in comps:
                    a, b = im.sampling[c]
                    rows = np.arange(mh)[:, None, None, None] * b + np.arange(b)[None, None, :, None]
                    cols = np.arange(mw)[None, :, None, None] * a + np.arange(a)[None, None, None, :]
                    cells.append((off[c] + rows * lay[c][0] + cols).reshape(mw * mh, a * b))
                    slots += [c] * (a * b)
                blocks, unit = np.concatenate(cells, 1).ravel(), len(slots)
            else:
                across, _, cols, rows = lay[comps[0]]
                blocks, unit = (off[comps[0]] + np.arange(rows)[:, None] * across + np.arange(cols)[None]).ravel(), 1
                slots = [comps[0]]
            places[id(im), tuple(comps)] = blocks, unit, slots
            size = own.restart * unit or len(blocks)
            n = min(len(own.parts), -(-len(blocks) // size))
            parts += own.parts[:n]
            tables.append(blocks)
            counts += [min(size, len(blocks) - i * size) for i in range(n)]
            if n < -(-len(blocks) // size):  # stretches that are missing leave their coefficients as they are
                tables[-1] = blocks[: n * size]
        table, count = np.concatenate(tables), np.array(counts, np.int64)
        first = np.cumsum(count) - count
        bits = _Bits(parts)
        if scan.start == 0:
            _dc(coef, bits, table, first, count, slots, _by_component(comps, [lut(t[0]) for t in scan.tables]), scan.high, scan.low)
        else:
            (_ac_refine if scan.high else _ac_first)(coef, bits, table, first, count, lut(scan.tables[0][1]), scan.start, scan.stop, scan.low)
    for lay, off, own in zip(layouts, offsets, out, strict=True):
        own += [coef[o * 64 : (o + a * b) * 64].reshape(b, a, 64) for (a, b, _, _), o in zip(lay, off, strict=True)]


def _by_component(comps: list[int], luts: list[np.ndarray]) -> list[np.ndarray]:
    out = [luts[0]] * (max(comps) + 1)
    for c, t in zip(comps, luts, strict=True):
        out[c] = t
    return out


def samples(blocks: np.ndarray, quant: bytes) -> np.ndarray:
    """The inverse transform: blocks of zigzag coefficients to a plane of 8-bit samples."""
    down, across, _ = blocks.shape
    q = np.frombuffer(quant, np.uint8 if len(quant) == 64 else "<u2").astype(np.float64)
    natural = np.empty((down * across, 64))
    natural[:, ZIGZAG] = blocks.reshape(-1, 64) * q
    x = natural.reshape(-1, 8, 8)
    y = _MATRIX.T @ x @ _MATRIX
    y = np.floor(y / _SCALE**2 + 0.5) + 128
    plane = np.clip(y, 0, 255).astype(np.uint8).reshape(down, across, 8, 8)
    return plane.transpose(0, 2, 1, 3).reshape(down * 8, across * 8)


def pixels(image: Image, coef: list[np.ndarray]) -> np.ndarray:
    """Full-resolution RGB, (height, width, 3): chroma is repeated up to the size of luma."""
    h, v = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
    planes = []
    for (a, b), c, q in zip(image.sampling, coef, image.quant, strict=True):
        p = samples(c, q)
        if a != h:
            p = p.repeat(h // a, 1)
        if b != v:
            p = p.repeat(v // b, 0)
        planes.append(p[: image.height, : image.width])
    if len(planes) < 3:
        return np.repeat(planes[0][..., None], 3, 2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    # The factors of the colour space, times 2^16.
    rgb = [y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb]
    return np.stack([np.clip((c + half) >> 16, 0, 255) for c in rgb], 2).astype(np.uint8)


# Encoding


def _bits_of(v: np.ndarray) -> np.ndarray:
    """How many bits the magnitude has."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _magnitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _pack(values: np.ndarray, lengths: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """Bit strings, joined for each of n owners (which never fall) and filled up with ones to whole bytes."""
    total = np.bincount(owner, lengths, n).astype(np.int64)
    size = -(-total // 8)
    begin = (np.cumsum(size) - size) * 8
    before = np.cumsum(lengths) - lengths
    base = np.zeros(n, np.int64)
    base[1:] = np.cumsum(total)[:-1]
    at = begin[owner] + before - base[owner]
    pad = size * 8 - total
    out = np.zeros((int(size.sum()) >> 2) + 3, np.uint32)
    for v, k, p in ((values, lengths, at), ((1 << pad) - 1, pad, begin + total)):
        use = k > 0
        v, k, p = v[use].astype(np.uint64), k[use], p[use]
        if not len(v):
            continue
        word = p >> 5
        v = v << (64 - k - (p & 31)).astype(np.uint64)
        cut = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[cut]] |= np.bitwise_or.reduceat(v >> np.uint64(32), cut).astype(np.uint32)
        out[word[cut] + 1] |= np.bitwise_or.reduceat(v & np.uint64(0xFFFFFFFF), cut).astype(np.uint32)
    data = out.byteswap().tobytes()
    return [data[b : b + s] for b, s in zip((begin >> 3).tolist(), size.tolist(), strict=True)]


def _dc_items(v: np.ndarray, fresh: np.ndarray, slot: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """v: first coefficients in coded order; fresh: a restart is before it; slot: its component."""
    diff = np.empty_like(v)
    interval = np.cumsum(fresh)
    for c in np.unique(slot):
        own = np.flatnonzero(slot == c)
        x = v[own]
        diff[own] = x - np.where(np.diff(interval[own], prepend=-1) != 0, 0, np.concatenate([[0], x[:-1]]))
    code, length = codes(table)
    size = _bits_of(diff)
    return (code[size].astype(np.uint64) << size.astype(np.uint64)) | _magnitude(diff, size), length[size] + size


def _ac_first_items(x: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a band of blocks, each (blocks, band); also the block of each code."""
    code, length = codes(table)
    n, width = x.shape
    block, k = np.nonzero(x)
    v = x[block, k].astype(np.int64)
    new = np.diff(block, prepend=-1) != 0
    run = k - np.where(new, 0, np.concatenate([[0], k[:-1] + 1]))
    long = run >> 4
    size = _bits_of(v)
    symbol = ((run & 15) << 4) | size
    last = np.full(n, -1)
    last[block] = k
    eob = last < width - 1
    # Every code's place: after those of earlier coefficients and the ends of earlier blocks.
    ends = np.cumsum(eob) - eob
    place = np.arange(len(v)) + np.cumsum(long) + ends[block]
    total = len(v) + int(long.sum()) + int(eob.sum())
    out, size_out, owner = np.full(total, code[0xF0], np.uint64), np.full(total, length[0xF0]), np.zeros(total, np.int64)
    out[place] = (code[symbol].astype(np.uint64) << size.astype(np.uint64)) | _magnitude(v, size)
    size_out[place] = length[symbol] + size
    per = np.bincount(block, 1 + long, n).astype(np.int64) + eob
    stop = np.cumsum(per)
    at = stop[eob] - 1
    out[at], size_out[at] = code[0], length[0]
    owner = np.repeat(np.arange(n), per)
    return out, size_out, owner


def _ac_refine_items(x: np.ndarray, low: int, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the next bit of coefficients; a symbol comes before the correction bits that precede it in the block."""
    code, length = codes(table)
    n, width = x.shape
    a = np.abs(x) >> low
    fix, new, zero = a > 1, a == 1, a == 0
    zeros = np.cumsum(zero, 1, dtype=np.int16)
    since = zeros - np.maximum.accumulate(np.where(new, zeros, 0), 1)
    later = np.logical_or.accumulate(new[:, ::-1], 1)[:, ::-1]
    long = zero & (since > 0) & (since % 16 == 0) & later
    items = np.zeros((n, width + 1), bool)
    items[:, :width] = fix | new | long
    event = new | long
    last = np.where(event.any(1), width - 1 - event[:, ::-1].argmax(1), -1)
    items[:, width] = last < width - 1
    block, k = np.nonzero(items)
    eob = k == width
    at = np.minimum(k, width - 1)
    is_fix = fix[block, at] & ~eob
    is_new = new[block, at] & ~eob
    events = np.flatnonzero(~is_fix)
    place = np.arange(len(k)) + 1
    place[events] = np.concatenate([[0], events[:-1] + 1])
    z = zeros[block[events], at[events]].astype(np.int64)
    same = np.diff(block[events], prepend=-1) == 0
    run = z - np.where(same, np.concatenate([[0], z[:-1]]), 0)
    e_new, e_eob = is_new[events], eob[events]
    symbol = np.where(e_eob, 0, np.where(e_new, (run << 4) | 1, 0xF0))
    values, sizes = np.zeros(len(k), np.uint64), np.ones(len(k), np.int64)
    sign = (x[block[events], at[events]] > 0) & e_new
    values[place[events]] = (code[symbol].astype(np.uint64) << e_new.astype(np.uint64)) | sign.astype(np.uint64)
    sizes[place[events]] = length[symbol] + e_new
    fixes = np.flatnonzero(is_fix)
    values[place[fixes]] = a[block[fixes], k[fixes]] & 1
    return values, sizes, block


#: Weights from which the codes are built: of sizes, and how fast those of runs fall.
_DC_TABLE = table_bytes(code_lengths({s: 0.7**s for s in range(12)}))
_AC_TABLE = table_bytes(code_lengths({r << 4 | s: 0.3**r * (0.22, 0.3, 0.26, 0.12, 0.05, 0.02, 0.005, 0.002, 0.001, 0.001)[s - 1] for r in range(16) for s in range(1, 11)} | {0: 0.02, 0xF0: 1e-4}))
_FIX_TABLE = table_bytes(code_lengths({r << 4 | 1: 0.7**r for r in range(16)} | {0: 0.2, 0xF0: 0.001}))
#: Blocks of luma and chroma MCUs between restart markers.
RESTART_MCUS, RESTART_BLOCKS = 8, 32


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(images: list[list[np.ndarray]], comments: list[bytes]) -> list[bytes]:
    """Progressive files of three components, chroma halved both ways, with all quantisers 1.

    ``images``: of each the coefficients of the components, (down, across, 64) in zigzag order. The scans: first coefficients without their
    last bit; of each component a low band without its last bit and a high band whole; then the last bits.
    """
    n = len(images)
    mcus = [im[1].shape[0] * im[1].shape[1] for im in images]
    dc = []
    for im in images:
        rows, cols = im[1].shape[:2]
        y = im[0][..., 0].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(rows * cols, 4)
        dc.append(np.concatenate([y, im[1][..., 0].reshape(-1, 1), im[2][..., 0].reshape(-1, 1)], 1))
    dc_values = np.concatenate(dc).astype(np.int64).ravel()
    flat = [np.concatenate([im[c].reshape(-1, 64) for im in images]) for c in range(3)]
    counts = [[im[c].shape[0] * im[c].shape[1] for im in images] for c in range(3)]

    def owners(per_image: list[int], step: int) -> tuple[np.ndarray, list[int]]:
        """Which restart interval each unit is in, and how many each image has."""
        k = [-(-c // step) for c in per_image]
        begin = np.cumsum(k) - k
        local = np.arange(sum(per_image)) - np.repeat(np.cumsum(per_image) - per_image, per_image)
        return np.repeat(begin, per_image) + local // step, k

    of_mcu, mcu_parts = owners(mcus, RESTART_MCUS)
    of_dc = np.repeat(of_mcu, 6)
    slot = np.tile([0, 0, 0, 0, 1, 2], sum(mcus))
    fresh = np.diff(of_dc, prepend=-1) != 0
    scans = []
    v, s = _dc_items(dc_values >> 1, fresh, slot, _DC_TABLE)
    scans.append((b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x01", RESTART_MCUS, _pack(v, s, of_dc, sum(mcu_parts)), mcu_parts))
    intervals = [owners(counts[c], RESTART_BLOCKS) for c in range(3)]
    for c in range(3):
        low, high = flat[c][:, 1:6], flat[c][:, 6:]
        for first, last, x, bit in ((1, 5, np.where(low < 0, -(-low >> 1), low >> 1), 1), (6, 63, high, 0)):
            v, s, block = _ac_first_items(x, _AC_TABLE)
            scans.append((bytes([1, c + 1, 0, first, last, bit]), RESTART_BLOCKS, _pack(v, s, intervals[c][0][block], sum(intervals[c][1])), intervals[c][1]))
    scans.append((b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x10", RESTART_MCUS, _pack(dc_values & 1, np.ones(len(dc_values), np.int64), of_dc, sum(mcu_parts)), mcu_parts))
    for c in range(3):
        v, s, block = _ac_refine_items(flat[c][:, 1:6], 0, _FIX_TABLE)
        scans.append((bytes([1, c + 1, 1, 1, 5, 0x10]), RESTART_BLOCKS, _pack(v, s, intervals[c][0][block], sum(intervals[c][1])), intervals[c][1]))
    tables = _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC4, b"\x00" + _DC_TABLE) + _segment(0xC4, b"\x10" + _AC_TABLE) + _segment(0xC4, b"\x11" + _FIX_TABLE)
    out = []
    begin = [0] * len(scans)
    for i in range(n):
        rows, cols = images[i][1].shape[:2]
        frame = _segment(0xC2, b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        file = [b"\xff\xd8", _segment(0xFE, comments[i]), tables, frame]
        restart = None
        for k, (head, step, data, parts) in enumerate(scans):
            if step != restart:
                file.append(_segment(0xDD, step.to_bytes(2, "big")))
                restart = step
            file.append(_segment(0xDA, head))
            own = data[begin[k] : begin[k] + parts[i]]
            begin[k] += parts[i]
            for r, d in enumerate(own):
                if r:
                    file.append(bytes([0xFF, 0xD0 + (r - 1) % 8]))
                file.append(d.replace(b"\xff", b"\xff\x00"))
        file.append(b"\xff\xd9")
        out.append(b"".join(file))
    return out
