"""Progressive JPEG in numpy: files made of payload bytes, and a decoder to coefficients and RGB tensors.

A payload byte is one quantised DCT coefficient (byte + 128, so never zero). Blocks fill the luma and then
the two chroma components of a 4:2:0 image. Scans: DC and two spectral bands at half precision, then one bit
of refinement for each (successive approximation). Restart intervals cut every scan in short segments.

The decoder accumulates all scans of many files into one array of coefficients; the segments of files
with equal tables advance together, one symbol a step. Refinement segments that are one end-of-band run, as
ours are, are read as a block of bits; any other is decoded bit by bit.
"""

from __future__ import annotations

import functools
import re
import struct
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

from panelwright.llm.huffman import pack

RESTART = 8
OFFSET = 128
#: The spectral bands; both hold a multiple of GROUP coefficients, which are packed as one entry.
BANDS, GROUP = ((1, 6), (7, 63)), 3
#: Huffman tables of our files: (class << 4 | id) to {code length: symbols}.
DC_CODES = {4: list(range(12))}
AC_CODES = {1: [0x07], 2: [0x08], 4: [0x00], 5: [0x10], 6: [0x20], 7: [0x30]}
#: Scans of our files, each for the three components: first and last coefficient, high and low bit.
SCANS = ((0, 0, 0, 1), (*BANDS[0], 0, 1), (*BANDS[1], 0, 1), (1, 63, 1, 0), (0, 0, 1, 0))
COMPONENTS = ((1, 2), (2, 1), (3, 1))
#: Scale of the whole-numbered transform; up to SMALL, sums are exact in single precision as well.
SCALE, SMALL = 1 << 11, 511


@functools.cache
def zigzag() -> np.ndarray:
    """Row-major index of each coefficient in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@functools.cache
def _basis() -> np.ndarray:
    """Samples of a block from its zigzag coefficients, in units of 1 / SCALE; whole numbers, so that sums are exact."""
    n = np.arange(8)
    one = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("yu,xv->uvyx", one, one).reshape(64, 64)
    return np.rint(both[zigzag()] * SCALE)


def canonical(table: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol."""
    out, code, last = {}, 0, 0
    for length in sorted(table):
        code <<= length - last
        last = length
        for symbol in table[length]:
            out[symbol] = (code, length)
            code += 1
    return out


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _dht(number: int, table: dict[int, list[int]]) -> bytes:
    return bytes([number, *[len(table.get(i, ())) for i in range(1, 17)], *[s for i in sorted(table) for s in table[i]]])


def size_of(payload_bytes: int) -> tuple[int, int]:
    """Width and height in units of 16 x 16 pixels (384 bytes each)."""
    units = -(-payload_bytes // 384)
    wide = max(1, int(units**0.5))
    return wide, -(-units // wide)


# Encoding


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, blocks) of the restart segments of components with counts blocks."""
    pieces = -(-counts // RESTART)
    owner = np.repeat(np.arange(len(counts)), pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return owner, np.minimum(RESTART, counts[owner] - rank * RESTART)


def _bits(values: np.ndarray, widths: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entries packed with each segment (ends: entries up to its end) filled to whole bytes by ones; byte ends."""
    totals = np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], ends])]
    pad = -np.diff(totals) % 8
    values = np.insert(values, ends, (1 << pad) - 1)
    widths = np.insert(widths, ends, pad)
    return pack(values, widths)[0], np.cumsum((np.diff(totals) + pad) // 8)


def _dc_entries(levels: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and widths of DC differences; the prediction is 0 at each segment's start."""
    diff = np.diff(levels, prepend=0)
    diff[starts] = levels[starts]
    size = np.zeros(len(diff), np.int64)
    large = np.abs(diff)
    while large.any():
        size += large > 0
        large >>= 1
    codes = canonical(DC_CODES)
    code = np.array([codes[i][0] for i in range(12)])[size]
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return code << size | bits, size + 4


def _eob(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and widths of end-of-band runs of 1 to RESTART blocks."""
    codes = canonical(AC_CODES)
    n = np.array([0, *[b.bit_length() - 1 for b in range(1, RESTART + 1)]])[blocks]
    code, length = (np.array([codes[i << 4][j] for i in range(4)])[n] for j in (0, 1))
    return code << n | (blocks - (1 << n)), length + n


def _grouped(values: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of GROUP entries as one."""
    values, widths = values.reshape(-1, GROUP), widths.reshape(-1, GROUP)
    value, width = values[:, 0], widths[:, 0]
    for i in range(1, GROUP):
        value, width = value << widths[:, i] | values[:, i], width + widths[:, i]
    return value, width


def _scan_bits(blocks: np.ndarray, counts: np.ndarray, filled: np.ndarray, scan: tuple) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Entropy-coded bytes of one component's scan over many files: bytes, segment ends, owner of each segment.

    blocks: (n, 64) coefficients of all files; counts: blocks by file; filled: how many of them aren't zero.
    """
    lo, hi, high, low = scan
    owner, size = _segments(counts)
    pieces = -(-counts // RESTART)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    full = np.clip(filled[owner] - rank * RESTART, 0, size)
    ends = np.cumsum(size)
    if hi == 0:
        dc = blocks[:, 0].astype(np.int64)
        values, widths = (dc & 1, np.ones(len(dc), np.int64)) if high else _dc_entries(dc >> low, ends - size)
        return *_bits(values, widths, ends), owner
    is_full = np.arange(len(blocks)) < np.repeat(ends - size + full, size)
    band = blocks[is_full, lo : hi + 1]
    if high:  # 63 correction bits a block, as three entries of 21
        powers = 2.0 ** np.arange(20, -1, -1)
        values = ((band & 1).reshape(-1, 21).astype(np.float32).astype(np.float64) @ powers).astype(np.int64)
        widths, per_block = np.full(len(values), 21, np.int64), 3
        at, runs, where = (np.cumsum(full) - full) * per_block, size, np.ones(len(size), bool)
    else:
        codes = canonical(AC_CODES)
        values = (band >> low).astype(np.uint32)
        long = values >= 128
        values |= np.where(long, np.uint32(codes[8][0] << 8), np.uint32(codes[7][0] << 7))
        widths = np.where(long, np.uint8(8 + codes[8][1]), np.uint8(7 + codes[7][1]))
        values, widths = _grouped(values, widths)
        per_block = (hi - lo + 1) // GROUP
        at, runs, where = np.cumsum(full) * per_block, size - full, size > full
    value, width = _eob(runs[where])
    values, widths = np.insert(values, at[where], value), np.insert(widths, at[where], width)
    return *_bits(values, widths.astype(np.int64), np.cumsum(full * per_block + where)), owner


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload (a positive multiple of 64 bytes)."""
    units = np.array([size_of(len(p)) for p in payloads]).reshape(-1, 2)
    area = units.prod(1)
    own = np.array([len(p) // 64 for p in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64).astype(np.int16) + np.int16(OFFSET)
    ends = np.cumsum(own)
    parts = [[] for _ in payloads]
    first = np.zeros(len(payloads), np.int64)
    for number, (ident, factor) in enumerate(COMPONENTS):
        counts = area * factor * factor
        filled = np.clip(own - first, 0, counts)
        blocks = np.zeros((int(counts.sum()), 64), np.int16)
        target = np.repeat(np.cumsum(counts) - counts, filled) + _ranges(filled)
        blocks[target] = flat[np.repeat(ends - own + first, filled) + _ranges(filled)]
        first += filled
        for order, scan in enumerate(SCANS):
            data, stops, owner = _scan_bits(blocks, counts, filled, scan)
            begins = np.concatenate([[0], stops[:-1]])
            pieces = [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(begins.tolist(), stops.tolist())]
            cuts = np.searchsorted(owner, np.arange(len(payloads) + 1)).tolist()
            head = _marker(0xDA, bytes([1, ident, 0x00, scan[0], scan[1], scan[2] << 4 | scan[3]]))
            for i in range(len(payloads)):
                mine = pieces[cuts[i] : cuts[i + 1]]
                parts[i].append((order, number, head + b"".join(p + bytes([0xFF, 0xD0 + k % 8]) for k, p in enumerate(mine[:-1])) + mine[-1]))
    tables = _marker(0xDB, bytes([0] + [1] * 64))
    tables_after = _marker(0xC4, _dht(0x00, DC_CODES) + _dht(0x10, AC_CODES)) + _marker(0xDD, struct.pack(">H", RESTART))
    out = []
    for payload, (wide, high), scans in zip(payloads, units.tolist(), parts):
        frame = struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + b"".join(bytes([i, f << 4 | f, 0]) for i, f in COMPONENTS)
        comment = _marker(0xFE, b"payload " + str(len(payload)).encode())
        body = b"".join(x[2] for x in sorted(scans, key=lambda x: x[:2]))
        out.append(b"\xff\xd8" + comment + tables + _marker(0xC2, frame) + tables_after + body + b"\xff\xd9")
    return out


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to n-1 for each n of counts, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


# Decoding


@dataclass
class Image:
    width: int
    height: int
    comment: bytes
    components: list  # (identifier, horizontal and vertical factor, quantiser number)
    quantisers: dict
    first_block: list  # of each component in the shared coefficient array
    shape: list  # rows and columns of blocks of each component


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


def _parse(data: bytes, base: int) -> tuple[Image, list, list, int]:
    """The image, its scans and the blocks that it needs.

    Scans of one component are (component, parameters, table, segments, restart interval); those of several, which can
    only hold first coefficients, are (components and tables, parameters, segments, restart interval).
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, scans, joint, tables, quantisers, interval, comment, blocks = 2, None, [], [], {}, {}, 0, b"", 0
    while True:
        kind = data[at + 1]
        if kind == 0xD9:
            return image, scans, joint, blocks
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
            shape = [(-(-(-(-height * p[2] // most_v)) // 8), -(-(-(-width * p[1] // most_h)) // 8)) for p in parts]
            first = base + np.concatenate([[0], np.cumsum([a * b for a, b in shape])])
            image = Image(width, height, comment, parts, quantisers, first[:-1].tolist(), shape)
            blocks = int(first[-1] - base)
        elif kind == 0xDA:
            n = body[0]
            names = [p[0] for p in image.components]
            lo, hi, low_high = body[1 + 2 * n : 4 + 2 * n]
            params = (lo, hi, low_high >> 4, low_high & 15)
            own = [(names.index(body[1 + 2 * i]), tables.get(body[2 + 2 * i] >> 4 if hi == 0 else 0x10 | body[2 + 2 * i] & 15, b"")) for i in range(n)]
            stop = _SCAN_END.search(data, at).start()
            segments = [s.replace(b"\xff\x00", b"\xff") for s in _RESTARTS.split(data[at:stop])]
            if n > 1:
                joint.append((own, params, segments, interval))
            else:
                rows, columns = image.shape[own[0][0]]
                scans.append((own[0][0], params, own[0][1], segments, interval or rows * columns))
            at = stop
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive Huffman file")


@functools.lru_cache(64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits."""
    by_length, at = {}, 16
    for length in range(1, 17):
        by_length[length] = list(table[at : at + table[length - 1]])
        at += table[length - 1]
    symbols, lengths = np.zeros(1 << 16, np.int64), np.full(1 << 16, 16, np.int64)
    for symbol, (code, length) in canonical({k: v for k, v in by_length.items() if v}).items():
        span = slice(code << (16 - length), (code + 1) << (16 - length))
        symbols[span], lengths[span] = symbol, length
    return symbols, lengths


@functools.lru_cache(16)
def _band_lookup(table: bytes, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every 16 bits: bits of code and value, run, and value; 0 bits where an entry needs more or is a run without value."""
    symbols, lengths = _lookup(table)
    bits = np.arange(1 << 16)
    run, size = symbols >> 4, symbols & 15
    total = lengths + size
    fits = (size > 0) & (total <= 16)
    raw = bits >> np.maximum(16 - total, 0) & ((1 << size) - 1)
    return np.where(fits, total, 0), run, (_extend(raw, size) << low).astype(np.int16)


def _windows(data: bytes) -> np.ndarray:
    """The 32 bits from each byte on; bits after the end are ones."""
    raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int64)
    return raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]


def _peek(windows: np.ndarray, at: np.ndarray, n) -> np.ndarray:
    """The next n (at most 16) bits at bit positions at."""
    return windows.take(at >> 3) >> (32 - n - (at & 7)) & ((1 << n) - 1)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < 1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def _scan_group(params: tuple, table: bytes, segments: list[bytes], first: np.ndarray, count: np.ndarray, coefficients: np.ndarray) -> None:
    """Adds segments (first: their first block, count: their blocks) of equal parameters to the coefficients."""
    lo, hi, high, low = params
    data = b"".join(segments)
    at = np.concatenate([[0], np.cumsum([len(s) for s in segments])])[:-1] * 8
    windows = _windows(data)
    if hi == 0 and high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        coefficients[np.repeat(first, count) + _ranges(count), 0] |= bits[np.repeat(at, count) + _ranges(count)].astype(np.int16) << low
        return
    symbols, lengths = _lookup(table)
    if hi == 0:
        level = np.zeros(len(at), np.int64)
        for i in range(int(count.max())):
            live = np.flatnonzero(count > i)
            code = _peek(windows, at[live], 16)
            size = symbols[code]
            at[live] += lengths[code]
            level[live] += _extend(_peek(windows, at[live], size), size)
            at[live] += size
            coefficients[first[live] + i, 0] = level[live] << low
        return
    if high:
        _refine(params, windows, data, symbols, lengths, at, first, count, coefficients)
        return
    totals, runs, values = _band_lookup(table, low)
    place, end = first * 64 + lo, (first + count) * 64  # where the next coefficient goes; a row ends at + hi
    flat = coefficients.reshape(-1)
    while len(at):
        code = _peek(windows, at, 16)
        total = totals.take(code)
        place += runs.take(code)
        plain = total.all()
        if plain:
            flat[place] = values.take(code)
            at += total
            place += 1
        else:
            _rare_symbols(windows, at, place, code, total, symbols, lengths, values, lo, low, flat)
        over = (place & 63) > hi if hi < 63 else (place & 63) == 0
        if not plain or over.any():
            place[over] += (63 - hi + lo) if hi < 63 else lo
            keep = place < end
            if not keep.all():
                at, place, end = at[keep], place[keep], end[keep]


def _rare_symbols(windows, at, place, code, total, symbols, lengths, values, lo, low, flat) -> None:
    """One step in which some segments meet a long value, a run of zeros or an end of band; arrays change in place."""
    symbol = symbols.take(code)
    run, size = symbol >> 4, symbol & 15
    put = np.flatnonzero(size)
    after = at + lengths.take(code)
    bits = _peek(windows, after, np.where(size > 0, size, np.where(run < 15, run, 0)))
    flat[place[put]] = _extend(bits[put], size[put]) << low
    ends = (size == 0) & (run < 15)
    at[:] = after + np.where(ends, run, size)
    row = (place - run) >> 6
    place[:] = np.where(ends, (row + (1 << np.where(ends, run, 0)) + bits) * 64 + lo, place + 1)


def _refine(params, windows, data, symbols, lengths, at, first, count, coefficients) -> None:
    lo, hi, _, low = params
    code = _peek(windows, at, 16)
    symbol = symbols[code]
    run = symbol >> 4
    is_end = (symbol & 15 == 0) & (run < 15)
    after = at + lengths[code]
    blocks = (1 << np.where(is_end, run, 0)) + _peek(windows, after, np.where(is_end, run, 0))
    whole = is_end & (blocks >= count)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    rows = np.repeat(first[whole], count[whole]) + _ranges(count[whole])
    band = coefficients[rows, lo : hi + 1]
    mark = band != 0
    if mark.all() and (band > 0).all():  # every coefficient takes a bit, one after another
        wide = count[whole] * (hi - lo + 1)
        own = bits[np.repeat((after + run)[whole], wide) + _ranges(wide)].astype(np.int16) << low
        coefficients[rows, lo : hi + 1] = band + own.reshape(band.shape)
        mark = mark[:0]
    if len(mark):
        _correct(coefficients, rows, band, mark, bits, (after + run)[whole], count[whole], lo, hi, low)
    for i in np.flatnonzero(~whole).tolist():
        _refine_slowly(params, bits, int(at[i]), symbols, lengths, coefficients[first[i] : first[i] + count[i]])


def _correct(coefficients, rows, band, mark, bits, begins, count, lo, hi, low) -> None:
    """A correction bit for every coefficient that isn't zero, in order, segment by segment."""
    by_row = mark.sum(1)
    per_segment = np.add.reduceat(by_row, np.cumsum(count) - count)
    own = np.repeat(begins, per_segment) + _ranges(per_segment)
    band[mark] += np.sign(band[mark]) * (bits[own].astype(np.int16) << low)
    coefficients[rows, lo : hi + 1] = band


def _refine_slowly(params, bits, at, symbols, lengths, blocks) -> None:
    """One refinement segment, bit by bit."""
    lo, hi, _, low = params

    def take(n: int) -> int:
        nonlocal at
        value = 0
        for _ in range(n):
            value = value << 1 | (int(bits[at]) if at < len(bits) else 1)
            at += 1
        return value

    def correct(block, k: int) -> None:
        if take(1):
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    skip = 0
    for block in blocks:
        k = lo
        while skip == 0 and k <= hi:
            peek = sum((int(bits[at + j]) if at + j < len(bits) else 1) << (15 - j) for j in range(16))
            symbol = int(symbols[peek])
            at += int(lengths[peek])
            run, size, value = symbol >> 4, symbol & 15, 0
            if size:
                value = (1 if take(1) else -1) << low
            elif run < 15:
                skip = (1 << run) + take(run)
                break
            while k <= hi:
                if block[k]:
                    correct(block, k)
                elif run == 0:
                    if value:
                        block[k] = value
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if skip:
            for j in range(k, hi + 1):
                if block[j]:
                    correct(block, j)
            skip -= 1


def _joint_scan(image: Image, scan: tuple, coefficients: np.ndarray) -> None:
    """Adds a scan of first coefficients of several components, whose blocks take turns in units of the sampling factors."""
    own, (_, _, high, low), segments, interval = scan
    most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    lookups = [None if high else _lookup(table) for _, table in own]
    unit = 0
    for segment in segments:
        windows, at, last = _windows(segment), 0, [0] * len(own)

        def take(n: int) -> int:
            nonlocal at
            value = int(windows[at >> 3]) >> (32 - n - (at & 7)) & ((1 << n) - 1) if n else 0
            at += n
            return value

        for unit in range(unit, min(unit + (interval or across * down), across * down)):
            for i, (number, _) in enumerate(own):
                _, h, v, _ = image.components[number]
                rows, columns = image.shape[number]
                for part in range(h * v):
                    if high:
                        value = take(1) << low
                    else:
                        code = take(16)
                        size = int(lookups[i][0][code])
                        at += int(lookups[i][1][code]) - 16
                        bits = take(size)
                        last[i] += bits - (1 << size) + 1 if size and bits < 1 << (size - 1) else bits
                        value = last[i] << low
                    row, column = unit // across * v + part // h, unit % across * h + part % h
                    if row < rows and column < columns:  # units at the edges have blocks that no image holds
                        coefficients[image.first_block[number] + row * columns + column, 0] |= value
        unit += 1


def coefficients_of(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images and the (blocks, 64) coefficients, in zigzag order, that all their scans add up to."""
    images, groups, joint_scans, base = [], defaultdict(list), [], 0
    for data in files:
        image, scans, joint, blocks = _parse(data, base)
        images.append(image)
        joint_scans += [(image, scan) for scan in joint]
        base += blocks
        turn = [0] * len(image.components)  # scans of a component depend on its earlier ones alone
        for number, params, table, segments, interval in scans:
            rows, columns = image.shape[number]
            own = groups[turn[number], params, table]
            turn[number] += 1
            for j, segment in enumerate(segments):
                own.append((segment, image.first_block[number] + j * interval, min(interval, rows * columns - j * interval)))
    coefficients = np.zeros((base, 64), np.int16)
    for (_, params, table), items in sorted(groups.items(), key=lambda x: x[0][0]):
        segments, first, count = zip(*items)
        _scan_group(params, table, list(segments), np.array(first), np.array(count), coefficients)
    for image, scan in joint_scans:  # bits of first coefficients that no other scan writes or reads
        _joint_scan(image, scan, coefficients)
    return images, coefficients


def _samples(coefficients: np.ndarray) -> np.ndarray:
    """(blocks, 64) samples of dequantised coefficients as small integers."""
    exact = np.float32 if -SMALL <= coefficients.min(initial=0) and coefficients.max(initial=0) <= SMALL else np.float64
    sums = (coefficients.astype(exact) @ _basis().astype(exact)).astype(np.int32)
    sums += SCALE // 2 + 128 * SCALE
    sums >>= SCALE.bit_length() - 1
    return np.clip(sums, 0, 255, out=sums).astype(np.int16)


def tensors(images: list[Image], coefficients: np.ndarray) -> list[np.ndarray]:
    """The (height, width, 3) RGB samples of each image: inverse transform, chroma repeated, colours turned."""
    plain = all((q == 1).all() for image in images for q in image.quantisers.values())
    if not plain:
        coefficients = coefficients.astype(np.int32)
        for image in images:
            for first, (rows, columns), (_, _, _, q) in zip(image.first_block, image.shape, image.components):
                coefficients[first : first + rows * columns] *= image.quantisers[q].astype(np.int32)
    samples = _samples(coefficients)
    out = []
    for image in images:
        planes = []
        for first, (rows, columns) in zip(image.first_block, image.shape):
            planes.append(samples[first : first + rows * columns].reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8))
        if len(planes) == 1:
            grey = planes[0][: image.height, : image.width].astype(np.uint8)
            out.append(np.repeat(grey[:, :, None], 3, 2))
            continue
        most_h, most_v = max(p[1] for p in image.components), max(p[2] for p in image.components)
        full = [_upsampled(p, most_v // c[2], most_h // c[1], image) for p, c in zip(planes, image.components)]
        y, b, r = full[0], planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        shifts = ((91881 * r + 32768) >> 16, (-22554 * b - 46802 * r + 32768) >> 16, (116130 * b + 32768) >> 16)
        _, h, v, _ = image.components[1]
        rgb = np.empty((image.height, image.width, 3), np.uint8)
        for i, shift in enumerate(shifts):
            sums = y + _upsampled(shift.astype(np.int16), most_v // v, most_h // h, image)
            rgb[:, :, i] = np.clip(sums, 0, 255, out=sums)
        out.append(rgb)
    return out


def _upsampled(plane: np.ndarray, down: int, across: int, image: Image) -> np.ndarray:
    rows, columns = plane.shape
    if down > 1 or across > 1:
        plane = np.broadcast_to(plane[:, None, :, None], (rows, down, columns, across)).reshape(rows * down, columns * across)
    return plane[: image.height, : image.width]


def payload_of(image: Image, coefficients: np.ndarray) -> bytes | None:
    """The payload bytes of one of our files, None of any other."""
    if not image.comment.startswith(b"payload "):
        return None
    n = int(image.comment.removeprefix(b"payload "))
    first = image.first_block[0]
    return (coefficients[first : first + n // 64] - OFFSET).astype(np.uint8).tobytes()
