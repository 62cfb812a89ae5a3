"""PNG and TIFF pages to pixels, height x width x 1 (gray) or 3 (red, green, blue), in numpy.

What becomes of a picture's mode: alpha beside colours is laid on white; alpha beside gray and the transparency of a palette
are left out, so the colour beneath shows; bits and small grays are spread over 0 to 255; of 16 bits the upper 8 stay.
Anything malformed, or coded in a way that isn't known here, raises ValueError.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

#: PNG's channels by colour type, its passes (first row, first column, row step, column step), TIFF's field sizes.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
FIELDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
WIDTH, HEIGHT, BITS, CODING, KIND, OFFSETS, SAMPLES, ROWS, SIZES, PLANAR, PREDICTOR, COLOURS, TILE_W, TILE_H, TILES, TILE_SIZES, EXTRA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 322, 323, 324, 325, 338


def on_white(colours: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    laid = colours.astype(np.int32) * alpha + 255 * (255 - alpha.astype(np.int32)) + 128
    return (((laid >> 8) + laid) >> 8).astype(np.uint8)


def _samples(rows: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    """Rows of bytes as height x width x channels samples; of 16 bits (high byte first) the upper 8."""
    n = width * channels
    if bits == 16:
        out = rows[:, : 2 * n : 2]
    elif bits == 8:
        out = rows[:, :n]
    else:
        each = 8 // bits
        shifts = (8 - bits * (1 + np.arange(each))).astype(np.uint8)
        out = ((rows[:, :, None] >> shifts) & np.uint8((1 << bits) - 1)).reshape(len(rows), -1)[:, :n]
    return out.reshape(len(rows), width, channels)


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """PNG rows without their filters. Where a row needs its left neighbours one by one, all rows go on together, each a pixel behind the one above."""
    height, n = rows.shape
    if not (kinds >= 3).any():
        out, above = np.empty_like(rows), np.zeros(n, np.uint8)
        for r in range(height):
            row = rows[r]
            if kinds[r] == 1:
                row = np.cumsum(np.pad(row, (0, -n % step)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:n]
            elif kinds[r] == 2:
                row = row + above
            out[r] = above = row
        return out
    width = -(-n // step)
    pixels = np.pad(rows, ((0, 0), (0, width * step - n))).reshape(height, width, step)
    # skewed[c + r, r] is pixel (r, c): its left, upper and upper left neighbours lie one or two steps before, at r and r - 1
    at = np.arange(height)
    skewed = np.zeros((width + height + 1, height + 1, step), np.int16)
    given = np.zeros((width + height - 1, height, step), np.int16)
    for c in range(width):
        given[at + c, at] = pixels[:, c]
    kind = kinds[:, None]
    for t in range(width + height - 1):
        low, high = max(0, t - width + 1), min(height, t + 1)
        k = kind[low:high]
        left, up, corner = skewed[t + 1, low + 1 : high + 1], skewed[t + 1, low:high], skewed[t, low:high]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, nearest, 0))))
        skewed[t + 2, low + 1 : high + 1] = (given[t, low:high] + guess) & 255
    out = np.empty((height, width, step), np.uint8)
    for c in range(width):
        out[:, c] = skewed[at + c + 2, at + 1]
    return out.reshape(height, -1)[:, :n]


def png(data: bytes) -> np.ndarray:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[3] not in CHANNELS or head[2] not in (1, 2, 4, 8, 16) or not head[0] or not head[1]:
        raise ValueError("a PNG without a known header")
    width, height, bits, colour, _, _, passes = head
    channels = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as cause:
        raise ValueError("a PNG with broken data") from cause
    out, used = np.zeros((height, width, channels), np.uint8), 0
    for top, first, down, across in PASSES if passes else [(0, 0, 1, 1)]:
        h, w = len(range(top, height, down)), len(range(first, width, across))
        if not h or not w:
            continue
        line = 1 + (w * channels * bits + 7) // 8
        if used + h * line > len(raw):
            raise ValueError("a PNG that ends early")
        rows = raw[used : used + h * line].reshape(h, line)
        used += h * line
        out[top::down, first::across] = _samples(unfiltered(rows[:, 0].astype(np.int16), rows[:, 1:], max(1, channels * bits // 8)), w, channels, bits)
    if colour == 3:
        table = np.zeros((256, 3), np.uint8)
        known = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)[:256]
        table[: len(known)] = known
        return table[out[:, :, 0]]
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    if colour == 6:
        return on_white(out[:, :, :3], out[:, :, 3:])
    return out[:, :, :1] if colour == 4 else out


def tiff_pages(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Each page of a TIFF by itself: its tags as JSON and its coded strips or tiles one after another."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("a TIFF whose pages can't be followed")
        seen.add(at)
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        tags = {}
        try:
            for k in range(n):
                tag, kind, count, value = struct.unpack(order + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
                if kind in FIELDS:
                    form = f"{order}{count}{FIELDS[kind]}"
                    size = struct.calcsize(form)
                    place = struct.unpack(order + "I", value)[0]
                    tags[tag] = struct.unpack(form, value[:size] if size <= 4 else data[place : place + size])
            at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
        except struct.error as cause:
            raise ValueError("a TIFF that ends early") from cause
        places, sizes = tags.get(TILES) or tags.get(OFFSETS), tags.get(TILE_SIZES) or tags.get(SIZES)
        if not places or not sizes or len(places) != len(sizes):
            raise ValueError("a TIFF page without data")
        kept = {k: v for k, v in tags.items() if k in (WIDTH, HEIGHT, BITS, CODING, KIND, SAMPLES, ROWS, PLANAR, PREDICTOR, COLOURS, TILE_W, TILE_H, EXTRA)}
        yield json.dumps({"order": order, "sizes": sizes, "tags": kept}), b"".join(data[p : p + s] for p, s in zip(places, sizes, strict=True))


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, wider one code early."""
    out, table, width, last = [], [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            word = table[code] if code < len(table) else b""
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code == len(table):
            word = last + last[:1]
            table.append(word)
        else:
            raise ValueError("an LZW code that isn't known yet")
        out.append(word)
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def _plain(coding: int, data: bytes) -> bytes:
    if coding == 1:
        return data
    if coding == 5:
        return lzw(data)
    if coding == 32773:
        return packbits(data)
    if coding in (8, 32946):
        try:
            return zlib.decompress(data)
        except zlib.error as cause:
            raise ValueError("a TIFF with broken data") from cause
    raise ValueError(f"TIFF coding {coding} isn't known here")


def tiff(tags: str, data: bytes) -> np.ndarray:
    """A page as tiff_pages gives it."""
    page = json.loads(tags)
    order, field = page["order"], {int(k): v for k, v in page["tags"].items()}
    one = lambda tag, usual: field.get(tag, [usual])[0]
    width, height, samples, kind, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(KIND, 1), one(BITS, 1)
    if not width or not height or bits not in (1, 2, 4, 8, 16) or len(set(field.get(BITS, [1]))) != 1:
        raise ValueError("a TIFF page of an unknown form")
    apart = one(PLANAR, 1) == 2 and samples > 1
    each = 1 if apart else samples
    tiled = TILE_W in field
    box_w, box_h = (one(TILE_W, width), one(TILE_H, height)) if tiled else (width, min(height, one(ROWS, height)))
    across, down = -(-width // box_w), -(-height // box_h)
    out, at = np.zeros((down * box_h, across * box_w, samples), np.uint8), 0
    if len(page["sizes"]) < across * down * (samples if apart else 1):
        raise ValueError("a TIFF page that lacks data")
    line = (box_w * each * bits + 7) // 8
    for k, size in enumerate(page["sizes"]):
        plane, place = divmod(k, across * down)
        if plane >= (samples if apart else 1):
            break
        raw = np.frombuffer(_plain(one(CODING, 1), data[at : at + size]), np.uint8)
        at += size
        top, left = place // across * box_h, place % across * box_w
        rows = box_h if tiled else min(box_h, height - top)
        if len(raw) < rows * line:
            raise ValueError("a TIFF strip that ends early")
        raw = raw[: rows * line].reshape(rows, line)
        if one(PREDICTOR, 1) == 2:
            wide = raw if bits == 8 else np.ascontiguousarray(raw).view(order + "u2")
            summed = np.cumsum(wide.reshape(rows, -1, each), axis=1, dtype=wide.dtype).reshape(rows, -1)
            raw = summed if bits == 8 else summed.astype(">u2").view(np.uint8)
        elif bits == 16 and order == "<":
            raw = np.ascontiguousarray(raw).view("<u2").astype(">u2").view(np.uint8)
        part = _samples(raw, box_w, each, bits)
        out[top : top + rows, left : left + box_w, plane : plane + 1] = part if apart else 0
        if not apart:
            out[top : top + rows, left : left + box_w] = part
    out = out[:height, :width]
    if kind == 3:
        table = (np.array(field[COLOURS], np.uint32).reshape(3, -1) >> 8).astype(np.uint8).T
        return table[np.minimum(out[:, :, 0], len(table) - 1)]
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    if kind in (0, 1):
        return 255 - out[:, :, :1] if kind == 0 else out[:, :, :1]
    if kind == 2 and samples >= 3:
        return on_white(out[:, :, :3], out[:, :, 3:4]) if samples > 3 and one(EXTRA, 0) == 2 else out[:, :, :3]
    if kind == 5 and samples >= 4:
        left = 255 - out[:, :, 3:4].astype(np.int32)
        return (left - (out[:, :, :3] * left + 127) // 255).astype(np.uint8)
    raise ValueError("a TIFF page of an unknown form")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed
