"""Pictures of every mode, drawn here byte by byte, against the pixels that they must give; TIFF pages over several tasks."""

import struct
import zlib

import numpy as np
import pytest

from inkwell.plans import analysis
from inkwell.sources import decoders, images

RNG = np.random.default_rng(6)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def packed(samples, bits):
    """Rows of samples as rows of bytes."""
    h = len(samples)
    flat = samples.reshape(h, -1)
    if bits == 16:
        return flat.astype(">u2").view(np.uint8).reshape(h, -1)
    spread = (flat[:, :, None] >> np.arange(bits)[::-1]) & 1
    return np.packbits(spread.reshape(h, -1).astype(np.uint8), axis=1)


def filtered(rows, step, kinds):
    """PNG's filters pixel by pixel, as their definition says."""
    out, above = bytearray(), [0] * rows.shape[1]
    for kind, row in zip(kinds, rows.tolist()):
        out.append(kind)
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - [0, a, b, (a + b) // 2, near][kind]) % 256)
        above = row
    return bytes(out)


def drawn_png(samples, bits, colour, kinds=(0,), extra=b"", interlaced=False):
    h, w = samples.shape[:2]
    channels = 1 if samples.ndim == 2 else samples.shape[2]
    step, body = max(1, channels * bits // 8), b""
    for top, first, down, across in decoders.PASSES if interlaced else [(0, 0, 1, 1)]:
        part = samples[top::down, first::across]
        if part.size:
            body += filtered(packed(part, bits), step, [kinds[i % len(kinds)] for i in range(len(part))])
    head = struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [(0,), (1, 2, 0), (4,), (3, 1, 4, 2, 0)])
@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "bits"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png(colour, bits, interlaced, kinds):
    palette = RNG.integers(0, 256, (1 << min(bits, 8), 3)).astype(np.uint8)
    extra = chunk(b"PLTE", palette.tobytes()) + chunk(b"tRNS", bytes([0, 128])) if colour == 3 else b""
    for shape in ((9, 13), (1, 1), (3, 2), (17, 5)):
        samples = RNG.integers(0, 1 << bits, (*shape, decoders.CHANNELS[colour]))
        got = decoders.png(drawn_png(samples, bits, colour, kinds, extra, interlaced))
        top = samples >> 8 if bits == 16 else samples * (255 // ((1 << bits) - 1)) if colour != 3 else samples
        if colour == 3:
            want = palette[samples[:, :, 0]]  # a transparent entry keeps its colour
        elif colour == 6:
            want = np.floor((top[:, :, :3] * top[:, :, 3:] + 255.0 * (255 - top[:, :, 3:])) / 255 + 0.5)
        else:
            want = top[:, :, :1] if colour == 4 else top  # alpha beside gray is left out
        assert got.shape == want.shape and np.abs(got.astype(int) - want).max() <= (colour == 6)


def lzw_coded(data):
    """TIFF's LZW, with a table that starts anew when full."""
    bits, table, width, now = [], {bytes([i]): i for i in range(256)}, 9, b""
    put = lambda code: bits.extend(int(b) for b in f"{code:0{width}b}")
    put(256)
    for byte in data:
        more = now + bytes([byte])
        if more in table:
            now = more
            continue
        put(table[now])
        table[more] = len(table) + 2
        width = max(9, (len(table) + 2).bit_length())
        if len(table) + 2 >= 4093:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        now = bytes([byte])
    if now:
        put(table[now])
        width = max(9, (len(table) + 3).bit_length())
    put(257)
    return np.packbits(bits).tobytes()


def packbits_coded(data):
    out = bytearray()
    for a in range(0, len(data), 100):
        part = data[a : a + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return bytes(out)


CODERS = {1: bytes, 5: lzw_coded, 8: zlib.compress, 32773: packbits_coded}


def drawn_tiff(pages, order="<", coding=1, rows=4, predictor=1, tile=None):
    """pages: samples (height x width x channels), bits, photometric kind, further tags."""
    out, links = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4), 4
    for samples, bits, kind, more in pages:
        h, w, channels = samples.shape
        if tile:
            boxes = [np.pad(samples, ((0, -h % tile), (0, -w % tile), (0, 0)))[a : a + tile, b : b + tile] for a in range(0, h, tile) for b in range(0, w, tile)]
        else:
            boxes = [samples[a : a + rows] for a in range(0, h, rows)]
        places, sizes = [], []
        for box in boxes:
            if predictor == 2:
                box = np.concatenate([box[:, :1], box[:, 1:] - box[:, :-1]], axis=1) % (1 << bits)
            raw = packed(box, bits)
            if bits == 16 and order == "<":
                raw = np.ascontiguousarray(raw).view(">u2").astype("<u2").view(np.uint8)
            coded = CODERS[coding](raw.tobytes())
            places.append(len(out))
            sizes.append(len(coded))
            out += coded
        layout = {322: tile, 323: tile, 324: places, 325: sizes} if tile else {273: places, 278: rows, 279: sizes}
        tags = {256: w, 257: h, 258: [bits] * channels, 259: coding, 262: kind, 277: channels, 317: predictor, **layout, **more}
        fields = b""
        for tag, value in sorted(tags.items()):
            value = value if isinstance(value, list) else [value]
            short = tag in (258, 320, 338)
            body = struct.pack(f"{order}{len(value)}{'H' if short else 'I'}", *value)
            if len(body) > 4:
                at, body = len(out), body
                out += body
                body = struct.pack(order + "I", at)
            fields += struct.pack(order + "HHI", tag, 3 if short else 4, len(value)) + body.ljust(4, b"\0")
        out[links : links + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + fields
        links = len(out)
        out += b"\0" * 4
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("coding", [1, 5, 8, 32773])
@pytest.mark.parametrize("tile", [None, 16])
def test_tiff(order, coding, tile):
    gray, deep = RNG.integers(0, 256, (21, 35, 1)), RNG.integers(0, 1 << 16, (9, 7, 1))
    rgb, rgba = RNG.integers(0, 256, (10, 6, 3)), RNG.integers(0, 256, (10, 6, 4))
    bit, index, colours = RNG.integers(0, 2, (12, 19, 1)), RNG.integers(0, 16, (6, 9, 1)), RNG.integers(0, 1 << 16, 48)
    flat = np.full((40, 90, 1), 200)
    pages = [(gray, 8, 1, {}), (gray, 8, 0, {}), (bit, 1, 0, {}), (bit, 1, 1, {}), (rgb, 8, 2, {}), (rgba, 8, 2, {338: 2}), (rgba, 8, 2, {338: 0}), (deep, 16, 1, {}), (index, 4, 3, {320: colours.tolist()}), (flat, 8, 1, {})]
    laid = np.floor((rgba[:, :, :3] * rgba[:, :, 3:] + 255.0 * (255 - rgba[:, :, 3:])) / 255 + 0.5)
    want = [gray, 255 - gray, 255 * (1 - bit), 255 * bit, rgb, laid, rgba[:, :, :3], deep >> 8, (colours.reshape(3, 16).T >> 8)[index[:, :, 0]], flat]
    got = [decoders.tiff(*p) for p in decoders.tiff_pages(drawn_tiff(pages, order, coding, tile=tile))]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a.shape == b.shape and np.abs(a.astype(int) - b).max() <= (b is laid)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_with_predictor(order):
    rgb, deep = RNG.integers(0, 256, (10, 30, 3)), RNG.integers(0, 1 << 16, (9, 30, 1))
    got = [decoders.tiff(*p) for p in decoders.tiff_pages(drawn_tiff([(rgb, 8, 2, {}), (deep, 16, 1, {})], order, 5, predictor=2))]
    assert (got[0] == rgb).all() and (got[1] == deep >> 8).all()


def test_long_lzw():
    data = RNG.integers(0, 4, 60000).astype(np.uint8).tobytes() + bytes(5000)
    assert decoders.lzw(lzw_coded(data)) == data


def test_malformed():
    whole = drawn_png(RNG.integers(0, 256, (5, 5, 1)), 8, 0)
    for bad in (b"", whole[:20], whole[:50], whole[:-30], b"\x89PNG\r\n\x1a\n" + whole[30:]):
        with pytest.raises(ValueError):
            decoders.png(bad)
    page = drawn_tiff([(RNG.integers(0, 256, (5, 5, 1)), 8, 1, {})])
    for bad in (b"", page[:30], page[:-30], page[:4] + page[-8:-4] + page[8:]):
        with pytest.raises(ValueError):
            list(decoders.tiff_pages(bad))
    with pytest.raises(ValueError):
        decoders.tiff(*next(decoders.tiff_pages(drawn_tiff([(RNG.integers(0, 256, (5, 5, 1)), 8, 1, {259: 7})]))))


def test_scan_of_modes(spark, tmp_path):
    """A palette with a transparent entry keeps its colour; a TIFF's pages are decoded by several tasks; broken files are told apart."""
    palette = chunk(b"PLTE", bytes([200, 10, 10, 0, 0, 0])) + chunk(b"tRNS", bytes([0]))
    (tmp_path / "palette.png").write_bytes(drawn_png(np.zeros((2, 3, 1), int), 8, 3, extra=palette))
    pages = [RNG.integers(0, 256, (6, 8, 1)) for _ in range(500)]
    (tmp_path / "many.tif").write_bytes(drawn_tiff([(p, 8, 1, {}) for p in pages], coding=32773))
    (tmp_path / "bad.tiff").write_bytes(b"II*\0")
    at = f"file://{tmp_path}"
    rasters = images.scan(spark, at)
    got = {r.origin.rsplit("/", 1)[1]: r for r in rasters.collect()}
    assert len(got) == 501 and got["palette.png"].data == bytes([200, 10, 10]) * 6 and len({r.page_id for r in got.values()}) == 501
    assert all(got["many.tif" + (f"#{k}" if k else "")].data == p.astype(np.uint8).tobytes() for k, p in enumerate(pages))
    tasks = images.scan(spark, at, "many.tif").groupBy(images.F.spark_partition_id()).count().collect()
    assert len([t for t in tasks if t["count"]]) == 4 and max(t["count"] for t in tasks) < 250
    assert images.scan(spark, at, first_page=True).count() == 2 and images.scan(spark, at, keep_invalid=True).count() == 502
    assert analysis.from_files(spark, at, pattern="*.tif").told.count() == 500
