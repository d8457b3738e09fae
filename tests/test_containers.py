import struct

import numpy as np

from mirrorlake.functions import containers as c


def tiff(entries, order="<", extra=b""):
    """A TIFF of one directory; values over four bytes come after it."""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    place, body, tail = 8 + 2 + 12 * len(entries) + 4, struct.pack(order + "H", len(entries)), b""
    for tag, kind, count, value in entries:
        if isinstance(value, bytes):
            if len(value) > 4:
                value, tail = struct.pack(order + "I", place + len(tail)), tail + value
            value = value.ljust(4, b"\0")
        else:
            value = struct.pack(order + ("HH" if kind == 3 else "I"), *((value, 0) if kind == 3 else (value,)))
        body += struct.pack(order + "HHI", tag, kind, count) + value
    return head + body + struct.pack(order + "I", 0) + tail + extra


def jpeg(marker=0xC0, components=3, w=40, h=30):
    frame = struct.pack(">BHHB", 8, h, w, components) + b"\1\x11\0" * components
    return b"\xff\xd8" + bytes([0xFF, marker]) + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\0\3\0" + b"ab\xff\0c\xff\xd0d" + b"\xff\xd9"


def test_detect_by_bytes():
    assert [c.detect(x) for x in (b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"RIFF0000WEBP", b"text", b"")] == ["jpeg", "png", "gif", "webp", None, None]
    assert c.detect(b"\0\0\0\x18ftypcrx \0\0\0\1isom") == "cr3" and c.detect(b"\0\0\0\x18ftypisom\0\0\0\1heic") == "heic" and c.detect(b"\0\0\0\x18ftypmp42\0\0\0\0") is None
    assert c.detect(tiff([(0x10F, 2, 6, b"NIKON\0")])) == "nef" and c.detect(tiff([(0x10F, 2, 5, b"SONY\0")], ">")) == "arw"
    assert c.detect(tiff([(0x10F, 2, 6, b"Canon\0")])) == "tiff" and c.detect(b"IIU\0\x08\0\0\0") == "rw2" and c.detect(b"II*\0\x10\0\0\0CR\x02\0") == "cr2"


def test_animated():
    chunk = lambda kind, data=b"": struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    still = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"IDAT")
    moving = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"acTL", b"x" * 8) + chunk(b"IDAT")
    assert not c.is_animated("png", still) and c.is_animated("png", moving)
    frame = b"\x2c" + b"\0" * 9 + b"\2" + b"\1a\0"
    head = b"GIF89a" + b"\0" * 7
    assert not c.is_animated("gif", head + frame + b"\x3b") and c.is_animated("gif", head + b"\x21\xf9\1x\0" + frame + frame)
    webp = lambda kind, data: b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(data)) + data
    assert c.is_animated("webp", webp(b"VP8X", b"\2\0\0\0")) and not c.is_animated("webp", webp(b"VP8X", b"\0\0\0\0")) and not c.is_animated("webp", webp(b"VP8 ", b"abcd"))
    assert not c.is_animated("gif", head[:9]) and not c.is_animated("jpeg", b"")


def test_previews():
    whole = jpeg()
    assert c.jpeg_span(b"xx" + whole + b"yy", 2) == whole and c.jpeg_size(whole) == (40, 30)
    assert c.jpeg_span(jpeg(0xC3), 0) is None and c.jpeg_span(jpeg(components=4), 0) is None and c.jpeg_span(whole[:-2], 0) is None
    n = len(tiff([(0x100, 4, 1, 1), (0x101, 4, 1, 1), (0x201, 4, 1, 1), (0x202, 4, 1, 1)]))
    raw = tiff([(0x100, 4, 1, 6000), (0x101, 4, 1, 4000), (0x201, 4, 1, n), (0x202, 4, 1, len(whole))], extra=whole)
    assert c.preview(raw) == (whole, (6000, 4000))
    box = lambda kind, data: struct.pack(">I", 8 + len(data)) + kind + data
    cr3 = box(b"ftyp", b"crx \0\0\0\1") + box(b"moov", box(b"uuid", b"\0" * 16 + box(b"PRVW", b"pad" + whole)))
    assert c.preview(cr3) == (whole, None) and c.preview(b"junk") is None


def test_orientation_and_turns():
    assert c.orientation(tiff([(0x112, 3, 1, 6)])) == 6 and c.orientation(tiff([(0x112, 3, 1, 9)])) == 1 and c.orientation(b"") == 1
    exif = b"Exif\0\0" + tiff([(0x112, 3, 1, 8)], ">")
    assert c.orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xd9") == 8
    a = np.arange(6).reshape(2, 3)
    assert (c.turn_upright(a, 6) == np.rot90(a, -1)).all() and (c.turn_upright(a, 8) == np.rot90(a)).all()
    assert (c.turn_upright(a, 3) == np.rot90(a, 2)).all() and (c.turn_upright(a, 5) == a.T).all() and (c.turn_upright(a, 7) == np.rot90(a, 2).T).all()


def test_declared_lengths_of_previews():
    cut = jpeg()[:-2]  # no end marker, so only the declared length tells where it ends
    n = len(tiff([(0x201, 4, 1, 1), (0x202, 4, 1, 1)]))
    assert c.preview(tiff([(0x201, 4, 1, n), (0x202, 4, 1, len(cut))], extra=cut))[0] == cut
    whole = jpeg()
    assert c.preview(tiff([(0x201, 4, 1, n), (0x202, 4, 1, len(whole) + 3)], extra=whole + b"abc"))[0] == whole + b"abc"
    assert c.preview(tiff([(0x201, 4, 1, n), (0x202, 4, 1, 99999)], extra=whole))[0] == whole
    assert c.preview(tiff([(0x201, 4, 1, n), (0x202, 4, 1, len(whole))], extra=jpeg(0xC3))) is None
    assert c.is_picture(b"\xff\xd8\xff\xd8" + whole[2:], 0, len(whole) + 2)
