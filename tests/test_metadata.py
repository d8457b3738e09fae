import struct

from test_containers import tiff

from mirrorlake.functions import metadata as m


def test_exif_values():
    rational = lambda *x: struct.pack("<" + "I" * len(x), *x)
    inner = [(0x829A, 5, 1, rational(1, 250)), (0x829D, 5, 1, rational(28, 10)), (0x8827, 3, 1, 400), (0x9204, 10, 1, struct.pack("<ii", 1, 3)), (0x9209, 3, 1, 0x41), (0x9003, 2, 20, b"2026:06:13 04:18:34\0"), (0xA402, 3, 1, 9)]
    got = dict(m.from_tiff(tiff(inner), "Settings", m.SETTINGS_TAGS)[0][1])
    assert got == {"Shutter speed": "1/250 s", "Aperture": "f/2.8", "ISO": "400", "Exposure compensation": "+0.33 EV", "Flash": "Fired, red-eye reduction", "Taken": "June 13, 2026, 4:18:34 am"}
    place = [(1, 2, 2, b"N\0"), (2, 5, 3, rational(51, 1, 30, 1, 36, 1)), (5, 1, 1, b"\1"), (6, 5, 1, rational(25, 2))]
    assert m.from_tiff(tiff(place), "Place", m.PLACE_TAGS) == [("Place", [("Latitude", "51.51000 N"), ("Height", "12.5 m below sea level")])]
    assert m.from_tiff(b"junk") == [] and m.from_tiff(b"II*\0\xff\xff\xff\xff") == []


def test_iptc_and_xmp():
    field = lambda n, v: b"\x1c\2" + bytes([n]) + struct.pack(">H", len(v)) + v
    raw = field(5, b"A title") + field(25, b"one") + field(25, b"two") + field(200, b"x")
    assert m.from_iptc(raw) == [("Description", [("Title", "A title"), ("Keywords", "one"), ("Keywords", "two")])]
    app13 = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(raw)) + raw
    assert m.read(b"\xff\xd8\xff\xed" + struct.pack(">H", len(app13) + 2) + app13 + b"\xff\xfe\0\5abc\xff\xd9", "jpeg") == m.from_iptc(raw) + [("File", [("Comment", "abc")])]
    xmp = b'<x:xmpmeta><rdf:Description photoshop:City="Oslo" rdf:about="x"/><dc:subject><rdf:Bag><rdf:li>b</rdf:li><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Bag></dc:subject><dc:title><rdf:Alt><rdf:li xml:lang="x">T</rdf:li></rdf:Alt></dc:title></x:xmpmeta>'
    assert m.from_xmp(xmp) == [("Description", [("City", "Oslo"), ("Keywords", "b, a"), ("Title", "T")])]


def test_png_text_and_dates():
    chunk = lambda kind, data=b"": struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Author\0me ") + chunk(b"iTXt", b"Title\0\0\0en\0hello") + chunk(b"IEND")
    assert m.read(png, "png") == [("Description", [("Author", "me"), ("Title", "hello")])]
    assert m.said_plainly("2026-02-31") == "February 31, 2026" and m.said_plainly("1700:01:01") is None and m.said_plainly("2026:01:02 25:00") == "January 2, 2026"
    assert m.said_plainly("2026:01:02 00:07") == "January 2, 2026, 12:07:00 am"
