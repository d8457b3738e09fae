"""What a picture file says about itself: bytes -> groups of (name, value) pairs in the order of the file.

metadata(content, format) is a pandas UDF over binary and format columns."""

import re
import struct

import pandas as pd

from .containers import T_EXIF, T_GPS, Tiff, _gif_blocks, boxes, jpeg_segments, png_chunks, text_of, webp_chunks

T_IPTC, T_XMP = 0x83BB, 0x02BC
XMP_MARK = b"http://ns.adobe.com/xap/1.0/\0"

#: Words for numbers.
PROGRAMS = {1: "Manual", 2: "Program", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative", 6: "Action", 7: "Portrait", 8: "Landscape"}
MODES = {0: "Automatic", 1: "Manual", 2: "Automatic bracket"}
METERING = {1: "Average", 2: "Centre weighted", 3: "Spot", 4: "Multi-spot", 5: "Multi-segment", 6: "Partial"}
LIGHT = {1: "Daylight", 2: "Fluorescent", 3: "Tungsten", 4: "Flash", 9: "Fine weather", 10: "Cloudy", 11: "Shade", 17: "Standard light A", 18: "Standard light B", 19: "Standard light C", 24: "Studio tungsten"}
BALANCE = {0: "Automatic", 1: "Manual"}
SCENES = {0: "Standard", 1: "Landscape", 2: "Portrait", 3: "Night"}
DEGREES = {0: "Normal", 1: "Soft", 2: "Hard"}
AMOUNTS = {0: "Normal", 1: "Low", 2: "High"}
COLOUR_SPACES = {1: "sRGB", 2: "Adobe RGB", 65535: "Uncalibrated"}
#: Tag -> (name, how its value is said), for each kind of directory.
IMAGE_TAGS = {
    0x010F: ("Make", "text"), 0x0110: ("Model", "text"), 0x010E: ("Description", "text"), 0x0132: ("Changed", "date"), 0x013B: ("Photographer", "text"),
    0x8298: ("Copyright", "text"), 0x9003: ("Taken", "date"), 0x9004: ("Digitised", "date"),
}
SETTINGS_TAGS = {
    0x9003: ("Taken", "date"), 0x9004: ("Digitised", "date"), 0x829A: ("Shutter speed", "seconds"), 0x829D: ("Aperture", "f/{}"), 0x8827: ("ISO", "number"),
    0x8832: ("ISO", "number"), 0x9204: ("Exposure compensation", "stops"), 0x8822: ("Exposure program", PROGRAMS), 0xA402: ("Exposure mode", MODES),
    0x9207: ("Metering", METERING), 0x9209: ("Flash", "flash"), 0x9208: ("Light source", LIGHT), 0xA403: ("White balance", BALANCE), 0x920A: ("Focal length", "{} mm"),
    0xA405: ("Focal length on 35mm", "{} mm"), 0x9206: ("Subject distance", "{} m"), 0xA406: ("Scene", SCENES), 0xA408: ("Contrast", DEGREES),
    0xA409: ("Saturation", AMOUNTS), 0xA40A: ("Sharpness", DEGREES), 0xA001: ("Colour space", COLOUR_SPACES), 0xA434: ("Lens", "text"), 0xA433: ("Lens make", "text"),
    0xA435: ("Lens serial", "text"), 0xA431: ("Body serial", "text"), 0xA430: ("Camera owner", "text"), 0x9286: ("Comment", "comment"),
}
PLACE_TAGS = {0x0008: ("Satellites", "text"), 0x0012: ("Map datum", "text"), 0x001B: ("Found by", "text"), 0x001D: ("Date", "text")}
IPTC_FIELDS = {
    5: "Title", 25: "Keywords", 40: "Instructions", 55: "Date created", 80: "Creator", 90: "City", 92: "Sublocation", 95: "State or province", 101: "Country",
    105: "Headline", 110: "Credit line", 115: "Source", 116: "Copyright notice", 118: "Contact", 120: "Description",
}
XMP_NAMES = {
    "title": "Title", "description": "Description", "caption": "Description", "headline": "Headline", "subject": "Keywords", "keywords": "Keywords", "creator": "Creator",
    "byline": "Creator", "credit": "Credit line", "source": "Source", "rights": "Copyright notice", "copyrightnotice": "Copyright notice", "usageterms": "Rights usage terms",
    "instructions": "Instructions", "datecreated": "Date created", "city": "City", "state": "State or province", "province": "State or province", "country": "Country",
    "location": "Sublocation", "sublocation": "Sublocation", "label": "Label", "lens": "Lens", "lensmodel": "Lens",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def trimmed(value: float) -> str:
    return f"{value:.2f}".rstrip("0").rstrip(".")


def said_plainly(text: str) -> str | None:
    n = [int(x) for x in re.findall("[0-9]+", text) if len(x) < 10]
    if len(n) < 3 or n[0] < 1800 or not 1 <= n[1] <= 12 or not 1 <= n[2] <= 31:
        return None
    said = f"{MONTHS[n[1] - 1]} {n[2]}, {n[0]}"
    if len(n) < 5 or n[3] > 23 or n[4] > 59:
        return said
    second = min(59, n[5]) if len(n) > 5 else 0
    return f"{said}, {n[3] % 12 or 12}:{n[4]:02}:{second:02} {'am' if n[3] < 12 else 'pm'}"


def _number(t: Tiff, entry, raw: bytes) -> int | None:
    form = {1: "B", 6: "B", 7: "B", 3: "H", 8: "H", 4: "I", 9: "I"}.get(entry[0])
    return struct.unpack_from(t.order + form, raw)[0] if form and len(raw) >= struct.calcsize(form) else None


def _ratio(t: Tiff, entry, raw: bytes) -> float | None:
    if entry[0] not in (5, 10):
        value = _number(t, entry, raw)
        return None if value is None else float(value)
    if len(raw) < 8:
        return None
    top, bottom = struct.unpack_from(t.order + ("ii" if entry[0] == 10 else "II"), raw)
    return top / bottom if bottom else None


def _value(t: Tiff, entry, shape) -> str | None:
    raw = t.bytes_of(entry)
    if raw is None:
        return None
    if shape == "text":
        return text_of(raw) or None
    if shape == "comment":
        return text_of(raw[8:]) or None
    if shape == "date":
        return said_plainly(text_of(raw))
    if isinstance(shape, dict):
        return shape.get(_number(t, entry, raw))
    if shape == "number":
        value = _number(t, entry, raw) if entry[1] == 1 else None
        return None if value is None else str(value)
    if shape == "flash":
        value = _number(t, entry, raw)
        if value is None:
            return None
        if value & 0x20:
            return "No flash on this camera"
        return ("Fired" if value & 1 else "Did not fire") + (", red-eye reduction" if value & 0x40 else "")
    value = _ratio(t, entry, raw)
    if value is None:
        return None
    if shape == "seconds":
        return f"{value:.1f} s" if value >= 1 else f"1/{1 / value:.0f} s" if value > 0 else None
    if shape == "stops":
        return f"{'+' if value > 0 else ''}{trimmed(value)} EV" if value else "0"
    return shape.format(trimmed(value))


def _place(t: Tiff, e: dict) -> list[tuple[str, str]]:
    out = []
    letter = lambda tag: (t.bytes_of(e[tag]) or b"\0")[0] if tag in e else None
    for name, side, tag in (("Latitude", 1, 2), ("Longitude", 3, 4)):
        raw = t.bytes_of(e[tag]) if tag in e and e[tag][1] >= 3 else None
        if raw and len(raw) >= 24 and letter(side) is not None:
            n = struct.unpack_from(t.order + "6I", raw)
            if n[1] and n[3] and n[5]:
                out.append((name, f"{n[0] / n[1] + n[2] / n[3] / 60 + n[4] / n[5] / 3600:.5f} {chr(letter(side))}"))
    raw = t.bytes_of(e[6]) if 6 in e else None
    height = _ratio(t, e[6], raw) if raw else None
    if height is not None:
        out.append(("Height", f"{trimmed(height)} m {'below' if letter(5) == 1 else 'above'} sea level"))
    return out


def from_tiff(raw: bytes, name="Image", tags=IMAGE_TAGS) -> list:
    t, out, seen = Tiff(raw), [], set()
    todo = [(t.read("I", 4) or 0, name, tags)] if t.order else []
    while todo:
        at, name, tags = todo.pop()
        if at in seen or len(seen) > 8:
            continue
        seen.add(at)
        e = t.entries(at)
        if not e:
            continue
        group: dict[str, str] = {}
        for tag, entry in e.items():
            if tag == T_EXIF:
                todo.append((entry[2], "Settings", SETTINGS_TAGS))
            elif tag == T_GPS:
                todo.append((entry[2], "Place", PLACE_TAGS))
            elif tag in (T_IPTC, T_XMP):
                out += (from_iptc if tag == T_IPTC else from_xmp)(t.bytes_of(entry) or b"")
            elif tag in tags and tags[tag][0] not in group:
                value = _value(t, entry, tags[tag][1])
                if value is not None:
                    group[tags[tag][0]] = value
        out.append((name, (_place(t, e) if tags is PLACE_TAGS else []) + list(group.items())))
        if t.after(at) and len(seen) < 8:
            todo.append((t.after(at), "Thumbnail", IMAGE_TAGS))
    return [g for g in out if g[0] != "Thumbnail"]


def from_iptc(raw: bytes) -> list:
    entries, at = [], 0
    while at + 5 <= len(raw):
        if raw[at] != 0x1C:
            at += 1
            continue
        size, start = struct.unpack_from(">H", raw, at + 3)[0], at + 5
        if size & 0x8000:
            start += size & 0x7FFF
            size = int.from_bytes(raw[at + 5 : start], "big")
        if start + size > len(raw):
            break
        name = IPTC_FIELDS.get(raw[at + 2]) if raw[at + 1] == 2 else None
        value = text_of(raw[start : start + size])
        if name and value:
            entries.append((name, value))
        at = start + size
    return [("Description", entries)] if entries else []


def from_photoshop(raw: bytes) -> list:
    """The IPTC block among the resources of an image-editor segment."""
    at = raw.find(b"Photoshop 3.0\0")
    at = raw.find(b"8BIM", at + 14) if at >= 0 else -1
    while 0 <= at <= len(raw) - 12:
        after = at + 7 + raw[at + 6]
        after += after % 2
        size = int.from_bytes(raw[after : after + 4], "big")
        if raw[at + 4 : at + 6] == b"\x04\x04":
            return from_iptc(raw[after + 4 : after + 4 + size])
        at = raw.find(b"8BIM", after + 4 + size)
    return []


def _xmp_name(prop: str) -> str | None:
    space, colon, name = prop.partition(":")
    return None if space in ("rdf", "x", "xmlns") else XMP_NAMES.get((name if colon else prop).lower())


def from_xmp(raw: bytes) -> list:
    """Properties as attributes and as elements, read by scanning; list items of one property are joined."""
    text, found = raw.decode("utf-8", "replace"), {}

    def add(name, value):
        value = value.strip()
        value = said_plainly(value) if name == "Date created" and value else value
        if value and value not in found.setdefault(name, []):
            found[name].append(value)

    for m in re.finditer(r"""(?<!\S)([^\s="<>]+)="([^"\s]*)"(?=[/>\s]|\Z)""", text):
        if _xmp_name(m[1]):
            add(_xmp_name(m[1]), m[2])
    at = 0
    for_open = re.compile(r"<([^>]*)>")
    while m := for_open.search(text, at):
        at, tag = m.end(), m[1]
        prop = tag.split()[0] if tag.split() else tag
        if tag[:1] in ("/", "?") or tag.endswith("/") or not _xmp_name(prop):
            continue
        end = text.find(f"</{prop}>", at)
        if end < 0:
            continue
        body = text[at:end]
        items = [x.strip() for x in re.findall(r"<rdf:li[^>]*>([^<]*)(?=<)", body) if x.strip()]
        for value in items or [re.sub(r"<[^>]*>", "", body)]:
            add(_xmp_name(prop), value)
        at = end + len(prop) + 3
    entries = sorted((name, ", ".join(values)) for name, values in found.items() if values)
    return [("Description", entries)] if entries else []


def from_png(raw: bytes) -> list:
    out, entries = [], []
    for kind, at, size in png_chunks(raw):
        data = raw[at : at + size]
        if len(data) < size or kind == b"IEND":
            break
        if kind in (b"tEXt", b"iTXt") and b"\0" in data:
            name, value = data.split(b"\0", 1)
            if kind == b"iTXt":
                # what follows the third zero byte: the flags are two of them, the language ends with one
                zeros = [m.start() for m in re.finditer(b"\0", value)]
                value = value[zeros[2] + 1 :] if len(zeros) > 2 else value
            entries.append((text_of(name), value.decode("utf-8", "replace").strip()))
        elif kind == b"eXIf":
            out += from_tiff(data)
    return out + ([("Description", entries)] if entries else [])


def read(raw: bytes, fmt: str) -> list[tuple[str, list[tuple[str, str]]]]:
    out = []
    if fmt == "jpeg":
        segments = list(jpeg_segments(raw))
        out += next((from_tiff(d[6:]) for m, d in segments if m == 0xE1 and d.startswith(b"Exif\0\0")), [])
        for mark, data in segments:
            if mark == 0xE1 and data.startswith(XMP_MARK):
                out += from_xmp(data[len(XMP_MARK) :])
            elif mark == 0xED:
                out += from_photoshop(data)
            elif mark == 0xFE:
                out.append(("File", [("Comment", text_of(data))]))
    elif fmt == "png":
        out += from_png(raw)
    elif fmt == "gif":
        comments = [("Comment", text_of(data)) for kind, label, data in _gif_blocks(raw) if kind == 0x21 and label == 0xFE]
        out += [("Description", comments)] if comments else []
    elif fmt == "webp":
        for kind, at, size in webp_chunks(raw):
            if at + size > len(raw):
                break
            out += {b"EXIF": from_tiff, b"XMP ": from_xmp}.get(kind, lambda _: [])(raw[at : at + size])
    elif fmt in ("heic", "cr3"):
        for kind, a, b in boxes(raw):
            if kind in (b"CMT1", b"CMT2", b"CMT4"):
                out += from_tiff(raw[a:b], *{b"CMT1": ("Image", IMAGE_TAGS), b"CMT2": ("Settings", SETTINGS_TAGS), b"CMT4": ("Place", PLACE_TAGS)}[kind])
            elif kind in (b"mdat", b"idat"):
                exif, xmp = raw.find(b"Exif\0\0", a, b), raw.find(b"<x:xmpmeta", a, b)
                out += from_tiff(raw[exif + 6 : b]) if exif >= 0 else []
                out += from_xmp(raw[xmp:b]) if xmp >= 0 else []
    else:
        out += from_tiff(raw)
    return [g for g in out if g[1]]


def metadata_udf():
    """Pandas UDF (binary, format) -> array of groups of entries."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<struct<name:string,entries:array<struct<k:string,v:string>>>>")
    def metadata(content: pd.Series, fmt: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "entries": [{"k": k, "v": v} for k, v in e]} for n, e in read(bytes(c), f)] if c is not None else None for c, f in zip(content, fmt, strict=True)])

    return metadata
