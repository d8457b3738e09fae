"""Picture containers read byte by byte: format by content, animation, embedded previews, orientation, metadata.

All functions take the bytes of one file and never fail on broken ones: what cannot be read is left out."""

import re
import struct

#: Brands of the ISO container and directory tags.
HEIC_BRANDS = (b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1")
T_WIDTH, T_HEIGHT, T_COMPRESSION, T_MAKE, T_STRIP, T_ORIENTATION, T_STRIP_SIZE, T_SUB = 0x100, 0x101, 0x103, 0x10F, 0x111, 0x112, 0x117, 0x14A
T_JPEG, T_JPEG_SIZE, T_EXIF, T_GPS, T_EXIF_WIDTH, T_EXIF_HEIGHT, T_PANASONIC = 0x201, 0x202, 0x8769, 0x8825, 0xA002, 0xA003, 0x2E
_UNIT = {1: 1, 2: 1, 6: 1, 7: 1, 3: 2, 8: 2, 4: 4, 9: 4, 11: 4, 5: 8, 10: 8, 12: 8}
DEPTH = 8


class Tiff:
    """Directories of a TIFF-like block."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.order = {b"II*\0": "<", b"IIU\0": "<", b"MM\0*": ">"}.get(raw[:4])

    def read(self, form: str, at: int):
        try:
            return struct.unpack_from(self.order + form, self.raw, at)[0]
        except struct.error:
            return None

    def entries(self, at: int) -> dict[int, tuple[int, int, int, int]]:
        """tag -> (type, count, value, place); the first of a repeated tag. Empty for a broken directory."""
        n = self.read("H", at)
        if n is None or at + 2 + 12 * n > len(self.raw):
            return {}
        out: dict = {}
        for k in range(n):
            place = at + 2 + 12 * k
            tag, kind, count, value = struct.unpack_from(self.order + "HHII", self.raw, place)
            out.setdefault(tag, (kind, count, value, place))
        return out

    def bytes_of(self, entry) -> bytes | None:
        kind, count, value, place = entry
        size = _UNIT.get(kind, 1) * count
        start = place + 8 if size <= 4 else value
        return self.raw[start : start + size] if start + size <= len(self.raw) else None

    def number(self, entry) -> int | None:
        if entry is None:
            return None
        if entry[0] == 3:
            return self.read("H", entry[3] + 8)
        return entry[2] if entry[0] in (4, 9) else None

    def after(self, at: int) -> int:
        n = self.read("H", at)
        return (self.read("I", at + 2 + 12 * n) or 0) if n is not None else 0

    def first(self) -> dict:
        return self.entries(self.read("I", 4) or 0) if self.order else {}


def text_of(raw: bytes) -> str:
    """Up to the first zero byte, broken characters replaced, control characters and runs of space as one space."""
    text = raw.split(b"\0", 1)[0].decode("utf-8", "replace")
    return " ".join(re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", text).split())


def maker(raw: bytes) -> str | None:
    t = Tiff(raw)
    entry = t.first().get(T_MAKE) if t.order else None
    value = t.bytes_of(entry) if entry else None
    return value.split(b"\0", 1)[0].decode("utf-8", "replace").strip() if value is not None else None


def detect(head: bytes) -> str | None:
    """Format by the first bytes; the file's name does not matter."""
    for magic, name in ((b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF87a", "gif"), (b"GIF89a", "gif")):
        if head.startswith(magic):
            return name
    if len(head) >= 12 and head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    if len(head) >= 12 and head[4:8] == b"ftyp":
        for at in range(8, min(len(head) - 3, 72), 4):
            brand = head[at : at + 4]
            if brand == b"crx ":
                return "cr3"
            if brand in HEIC_BRANDS:
                return "heic"
    if head.startswith(b"IIU\0"):
        return "rw2"
    order = Tiff(head).order
    if not order:
        return None
    if order == "<" and len(head) >= 11 and head[8:10] == b"CR":
        return "cr2"
    made = maker(head) or ""
    return "nef" if made.startswith("NIKON") else "arw" if made.startswith("SONY") else "tiff"


def chunks(raw: bytes, start: int, order: str, kind_first: bool, align: int, trailer: int):
    """(kind, place of the data, length) of the chunks of a PNG or RIFF file."""
    at = start
    while at + 8 <= len(raw):
        a, b = raw[at : at + 4], raw[at + 4 : at + 8]
        kind, size = (a, b) if kind_first else (b, a)
        size = struct.unpack(order + "I", size)[0]
        yield kind, at + 8, size
        at += 8 + size + trailer + (size & 1 if align == 2 else 0)


def png_chunks(raw: bytes):
    return chunks(raw, 8, ">", False, 1, 4)


def webp_chunks(raw: bytes):
    return chunks(raw, 12, "<", True, 2, 0)


def _gif_blocks(raw: bytes):
    """(introducer, label, data or None) of the blocks of a GIF up to its end or the first broken one."""
    if len(raw) < 13:
        return
    at = 13 + (3 << ((raw[10] & 7) + 1) if raw[10] & 0x80 else 0)

    def parts(at):
        data = b""
        while at < len(raw):
            n = raw[at]
            at += 1
            if n == 0:
                return at, data
            if at + n > len(raw):
                return None, data
            data += raw[at : at + n]
            at += n
        return None, data

    while at < len(raw):
        kind = raw[at]
        if kind == 0x2C:
            yield kind, None, None
            if at + 10 > len(raw):
                return
            local = raw[at + 9]
            at, _ = parts(at + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        elif kind == 0x21:
            label = raw[at + 1] if at + 1 < len(raw) else 0
            at, data = parts(at + 2)
            yield kind, label, data
        else:
            return
        if at is None:
            return


def is_animated(fmt: str, raw: bytes) -> bool:
    if fmt == "gif":
        frames = 0
        for kind, _, _ in _gif_blocks(raw):
            frames += kind == 0x2C
            if frames > 1:
                return True
        return False
    if fmt == "png":
        for kind, _, _ in png_chunks(raw):
            if kind in (b"acTL", b"IDAT", b"IEND"):
                return kind == b"acTL"
    if fmt == "webp":
        for kind, at, _ in webp_chunks(raw):
            if kind == b"VP8X":
                return at < len(raw) and bool(raw[at] & 2)
            if kind in (b"ANIM", b"ANMF"):
                return True
    return False


# ---- embedded JPEG previews ------------------------------------------------------------------------------


def jpeg_span(raw: bytes, at: int) -> bytes | None:
    """The JPEG stream that begins at a place, up to its end marker, if it is a picture: baseline, extended or
    progressive with one or three components (not the lossless stream of a sensor)."""
    if raw[at : at + 2] != b"\xff\xd8":
        return None
    start, at, picture = at, at + 2, False
    while at + 2 <= len(raw):
        if raw[at] != 0xFF:
            return None
        mark = raw[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            return raw[start : at + 2] if picture else None
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        if at + 4 > len(raw):
            return None
        size = struct.unpack_from(">H", raw, at + 2)[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if mark > 0xC2 or at + 10 > len(raw) or raw[at + 9] not in (1, 3):
                return None
            picture = True
        at += 2 + max(2, size)
        if mark == 0xDA:  # entropy-coded data up to the next marker that is no restart and no stuffed byte
            found = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(raw, at)
            if not found:
                return None
            at = found.start()
    return None


def is_picture(raw: bytes, at: int, end: int) -> bool:
    """Whether the first frame of the JPEG in raw[at:end] is one that can be shown."""
    if raw[at : at + 3] != b"\xff\xd8\xff":
        return False
    at += 2
    while at + 2 <= end and raw[at] == 0xFF:
        mark = raw[at + 1]
        if mark in (0xD9, 0xDA):
            return False
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return mark <= 0xC2 and at + 10 <= end and raw[at + 9] in (1, 3)
        alone = mark == 0x01 or 0xD0 <= mark <= 0xD8
        if not alone and mark != 0xFF and at + 4 > end:
            return False
        at += 1 if mark == 0xFF else 2 if alone else 2 + max(2, struct.unpack_from(">H", raw, at + 2)[0])
    return False


def embedded(raw: bytes, at: int, size: int | None) -> bytes | None:
    """The JPEG at a place: as long as the container says, where that lies in the file, else as its markers say."""
    if size is None or size <= 4 or at + size > len(raw):
        return jpeg_span(raw, at)
    return raw[at : at + size] if is_picture(raw, at, at + size) else None


def jpeg_size(raw: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(raw) and raw[at] == 0xFF:
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", raw, at + 5)
            return w, h
        at += 2 + max(2, struct.unpack_from(">H", raw, at + 2)[0])
    return None


def _directories(t: Tiff):
    """Entries of the directories of a file, each once: those of the chain, and those that hang off them."""
    todo, seen = [t.read("I", 4) or 0], set()
    while todo:
        at = todo.pop()
        if at in seen or len(seen) >= DEPTH:
            continue
        seen.add(at)
        e = t.entries(at)
        if not e:
            continue
        yield e
        if T_EXIF in e:
            todo.append(e[T_EXIF][2])
        if T_SUB in e:
            _, count, value, _ = e[T_SUB]
            todo += [value] if count == 1 else [x for x in (t.read("I", value + 4 * k) for k in range(min(count, DEPTH))) if x is not None]
        if t.after(at):
            todo.append(t.after(at))


def _places(t: Tiff, e: dict) -> list[tuple[int, int | None]]:
    """Where one directory says that a JPEG stands, and how long it is."""
    number = lambda tag: t.number(e.get(tag))
    out = [(number(T_JPEG), number(T_JPEG_SIZE))]
    if T_PANASONIC in e:
        out.append((e[T_PANASONIC][2], e[T_PANASONIC][1]))
    if number(T_COMPRESSION) in (6, 7):
        out.append((number(T_STRIP), number(T_STRIP_SIZE)))
    return [(at, size) for at, size in out if at is not None and size is not None]


def _tiff_preview(raw: bytes):
    t = Tiff(raw)
    found, sizes = [], []
    for e in _directories(t):
        sides = [(t.number(e.get(w)), t.number(e.get(h))) for w, h in ((T_WIDTH, T_HEIGHT), (2, 3), (T_EXIF_WIDTH, T_EXIF_HEIGHT))]
        sizes += [s for s in sides if None not in s]
        found += [x for x in (embedded(raw, *place) for place in _places(t, e)) if x]
    return (max(found, key=len), max(sizes, key=lambda s: s[0] * s[1], default=None)) if found else None


CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"meta", b"uuid")


def boxes(raw: bytes, start=0, end=None, depth=0):
    """(kind, start, end) of all boxes of an ISO file, outer before inner."""
    end = len(raw) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I", raw, start)[0], raw[start + 4 : start + 8]
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        size = end - start if size == 0 else size
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        if kind in CONTAINERS and depth < DEPTH:
            yield from boxes(raw, start + head + {b"uuid": 16, b"meta": 4}.get(kind, 0), start + size, depth + 1)
        start += size


def preview(raw: bytes) -> tuple[bytes, tuple[int, int] | None] | None:
    """The largest embedded JPEG of a raw file, and the size that the file gives itself."""
    if Tiff(raw).order:
        return _tiff_preview(raw)
    if raw[4:8] != b"ftyp":
        return None
    best = None
    for kind, a, b in boxes(raw):
        if kind in (b"PRVW", b"THMB", b"mdat"):
            at = raw.find(b"\xff\xd8\xff", a, b)
            found = jpeg_span(raw, at) if at >= 0 else None
            if found and (best is None or len(found) > len(best)):
                best = found
    return (best, None) if best else None


def jpeg_segments(raw: bytes):
    """(marker, data) of the segments before the picture data."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] not in (0xDA, 0xD9):
        size = max(2, struct.unpack_from(">H", raw, at + 2)[0])
        yield raw[at + 1], raw[at + 4 : at + 2 + size]
        at += 2 + size


def orientation(raw: bytes) -> int:
    if raw.startswith(b"\xff\xd8\xff"):
        raw = next((d[6:] for m, d in jpeg_segments(raw) if m == 0xE1 and d.startswith(b"Exif\0\0")), b"")
    t = Tiff(raw)
    value = t.number(t.first().get(T_ORIENTATION)) if t.order else None
    return value if value is not None and 1 <= value <= 8 else 1


def turn_upright(picture, way: int):
    """A picture array turned as its orientation asks (1-8); for showing only."""
    import numpy as np

    if way in (5, 6, 7, 8):
        picture = np.swapaxes(picture, 0, 1)
    return {2: picture[:, ::-1], 3: picture[::-1, ::-1], 4: picture[::-1], 6: picture[:, ::-1], 7: picture[::-1, ::-1], 8: picture[::-1]}.get(way, picture)
