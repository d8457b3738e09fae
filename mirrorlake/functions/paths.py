"""Column functions over relative paths and picture facts: folder, extension, format, keep score."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and the format that each stands for.
FORMATS = {
    "jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "jfif": "jpeg", "png": "png", "gif": "gif", "webp": "webp", "tif": "tiff", "tiff": "tiff",
    "heic": "heic", "heif": "heic", "cr2": "cr2", "cr3": "cr3", "nef": "nef", "arw": "arw", "rw2": "rw2",
}
LOSSY = ("jpeg", "webp", "heic")
#: Marks of copies in a file's name and in its path.
COPY_MARKERS = (" - copy", " copy", "copy of ", "-copy", "_copy", "(1)", "(2)", "(3)")
COPY_FOLDERS = ("/copy/", "/new folder", "/downloads/")


def folder_of(path) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def format_of(path) -> Column:
    """Format by extension, null where it is no picture's."""
    return F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[extension(path)]


def is_lossy(fmt) -> Column:
    return F.col(fmt).isin(*LOSSY) if isinstance(fmt, str) else fmt.isin(*LOSSY)


def has_copy_number(name) -> Column:
    return name.rlike(r"[_-][0-9]+$")


def ascii_lower(x) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_penalty(path) -> Column:
    """0 or less: 0.05 for each mark of a copy, 0.15 at most, and 0.0005 for each character, 0.05 at most."""
    path = F.col(path) if isinstance(path, str) else path
    low = ascii_lower(path)
    name = stem(low)
    hits = [F.contains(name, F.lit(m)) for m in COPY_MARKERS] + [F.contains(low, F.lit(m)) for m in COPY_FOLDERS]
    hits += [F.startswith(name, F.lit("~")), has_copy_number(name)]
    marks = sum((h.cast("int") for h in hits), F.lit(0))
    return -(F.least(marks * F.lit(0.05), F.lit(0.15)) + F.least(F.char_length(path) * F.lit(0.0005), F.lit(0.05)))


def keep_score(width="width", height="height", fmt="format", channels="channels", size="size_bytes", path="rel_path") -> Column:
    """How much a picture is worth keeping: doublings of pixels first, all else below one doubling."""
    pixels = F.greatest(F.col(width).cast("double") * F.col(height).cast("double"), F.lit(1.0))
    each = F.greatest(F.col(size), F.lit(0)).cast("double") / pixels
    return (
        F.log2(pixels)
        + F.when(is_lossy(fmt), 0.0).otherwise(0.30)
        - F.least(each, F.lit(8.0)) / 8.0 * 0.20
        + F.when(F.col(channels) >= 3, 0.15).otherwise(0.0)
        + F.when(F.col(channels).isin(2, 4), 0.08).otherwise(0.0)
        + path_penalty(path)
    )


def aspect_ok(w1, h1, w2, h2, most=0.06) -> Column:
    """Long over short side differs by less than most of the larger ratio; every side is over 0."""
    ratio = lambda w, h: F.greatest(w, h).cast("double") / F.least(w, h).cast("double")
    w1, h1, w2, h2 = (F.col(x) if isinstance(x, str) else x for x in (w1, h1, w2, h2))
    good = (w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0)
    a, b = ratio(w1, h1), ratio(w2, h2)
    return F.when(good, F.abs(a - b) / F.greatest(a, b) < most).otherwise(False)


def csv_field(x) -> Column:
    """RFC 4180 quoting where a comma, a quote or a line break asks for it."""
    x = (F.col(x) if isinstance(x, str) else x).cast("string")
    return F.when(x.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
