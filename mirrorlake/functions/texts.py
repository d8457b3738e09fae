"""Column functions that put numbers and names into words."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import FORMATS


def fill(template: str, **values) -> Column:
    """A template with its {names} filled in, read once from left to right: braces in a value stay as they are, and
    so does a name that has no value."""
    parts = []
    for piece in re.split(r"(\{[^}]*\})", template):
        name = piece[1:-1] if piece[:1] == "{" and piece[-1:] == "}" else None
        value = values.get(name) if name is not None else None
        parts.append(F.lit(piece) if value is None else (value if isinstance(value, Column) else F.lit(value)).cast("string"))
    return F.concat(*parts)


def counted(n, one: str, more: str) -> Column:
    """A number and its noun, which differs for one of it."""
    n = F.col(n) if isinstance(n, str) else n
    return fill("{count} {noun}", count=n, noun=F.when(n == 1, one).otherwise(more))


def trimmed(x) -> Column:
    """Two decimals without zeros, and without a point, at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), "0+$", ""), r"\.$", "")


def fraction(part, whole, out_of: int) -> Column:
    """Part of a whole on a scale of out_of; nothing of nothing is nothing."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    least = F.least(part, whole) * F.lit(out_of)
    return F.when(whole == 0, F.lit(0)).otherwise((least - F.pmod(least, whole)) / whole).cast("long")


def on_preset(sensitivity, percent) -> Column:
    """Whether two settings of one decimal place are the same one."""
    return F.abs(sensitivity - percent) < 0.05


def fit_within(width, height, target: int) -> Column:
    """Struct of width and height of the largest picture of that shape whose long side is target, 1 at least; a
    smaller one stays as it is."""
    width, height = (F.col(x).cast("long") if isinstance(x, str) else x for x in (width, height))
    share = lambda a, b: F.greatest((a * target - F.pmod(a * target, b)) / b, F.lit(1)).cast("int")
    fits = (width <= target) & (height <= target)
    w = F.when(fits, width).when(width >= height, F.lit(target)).otherwise(share(width, height))
    h = F.when(fits, height).when(width >= height, share(height, width)).otherwise(F.lit(target))
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def parse_format(name) -> Column:
    """The format of a stored name; one that is not known counts as jpeg."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.isin(*sorted(set(FORMATS.values()))), name).otherwise("jpeg")


def kept_out(name) -> Column:
    """Folders that a listing does not enter."""
    return F.substring(name, 1, 1).isin(".", "@")
