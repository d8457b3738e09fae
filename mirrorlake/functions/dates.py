"""Column functions over times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names as they are said.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def file_date(seconds) -> Column:
    """YYYY-MM-DD HH:MM in UTC for whole seconds since 1970, before it too; the session's zone is no matter."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    days = F.floor(seconds / F.lit(86400)).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d", F.floor(rest / 3600).cast("int"), F.floor(rest % 3600 / 60).cast("int"))
    return F.concat_ws(" ", F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd"), clock)


def whole_seconds(ts) -> Column:
    """Whole seconds since 1970, cut off, and 0 before it or without a time."""
    return F.coalesce(F.greatest(F.unix_seconds(ts), F.lit(0)), F.lit(0))


def said_plainly(text) -> Column:
    """'June 13, 2026, 4:18:34 am' from digits apart; without a sound clock only the date; null if no date.
    Days are only held to 1-31."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.regexp_extract_all(text, F.lit("([0-9]+)"))
    part = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    year, month, day, hour, minute, second = (part(k) for k in range(1, 7))
    good = (year >= 1800) & month.between(1, 12) & day.between(1, 31)
    date = F.format_string("%s %d, %d", F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.least(month, F.lit(12)), F.lit(1))), day, year)
    half = F.when(hour < 12, "am").otherwise("pm")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    second = F.least(F.coalesce(second, F.lit(0)), F.lit(59))
    clock = F.when((hour <= 23) & (minute <= 59), F.format_string("%d:%02d:%02d %s", shown, minute, second, half))
    return F.when(good, F.concat_ws(", ", date, clock))
