"""Old index layouts brought to the present one: columns added with defaults, times to seconds, dead columns dropped."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEAD = ("bytes_hash", "dct_hash", "mtime_ns", "mtime_ms")


def files(rows: DataFrame) -> DataFrame:
    """files with mtime_ns or mtime_ms -> mtime_seconds (cut off), and not_a_picture where it was not yet."""
    if "mtime_seconds" not in rows.columns:
        old = "mtime_ns div 1000000000" if "mtime_ns" in rows.columns else "mtime_ms div 1000" if "mtime_ms" in rows.columns else "0L"
        rows = rows.withColumn("mtime_seconds", F.expr(old).cast("long"))
    if "not_a_picture" not in rows.columns:
        rows = rows.withColumn("not_a_picture", F.lit(False))
    return rows.drop(*DEAD)


def fingerprints(rows: DataFrame) -> DataFrame:
    """fingerprints without corners get empty ones."""
    if "corners" not in rows.columns:
        rows = rows.withColumn("corners", F.lit(b""))
    return rows.drop(*DEAD)


def table(name: str, rows: DataFrame, schema: str) -> DataFrame:
    """A table of an older index with the columns of schema and no others."""
    rows = files(rows) if name == "files" else fingerprints(rows) if name == "fingerprints" else rows
    columns = [c.split() for c in schema.split(", ")]
    return rows.select(*[F.col(c).cast({"long": "bigint"}.get(kind, kind)).alias(c) for c, kind in columns])
