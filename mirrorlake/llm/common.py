"""What several operators share: reading tables, tables in the shared folder, SQL snippets."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from mirrorlake.sources.shared import drop_stash, shared_dir, stash

__all__ = ["SPACE", "WORD", "drop_stash", "few_rows", "let", "shared_dir", "stash", "table", "words_sql"]

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\\x20\\x09-\\x0D]+"
SPACE = r"[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def few_rows(spark: SparkSession, rows=1000):
    """Arrow batches of so many rows at most in the jobs that run within, so that batches of texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_sql(text: str) -> str:
    """SQL for the array of words of a text; null gives an empty array."""
    return f"array_remove(split(coalesce({text}, ''), '{SPACE}'), '')"
