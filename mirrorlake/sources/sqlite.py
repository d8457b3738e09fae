"""Indexes in a SQLite file: read into a Catalogue, older layouts too, and written from one.

Tables are read by tasks, each a range of row numbers, so the file must stand where executors see it. A single
file has a single writer, so export runs on the driver, one partition of a table in memory at a time."""

import math
import os
import sqlite3
import time
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.sources import migrate
from mirrorlake.sources.catalogue import KEYS, SCHEMAS, Catalogue

#: Rows that a task reads.
ROWS = 50_000
#: How kinds of columns are declared in the file.
DECLARED = {"long": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "string": "TEXT", "binary": "BLOB"}
_ARROW = {"INTEGER": ("long", pa.int64()), "TEXT": ("string", pa.string()), "BLOB": ("binary", pa.binary()), "REAL": ("double", pa.float64())}


def _open(path: str):
    return closing(sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True))


def layout(path: str) -> dict[str, list[tuple[str, str]]]:
    """Table -> (column, declared type) as the file has them."""
    with _open(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        return {n: [(r[1], (r[2] or "BLOB").upper()) for r in db.execute(f'PRAGMA table_info("{n}")')] for n in names}


def read_table(spark: SparkSession, path: str, name: str, rows=ROWS) -> DataFrame:
    columns = layout(path)[name]
    with _open(path) as db:
        low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{name}"').fetchone()
    schema = pa.schema([(c, _ARROW.get(kind, _ARROW["BLOB"])[1]) for c, kind in columns])
    chosen = ", ".join(f'"{c}"' for c, _ in columns)

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                first = low + k * rows
                with _open(path) as db:
                    cursor = db.execute(f'SELECT {chosen} FROM "{name}" WHERE rowid BETWEEN ? AND ?', (first, first + rows - 1))
                    while got := cursor.fetchmany(4096):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), schema.types, strict=True)], schema=schema)

    parts = math.ceil((high - low + 1) / rows)
    ddl = ", ".join(f"`{c}` {_ARROW.get(kind, _ARROW['BLOB'])[0]}" for c, kind in columns)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(read, ddl)


def import_index(spark: SparkSession, path: str, index: str) -> Catalogue:
    """A Catalogue at index with the rows of the file; tables that it lacks are empty, or absent where a review's."""
    there = layout(path)
    found = {}
    for name in SCHEMAS:
        if name in there:
            rows = read_table(spark, path, name)
            found[name] = migrate.table(name, rows, SCHEMAS[name])
    catalogue = Catalogue(spark, index)
    catalogue._swap(found)
    return catalogue


def export_index(catalogue: Catalogue, path: str) -> int:
    """Write the tables of an index into a new file; the number of rows. The file appears whole or not at all."""
    part, n = f"{path}.{time.time_ns()}", 0
    with closing(sqlite3.connect(part)) as db:
        for name, schema in SCHEMAS.items():
            if not catalogue.exists(name):
                continue
            columns = [c.split() for c in schema.split(", ")]
            lines = [f'"{c}" {DECLARED[kind]} NOT NULL' for c, kind in columns if [c] != KEYS[name] or kind == "string"]
            lines = [f'"{c}" INTEGER PRIMARY KEY' for c, kind in columns if [c] == KEYS[name] and kind == "long"] + lines
            if name == "files":
                lines = ['"id" INTEGER PRIMARY KEY', *(x + " UNIQUE" * x.startswith('"rel_path"') for x in lines if not x.startswith('"id"'))]
            elif len(KEYS[name]) > 1 or name == "meta":
                lines.append(f"PRIMARY KEY ({', '.join(KEYS[name])})")
            db.execute(f"CREATE TABLE {name} ({', '.join(lines)})")
            names = ", ".join(f'"{c}"' for c, _ in columns)
            rows = catalogue.table(name).select(*[F.col(c).cast("int").alias(c) if kind == "boolean" else F.col(c) for c, kind in columns])
            held = []
            for r in rows.toLocalIterator():
                held.append([bytes(x) if isinstance(x, bytearray) else x for x in r])
                if len(held) == 4096:
                    db.executemany(f"INSERT INTO {name} ({names}) VALUES ({', '.join('?' * len(columns))})", held)
                    n, held = n + len(held), []
            db.executemany(f"INSERT INTO {name} ({names}) VALUES ({', '.join('?' * len(columns))})", held)
            n += len(held)
        db.commit()
    os.replace(part, path)
    return n
