"""The picture index: Parquet tables behind numbered version files.

A table is a base and the changes since, each a folder of rows by key, in which a row replaces that of its key or
says that it is gone. So a change costs what it changes; a table with more than MOST_CHANGES of them is written
whole again. A change becomes visible with the next version file, which is put in place by a rename that never
overwrites: a reader sees all of a change or none, and of two writers the second fails instead of undoing the first.
An index of an older schema is brought to the present one when it is opened."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorlake.operators import review
from mirrorlake.sources import migrate

SCHEMA_VERSION = 1
MOST_CHANGES = 12
SCHEMAS = {
    "meta": "key string, value string",
    "files": "id long, rel_path string, size_bytes long, mtime_seconds long, last_scanned_at long, not_a_picture boolean",
    "images": "file_id long, width int, height int, format string, channels int",
    "fingerprints": "file_id long, fingerprint_version long, dct_hashes binary, ring_stats binary, corners binary",
    "ignore": "lower long, higher long",
    "keep": "file_id long",
    "duplicate_sets": "set_id long, file_id long, at long",
}
KEYS = {"meta": ["key"], "files": ["rel_path"], "images": ["file_id"], "fingerprints": ["file_id"], "ignore": ["lower", "higher"], "keep": ["file_id"], "duplicate_sets": ["set_id", "file_id"]}
#: What a listing tells of a file, and what reading it does.
FOUND = ("rel_path", "size_bytes", "mtime_seconds")
READ = ("width", "height", "format", "channels", "fingerprint_version", "dct_hashes", "ring_stats", "corners")
#: Tables that only exist while a review goes on; not being there is not the same as being empty.
REVIEW = ("keep", "duplicate_sets")


class Catalogue:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at: dict[str, list[str]] = {}
        self._version = max((int(x.getPath().getName()) for x in self._list("versions") if x.getPath().getName().isdigit()), default=-1)
        if self._version < 0:
            self._swap({name: self._empty(name) for name in SCHEMAS if name not in REVIEW})
            return
        state = json.loads(self._read(f"versions/{self._version:012d}"))
        self._at = state["tables"]
        if state["schema"] > SCHEMA_VERSION:
            raise ValueError(f"index of schema {state['schema']}, this is {SCHEMA_VERSION}")
        if state["schema"] < SCHEMA_VERSION:
            self._swap({name: migrate.table(name, spark.read.parquet(*[f"{self.path}/{x}" for x in parts]), SCHEMAS[name]) for name, parts in self._at.items()})

    # ---- storage

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._hadoop(name))

    def _list(self, name: str):
        return self._fs.listStatus(self._hadoop(name)) if self._exists(name) else []

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._hadoop(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, name: str, rows: DataFrame, files: int | None = None) -> str:
        at = f"{name}/{uuid.uuid4().hex}"
        (rows.coalesce(files) if files else rows).write.parquet(f"{self.path}/{at}")
        return at

    def _swap(self, whole: dict[str, DataFrame | None], changed: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, files: int | None = None) -> None:
        """Write tables whole (None drops one), and changes to others: rows that are new or replace those of their key,
        and keys of rows that go. Then put the next version in place."""
        now = {name: list(parts) for name, parts in self._at.items()}
        for name, rows in whole.items():
            now.pop(name, None)
            if rows is not None:
                now[name] = [self._write(name, rows, files)]
        for name in {**(changed or {}), **(gone or {})}:
            part = None
            if name in (changed or {}):
                part = changed[name].select(*self._empty(name).columns).withColumn("gone", F.lit(False))
            if name in (gone or {}):
                left = gone[name].select(*KEYS[name]).distinct().withColumn("gone", F.lit(True))
                part = left if part is None else part.unionByName(left, allowMissingColumns=True)
            now.setdefault(name, []).append(self._write(name, part))
            if len(now[name]) > MOST_CHANGES:
                now[name] = [self._write(name, self._merged(name, now[name]))]
        self._publish(now)

    def _publish(self, now: dict[str, list[str]]) -> None:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, goal = self._hadoop(f"versions/new-{uuid.uuid4().hex}"), self._hadoop(f"versions/{self._version + 1:012d}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps({"schema": SCHEMA_VERSION, "tables": now}).encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext
        files = files.getFileContext(new.toUri(), hadoop) if new.toUri().getScheme() else files.getFileContext(hadoop)
        try:
            files.rename(new, goal, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(new, False)
            if self._exists(f"versions/{self._version + 1:012d}"):
                raise RuntimeError(f"{self.path} was changed by another writer; open it again") from e
            raise
        self._version, self._at = self._version + 1, now

    def _merged(self, name: str, parts: list[str]) -> DataFrame:
        columns, keys = self._empty(name).columns, KEYS[name]
        base = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{parts[0]}")
        if len(parts) == 1:
            return base
        changes = None
        for k, part in enumerate(parts[1:]):
            rows = self.spark.read.schema(f"{SCHEMAS[name]}, gone boolean").parquet(f"{self.path}/{part}").withColumn("turn", F.lit(k))
            changes = rows if changes is None else changes.unionByName(rows)
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys], "gone"), "turn").alias("r"))
        stay = base.join(last.select(*keys), keys, "left_anti")
        return stay.unionByName(last.where("not r.gone").select(*[c if c in keys else F.col(f"r.{c}") for c in columns]))

    def exists(self, name: str) -> bool:
        """Whether a table is there, which is not the same as having rows."""
        return name in self._at

    def table(self, name: str) -> DataFrame:
        """A table as it is now; a review table that is not there reads as empty."""
        return self._merged(name, self._at[name]) if name in self._at else self._empty(name)

    def compact(self, files: int = 1) -> None:
        """Write every table whole into few files and remove what the present version does not name."""
        self._swap({name: self.table(name) for name in self._at}, files=files)
        named = {part for parts in self._at.values() for part in parts}
        for name in SCHEMAS:
            for status in self._list(name):
                if f"{name}/{status.getPath().getName()}" not in named:
                    self._fs.delete(status.getPath(), True)
        for status in self._list("versions"):
            if status.getPath().getName() != f"{self._version:012d}":
                self._fs.delete(status.getPath(), False)

    def delete(self) -> int:
        """Remove the index; the number of pictures that it knew."""
        n = self.count_pictures()
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)
        self._at = {}
        return n

    # ---- rows

    def count_files(self) -> int:
        return self.table("files").count()

    def count_pictures(self) -> int:
        return self.table("files").where("not not_a_picture").count()

    def known(self) -> DataFrame:
        """Files with the version of their fingerprint, -1 without one."""
        prints = self.table("fingerprints").select(F.col("file_id").alias("id"), "fingerprint_version")
        return self.table("files").join(prints, "id", "left").withColumn("fingerprint_version", F.coalesce("fingerprint_version", F.lit(-1)))

    def indexed_images(self) -> DataFrame:
        files = self.table("files").withColumnRenamed("id", "file_id")
        return files.join(self.table("images"), "file_id").join(self.table("fingerprints"), "file_id")

    def signatures(self) -> DataFrame:
        """What the search reads; rows whose hashes are not 256 bytes are left out."""
        rows = self.indexed_images().where(F.length("dct_hashes") == 256)

        def unpack(batches):
            import numpy as np
            import pandas as pd

            from mirrorlake.functions import kernels

            for pdf in batches:
                hashes = [np.frombuffer(x, "<i8").reshape(8, 4).tolist() for x in pdf.dct_hashes]
                rings = [(np.frombuffer(x, "<f4") * np.resize(np.array([1, 4, 4, 1], "f4"), len(x) // 4)).tolist() if len(x) % 4 == 0 else [] for x in pdf.ring_stats]
                points = [[{"x": x, "y": y, "words": np.frombuffer(d, "<i8").tolist()} for x, y, d in kernels.unpack_corners(bytes(raw))] for raw in pdf.corners]
                yield pd.DataFrame({**{c: pdf[c] for c in shown}, "hashes": hashes, "rings": rings, "corners": points})

        shown = ["file_id", "rel_path", "size_bytes", "mtime_seconds", "width", "height", "format", "channels"]
        kinds = "file_id long, rel_path string, size_bytes long, mtime_seconds long, width int, height int, format string, channels int"
        return rows.select(*shown, "dct_hashes", "ring_stats", "corners").mapInPandas(unpack, f"{kinds}, hashes array<array<bigint>>, rings array<float>, corners array<struct<x:int,y:int,words:array<bigint>>>")

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        """Give rows with new paths the ids after the greatest; known paths keep theirs. New rows are numbered
        within hash ranges first, so no task sees them all."""
        files = self.table("files")
        known = files.select("rel_path", F.col("id").alias("old"))
        top = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows = rows.join(known, "rel_path", "left").withColumn("part", F.when(F.col("old").isNull(), F.pmod(F.xxhash64("rel_path"), F.lit(1024))))
        sizes = rows.where("old is null").groupBy("part").count()
        starts = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        number = F.row_number().over(Window.partitionBy("part").orderBy("rel_path"))
        rows = rows.join(starts, "part", "left").withColumn("id", F.coalesce("old", F.lit(top) + F.col("start") + number))
        return rows.drop("old", "part", "start")

    def upsert(self, records: DataFrame, at: int) -> None:
        """Pictures read: rel_path, size_bytes, mtime_seconds, width, height, format, channels, fingerprint_version,
        dct_hashes, ring_stats, corners. Ids of known paths stay."""
        rows = self._with_ids(records.select(*FOUND, *READ).dropDuplicates(["rel_path"])).withColumn("last_scanned_at", F.lit(at).cast("long")).withColumn("not_a_picture", F.lit(False))
        self._merge(rows, True)

    def not_pictures(self, records: DataFrame, at: int) -> None:
        """Files read and rejected: rel_path, size_bytes, mtime_seconds. They keep a row, so they are not read again."""
        rows = self._with_ids(records.select(*FOUND).dropDuplicates(["rel_path"])).withColumn("last_scanned_at", F.lit(at).cast("long")).withColumn("not_a_picture", F.lit(True))
        self._merge(rows, False)

    def _merge(self, rows: DataFrame, pictures: bool) -> None:
        from .shared import drop_stash, stash

        rows = stash(rows, "records")
        some = rows.withColumnRenamed("id", "file_id")
        if pictures:
            self._swap({}, {"files": rows, "images": some, "fingerprints": some})
        else:
            self._swap({}, {"files": rows}, {"images": some, "fingerprints": some})
        drop_stash(rows)

    def delete_paths(self, paths: DataFrame) -> int:
        """Delete files by path, and all that refers to them; the number of files that were there."""
        from .shared import drop_stash, stash

        gone = self.table("files").join(paths.select("rel_path").distinct(), "rel_path", "left_semi").select("rel_path", F.col("id").alias("file_id"))
        gone = stash(gone, "gone")
        n = gone.count()
        if n:
            ids = gone.select("file_id")
            lost = {"files": gone, "images": gone, "fingerprints": gone}
            if self.exists("keep"):
                lost["keep"] = gone
            if self.exists("duplicate_sets"):
                lost["duplicate_sets"] = self.table("duplicate_sets").join(ids, "file_id", "left_semi")
            pairs = self.table("ignore")
            lost["ignore"] = pairs.join(ids.withColumnRenamed("file_id", "lower"), "lower", "left_semi").unionByName(pairs.join(ids.withColumnRenamed("file_id", "higher"), "higher", "left_semi"))
            self._swap({}, None, lost)
        drop_stash(gone)
        return n

    # ---- settings and review

    def meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).first()
        return row and row.value

    def set_meta(self, key: str, value: str) -> None:
        self._swap({}, {"meta": self.spark.createDataFrame([(key, value)], SCHEMAS["meta"])})

    def forget_meta(self, key: str) -> None:
        self._swap({}, None, {"meta": self.spark.createDataFrame([(key,)], "key string")})

    def ignored(self) -> DataFrame:
        return self.table("ignore")

    def ignore(self, pairs: DataFrame) -> None:
        self._swap({}, {"ignore": self._ordered(pairs).distinct()})

    def unignore(self, pairs: DataFrame) -> None:
        self._swap({}, None, {"ignore": self._ordered(pairs)})

    @staticmethod
    def _ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("lower", "higher").alias("lower"), F.greatest("lower", "higher").alias("higher")).where("lower != higher")

    def begin_review(self) -> None:
        self._swap({name: self._empty(name) for name in REVIEW if name not in self._at})

    def kept(self) -> DataFrame | None:
        """Marks; None if there never was a review."""
        return self.table("keep") if "keep" in self._at else None

    def keep_these(self, ids: DataFrame) -> None:
        self._begun("keep")
        self._swap({}, {"keep": ids.select("file_id").distinct()})

    def unkeep_these(self, ids: DataFrame) -> None:
        self._begun("keep")
        self._swap({}, None, {"keep": ids})

    def _begun(self, name: str) -> None:
        if not self.exists(name):
            self._swap({name: self._empty(name)})

    def clear_keep(self) -> None:
        self._swap({"keep": None})

    def store_sets(self, members: DataFrame) -> None:
        """Keep the sets in their order (by set_id)."""
        at = members.select("set_id").distinct().withColumn("at", (F.row_number().over(Window.orderBy("set_id")) - 1).cast("long"))
        self._swap({"duplicate_sets": members.select("set_id", "file_id").join(at, "set_id").select("set_id", "file_id", "at")})

    def stored_sets(self) -> DataFrame:
        """Stored sets with the images that are still there; sets of one are gone."""
        return review.rebuild_sets(self.table("duplicate_sets"), self.indexed_images())

    def sets_in_order(self) -> DataFrame:
        """The stored sets, one row each, in the order that they were kept in."""
        return review.in_order(self.stored_sets())

    def review_over(self) -> None:
        """After a clean-up: sets and marks go, ignored pairs stay."""
        self._swap({"keep": None, "duplicate_sets": None})

    def clear_sets(self) -> None:
        self._swap({"duplicate_sets": None})
