"""Listing of a picture folder as a Spark data source: one partition for each share of its subfolders.

Spark's own file index hides names that begin with a dot or an underscore; here only subfolders that begin
with a dot or an at sign are kept out, and files of any name count when their extension is a picture's."""

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mirrorlake.functions.paths import FORMATS

SCHEMA = "rel_path string, abs_path string, size_bytes long, mtime_seconds long"
FOLDERS_A_PARTITION = 64


def is_kept_out(folder_name: str) -> bool:
    return folder_name[:1] in (".", "@")


def is_picture_name(name: str) -> bool:
    return "." in name and name.rsplit(".", 1)[1].lower() in FORMATS


class _Folders(InputPartition):
    def __init__(self, folders):
        super().__init__(folders)
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, root: str, recurse: bool):
        self.root, self.recurse = root, recurse

    def partitions(self):
        """Folder names only are listed here; files are listed by the tasks. An unreadable root is an error."""
        os.scandir(self.root).close()
        found, todo = [], [""]
        while todo:
            here = todo.pop()
            found.append(here)
            if not self.recurse:
                break
            try:
                with os.scandir(os.path.join(self.root, here)) as entries:
                    todo += [os.path.join(here, e.name) for e in entries if e.is_dir(follow_symlinks=False) and not is_kept_out(e.name)]
            except OSError:
                continue
        return [_Folders(found[k : k + FOLDERS_A_PARTITION]) for k in range(0, len(found), FOLDERS_A_PARTITION)]

    def read(self, partition):
        for folder in partition.folders:
            try:
                entries = list(os.scandir(os.path.join(self.root, folder)))
            except OSError:
                continue
            for e in entries:
                try:
                    e.name.encode("utf-8")
                    if not is_picture_name(e.name) or not e.is_file():
                        continue
                    stat = e.stat()
                except (OSError, UnicodeEncodeError):
                    continue
                rel = "/".join(x for x in (*folder.split(os.sep), e.name) if x)
                yield rel, e.path, stat.st_size, max(0, int(stat.st_mtime_ns // 1_000_000_000))


class PictureFolder(DataSource):
    """spark.read.format("picture_folder").option("recurse", "true").load(root)"""

    @classmethod
    def name(cls):
        return "picture_folder"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("recurse", "true").lower() == "true")


def listing(spark, root: str, recurse=True):
    spark.dataSource.register(PictureFolder)
    return spark.read.format("picture_folder").option("recurse", str(recurse).lower()).load(root)
