import json
import sqlite3

import pytest
from test_catalogue import records

from mirrorlake.sources import sqlite
from mirrorlake.sources.catalogue import MOST_CHANGES, Catalogue


def test_changes_are_merged_and_written_whole_now_and_then(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/index")
    c.upsert(records(spark, "a.png", "b.png"), 1)
    assert len(c._at["files"]) == 2
    for k in range(MOST_CHANGES + 2):
        c.set_meta("turn", str(k))
        assert c.meta("turn") == str(k)
    assert len(c._at["meta"]) <= MOST_CHANGES
    c.delete_paths(spark.createDataFrame([("a.png",)], "rel_path string"))
    c.upsert(records(spark, "a.png", size=77), 2)
    again = Catalogue(spark, c.path)
    assert {r.rel_path: r.size_bytes for r in again.table("files").collect()} == {"a.png": 77, "b.png": 10}
    assert again.count_files() == again.count_pictures() == 2


def test_of_two_writers_the_second_fails(spark, tmp_path):
    one = Catalogue(spark, f"file://{tmp_path}/index")
    other = Catalogue(spark, one.path)
    one.set_meta("k", "one")
    with pytest.raises(RuntimeError):
        other.set_meta("k", "other")
    assert Catalogue(spark, one.path).meta("k") == "one"


def test_an_older_index_is_brought_up_when_opened(spark, tmp_path):
    root = tmp_path / "index"
    spark.createDataFrame([(1, "a.png", 5, 1999999999, 3, "x")], "id long, rel_path string, size_bytes long, mtime_ns long, last_scanned_at long, bytes_hash string").write.parquet(f"file://{root}/files/old")
    spark.createDataFrame([(1, 1, bytearray(256), bytearray(192), "y")], "file_id long, fingerprint_version long, dct_hashes binary, ring_stats binary, dct_hash string").write.parquet(f"file://{root}/fingerprints/old")
    (root / "versions").mkdir()
    (root / "versions" / "000000000004").write_text(json.dumps({"schema": 0, "tables": {"files": ["files/old"], "fingerprints": ["fingerprints/old"]}}))
    c = Catalogue(spark, f"file://{root}")
    row = c.table("files").first()
    assert (row.mtime_seconds, row.not_a_picture) == (1, False) and bytes(c.table("fingerprints").first().corners) == b""
    (root / "versions" / "000000000099").write_text(json.dumps({"schema": 9, "tables": {}}))
    with pytest.raises(ValueError):
        Catalogue(spark, f"file://{root}")


def test_sqlite_files_old_and_new(spark, tmp_path):
    path = str(tmp_path / "old.sqlite")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE files (id INTEGER PRIMARY KEY, rel_path TEXT NOT NULL UNIQUE, size_bytes INTEGER NOT NULL, mtime_ms INTEGER NOT NULL, last_scanned_at INTEGER NOT NULL)")
    db.executemany("INSERT INTO files VALUES (?, ?, ?, ?, ?)", [(k, f"p{k}.png", k, k * 1000 + 999, 1) for k in (1, 2, 900)])
    db.execute("CREATE TABLE images (file_id INTEGER PRIMARY KEY, width INTEGER, height INTEGER, format TEXT, channels INTEGER)")
    db.execute("INSERT INTO images VALUES (2, 30, 20, 'png', 3)")
    db.execute("CREATE TABLE fingerprints (file_id INTEGER PRIMARY KEY, fingerprint_version INTEGER, dct_hashes BLOB, ring_stats BLOB)")
    db.execute("INSERT INTO fingerprints VALUES (2, 1, ?, ?)", (bytes(256), bytes(192)))
    db.commit()
    db.close()
    assert sorted(r.id for r in sqlite.read_table(spark, path, "files", rows=2).collect()) == [1, 2, 900]
    c = sqlite.import_index(spark, path, f"file://{tmp_path}/index")
    assert {r.rel_path: r.mtime_seconds for r in c.table("files").collect()} == {"p1.png": 1, "p2.png": 2, "p900.png": 900}
    assert c.indexed_images().count() == 1 and not c.exists("keep") and c.table("meta").count() == 0
    c.begin_review()
    c.keep_these(spark.createDataFrame([(2,)], "file_id long"))
    assert sqlite.export_index(c, str(tmp_path / "new.sqlite")) == 3 + 1 + 1 + 1
    back = sqlite.import_index(spark, str(tmp_path / "new.sqlite"), f"file://{tmp_path}/back")
    assert sorted(map(tuple, back.table("files").collect())) == sorted(map(tuple, c.table("files").collect()))
    assert [r.file_id for r in back.kept().collect()] == [2] and bytes(back.table("fingerprints").first().dct_hashes) == bytes(256)
