from mirrorlake.sources.catalogue import Catalogue


def records(spark, *paths, size=10):
    rows = [(p, size, 5, 100, 80, "png", 3, 2, bytes(256), bytes(192), b"") for p in paths]
    return spark.createDataFrame(rows, "rel_path string, size_bytes long, mtime_seconds long, width int, height int, format string, channels int, fingerprint_version long, dct_hashes binary, ring_stats binary, corners binary")


def test_upsert_keeps_ids_and_delete_cascades(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/index")
    c.upsert(records(spark, "a.png", "b.png", "c.png"), 1)
    ids = {r.rel_path: r.id for r in c.table("files").collect()}
    assert sorted(ids.values()) == [1, 2, 3]
    c.upsert(records(spark, "b.png", "d.png", size=99), 2)
    after = {r.rel_path: (r.id, r.size_bytes) for r in c.table("files").collect()}
    assert after["b.png"] == (ids["b.png"], 99) and after["a.png"] == (ids["a.png"], 10) and after["d.png"][0] == 4
    assert c.indexed_images().count() == 4 and c.table("fingerprints").count() == 4
    c.not_pictures(spark.createDataFrame([("a.png", 3, 3), ("x.png", 1, 1)], "rel_path string, size_bytes long, mtime_seconds long"), 3)
    assert c.indexed_images().count() == 3
    assert {r.rel_path: r.fingerprint_version for r in c.known().where("not_a_picture").collect()} == {"a.png": -1, "x.png": -1}
    pair = spark.createDataFrame([(ids["c.png"], ids["b.png"])], "lower long, higher long")
    c.ignore(pair)
    c.ignore(pair)
    assert [(r.lower < r.higher) for r in c.ignored().collect()] == [True]
    assert c.kept() is None
    c.begin_review()
    assert c.kept().count() == 0
    c.keep_these(spark.createDataFrame([(ids["b.png"],), (4,)], "file_id long"))
    c.store_sets(spark.createDataFrame([(2, ids["b.png"]), (2, ids["c.png"]), (4, 4)], "set_id long, file_id long"))
    assert c.delete_paths(spark.createDataFrame([("b.png",), ("none",)], "rel_path string")) == 1
    assert c.ignored().count() == 0 and [r.file_id for r in c.kept().collect()] == [4] and c.stored_sets().count() == 0
    assert c.indexed_images().count() == 2
    c.set_meta("recurse", "1")
    c.set_meta("recurse", "0")
    again = Catalogue(spark, f"file://{tmp_path}/index")
    assert again.meta("recurse") == "0" and again.meta("none") is None
    again.compact()
    assert again.table("files").count() == 4 and len(list((tmp_path / "index" / "files").iterdir())) == 1
    again.forget_meta("recurse")
    assert again.meta("recurse") is None
    assert again.delete() == 2 and not (tmp_path / "index").exists()
