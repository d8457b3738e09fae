from test_kernels import detailed

from mirrorlake.functions.decode import write_png
from mirrorlake.sources.catalogue import Catalogue
from mirrorlake.sources.listing import listing
from mirrorlake.streaming.watch import watch


def test_stream_of_listings_merges_and_repeats_do_nothing(spark, tmp_path):
    root, index = tmp_path / "p", f"file://{tmp_path}/i"
    root.mkdir()
    (root / "a.png").write_bytes(write_png(detailed(60, 80, 1)))
    (root / "b.png").write_bytes(b"text")
    listing(spark, str(root)).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(listing(spark, str(root)).schema).parquet(str(tmp_path / "in"))
    q = watch(rows, index, str(tmp_path / "ck"), once=True)
    q.awaitTermination(100)
    c = Catalogue(spark, index)
    assert c.indexed_images().count() == 1 and c.table("files").where("not_a_picture").count() == 1
    ids = {r.rel_path: r.id for r in c.table("files").collect()}
    listing(spark, str(root)).write.mode("append").parquet(str(tmp_path / "in"))
    q = watch(rows, index, str(tmp_path / "ck"), once=True)
    q.awaitTermination(100)
    assert {r.rel_path: r.id for r in Catalogue(spark, index).table("files").collect()} == ids
