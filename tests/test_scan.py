import io
import json
import os

import numpy as np
from test_kernels import detailed

from mirrorlake.functions import kernels
from mirrorlake.functions.decode import png, write_png
from mirrorlake.operators.matching import Thresholds, find_sets
from mirrorlake.operators.review import auto_plan
from mirrorlake.plans import cleanup
from mirrorlake.plans.scan import scan
from mirrorlake.sources.catalogue import Catalogue
from mirrorlake.sources.listing import listing


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_png_round_trip():
    picture = detailed(40, 50, 3)
    back, channels = png(write_png(picture))
    assert channels == 3 and (back == picture).all()


def test_scan_search_and_clean(spark, tmp_path):
    root, index = tmp_path / "pictures", f"file://{tmp_path}/index"
    one, other = detailed(300, 400, 1), detailed(300, 400, 2)
    put(root / "one.png", write_png(one))
    put(root / "sub" / "one copy.png", write_png(kernels.shrink(one, 200, 150)))
    put(root / "sub" / "turned.png", write_png(np.ascontiguousarray(np.rot90(one))))
    put(root / "_other.png", write_png(other))
    put(root / "text.png", b"only text")
    put(root / "broken.png", write_png(one)[:500])
    put(root / ".git" / "hidden.png", write_png(one))
    put(root / "@eaDir" / "hidden.png", write_png(one))
    put(root / "note.txt", b"x")
    image = spark._jvm.java.awt.image.BufferedImage(120, 90, 1)
    for x in range(0, 120, 3):
        image.setRGB(x, x * 90 // 120, 0xFFFFFF)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(root / ".line.jpg")))
    names = {r.rel_path for r in listing(spark, str(root)).collect()}
    assert names == {"one.png", "sub/one copy.png", "sub/turned.png", "_other.png", "text.png", "broken.png", ".line.jpg"}
    assert {r.rel_path for r in listing(spark, str(root), False).collect()} == {n for n in names if "/" not in n}

    s = scan(spark, str(root), index)
    assert (s.indexed, s.removed, s.not_pictures, s.failed, s.unchanged) == (5, 0, 1, 1, 0)
    assert scan(spark, str(root), index, compare_only=True).unchanged == 7
    c = Catalogue(spark, index)
    facts = {r.rel_path: (r.width, r.height, r.format, r.channels) for r in c.indexed_images().collect()}
    assert facts["sub/turned.png"] == (300, 400, "png", 3) and facts[".line.jpg"][:3] == (120, 90, "jpeg")

    sets = find_sets(c.signatures(), Thresholds.preset("balanced")).collect()
    assert {r.rel_path for r in sets} == {"one.png", "sub/one copy.png", "sub/turned.png"} and len({r.set_id for r in sets}) == 1
    keep = {r.rel_path for r in sets if r.auto_keep}
    assert len(keep) == 1 and "sub/one copy.png" not in keep
    inside = find_sets(c.signatures(), Thresholds.preset("balanced", within_a_folder=True)).collect()
    assert {r.rel_path for r in inside} == {"sub/one copy.png", "sub/turned.png"}

    os.remove(root / "_other.png")
    members = spark.createDataFrame(sets)
    out = io.StringIO()
    cleanup.json_report(members, out)
    report = json.loads(out.getvalue())
    assert cleanup.csv_lines(members).count() == 3 and len(report) == 1 and len(report[0]["members"]) == 3
    plan = auto_plan(members)
    assert cleanup.describe(plan).startswith("2 files")
    done = cleanup.apply_plan(plan, str(root), "move", str(tmp_path / "out"))
    assert done.where("message is not null").count() == 0 and len(list((tmp_path / "out").rglob("*.png"))) == 2
    assert cleanup.forget(c, done) == 2
    s = scan(spark, str(root), index)
    assert (s.indexed, s.removed, s.unchanged) == (0, 1, 4)


def test_corners_join_a_crop(spark, tmp_path):
    root, index = tmp_path / "p", f"file://{tmp_path}/i"
    base = detailed(700, 900, 1)
    put(root / "base.png", write_png(base))
    put(root / "crop.png", write_png(np.ascontiguousarray(base[140:560, 180:720])))
    put(root / "other.png", write_png(detailed(500, 640, 7)))
    assert scan(spark, str(root), index).indexed == 3
    signatures = Catalogue(spark, index).signatures()
    assert find_sets(signatures, Thresholds.preset("close")).count() == 0
    assert {r.rel_path for r in find_sets(signatures, Thresholds.preset("close", corners=True)).collect()} == {"base.png", "crop.png"}


def test_corner_agreement_deals_its_pictures_out(spark, tmp_path):
    """One file is one partition; each picture takes long. The agreement is that of the listed corners."""
    from pyspark.sql import functions as F

    from mirrorlake.functions import kernels
    from mirrorlake.plans import registry

    rows = [(i, [float(np.float32((i * 64 + j) % 97 / 97)) for j in range(64)]) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.queries()["corner_agreement"](spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in got}) == 8
    pairs = lambda g: (np.array([p[:2] for p in g], np.float32), np.array([np.frombuffer(p[2], "<u8") for p in g]))
    for r in got:
        whole = kernels.luma(registry._picture(rows[r.vec_id][1], 160))
        one, crop, negative = (pairs(kernels.features(x)) for x in (whole, whole[12:, 20:], 255 - whole))
        assert (r.crop, r.negative) == (kernels.agreement(one, crop), kernels.agreement(one, negative)) and r.crop >= kernels.AGREEING > r.negative
