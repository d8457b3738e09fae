import random

import numpy as np
from pyspark.sql import functions as F

from mirrorlake.functions import dates, paths
from mirrorlake.operators import corners, matching, review
from mirrorlake.operators.components import components
from mirrorlake.plans import notes
from mirrorlake.sources import migrate

SCHEMA = "file_id long, hashes array<array<bigint>>, rings array<float>, width int, height int, rel_path string, format string, channels int, size_bytes long, mtime_seconds long"


def row(i, seed, ring=0.5, w=800, h=600, size=1000, mtime=1, path=None):
    seed = seed - (1 << 64) if seed >= 1 << 63 else seed
    return (i, [[seed, 0, 0, 0]] * 8, [ring] * 48, w, h, path or f"f/p{i}.jpeg", "jpeg", 3, size, mtime)


def sets(spark, rows, **t):
    t = {"max_bits": 38, "max_ring": 0.05} | t
    out = {}
    for r in matching.find_sets(spark.createDataFrame(rows, SCHEMA), matching.Thresholds(**t)).collect():
        out.setdefault(r.set_id, {})[r.file_id] = r.auto_keep
    return out


def test_chain_colour_shape_and_fold(spark):
    rows = [row(1, 0b0000), row(2, 0b0011), row(3, 0b1111)]
    assert sets(spark, rows, max_bits=2) == {1: {1: True, 2: False, 3: False}} or set(sets(spark, rows, max_bits=2)[1]) == {1, 2, 3}
    assert sets(spark, [row(1, 7, 0.5), row(2, 7, 0.0)]) == {}
    assert set(sets(spark, [row(1, 7, 0.5), row(2, 7, 0.0)], ignore_colour=True)[1]) == {1, 2}
    assert sets(spark, [row(1, 7, w=1600, h=400), row(2, 7, w=800, h=800)]) == {}
    assert sets(spark, [row(1, 0), row(2, (1 << 64) - 1)]) == {}
    got = sets(spark, [row(5, 3, w=400, h=300, size=20000, mtime=1), row(9, 3, w=1600, h=1200, size=300000, mtime=9)])
    assert got == {5: {5: False, 9: True}}
    many = [row(i, 77) for i in range(50)] + [row(99, 1 << 40 | 0xFFFFFFFF, ring=0.1)]
    assert {k: len(v) for k, v in sets(spark, many).items()} == {0: 50}


def test_banded_search_equals_all_pairs(spark):
    hashes = []
    for i in range(200):
        seed = i * 0x9E3779B97F4A7C15 % (1 << 64)
        hashes.append(hashes[i - 1] ^ 0b10101101 if i % 20 == 1 else hashes[i - 2] if i % 20 == 2 else seed)
    got = {frozenset(v) for v in sets(spark, [row(i, h) for i, h in enumerate(hashes)], max_bits=15).values()}
    up = list(range(200))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in range(200):
        for b in range(a):
            if bin(hashes[a] ^ hashes[b]).count("1") <= 15:
                up[max(find(a), find(b))] = min(find(a), find(b))
    want = {}
    for i in range(200):
        want.setdefault(find(i), set()).add(i)
    assert got == {frozenset(v) for v in want.values() if len(v) > 1}


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(rnd.randrange(300, 330), rnd.randrange(300, 330)) for _ in range(25)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_thresholds_and_corner_constants():
    assert [matching.Thresholds.at(p).max_bits for p in (5, 15, 30, 50, 90, -1)] == [12, 38, 76, 127, 127, 0]
    assert matching.Thresholds.preset("nothing") == matching.Thresholds.at(15)
    bits = corners.sampled_bits()
    assert len(bits) == 16 and all(len(set(r)) == 20 for r in bits)
    assert [corners.table_bits(n) for n in (0, 96 * 64, 96 * 65, 96 << 20, 96 << 30)] == [6, 6, 7, 20, 20]


def test_corner_buckets_by_folder(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(6):
        words = rnd.integers(-(1 << 62), 1 << 62, (12, 4))
        for j, folder in ((0, "a"), (1, "a" if i % 2 else "b")):
            rows.append((2 * i + j, f"{folder}/{2 * i + j}.png", [{"x": k, "y": k, "words": (w ^ (j << 3)).tolist()} for k, w in enumerate(words)]))
    s = spark.createDataFrame(rows, "file_id long, rel_path string, corners array<struct<x:int,y:int,words:array<bigint>>>")
    assert {(r.lo, r.hi) for r in corners.corner_pairs(s).collect()} == {(2 * i, 2 * i + 1) for i in range(6)}
    assert {(r.lo, r.hi) for r in corners.corner_pairs(s, True).collect()} == {(2 * i, 2 * i + 1) for i in (1, 3, 5)}


def test_review(spark):
    members = spark.createDataFrame([(1, 1, "a", 5, True), (1, 2, "b", 6, False), (1, 3, "c", 7, False), (8, 8, "d", 1, True), (8, 9, "e", 2, False)], "set_id long, file_id long, rel_path string, size_bytes long, auto_keep boolean")
    some = spark.createDataFrame([(2, 1), (1, 3)], "lower long, higher long")
    assert review.ignored_sets(members, some).count() == 0
    every = some.union(spark.createDataFrame([(2, 3), (2, 3)], some.schema))
    assert [r.set_id for r in review.ignored_sets(members, every).collect()] == [1]
    marks = spark.createDataFrame([(1,)], "file_id long")
    assert {r.file_id for r in review.cleanup_plan(members, marks, some).collect()} == {2, 3, 8, 9}
    assert {r.file_id for r in review.cleanup_plan(members, marks, every).collect()} == {8, 9}
    assert review.recoverable(members).first().asDict() == {"n_sets": 2, "n_members": 5, "duplicates": 3, "recoverable_bytes": 15}


def test_scalars(spark):
    rows = [("a/b/Photo - Copy (1).JPG",), ("x_12.png",), ("noext",), ("a.b/c",), ("downloads/x.jpg",), ("q/Downloads/x.tar.Tif",)]
    p = spark.createDataFrame(rows, "p string")
    got = p.select(paths.folder_of("p"), paths.stem(F.col("p")), paths.extension(F.col("p")), paths.format_of(F.col("p")), F.round(paths.path_penalty("p"), 6)).collect()
    assert [tuple(r)[:4] for r in got] == [("a/b", "Photo - Copy (1)", "jpg", "jpeg"), ("", "x_12", "png", "png"), ("", "noext", "", None), ("a.b", "c", "", None), ("downloads", "x", "jpg", "jpeg"), ("q/Downloads", "x.tar", "tif", "tiff")]
    assert [r[4] for r in got] == [-0.162, -0.054, -0.0025, -0.0025, -0.0075, -0.0605]
    s = spark.createDataFrame([(0,), (-1,), (1700000000,), (-86401,)], "s long")
    assert [r[0] for r in s.select(dates.file_date("s")).collect()] == ["1970-01-01 00:00", "1969-12-31 23:59", "2023-11-14 22:13", "1969-12-30 23:59"]
    t = spark.createDataFrame([("2026:02:31 12:05",), ("1799-01-01",), ("2026-6-13 25:00",), ("nothing",), ("2026-06-13T00:04:99",)], "t string")
    assert [r[0] for r in t.select(dates.said_plainly("t")).collect()] == ["February 31, 2026, 12:05:00 pm", None, "June 13, 2026", None, "June 13, 2026, 12:04:59 am"]


def test_migration_and_notes(spark):
    old = spark.createDataFrame([(1, 1999999999, "x")], "id long, mtime_ns long, bytes_hash string")
    assert migrate.files(old).collect() == [(1, 1, False)]
    assert migrate.fingerprints(spark.createDataFrame([(1,)], "file_id long")).first().corners == b""
    assert [notes.on_opening(*x) for x in ((True, True, True), (True, False, False), (True, False, True), (False, True, True), (False, False, False))] == ["rescan", "rescan", "ask", "review", "search"]
    n = notes.Notes(auto_rescan=True, auto_mark=True, within_a_folder=True, recurse=True).sound()
    assert not n.auto_rescan and not n.auto_mark and n.within_a_folder
    assert notes.read_settings(["a=1", "previous=/b", "previous=/A", "previous=/b", "junk"]) == ({"a": "1"}, ["/A", "/b"])


def test_corner_query_follows_the_number_filed(spark, monkeypatch):
    import pyspark.sql.functions as F

    from mirrorlake.operators import corners
    from mirrorlake.plans import registry

    # 40,000 documents of evenly spread lengths
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    monkeypatch.setattr(registry, "_t", lambda *_: docs)
    asked = []
    monkeypatch.setattr(corners, "bucket_pairs", lambda rows, bits, limit, **_: asked.append((bits, limit)) or rows)
    registry.corner_bucket_candidates(spark, "")
    filed = 8 * docs.count()
    assert asked == [(corners.table_bits(filed), (filed >> corners.table_bits(filed)) * corners.BUCKET_LIMIT)] and asked[0] != (6, 4000)
