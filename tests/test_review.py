from pyspark.sql import functions as F

from mirrorlake.functions import texts
from mirrorlake.operators import corners, review


def test_verbs_leave_ignored_sets_alone(spark):
    rows = [(1, 10, True), (1, 11, False), (2, 20, True), (2, 21, False), (2, 22, False), (3, 30, True), (3, 31, False)]
    m = spark.createDataFrame([(*r, f"p{r[1]}", r[1]) for r in rows], "set_id long, file_id long, auto_keep boolean, rel_path string, mtime_seconds long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "file_id long")
    got = lambda df: sorted(r.file_id for r in df.collect())
    ignored = spark.createDataFrame([(10, 11)], "lower long, higher long")
    marks = ids(11, 21)
    assert got(review.toggle(marks, m, ignored, ids(10, 11, 21, 30, 99))) == [11, 30]
    assert got(review.keep_only(marks, m, ignored, ids(10, 22))) == [11, 22]
    assert got(review.mark_everything(marks, m, ignored)) == [11, 20, 21, 22, 30, 31] and got(review.unmark_everything(marks, m, ignored)) == [11]
    assert got(review.auto_mark(marks, m, ignored)) == [11, 20, 21, 30]
    sets = m.where("set_id = 2")
    assert got(review.keep_all_of(marks, m, sets)) == [11, 20, 21, 22] and got(review.keep_none_of(marks, m, sets)) == [11]
    pairs = review.ignore_sets(ignored, m, sets)
    assert sorted(map(tuple, pairs.collect())) == [(10, 11), (20, 21), (20, 22), (21, 22)]
    assert sorted(map(tuple, review.unignore_sets(pairs, m, sets).collect())) == [(10, 11)]
    left, kept = review.forget_members(m, review.take_up_the_marks(m, marks), spark.createDataFrame([("p10",), ("p22",)], "rel_path string"))
    assert sorted({r.set_id for r in left.collect()}) == [2, 3] and [tuple(r) for r in kept.collect()] == [(2, 21)]


def test_cursor_keys(spark):
    rows = [(s, 10 * s + k) for s, n in ((1, 3), (2, 2), (3, 1), (4, 4)) for k in range(n)]
    m = spark.createDataFrame([(*r, f"p{r[1]}", r[1]) for r in rows], "set_id long, file_id long, rel_path string, mtime_seconds long")
    none = spark.createDataFrame([], "lower long, higher long")
    shut = spark.createDataFrame([(20, 21)], "lower long, higher long")
    to = lambda ignored, at, ahead, by_set=False: [r.file_id for r in review.walk(m, ignored, at, ahead, by_set).collect()]
    assert to(none, 11, True) == [12] and to(none, 12, True) == [20] and to(none, 20, False) == [12] and to(none, 10, False) == []
    assert to(none, 12, True, True) == [21] and to(none, 43, False, True) == [30] and to(none, 43, True, True) == [] and to(none, 99, True) == []
    # set 2 is stepped over; the place shrinks with every shorter set on the way
    assert to(shut, 12, True) == [30] and to(shut, 30, False) == [12] and to(shut, 20, True) == [30] and to(shut, 12, True, True) == [30]
    assert to(shut, 43, False, True) == [30] and to(shut, 30, False, True) == [10]


def test_texts(spark):
    row = spark.range(1).select(
        texts.fill("{a} of {b}{c", a=F.lit("{b}"), b=3).alias("x"), texts.counted(F.lit(1), "file", "files").alias("one"), texts.counted(F.lit(0), "file", "files").alias("none"),
        texts.trimmed(F.lit(2.0)).alias("t"), texts.trimmed(F.lit(0.25)).alias("u"), texts.fraction(F.lit(7), F.lit(5), 100).alias("f"), texts.fraction(F.lit(1), F.lit(0), 100).alias("g"), texts.parse_format(F.lit("bmp")).alias("p"),
    ).first()
    assert tuple(row) == ("{b} of 3{c", "1 file", "0 files", "2", "0.25", 100, 0, "jpeg")


def test_corner_pass_grows_with_the_pictures(spark):
    import time

    def shown(n):
        corner = lambda p: F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"), F.array(*[F.xxhash64(F.when(F.col("id") % 10 == 9, F.col("id") - 1).otherwise(F.col("id")), p, F.lit(j)) for j in range(4)]).alias("words"))
        return spark.range(n).select(F.col("id").alias("file_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), corner).alias("corners")).cache()

    took = {}
    for n in (500, 500, 2000):
        rows = shown(n)
        rows.count()
        began = time.perf_counter()
        pairs = corners.corner_pairs(rows).collect()
        took[n] = time.perf_counter() - began
        assert {(r.lo, r.hi) for r in pairs} >= {(k - 1, k) for k in range(9, n, 10)}
    assert took[2000] < 8 * took[500]
