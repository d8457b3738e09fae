import time

from test_operators import SCHEMA

from mirrorlake.operators.matching import Thresholds, find_sets
from mirrorlake.sources.shared import stash


def spread(x):
    x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def rows(n, copies=False):
    out = []
    for i in range(n):
        k = 7 if copies else i - 1 if i % 10 == 9 else i
        words = [spread(4 * k + j) - (1 << 63) for j in range(4)]
        out.append((i, [words] * 8, [0.25] * 48, 800, 600, f"folder{i % 50}/picture{i}.jpeg", "jpeg", 3, 1000 + i, i))
    return out


def search(spark, n, copies=False):
    signatures = stash(spark.createDataFrame(rows(n, copies), SCHEMA).repartition(8), "speed")
    began = time.perf_counter()
    members = find_sets(signatures, Thresholds.preset("balanced")).count()
    return members, time.perf_counter() - began


def test_time_grows_far_less_than_the_square(spark):
    search(spark, 200)
    (few, small), (many, large) = search(spark, 1000), search(spark, 4000)
    assert (few, many) == (200, 800)
    assert large < 20 * 3 and large < 8 * small, (small, large)
    (few, small), (many, large) = search(spark, 500, True), search(spark, 2000, True)
    assert (few, many) == (500, 2000) and large < 8 * small, (small, large)
