import random

from mirrorlake.llm import decontaminate as dc


def data(seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghijé") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    draw = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(draw(rnd.randint(10, 50)))) for i in range(30)] + [(50, "too short"), (51, None)]
    docs, want = [], set()
    for i in range(120):
        words = draw(rnd.randint(0, 200))
        if i % 4 == 0:
            item, text = items[rnd.randrange(30)]
            passage = text.split()
            for k in range(2, len(passage), 9):  # one word in nine is another
                passage[k] = rnd.choice(vocab)
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() if i % 8 == 0 and w.isascii() else w + "," for w in passage]
            want.add((i, item))
        docs.append((i, " ".join(words)))
    return docs, items, want


def test_substituted_passages_are_found_and_nothing_else(spark):
    docs, items, want = data()
    d = spark.createDataFrame([(*x, 1) for x in docs] + [(None, items[0][1], 2), (None, None, 2), (900, items[1][1] + " z " * 30000, 3)] + [(901, items[2][1], 3)] * 2, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.overlaps(d, b).collect()]
    assert sorted(x for x in got if x[0] is not None and x[0] < 900) == sorted(want)
    assert (None, 0) in got and (900, 1) in got and got.count((901, 2)) == 2
    left = dc.clean(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want} | {None}
    small = [(r.doc_id, r.item_id) for r in dc.overlaps(d, b, most=400).collect()]
    assert sorted(small, key=str) == sorted(got, key=str)
    assert dc.overlaps(d.limit(0), b).count() == 0 and dc.overlaps(d, b.limit(0)).count() == 0 and dc.clean(d, b.limit(0)).count() == d.count()


def test_spans_point_at_the_words(spark):
    text = "lead in words here " + "alpha beta gamma delta epsilon zeta eta theta iota kappa" + " tail"
    s = dc.Seeds([(7, "alpha beta gamma delta epsilon zeta eta theta iota kappa")])
    import numpy as np

    raw = text.encode()
    assert s.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) == [(0, 0, 10, 4, 13)]


def _found(item, text):
    import numpy as np

    raw = text.encode()
    return [(n, a, b) for _, _, n, a, b in dc.Seeds([(1, item)]).find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))]


def test_short_items_long_runs_and_inserted_words():
    words = lambda n, mark="w": [f"{mark}{k}" for k in range(n)]
    around = " ".join(words(30, "x"))
    for size, taken in ((6, 6), (7, 7), (59, 23), (300, 100)):
        item = words(size)
        at = (size - taken) // 2
        assert _found(" ".join(item), f"{around} {' '.join(item[at : at + taken])} {around}") == [(taken, 30, 29 + taken)], size
    item = words(60)
    split = [*item[:20], "new", *item[20:40], "new", *item[40:]]
    assert _found(" ".join(item), f"{around} {' '.join(split)}") == [(60, 30, 91)]
    # parts of 12 words with a word put in or left out between them, none of them enough by itself
    parts = [*item[:12], "new", *item[12:24], *item[25:37], "new", *item[37:49]]
    assert _found(" ".join(item), f"{around} {' '.join(parts)}") == [(48, 30, 79)]
    # far apart, a part of the item, and most of a short one do not count
    assert _found(" ".join(item), f"{' '.join(item[:12])} {around} {' '.join(item[12:24])}") == []
    assert _found(" ".join(words(7)), f"{around} {' '.join(words(6))} {around}") == []


def test_ids_of_any_type_and_repeated_items(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    for kind, one in (("int", 7), ("string", "seven"), ("double", 7.5)):
        docs = spark.createDataFrame([(one, "before " + text + " after", 1)], f"doc_id {kind}, text string, th int")
        items = spark.createDataFrame([(one, text), (one, text), (None, text)], f"item_id {kind}, text string")
        for most in (dc.MOST_BYTES, 0):
            got = dc.overlaps(docs, items, most=most)
            assert dict(got.dtypes)["item_id"] == dict(items.dtypes)["item_id"]
            assert sorted(((r.doc_id, r.item_id, r.n_words, r.first_word) for r in got.collect()), key=str) == [(one, one, 10, 1), (one, None, 10, 1)] if kind == "string" else True
            assert got.count() == 2 and dc.clean(docs, items, most=most).count() == 0


def test_ties_are_the_first_of_equals():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    assert _found(item, f"{item} x y z u v w x y z u v w {item}") == [(10, 0, 9)]


def test_joined_benchmark_gives_the_same_on_the_driver_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    whole, joined = (sorted(map(tuple, dc.overlaps(docs, items, most=most).collect())) for most in (dc.MOST_BYTES, 0))
    assert whole == joined and whole
    left = [{r.doc_id for r in dc.clean(docs, items, most=most).collect()} for most in (dc.MOST_BYTES, 0)]
    assert left[0] == left[1] == {r.doc_id for r in docs.collect()} - {x[0] for x in whole}
