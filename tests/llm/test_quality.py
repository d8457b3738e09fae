import zlib

import numpy as np

from mirrorlake.llm import quality


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    model = quality.Model(features=5)
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    x, first, y = rnd.standard_normal((9, 5)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, first)[0]) + (1 - y) * np.log(1 - s))
    grad = model.gradients(x, first, y, np.ones(3))
    for k, p in model.p.items():
        at = tuple(rnd.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-4, k


def test_passages_do_not_depend_on_neighbours():
    texts = ["", "one two", "x " * 200, "é à", " lead and  trail ", " \n \t", ""]
    raw = [t.encode() for t in texts]
    both, first = quality.passages(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.diff(first).tolist() == [1, 1, 4, 1, 1, 1, 1]
    for i, b in enumerate(raw):
        alone, _ = quality.passages(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert np.allclose(both[first[i] : first[i + 1]], alone)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.query(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == 10000
    right = []
    for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if got[r.doc_id].held_out:
            right.append((got[r.doc_id].predicted == r.quality, r.quality))
    accuracy = np.mean([x for x, _ in right])
    balanced = np.mean([np.mean([x for x, q in right if q == k]) for k in (0, 1)])
    print(accuracy, balanced)
    assert accuracy > 0.95 and balanced > 0.9


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "a b", 1), (1, "a b", 1), (None, "", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, none)).collect()
    assert [(r.score, r.predicted, r.held_out) for r in got if r.doc_id is None] == [(0.5, 0, False)] and len(got) == 4
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none)).count() == 0


def test_repeated_ids_and_long_texts_bound_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 10, f"text {i} " + "word " * 2000) for i in range(40)] + [(5, None)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id int, quality int")
    held = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y: held.append((bags, y)) or self)
    quality.train(docs, labels, most=3)
    (bags, y), ids = held[0], [i for i in range(10) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(bags) == len(ids) == len(y) and max(map(len, bags)) <= 3
