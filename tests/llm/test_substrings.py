import hashlib
import random

import numpy as np

from mirrorlake.llm import substrings


def brute(rows, length):
    seen = {}
    for i, t in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    gone = [bytearray(len((t or "").encode())) for t in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    out = []
    for t, g in zip(rows, gone, strict=True):
        kept = bytes(x for x, y in zip((t or "").encode(), g, strict=True) if not y)
        out.append((len(g), sum(g), sum(y and not x for x, y in zip([0, *g], g, strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(n=60, seed=4):
    rnd = random.Random(seed)
    draw = lambda k: "".join(rnd.choice("abcdeé ") for _ in range(k))
    pool = [draw(rnd.choice([30, 90, 200, 600])) for _ in range(12)]
    rows = [None, "", "é" * 300, "ab" * 400, "x", "ab" * 400]
    for _ in range(n):
        text = "".join(rnd.choice(pool) if rnd.random() < 0.5 else draw(rnd.randint(1, 120)) for _ in range(rnd.randint(1, 8)))
        if rnd.random() < 0.3:
            text += text[rnd.randint(0, len(text)) :]
        rows.append(text)
    return rows


def run(spark, rows, length, k, **more):
    frame = spark.createDataFrame([(i, t, b"") for i, t in enumerate(rows)], "doc_id long, text string, kept binary")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup(frame, length=length, k=k, **more).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, length)


def test_equals_brute_force(spark):
    run(spark, corpus(), 50, 20)


def test_hot_anchors_and_small_pieces_give_the_same(spark):
    run(spark, corpus(30, 8), 40, 16, hot=1, flush=800, piece=500)


def test_production_length(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 300))) for _ in range(6)]
    rows = []
    for _ in range(30):
        t = rnd.choice(base).split(" ")
        t[rnd.randrange(len(t))] = "EDIT"
        rows.append(" ".join(t))
    run(spark, rows + base[:2] * 2, 400, 160)


def test_nulls_repeats_and_empty_table(spark):
    text = "abcdefghij" * 45
    frame = spark.createDataFrame([(1, text), (1, text), (None, text[:-1] + "X"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.dedup(frame).collect())
    assert got == [(0, 450, 449, 1), (1, 450, 450, 1), (1, 450, 450, 1), (2, 0, 0, 0)]
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_match_lengths():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        t = rnd.integers(97, 99, 120).astype(np.uint8)
        raw = t.tobytes()
        want = []
        for i in range(len(raw)):
            best = 0
            for j in range(len(raw)):
                n = 0
                while i != j and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
                    n += 1
                best = max(best, n)
            want.append(best)
        assert substrings.match_lengths(t, 120).tolist() == want


def test_whole_table_against_every_string(spark):
    """All strings of 400 bytes of all documents of sf0.01, by a hash of each, against the query."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    seen, repeated = set(), set()
    for _, b in rows:
        for p in range(len(b) - 399):
            h = hash(b[p : p + 400])
            (repeated if h in seen else seen).add(h)
    want = {}
    for i, b in rows:
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - 399):
            if hash(b[p : p + 400]) in repeated:
                gone[p] += 1
                gone[p + 400] -= 1
        left = np.frombuffer(b, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes()
        want[i] = (len(b), len(b) - len(left), hashlib.sha256(left).hexdigest(), len(left), len(left.decode("utf-8", "ignore")) if left.isascii() else None)
    got = {r.doc_id: r for r in substrings.query(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(want) and sum(w[1] for w in want.values()) == 460508
    for i, w in want.items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256, got[i].n_kept) == w[:4], i
        assert w[4] is None or got[i].n_chars == w[4]
    whole = {r.doc_id: r.n_chars for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all((got[i].n_chars < whole[i]) == (w[1] > 0) for i, w in want.items())


def test_passages_of_over_50_words_go_by_their_bytes(spark):
    """Items of over 50 words of the benchmark are under 400 bytes: alone in two documents they stay, two in a row go."""
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 50]
    assert len(items) == 42 and max(len(t.encode()) for t in items) == 394
    rows = [f"{c}<{t}>{c}" for t in items for c in "xy"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {(r.n_removed, r.n_spans) for r in substrings.dedup(frame).collect()} == {(0, 0)}
    pairs = [f"{a} {b}" for a, b in zip(items[::2], items[1::2], strict=True)]
    rows = [f"{c}<{t}>{c}" for t in pairs for c in "xy"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.dedup(frame).collect()}
    assert got == {i: (len(pairs[i // 2].encode()) + 2, 1) for i in range(len(rows))}
