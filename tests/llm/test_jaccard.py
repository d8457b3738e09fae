import random
import re
from collections import defaultdict

import numpy as np

from mirrorlake.llm import jaccard
from mirrorlake.llm.packed import U64


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Position -> (root position, links) over all pairs."""
    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    empty = [i for i, s in enumerate(sets) if not s]
    for i in empty:
        links[i] = len(empty) - 1
        up[i] = empty[0]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j > i:
                    common[j] += 1
        for j, c in common.items():
            if 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))], links


def corpus(groups=20, seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([4, 9, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 4, 30])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 40))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append(" ".join(words))
    return rows


def check(spark, rows):
    got = jaccard.join(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")).collect()
    roots, links = brute(rows)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(rows):
        assert by[i].class_id == rows[roots[k]][0], (i, t[:80])
        assert by[i].n_links == links[k]


def test_equals_brute_force(spark):
    check(spark, list(enumerate(corpus() + ["one two three", "one two three", "ONE two three", "a b c d e f " * 2000])))


def test_nulls_repeats_and_empty_table(spark):
    text = "alpha beta gamma delta epsilon zeta"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (None, " \n"), (4, text + " eta")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 1, 2), (0, 2, 2), (1, 1, 2), (1, 1, 2), (2, 2, 2), (3, 2, 2), (4, 4, 0)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, __none string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(docs).collect())
    assert kept == [(1, text), (2, ""), (4, text + " eta")]
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    check(spark, list(enumerate(corpus(8, seed=9))))


def test_common_counts():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 9000, rnd.integers(1, 5000)).astype(U64)) for _ in range(9)]
    got = jaccard.common_counts(sets)
    for i in range(9):
        for j in range(9):
            assert i == j or got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_keep_one_keeps_clashing_columns(spark):
    names = ["__h", "__id", "__th", "row", "h", "no", "kept_id"]
    rows = [(i, "one two three four five six seven", *range(i, i + 7)) for i in (4, 3)] + [(9, None, *range(7))]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)))
    assert sorted(map(tuple, got.collect()), key=str) == [(3, "one two three four five six seven", *range(3, 10)), (9, None, *range(7))]
