import re

from mirrorlake.llm import mixing


def fill(sizes, weights=(5, 2, 1), share=1.5):
    """Brute force: give each open source its part of what is left until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_budgets_and_reruns(spark):
    rows = [(i, "w " * (i % 37) + "\x0bx", f"s{i * i % 11}" if i % 11 else None, i) for i in range(600)] + [(None, None, "s1", 0), (5, "dup", "é", 0), (5, "dup", "é", 0), (7, "", "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1, s
        epochs = {r.taken // r.size for r in mine if r.size}
        assert max(epochs, default=0) - min(epochs, default=0) <= 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_one_source_takes_what_there_is(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "e f", "x")], "doc_id long, text string, source string")
    assert {r.doc_id: r.target for r in mixing.mix(docs).collect()} == {1: 9.0, 2: 9.0}
    assert sum(r.taken for r in mixing.mix(docs).collect()) == 9
