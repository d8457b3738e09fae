import random
import re

from mirrorlake.llm import lines


def tokens(line):
    got = set(re.findall(r"[^\x20\x09-\x0D]+", line))
    return got if len(got) >= lines.LEAST_TOKENS else None


def brute(rows):
    """Position -> numbers of the removed lines; rows in order of id."""
    before, out = [], []
    for _, text in rows:
        gone = []
        for k, line in enumerate((text or "").split("\n")):
            if (s := tokens(line)) is not None:
                if any(5 * len(s & t) >= 4 * len(s | t) for t in before):
                    gone.append(k)
                before.append(s)
        out.append(gone)
    return out


def corpus(n=60, seed=2):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    pool = [[rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 6, 12, 40, 90]))] for _ in range(40)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 12)):
            words = list(rnd.choice(pool)) if rnd.random() < 0.5 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 30))]
            for _ in range(rnd.randint(0, 1 + len(words) // 8)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rnd.shuffle(words)
            text.append(" ".join(words))
        rows.append((i - 5, "\n".join(text)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus() + [(100, "a b c d e f\n\n a\tb c d e f \nx"), (101, "w " * 9000 + "\n" + " ".join(map(str, range(5000))))]
    got = {r.doc_id: r for r in lines.report(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")).collect()}
    assert len(got) == len(rows)
    for (i, text), gone in zip(rows, brute(rows), strict=True):
        assert got[i].removed == gone, (i, text)
        assert got[i].n_removed == len(gone) and got[i].n_lines == text.count("\n") + 1
    kept = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), gone in zip(rows, brute(rows), strict=True):
        assert kept[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def test_limits_do_not_change_the_result(spark):
    for seed, limits in ((7, lines.Limits(2, 2, 3, 1, 64)), (8, lines.Limits(1, 1, 1, 1, 1)), (9, lines.Limits(4, 2, 0, 2, 16))):
        rows = corpus(40, seed=seed)
        got = {r.doc_id: r.removed for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string"), limits=limits).collect()}
        assert [got[i] for i, _ in rows] == brute(rows)


def test_ids_of_any_type(spark):
    """String ids are ordered as strings, line numbers as numbers; ids of one start, dates and null ids too."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = base.replace("kappa", "lambda")
    filler = [f"filler{k} " + " ".join(f"w{k}x{j}" for j in range(6)) for k in range(12)]
    text = "\n".join([*filler[:2], base, *filler[2:9], near])
    for kind, ids in (("string", ["document-000000002", "document-000000010", None]), ("long", [2, 10, None]), ("double", [2.5, 10.0, None])):
        rows = [(ids[1], near + "\n" + filler[11]), (ids[0], text), (ids[2], filler[11] + " more\nnew line of the last one")]
        got = {r.doc_id: r.removed for r in lines.report(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()}
        assert got == {ids[0]: [10], ids[1]: [0], ids[2]: [0]}, kind


def family(n, seed=5):
    """One line and n near copies of it, each with words changed; many are not near the first."""
    rnd = random.Random(seed)
    base = [f"base{k}" for k in range(20)]
    out = [(0, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for k in rnd.sample(range(20), rnd.choice([1, 1, 2, 2, 3, 4])):
            words[k] = f"new{rnd.randrange(40)}"
        out.append((i, " ".join(words)))
    return out


def test_large_family_of_near_copies(spark):
    import numpy as np

    rows = family(5000)
    got = {r.doc_id: r.removed for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = {w: k for k, w in enumerate(sorted({w for _, t in rows for w in t.split()}))}
    held = np.zeros((len(rows), len(names)), np.float32)
    for i, t in rows:
        held[i, [names[w] for w in t.split()]] = 1
    size = held.sum(1)
    both = held @ held.T
    near = 5 * both >= 4 * (size[:, None] + size - both)
    expected = np.tril(near, -1).any(1)
    assert 4000 < expected.sum() < 5000
    assert [bool(got[i]) for i, _ in rows] == expected.tolist()


def test_family_costs_in_proportion():
    """Links that leave a partition grow as the family, not as its square."""
    import numpy as np

    def postings(n):
        rows = np.zeros(n, lines.POSTING)
        rows["word"], rows["sid"], rows["o"], rows["n"] = 7, np.arange(n) * 7919 + 1, np.arange(n), 10
        return rows

    sent = {n: sum(len(a) for a, b, _, _ in lines.near(postings(n)) if b is not None) for n in (2000, 8000)}
    assert sent[8000] <= 4.1 * sent[2000] <= 4.1 * lines.Limits().few * 2000


def test_clashing_columns_stay(spark):
    names = ["__h", "lines", "row", "th", "h", "id", "__lines"]
    rows = [(1, "a b c\na b c", *range(7)), (2, "x", *range(7, 14))]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)))
    assert sorted(map(tuple, got.collect())) == [(1, "a b c", *range(7)), (2, "x", *range(7, 14))]


def test_nulls_repeats_and_empty_table(spark):
    line = "one two three four five"
    rows = [(2, line), (2, line), (None, line), (1, None), (3, ""), (4, line + "\nshort")]
    got = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.removed) for r in got) == [(0, 1, [0]), (1, 0, []), (2, 1, []), (2, 1, []), (3, 1, []), (4, 2, [0])]
    assert sorted(r.text or "" for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == ["", "", "", line, line, "short"]
    assert lines.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_count(spark):
    rows = [(1, "Home\nAll rights reserved.\n\na b c d e"), (2, "All rights reserved.\nHome\n\nb a c d\nAll rights"), (3, "x x x x x x\nx\na b c\nc b a")]
    got = {r.doc_id: r.removed for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 1, 3], 3: [1, 3]}
