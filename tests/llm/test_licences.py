import re

from mirrorlake.llm import licences

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """Base places and labels, and labels of templates by pairwise comparison of k-grams along diagonals."""
    words = words_of(text)
    base = [(i, label) for i in range(len(words)) for p, label in licences.PHRASES if words[i : i + len(p.split())] == p.split()]
    more, score = set(), 0.0
    for label, wording in licences.TEMPLATES:
        t, k = wording.lower().split(), licences.GRAM
        lines = {}
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    lines.setdefault(i - j, set()).add(j)
        spans, last = [], None
        for d in sorted(lines):
            if last is None or d - last > licences.GAP:
                spans.append(set())
            spans[-1] |= lines[d]
            last = d
        for s in spans:
            if len(s) / (len(t) - k + 1) >= licences.LEAST:
                more.add(label)
                score = max(score, len(s) / (len(t) - k + 1))
    return words, base, more, score or (0.5 if base else 0.0)


def test_equals_brute_force(spark):
    mit = licences.TEMPLATES[1][1]
    texts = [None, "", "mit", "MIT License. Apache-License, mit license cc by", "é CC-BY-NC 4.0 Licensed under CC BY-NC 4.0.", "x y z " + mit.replace("obtaining", "obtaining really"),
             "Released under the MIT License!", "the GNU general\npublic license", "word " * 20000 + "Licensed under the Apache License, Version 2.0", "permission is hereby granted free of tea", mit[:60], "gnu general public"]
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(None, texts[3], 1), (None, texts[4], 1), (6, texts[6], 2)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, score int")).collect()
    assert len(got) == len(rows)
    seen = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got), key=str)
    want = []
    for i, t, _ in rows:
        words, base, more, score = brute(t)
        at = [p for p, _ in base]
        labels = {x for _, x in base}
        want.append((i is None, i or 0, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), round(score, 9)))
    assert seen == sorted(want, key=str)
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
