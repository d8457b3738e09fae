import re
from collections import Counter

import corpus_pipeline
from mirrorlake.llm import rules
from mirrorlake.llm.common import stash, table

from test_jaccard import brute as near_copies
from test_lines import brute as near_lines


def _words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def _holds(text, item, least=0.4):
    """Brute force: the best run of matches (1) and substitutions (-2) over all offsets has 8 words and the share."""
    a, b = _words(text), _words(item)
    starts = {}
    for i, w in enumerate(a):
        starts.setdefault(w, []).append(i)
    same_at = Counter(i - j for j, w in enumerate(b) for i in starts.get(w, ()))
    for shift in (x for x, n in same_at.items() if n >= 8):
        best = total = found = 0
        run = []
        for j in range(max(0, -shift), min(len(b), len(a) - shift)):
            same = a[j + shift] == b[j]
            if total <= 0:
                total, run = 0, []
            total += 1 if same else -2
            run.append(same)
            if total > best:
                best, found = total, sum(run)
        if found >= max(8, least * len(b)):
            return True
    return False


def test_stages_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = {r.doc_id for r in rules.report(docs).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    gone = near_lines(rows)
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(g))) for (i, t), g in zip(rows, gone, strict=True)]
    roots, _ = near_copies(rows)
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    items = [r.text for r in table(spark, d, "benchmark").collect()]
    rows = [r for r in rows if not any(_holds(r[1], x) for x in items)]
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stash(stage(spark, got, d), "test")
        assert got.columns == docs.columns, name
    left = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in left.items()} == dict(rows)
    assert all(r.n_chars == len(r.text) for r in left.values())
    out = corpus_pipeline.STAGES[-1][1](spark, got, d).collect()
    assert {r.doc_id for r in out} == set(left)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", left[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size for r in out)
    for source in {r.source for r in left.values()}:
        mine = [r for r in out if left[r.doc_id].source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target)


def test_nulls_and_empty_tables_through_all_stages(spark, tmp_path):
    line = " ".join(f"word{k} of many" for k in range(30)) + "."
    other = " ".join(f"thing{k} in here" for k in range(30)) + "."
    rows = [(1, line, "en", None, 1, 7), (1, line, "en", None, 1, 7), (None, other, None, "s", None, 8), (2, None, "en", "s", 0, 9), (3, "", None, None, None, None), (4, line + "\n" + other + " more", "de", "s", 5, 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, `row` int"
    for some in (rows, []):
        d = str(tmp_path / f"t{len(some)}")
        spark.createDataFrame(some, kinds).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "short one")] if some else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = table(spark, d, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stash(stage(spark, docs, d), "test")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"], name
        # the line of 4 that repeats that of 1 goes, and that of the null id, which is last, repeats the other of 4
        left = sorted(((r.doc_id, r.text, r.row) for r in docs.collect()), key=str)
        assert left == ([(1, line, 7), (4, other + " more", 1), (None, "", 8)] if some else [])
        out = corpus_pipeline.run(spark, d).collect()
        assert sorted((str(r.doc_id), r.size) for r in out) == ([("1", 90), ("4", 91), ("None", 0)] if some else [])
