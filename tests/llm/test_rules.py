import re
from collections import Counter

from mirrorlake.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    plain = " ".join(f"word{i}" for i in range(60))
    return [None, "", " \n\t ", "a b c", "a b c a b c", plain, plain + "\n" + plain, "é ü ñ " * 30, ("x " * 40 + "\n") * 20, "# " * 80, plain + "\x0b\x0c\r end", "A! " * 60 + plain, "w " * 40000, "a\n\n \na\nb", plain.upper()]


def test_metrics_and_verdicts_equal_brute_force(spark):
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(None, "a b", 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    got = rules.report(docs).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    kept = {r.doc_id for r in got if r.kept}
    for r in (r for r in got if r.doc_id is not None):
        want = brute(texts()[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert {5, 10} <= kept and not kept & {9, 14}
    left = rules.filter_documents(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept


def test_order_changes_no_verdict_and_empty_table(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    checks = rules.rules()
    rows = rules.with_words(docs)
    a, b = ([r.x for r in rows.selectExpr(f"{rules.cascade(checks, order)} as x").collect()] for order in (list(checks), list(checks)[::-1]))
    assert a == b
    assert rules.report(docs.limit(0)).count() == 0 and rules.filter_documents(docs.limit(0)).count() == 0


def test_order_is_by_rejections_per_cost_of_what_is_left():
    verdicts = {"a": [True] * 6 + [False] * 4, "b": [True] * 6 + [False] * 4, "c": [False] * 7 + [True] * 3, "dear": [True] * 10}
    assert rules.greedy(verdicts, {"a": 1, "b": 1.1, "c": 1, "dear": 100}) == ["a", "c", "b", "dear"]


def test_the_same_rows_give_the_same_order_of_costs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    orders = [rules.plan_cascade(docs, rules.rules()) for _ in range(2)]
    assert all(set(o) == set(rules.rules()) for o in orders)
    # counting words costs nothing beside the sorted windows, which reject less
    assert all(o.index("short") < o.index("repeated") for o in orders)
