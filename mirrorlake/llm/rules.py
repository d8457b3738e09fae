"""Operator 1: quality rules as a short-circuit cascade.

Each rule is one Column over the words of a text. A bounded sample (SAMPLE_ROWS rows of SAMPLE_BYTES or less, drawn by
chance from the first partitions that hold so many) is taken and written once. One pass over it gives the verdict of every rule on every row;
the cost of a rule is the time of REPEAT evaluations of the very expression that will run, less that of none.
The order is greedy: next comes the rule that rejects most per cost of the rows that all earlier ones let pass.
Rules are chained in one CASE, so a later one is only evaluated for rows that passed. The order changes the
time, never the verdict.
Only built-in functions are used; the table is read once and nothing is shuffled.

Defined cases: a null or empty text has no words, so base_failed is true; ids and other columns pass
through untouched; repeated rows are judged each; an empty table gives an empty result.
"""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, let, stash, table, words_sql

MIN_WORDS = 50
#: Percent of words in repeated 3-word windows above which a text fails.
MOST_REPEATED = 50
#: Symbols per 100 words, duplicate lines per 100 lines, "!" and "|" per 100 words, capitals per 100 letters.
MOST_SYMBOLS, MOST_DUP_LINES, MOST_MARKS, MOST_CAPITALS = 30, 50, 30, 60
#: Mean characters of a word.
MEAN_WORD = (2, 20)
SAMPLE_ROWS, SAMPLE_BYTES = 500, 1 << 16
#: Share of the rows that are drawn; evaluations of each row of the sample when a rule is timed.
DRAWN, REPEAT = 0.2, 4


def _repeat_words(w: str) -> str:
    """SQL: words in 3-word windows that stand twice or more in the array w. Windows, as 64-bit hashes, are sorted and
    compared with their neighbours, so the cost is n log n."""
    windows = f"sort_array(transform(sequence(1, size({w}) - 2), i -> struct(xxhash64({w}[i - 1], {w}[i], {w}[i + 1]) as h, i as i)))"
    same = "zip_with(s, slice(s, 2, size(s)), (x, y) -> if(y.i is not null and x.h = y.h, array(x.i, y.i), cast(array() as array<int>)))"
    hits = f"array_distinct(flatten({let('s', windows, same)}))"
    covered = f"size(array_distinct(flatten(transform({hits}, i -> array(i, i + 1, i + 2)))))"
    return f"if(size({w}) < 4, 0, {covered})"


def metric(name: str, text="text", words="words") -> str:
    """SQL of one base metric over the text and its array of words."""
    t, w = f"coalesce({text}, '')", words
    lines = f"filter(split({t}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    return {
        "n_words": f"size({w})",
        "word_chars": f"length(array_join({w}, ''))",
        "n_symbols": f"length({t}) - length(translate({t}, '#*$%&|<>', ''))",
        "n_dup_lines": let("ls", lines, "size(ls) - size(array_distinct(ls))"),
        "n_repeat_words": _repeat_words(w),
    }[name]


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules(text="text", words="words") -> dict[str, str]:
    """Name of each rule -> SQL that is true where the rule rejects."""
    t, w = f"coalesce({text}, '')", words
    m = {name: metric(name, text, words) for name in METRICS}
    return {
        "short": f"size({w}) < {MIN_WORDS}",
        "repeated": f"100 * ({m['n_repeat_words']}) > {MOST_REPEATED} * size({w})",
        "symbols": f"100 * ({m['n_symbols']}) > {MOST_SYMBOLS} * size({w})",
        "dup_lines": f"100 * ({m['n_dup_lines']}) > {MOST_DUP_LINES} * (1 + length({t}) - length(replace({t}, '\\n', '')))",
        "marks": f"100 * (length({t}) - length(translate({t}, '!|', ''))) > {MOST_MARKS} * size({w})",
        "capitals": f"100 * regexp_count({t}, '[A-Z]') > {MOST_CAPITALS} * (1 + regexp_count({t}, '[A-Za-z]'))",
        "word_length": f"({m['word_chars']}) < {MEAN_WORD[0]} * size({w}) or ({m['word_chars']}) > {MEAN_WORD[1]} * size({w})",
    }


def with_words(docs: DataFrame, text="text", words="words") -> DataFrame:
    return docs.withColumn(words, F.expr(words_sql(f"`{text}`")))


def plan_cascade(texts: DataFrame, checks: dict[str, str], prepare=None, sample_rows=SAMPLE_ROWS) -> list[str]:
    """Names of the rules, best first, for texts (column text) that prepare gives what the checks use. The sample comes
    to the driver, so only as many partitions are read as hold it."""
    short = texts.select("text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    drawn = short.where(F.rand(7) < DRAWN).limit(sample_rows).collect()
    if len(drawn) < sample_rows // 10:  # a small table
        drawn = short.limit(sample_rows).collect()
    sample = (prepare or with_words)(texts.sparkSession.createDataFrame([(r.text,) for r in drawn], "text string").coalesce(1))
    sample = stash(sample, "rulesample")
    verdicts = sample.select(*[F.expr(f"coalesce({sql}, false)").alias(name) for name, sql in checks.items()]).collect()
    again = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))).alias("turn__"))

    def seconds(sql):
        began = time.perf_counter()
        again.agg(F.sum(F.expr(f"if(({sql}) and turn__ > 0, 1, 0)"))).collect()
        return time.perf_counter() - began

    none = min(seconds("true") for _ in range(2))
    cost = {name: max(seconds(sql) - none, 1e-3) for name, sql in checks.items()}
    drop_stash(sample)
    return greedy({name: [bool(r[name]) for r in verdicts] for name in checks}, cost)


def greedy(verdicts: dict[str, list[bool]], cost: dict[str, float]) -> list[str]:
    """Rules in order of rejections per cost among the rows that no earlier rule rejects."""
    order, left = [], list(verdicts)
    alive = [True] * len(next(iter(verdicts.values()), []))
    while left:
        n = sum(alive)
        rate = {name: (sum(x and y for x, y in zip(alive, verdicts[name], strict=True)) + 0.5) / (n + 1) / cost[name] for name in left}
        best = max(left, key=rate.get)
        order.append(best)
        left.remove(best)
        alive = [x and not y for x, y in zip(alive, verdicts[best], strict=True)]
    return order


def cascade(checks: dict[str, str], order: list[str]) -> str:
    """SQL that is true where no rule rejects; a CASE, so rules after the first rejection are not evaluated."""
    return "case " + " ".join(f"when {checks[name]} then false" for name in order) + " else true end"


def filter_documents(docs: DataFrame, text="text") -> DataFrame:
    """The rows that every rule keeps, with the columns of docs. The words are bound inside the predicate,
    because the optimizer moves a filter below the projection that would hold them."""
    order = plan_cascade(docs.select(F.col(f"`{text}`").alias("text")), rules())
    return docs.where(F.expr(let("words", words_sql(f"`{text}`"), cascade(rules(f"`{text}`", "words"), order))))


def report(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id, the base metrics, base_failed and kept for every row."""
    measured = lambda texts: with_words(texts).select("*", *[F.expr(metric(m)).cast("long").alias(m) for m in METRICS])
    rows = measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    checks = rules() | {
        "short": f"n_words < {MIN_WORDS}",
        "repeated": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
        "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * n_words",
        "dup_lines": f"100 * n_dup_lines > {MOST_DUP_LINES} * (1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), '\\n', '')))",
        "word_length": f"word_chars < {MEAN_WORD[0]} * n_words or word_chars > {MEAN_WORD[1]} * n_words",
    }
    order = plan_cascade(docs.select(F.col(text).alias("text")), checks, measured)
    return rows.select("doc_id", *METRICS, failed.alias("base_failed"), F.expr(cascade(checks, order)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def metrics_sql(docs: str) -> str:
    """DuckDB: the metrics for a relation of documents, with row numbers in k."""
    return rf"""
b AS (SELECT row_number() OVER () AS k, * FROM {docs}),
w AS (SELECT k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM b),
g AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
d AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY k),
m AS (SELECT w.k, doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON c.k = w.k),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
        NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words OR 100 * n_symbols > {MOST_SYMBOLS} * n_words
          OR 100 * n_dup_lines > {MOST_DUP_LINES} * (1 + length(text) - length(replace(text, chr(10), '')))
          OR 100 * (length(text) - length(regexp_replace(text, '[!|]', '', 'g'))) > {MOST_MARKS} * n_words
          OR 100 * len(regexp_extract_all(text, '[A-Z]')) > {MOST_CAPITALS} * (1 + len(regexp_extract_all(text, '[A-Za-z]')))
          OR word_chars < {MEAN_WORD[0]} * n_words OR word_chars > {MEAN_WORD[1]} * n_words) AS kept FROM m)"""


ORACLE = f"""WITH {metrics_sql("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM v"""
