"""Operator 7: secret scans by a battery of randomness tests.

Plain patterns (assignments, access keys, long hex runs) give the base spans. The method looks at every
longest run of SHORTEST or more characters of one encoding, with the '=' that pad it, that no base span
touches: a run of mixed token characters is cut at inner '=', and where it has '+' or '/' as well as '-' or
'_' into the longest pieces in base64 and those in base64url, which may overlap. Of each it infers the
encoding (decimal, hex, base32, letters and digits, base64) and tests it against that alphabet:
  - chi-squared uniformity of the characters (Wilson-Hilferty normal form; unevenness counts),
  - a runs test of characters in the lower against the upper half of the alphabet (two-sided),
  - serial correlation of neighbouring characters (two-sided).
The three scores are combined by Stouffer's rule; a token below RANDOM is not random and goes no further.
What is left may still be language. So its characters, letters in either case as one, are weighed against language
as it is in the table: the weight of a character is the logarithm of its share in random tokens of the encoding
over its share in all texts, and the sum has a known mean and variance for a token drawn from those texts. A sum
far above is no language. Of these p-values a Benjamini-Hochberg threshold by class of encoding and length decides
what is reported, so the false discovery rate is that of the reported secrets. Tokens of digits alone are held
against digits, which is to say that they are hardly ever reported. The threshold comes from a histogram of the whole
table (at most ENCODINGS x LENGTHS x BINS rows reach the driver, whatever the input), the shares from one row of sums.

The table is scanned three times and nothing but sums and the histogram is shuffled. Built-in functions only.

Defined cases: a null or empty text has no spans (base_sha256 is the hash of the empty string); ids,
repeated rows and other columns are passed by; an empty table gives an empty result; texts are scanned whole.
"""

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

SHORTEST = 16
ALPHA = 0.01
#: Least p-value of the battery, under the hypothesis that a token is random.
RANDOM = 0.01
#: Share of random characters that language is granted, as names carry digits and such.
MIXED = 0.1
#: Bins of p-values, STEPS a power of ten, the last one open.
BINS, STEPS = 1000, 50
#: Lower ends of the length classes.
LENGTHS = (16, 24, 32, 40, 64, 128)

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA([A-Z0-9]+))"
HEX = r"([0-9a-f]{32,})"
#: Longest pieces in base64 (without those that are part of a longer one in base64url), and in base64url with - or _.
_PAD = r"(?:=++(?![A-Za-z0-9+/_-]))?"
TOKEN = r"((?<![A-Za-z0-9+/])(?:(?=[A-Za-z0-9]*+[+/])|(?<![_-])(?=[A-Za-z0-9]++(?![_-])))[A-Za-z0-9+/]{%d,}+%s)" % (SHORTEST, _PAD)
TOKEN_URL = r"((?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*+[_-])[A-Za-z0-9_-]{%d,}+%s)" % (SHORTEST, _PAD)

#: Encodings from narrow to wide, each with its characters in order.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("upper_hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)

_SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,body:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, kind_no: int, group: int, least: int) -> str:
    """SQL: the matches of pattern with their places. The pieces between matches come from split, so
    where a match begins is the sum of the lengths of all pieces and matches before it."""
    q = _quoted(pattern)
    step = (
        "aggregate(sequence(1, size(m)), "
        f"named_struct('at', cast(0 as bigint), 'out', cast(array() as {_SPAN})), "
        "(a, j) -> named_struct('at', a.at + length(g[j - 1]) + length(m[j - 1]), 'out', "
        f"if(length(v[j - 1]) >= {least}, array_append(a.out, named_struct('start', a.at + length(g[j - 1]), 'kind_no', {kind_no}, "
        "'end', a.at + length(g[j - 1]) + length(m[j - 1]), 'body', m[j - 1])), a.out)), a -> a.out)"
    )
    body = let("m", f"regexp_extract_all({text}, {q}, 0)", let("v", f"regexp_extract_all({text}, {q}, {group})", let("g", f"split({text}, {q})", step)))
    return f"case when {text} rlike {q} then {body} else cast(array() as {_SPAN}) end"


def _normal_tail(z: str) -> str:
    """SQL: probability that a normal deviate is z or more (logistic form, within 0.0002)."""
    return f"(1 / (1 + exp(least(700, greatest(-700, 1.5976 * ({z}) + 0.070566 * pow(least(40, greatest(-40, {z})), 3))))))"


def _encoding(x: str) -> str:
    """SQL: number of the narrowest encoding that has every character of x, or null."""
    out = "case "
    for k, (_, letters) in enumerate(ENCODINGS):
        cls = letters.replace("-", "").replace("/", "\\\\/")
        out += f"when {x} rlike '^[{cls}{'-' if '-' in letters else ''}]+=*$' then {k} "
    return out + "end"


#: Every character of an encoding.
CHARACTERS = "".join(sorted({c for _, letters in ENCODINGS for c in letters}))


class Language(NamedTuple):
    """Weights of the characters of an encoding, in the order of letters, and mean and variance of that of one
    character of language."""

    letters: str
    weights: list[float]
    mean: float
    variance: float


def language(count: dict[str, int], letters: str) -> Language:
    """From the counts of characters in all texts; one of each is added, so no share is nothing."""
    folded = "".join(dict.fromkeys(letters.lower()))
    known = [1 + sum(count[c] for c in letters if c.lower() == x) for x in folded]
    random = [letters.lower().count(x) / len(letters) for x in folded]
    share = [(1 - MIXED) * n / sum(known) + MIXED * u for n, u in zip(known, random, strict=True)]
    weights = [math.log(u / q) for u, q in zip(random, share, strict=True)]
    mean = sum(q * w for q, w in zip(share, weights, strict=True))
    return Language(folded, weights, mean, max(1e-9, sum(q * w * w for q, w in zip(share, weights, strict=True)) - mean**2))


def background(docs: DataFrame, text: str) -> list[Language]:
    """What language is in each encoding, by the characters of all texts."""
    t = F.col(f"`{text}`")
    row = docs.agg(*[F.coalesce(F.sum(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))), F.lit(0)).alias(f"c{k}") for k, c in enumerate(CHARACTERS)]).first()
    count = {c: row[k] for k, c in enumerate(CHARACTERS)}
    return [language(count, letters) for _, letters in ENCODINGS]


def _p_values(x: str, k: str, known: list[Language]) -> str:
    """SQL: struct of two p-values for token x in encoding k: random (of the battery; small: not random) and language
    (of the weights; small: no language)."""
    letters = "element_at(array(" + ", ".join(f"'{x}'" for _, x in ENCODINGS) + f"), {k} + 1)"
    # n characters, a letters; f: sum of squared counts; runs of halves; correlation of neighbours
    stats = let(
        "c",
        f"transform(filter(split({x}, ''), y -> y != '' and y != '='), y -> cast(instr(ls, y) - 1 as double))",
        "named_struct('n', cast(size(c) as double), 'a', cast(length(ls) as double), "
        f"'f', aggregate(split(ls, ''), 0D, (s, y) -> if(y = '', s, s + pow(length({x}) - length(replace({x}, y, '')), 2))), "
        "'up', cast(size(filter(c, y -> 2 * y >= length(ls))) as double), "
        "'runs', aggregate(zip_with(c, slice(c, 2, size(c)), (y, w) -> if(w is not null and (2 * y >= length(ls)) != (2 * w >= length(ls)), 1D, 0D)), 1D, (s, y) -> s + y), "
        "'mean', aggregate(c, 0D, (s, y) -> s + y) / greatest(1, size(c)), 'sq', aggregate(c, 0D, (s, y) -> s + y * y), "
        "'cross', aggregate(zip_with(c, slice(c, 2, size(c)), (y, w) -> coalesce(y * w, 0D)), 0D, (s, y) -> s + y), "
        "'ends', coalesce(c[0], 0D), 'last', coalesce(element_at(c, -1), 0D))",
    )
    chi = "(s.a / s.n * s.f - s.n)"
    df = "(s.a - 1)"
    z_chi = f"((pow(greatest(1e-9, {chi}) / {df}, 1D / 3) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df})))"
    lo = "(s.n - s.up)"
    mu = f"(2 * s.up * {lo} / s.n + 1)"
    var = f"greatest(1e-9, ({mu} - 1) * ({mu} - 2) / greatest(1, s.n - 1))"
    z_runs = f"(case when s.up = 0 or {lo} = 0 then sqrt(s.n) else abs(s.runs - {mu}) / sqrt({var}) end)"
    spread = "(s.sq - s.n * s.mean * s.mean)"
    cross = "(s.cross - s.mean * (2 * s.n * s.mean - s.ends - s.last) + (s.n - 1) * s.mean * s.mean)"
    z_serial = f"(case when {spread} <= 0 then sqrt(s.n) else abs({cross} / {spread}) * sqrt(s.n) end)"
    # |z| of a normal deviate has mean 0.798 and deviation 0.603
    z = f"(({z_chi} + ({z_runs} - 0.798) / 0.603 + ({z_serial} - 0.798) / 0.603) / sqrt(3D))"
    sum_ = f"aggregate(split(lower({x}), ''), 0D, (s, y) -> s + if(y = '' or y = '=', 0D, q.w[instr(q.l, y) - 1]))"
    far = f"(({sum_} - s.n * q.m) / sqrt(s.n * q.v))"
    both = f"named_struct('random', {_normal_tail(z)}, 'language', {_normal_tail(far)})"
    held = ", ".join(f"named_struct('l', '{a.letters}', 'w', array({', '.join(f'{w!r}D' for w in a.weights)}), 'm', {a.mean!r}D, 'v', {a.variance!r}D)" for a in known)
    return let("ls", letters, let("q", f"element_at(array({held}), {k} + 1)", let("s", stats, both)))


def _class(length: str) -> str:
    return "case " + " ".join(f"when {length} >= {least} then {k}" for k, least in reversed(list(enumerate(LENGTHS)))) + " end"


def _with_spans(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, the base spans by kind, and the tokens that pass the battery as structs (start, end, encoding, class
    of length, bin of the p-value of language)."""
    known = background(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select(
        "doc_id",
        F.expr(_spans("t", ASSIGN, 0, 2, 8)).alias("assign"),
        F.expr(_spans("t", ACCESS, 1, 1, 16)).alias("access"),
        F.expr(_spans("t", HEX, 2, 1, 32)).alias("hex"),
        F.concat(F.expr(_spans("t", TOKEN, 3, 1, SHORTEST)), F.expr(_spans("t", TOKEN_URL, 3, 1, SHORTEST))).alias("token"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), base.alias("base"), "token")
    tested = f"""transform(filter(token, x -> not exists(base, b -> b.start < x.end and x.start < b.end) and ({_encoding('x.body')}) is not null),
        x -> {let('k', _encoding('x.body'), let('p', _p_values('x.body', 'k', known), f"named_struct('start', x.start, 'end', x.end, 'enc', k, 'len', {_class('length(x.body)')}, 'random', p.random, 'bin', cast(least({BINS - 1}, floor(-{STEPS} * log10(greatest(1e-300, p.language)))) as int))"))})"""
    tested = f"filter({tested}, x -> x.random >= {RANDOM})"
    return rows.withColumn("tested", F.expr(tested)).drop("token")


def limits(rows: DataFrame, alpha=ALPHA) -> dict[tuple[int, int], int]:
    """Benjamini-Hochberg by (encoding, length class): the lowest bin that is reported, BINS for none. A bin counts
    at its largest p-value. Only histogram counts leave the executors."""
    seen = rows.select(F.explode("tested").alias("x")).groupBy("x.enc", "x.len", "x.bin").count().collect()
    groups: dict[tuple[int, int], dict[int, int]] = {}
    for r in seen:
        groups.setdefault((r["enc"], r["len"]), {})[r["bin"]] = r["count"]
    return {key: reported(bins, alpha) for key, bins in groups.items()}


def reported(bins: dict[int, int], alpha: float) -> int:
    total, above, first = sum(bins.values()), 0, BINS
    for b in range(BINS - 1, -1, -1):
        above += bins.get(b, 0)
        if above and 10 ** (-b / STEPS) <= alpha * above / total:
            first = b
    return first


def scan(docs: DataFrame, text="text", doc_id="doc_id", alpha=ALPHA) -> DataFrame:
    """doc_id, counts of the base kinds, base (array of spans) and random (array of spans of the method)."""
    rows = _with_spans(docs, text, doc_id)
    cut = limits(rows, alpha)
    test = "case " + " ".join(f"when x.enc = {k} and x.len = {n} then x.bin >= {b}" for (k, n), b in sorted(cut.items())) + " else false end" if cut else "false"
    return rows.withColumn("random", F.expr(f"filter(tested, x -> {test})")).drop("tested")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    name = "element_at(array('assign', 'access', 'hex', 'random'), x.kind_no + 1)"
    said = lambda spans: f"array_join(transform({spans}, x -> concat({name}, ':', x.start, ':', x.end)), ',')"
    every = "array_sort(concat(transform(base, x -> named_struct('start', x.start, 'kind_no', x.kind_no, 'end', x.end)), transform(random, x -> named_struct('start', x.start, 'kind_no', 3, 'end', x.end))))"
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.expr(said("base")).cast("binary"), 256).alias("base_sha256"), F.expr(said(every)).alias("spans"))
