import hashlib
import random
import re

from mirrorlake.llm import secrets

KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def brute(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))
    return spans, hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def texts():
    rnd = random.Random(5)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    mixed = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64))
    return [
        None, "", "no secrets here", f'é token = "{hexa(40)}" end', f"password:secret:abcdefgh1 AKIA{'A' * 12} AKIAB",
        f"{hexa(31)} {hexa(32)} g{hexa(33)}AKIA0000000000001{hexa(5)}", "API_KEY=short APIKEY==longer.value-1 Passwd ' : 'x",
        f"begin {mixed} end", "abcabcabcabcabcabcabcabcabcabcabc " * 3, "thanblyonerthandedthetionthanblyoner", "x " * 30000 + f"secret={hexa(40)}",
        f"token={hexa(9)}" * 3,
    ]


def test_base_spans_equal_brute_force_and_random_tokens_are_found(spark, tmp_path):
    rows = [(i, t, "kept out", i) for i, t in enumerate(texts())] + [(None, "token=abcdefgh12", "", 0)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, base string, n_hex int").write.parquet(str(tmp_path / "documents.parquet"))
    got = secrets.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts()):
        spans, digest = brute(t)
        assert by[i].base_sha256 == digest, (i, t[:100], by[i].spans, spans)
        assert [by[i].n_assign, by[i].n_access, by[i].n_hex] == [sum(k == x for _, x, _ in spans) for k in range(3)]
    assert "random:6:70" in by[7].spans and "random" not in by[8].spans + by[9].spans
    assert [r.n_assign for r in got if r.doc_id is None] == [1, 1]


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_inside_mixed_runs_are_tested(spark):
    rnd = random.Random(11)
    draw = lambda n, more: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(n))
    key, url, short = draw(20, "") + "/" + draw(19, ""), draw(20, "") + "-" + draw(19, ""), draw(20, "")
    lead = ["AWS_SECRET_ACCESS_KEY=", "https://a.b/v1/", "see "]
    tail = ["", "/x+y?a=b", "."]
    rows = [(i, a + x + b) for i, (a, x, b) in enumerate(zip(lead, (key, url, short), tail, strict=True))] + [(3, "thethethethethethethe " * 9)]
    got = {r.doc_id: [(x.start, x.end) for x in r.random] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in enumerate((key, url, short)):
        assert (len(lead[i]), len(lead[i]) + len(x)) in got[i], (i, got[i])
    assert got[3] == []


def test_pieces_are_the_longest_of_each_encoding():
    rnd = random.Random(3)
    for _ in range(3000):
        t = "".join(rnd.choice("aB1aB1aB1aB1aB1aB1aB1aB1aB1+/-_=. ") for _ in range(rnd.randint(1, 120)))
        every = {m.span() for p in (r"[A-Za-z0-9+/]+", r"[A-Za-z0-9_-]+") for m in re.finditer(p, t)}
        want = {x for x in every if x[1] - x[0] >= secrets.SHORTEST and not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in every)}
        got = [(m.start(), m.start() + len(m[0].rstrip("="))) for p in (secrets.TOKEN, secrets.TOKEN_URL) for m in re.finditer(p, t)]
        assert len(got) == len(set(got)) and set(got) == want, t


COUNT = {c: 1000 // (k + 1) for k, c in enumerate(secrets.CHARACTERS)}


def test_weights_have_the_mean_and_variance_of_draws():
    import numpy as np

    rnd = np.random.default_rng(2)
    for _, letters in secrets.ENCODINGS:
        known = secrets.language(COUNT, letters)
        share = np.array([1 + sum(COUNT[c] for c in letters if c.lower() == x) for x in known.letters], float)
        random_ = np.array([letters.lower().count(x) for x in known.letters]) / len(letters)
        draws = rnd.multinomial(30, 0.9 * share / share.sum() + 0.1 * random_, 100000) @ np.array(known.weights)
        assert abs(draws.mean() - 30 * known.mean) < 0.05 and abs(draws.var() / (30 * known.variance) - 1) < 0.03


def test_battery_equals_plain_arithmetic(spark):
    import math

    rnd = random.Random(4)
    letters = dict(secrets.ENCODINGS)["alnum"]
    tokens = ["".join(rnd.choice(letters[:size]) for _ in range(n)) for n in (16, 24, 40, 90) for size in (5, 26, 62)]
    known = [secrets.language(COUNT, x) for _, x in secrets.ENCODINGS]
    k = [name for name, _ in secrets.ENCODINGS].index("alnum")
    got = spark.createDataFrame([(t,) for t in tokens], "t string").selectExpr("t", f"{secrets._p_values('t', str(k), known)} as p").collect()
    tail = lambda z: 1 / (1 + math.exp(min(700, 1.5976 * z + 0.070566 * max(-40, min(40, z)) ** 3)))
    for r in got:
        c = [letters.index(x) for x in r.t]
        n, a = len(c), 62
        f = sum(r.t.count(x) ** 2 for x in letters)
        df = a - 1
        z_chi = (((a / n * f - n) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        high = [2 * x >= a for x in c]
        up, lo = sum(high), n - sum(high)
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mu = 2 * up * lo / n + 1
        z_runs = abs(runs - mu) / math.sqrt((mu - 1) * (mu - 2) / (n - 1)) if up and lo else math.sqrt(n)
        mean = sum(c) / n
        z_serial = abs(sum((x - mean) * (y - mean) for x, y in zip(c, c[1:], strict=False)) / sum((x - mean) ** 2 for x in c)) * math.sqrt(n)
        z = (z_chi + (z_runs - 0.798) / 0.603 + (z_serial - 0.798) / 0.603) / math.sqrt(3)
        q = known[k]
        far = (sum(q.weights[q.letters.index(x)] for x in r.t.lower()) - n * q.mean) / math.sqrt(n * q.variance)
        assert math.isclose(r.p.random, tail(z), rel_tol=1e-6, abs_tol=1e-12)
        assert math.isclose(r.p.language, tail(far), rel_tol=1e-6, abs_tol=1e-12)


def test_control_is_of_what_is_reported(spark):
    """Identifiers and constants of language are not called secrets; planted keys are found, few others."""
    rnd = random.Random(9)
    words = """about after again answer because before between change children different does earth enough every family father follow found great
    group house important kind large learn letter light little live mother move never night number often other paper part people picture place
    plant point river school sentence should side small something spell still story study such think thought three through together took under
    until watch water well where while word work world would write year young""".split()
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows, planted = [], {}
    for i in range(400):
        name = "".join(rnd.choice(words).title() for _ in range(6))
        lead = f"{prose(60)} {name} {''.join(rnd.choice(words) for _ in range(5)).upper()} "
        key = "".join(rnd.choice(dict(secrets.ENCODINGS)["alnum"]) for _ in range(rnd.choice([32, 40, 48]))) if i % 4 == 0 else ""
        if key:
            planted[i] = (len(lead), len(lead) + len(key))
        rows.append((i, lead + key + " end"))
    rows += [(1000, "ThisIsAVeryLongCamelCaseIdentifierName123"), (1001, "HELLOWORLDTHISISACONSTANTNAME")]
    got = {r.doc_id: [(x.start, x.end) for x in r.random] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(span in got[i] for i, span in planted.items())
    total = sum(map(len, got.values()))
    assert got[1000] == got[1001] == [] and found >= 0.9 * len(planted) and total - found <= 0.1 * total, (found, total)


def test_threshold_equals_plain_benjamini_hochberg():
    rnd = random.Random(6)
    for _ in range(50):
        bins = {rnd.randrange(150): rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))}
        p = sorted(10 ** (-b / secrets.STEPS) for b, n in bins.items() for _ in range(n))
        cut = max((x for k, x in enumerate(p, 1) if x <= 0.05 * k / len(p)), default=None)
        first = secrets.reported(bins, 0.05)
        assert [b for b in bins if b >= first] == [b for b in bins if cut is not None and 10 ** (-b / secrets.STEPS) <= cut]
