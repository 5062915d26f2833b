"""Secret scans and personal data: base spans against Python's re, the methods' own spans, masks."""

import hashlib
import inspect
import math
import re
import string

import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfmark.llm import pii, secret_scan, spans

KEYWORDS = "password passwd secret token"
either = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
ASSIGN = "(" + "|".join([*map(either, KEYWORDS.split()), either("api") + "_?" + either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
digits = lambda s: re.sub("[^0-9]", "", s)


def luhn(s):
    v = [int(c) for c in reversed(s)]
    return sum(v[::2] + [d * 2 - 9 * (d > 4) for d in v[1::2]]) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]
ODD = [
    "token = 'abcdef' secret:secret: abcdefgh é password=12345 PASSWORD: \"x1y2z3\"", "a" * 30 + " " + "0" * 25, "secret=token: abcdefgh apikey=aaaaaa api_key==abcdefg ſecret=abcdefg toKen=abcdefg",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "x AKIAKIA" + "C" * 20, "héé 😀 token=abcdef1 " * 300, "a@b.c_d@e.f x@y.z@q.r.s é a..b@c-.d. @x.y a@b 😀 z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111 4111-1111-1111-1111  4111  1111 1111 1111 378282246310005 1 0000000000000000", "+1 (555) 555-5555. +49 30 1234567- +1+22 333 444 5555 +12345", "1 2" * 40 + " " + "7 " * 3000 + "+" * 50,
]


def base(kinds, text):
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, rx, ok) in enumerate(kinds) for m in re.finditer(rx, text) if ok(m))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


@pytest.mark.parametrize(("find", "kinds"), [(secret_scan.find_secrets, SECRETS), (pii.find_personal_data, PERSONAL)])
def test_base_spans(spark, messy, texts, nothing, find, kinds):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = find(messy.unionByName(odd, allowMissingColumns=True)).collect()
    want = sorted(hashlib.sha256(base(kinds, t or "").encode()).hexdigest() for t in [t for _, t, _ in texts] + ODD)
    assert sorted(r.base_sha256 for r in got) == want
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        r, want_spans = by_id[1000 + i], base(kinds, t).split(",")
        assert r.base_sha256 == hashlib.sha256(",".join(want_spans).encode()).hexdigest()
        for kind, _, _ in kinds:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in want_spans)
        assert set(filter(None, want_spans)) <= set(r.spans.split(","))
    assert find(nothing).count() == 0


def test_long_texts_stay_linear(spark):
    long = ["9" * 20_000 + ".1" * 4_000, "a" * 20_000 + "@" + "b.c" * 8_000, "+" + "1" * 5_000 + "(" * 20_000, "1 " * 20_000, "token=abcdef " * 20_000, "AKIA" * 10_000, "0a" * 40_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    s = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    assert s[4].n_assign == 20_000 and s[6].n_hex == 1
    p = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert p[1].n_email == 1 and p[1].spans == "email:0:44001"


def test_random_strings_are_found_and_words_are_not(spark):
    rng = np.random.default_rng(3)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    alnum = string.ascii_letters + string.digits
    keys = [draw(alnum, 32) for _ in range(10)] + [draw(alnum + "+/", 44) for _ in range(10)]
    words = ["internationalisation", "counterrevolutionaries", "src/main/resources/config/application", "the-quick-brown-fox-jumps-over", "CONFIGURATION_OPTIONS_DEFAULT"]
    df = spark.createDataFrame([(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {w} there") for i, w in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    assert sum(got[i].n_random for i in range(len(keys))) >= 18
    assert got[0].spans == "random:4:36"
    assert all(got[100 + i].n_random == 0 for i in range(len(words)))


def test_dates_are_not_found_among_keys(spark):
    rng = np.random.default_rng(4)
    keys = ["".join(rng.choice(list(string.ascii_letters + string.digits), 32)) for _ in range(20)]
    plain = ["2024-05-17T12-30-55Z", "20240517T123055Z", "2024-05-17T12-30"]
    df = spark.createDataFrame([(i, f"see {k} there") for i, k in enumerate(keys + plain)], "doc_id long, text string")
    got = {r.doc_id: r.n_random for r in secret_scan.find_secrets(df).collect()}
    assert sum(got[i] for i in range(20)) >= 19
    assert [w for i, w in enumerate(plain) if got[20 + i]] == []


ENCODINGS = {"base62": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits, "base64": string.ascii_letters + string.digits + "+/", "HEX": "0123456789ABCDEF"}


def test_recall_by_length_and_encoding_at_low_prevalence(spark):
    """Keys are under 1% of the runs, the rest are the long names in the standard library's sources."""
    import inspect
    import subprocess
    import tarfile
    import typing

    rng = np.random.default_rng(8)
    source = "".join(inspect.getsource(m) for m in (inspect, subprocess, tarfile, typing))
    names = sorted(set(re.findall(r"(?<![A-Za-z0-9+/_-])[A-Za-z_][A-Za-z_]{11,}(?![A-Za-z0-9+/_-])", source)))
    plain = [f"{w} and {w}" for w in names] * 60
    planted = [(name, n, "".join(rng.choice(list(chars), n))) for name, chars in ENCODINGS.items() for n in (16, 20, 24, 32) for _ in range(20)]
    assert len(names) > 300 and len(planted) < 0.01 * 2 * len(plain)
    df = spark.createDataFrame([(i, f"see {k} there") for i, (_, _, k) in enumerate(planted)] + [(10_000 + i, t) for i, t in enumerate(plain)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(df).where("n_random > 0").collect()}
    for name in ENCODINGS:
        for n in (16, 20, 24, 32):
            ids = [i for i, (a, b, _) in enumerate(planted) if (a, b) == (name, n)]
            least = 0.6 if n == 16 else 0.85
            assert sum(i in got for i in ids) >= least * len(ids), (name, n)
    assert sum(i >= 10_000 for i in got) <= 0.05 * len(got)


def test_redaction(spark, messy):
    df = spark.createDataFrame([(1, "é token=abcdef1 x AKIA" + "A" * 16, 40, "keep"), (2, None, None, "keep"), (3, "plain", 5, "keep")], "doc_id long, text string, n_chars int, spans string")
    out = secret_scan.redact_secrets(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "é [SECRET] x [SECRET]", 21, "keep"), (2, None, None, "keep"), (3, "plain", 5, "keep")]
    out = secret_scan.redact_secrets(messy)
    assert out.schema == messy.schema and out.exceptAll(messy).count() == 0  # no secrets there: nothing changes
    none = secret_scan.redact_secrets(messy.limit(0))
    assert none.schema == messy.schema and none.count() == 0


def test_a_text_of_very_many_secrets_is_redacted_in_linear_time(spark):
    import time

    n = 100_000
    df = spark.createDataFrame([(1, "token=abcdef12 é " * n)], "doc_id long, text string")
    began = time.perf_counter()
    assert secret_scan.redact_secrets(df).first().text == "[SECRET] é " * n
    assert time.perf_counter() - began < 60


def test_spans_are_united_masked_and_compared(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        n, k = int(rng.choice([0, 5, 300, 5000, 9000])), int(rng.choice([0, 1, 3, 700]))
        draw = lambda size: sorted((int(a), int(min(a + b, n))) for a, b in zip(rng.integers(0, n, size), rng.integers(1, 40, size), strict=True)) if n else []  # noqa: E731, B023
        rows.append((i, "".join(rng.choice(list("ab é😀\n"), n)), draw(k), draw(5)))
    span = "array<struct<start:bigint,end:bigint>>"
    df = spark.createDataFrame(rows, f"i int, text string, s {span}, c {span}")
    text, s, c = F.col("text"), F.col("s"), F.col("c")
    got = {r.i: r for r in df.select("i", spans.masked(text, s, lambda _: F.lit("#")).alias("m"), spans.blanked(text, s).alias("b"), spans.united(s).alias("u"), spans.apart(c, text, s).alias("apart")).collect()}
    for i, t, own, other in rows:
        united, left, hidden, at = [], "", list(t), 0
        for a, b in own:
            if united and a < united[-1][1]:
                united[-1][1] = max(united[-1][1], b)
            else:
                united.append([a, b])
        for a, b in united:
            left, at = left + t[at:a] + "#", b
            hidden[a:b] = "\uffff" * (b - a)
        assert got[i].m == left + t[at:] and got[i].b == "".join(hidden)
        assert [list(x) for x in got[i].u] == united
        assert [tuple(x) for x in got[i].apart] == [(a, b) for a, b in other if all(y <= a or b <= x for x, y in own)]


def test_weak_supervision(spark):
    texts = ["Call me: 555-123-4567 or write to joe [at] example [dot] com.", "Signed Dr. Maria Lopez, tel 212-555-7788", "IBAN: DE89 3704 0044 0532 0130 00", "page 12-34-5678 of 99", "version 12 345 6789"] * 20
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    kinds = [{s.split(":")[0] for s in filter(None, r.spans.split(","))} for r in got[:5]]
    assert kinds[0] == {"number", "mail_words"} and "name" in kinds[1] and kinds[2] == {"account"} and kinds[3] == kinds[4] == set()


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.4
    acc = (0.9, 0.75, 0.6)
    votes = np.stack([np.where(rng.random(len(y)) < 0.2, 1, np.where(rng.random(len(y)) < a, 2 * y, 2 * ~y)) for a in acc], axis=1).astype(int)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, rel = pii.expectation_maximisation(patterns, counts.astype(float), 300)
    right = [rel[k, 1, 2] / (rel[k, 1, 2] + rel[k, 1, 0]) for k in range(3)]
    assert np.allclose(right, acc, atol=0.06) and ((p[inverse.ravel()] > 0.5) == y).mean() > 0.85


def upper_tail(z):
    z = min(max(z, -30.0), 30.0)
    return 1 / (1 + math.exp(min(1.5976 * z + 0.07056 * z**3, 300.0)))


def joint_p(s):
    """The battery's joint p-value anew."""
    if len(set(s)) == 1 or re.fullmatch(r"[-0-9+/_]+", s):
        return 1.0
    n = len(s)
    a = next(size for rx, size in ((r"[0-9a-f]+|[0-9A-F]+", 16), (r"[A-Z2-7]+", 32), (r"[0-9a-z]+|[0-9A-Z]+", 36), (r"[0-9A-Za-z]+", 62), (r".+", 64)) if re.fullmatch(rx, s))
    chi = a / n * sum(s.count(c) ** 2 for c in set(s)) - n
    p1 = upper_tail((a * (1 + (n - 1) * 0.068) - n - chi) / math.sqrt(2 * (a - 1) + 4 * n * max(a * 0.068 - 1, 0.05)))
    core = re.sub("[-_/+]", "", s)
    steps, changes = max(len(core) - 1, 1), len(re.findall("[a-z]+|[A-Z]+|[0-9]+", core)) - 1
    rate = 0.32 if re.search("[a-z]", s) and re.search("[A-Z]", s) else 0.12
    p2 = 1.0 if changes < 1 else upper_tail((changes - 0.5 - steps * rate) / math.sqrt(steps * rate * (1 - rate)))
    vowel = [c in "aeiouyAEIOUY" for c in s]
    share = min(0.98, max(0.02, sum(vowel) / n))
    turns = sum(x != y for x, y in zip(vowel, vowel[1:], strict=False))
    p3 = upper_tail((max(-1.0, min(1.0, 1 - turns / ((n - 1) * 2 * share * (1 - share)))) + 0.30) * math.sqrt(n))
    chain = sum(float(f"{secret_scan._step(x, y):.3f}") for x, y in zip(s, s[1:], strict=False)) + (n - 1) * math.log(a) + math.log(5)
    h = -(math.log(p1) + math.log(p2) + math.log(p3) + max(min(chain, 0.0), -300.0))
    return min(1.0, math.exp(-h) * (1 + h + h * h / 2 + h**3 / 6))


def test_p_values_and_cut_by_brute_force(spark):
    rng = np.random.default_rng(11)
    names = [w for w in re.findall(r"[A-Za-z0-9+/_-]{12,}", inspect.getsource(inspect)) if not re.fullmatch(r"[0-9a-f]{24,}", w)]
    keys = ["".join(rng.choice(list(chars), n)) for chars in ENCODINGS.values() for n in (12, 17, 23, 40) for _ in range(4)]
    runs = sorted({*names, *keys, "a" * 15, "-" * 20, "0123456789-0123", "AbAbAbAbAbAb"})
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, s string").withColumn("p", secret_scan.p_value(F.col("s")))
    for r in df.collect():
        assert r.p == pytest.approx(joint_p(r.s), rel=1e-6, abs=1e-90), r.s
    # The step-up rule: of all bins' edges the largest t with m * t <= level * (runs at or below t).
    docs = spark.createDataFrame([(i, f"see {r} there") for i, r in enumerate(runs)], "doc_id long, text string")
    limit, mean = secret_scan.discovery_cut(secret_scan.scan(docs), 0.01)
    found = [(joint_p(w), len(w)) for t in (f"see {r} there" for r in runs) for w in [t[4:-6]] if base(SECRETS, t) == ""]
    assert mean == pytest.approx(sum(n for _, n in found) / len(found))
    weighed = [min(p * mean / n, 1.0) for p, n in found]
    edges = [10 ** (-0.05 * b) for b in range(1201)]
    fits = [t for t in edges if t * len(found) <= 0.01 * sum(w <= t * (1 + 1e-9) for w in weighed)]
    # Edges of empty bins find nothing more: the cut is the edge of the last bin with runs, and the same runs are discoveries.
    at_most = lambda t: sum(w <= t * (1 + 1e-9) for w in weighed)
    assert limit in [pytest.approx(t) for t in fits] and at_most(limit) == at_most(max(fits)) > 0
