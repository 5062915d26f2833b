"""Secret scans: base patterns, and a randomness test battery with length-aware false-discovery control.

Base kinds (assign, access, hex) are patterns. The battery adds spans of kind ``random``: runs of 12 or more key
characters outside the base spans. The encoding is inferred from the characters (hex, base32, base36, base62, base64) and
gives the alphabet. Four tests compare a run with what ordinary text of its length would show:

* chi-squared uniformity over the alphabet: text's letters coincide far more often than a uniform draw's;
* runs: how often the character class (lower, upper, digit) changes, separators left out;
* serial correlation: whether vowels and other characters alternate as in words;
* word pairs: how likely a chain of letter pairs of English words, class changes, digits and separators makes the run,
  against a uniform draw. Under the chain the likelihood ratio's inverse is a p-value by Markov's inequality.

Digits alone, dates and runs of one repeated character are no keys. Fisher's rule joins their p-values; a weight in proportion to the run's length (mean 1 over all runs) makes a long
run count for more; Benjamini and Hochberg's step-up rule over all runs of all documents sets the cut. The rule
needs only the number of runs in each of a fixed number of p-value bins.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .spans import apart, bare, find, joined, let, masked, ranked

#: The base patterns. (?i) without (?u) folds ASCII letters only.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+"
KINDS = ["assign", "access", "hex"]

#: What ordinary text shows: chance that two of its characters are equal, class changes per step, and correlation of vowels.
#: Class changes are rarer where there is one case only than in names of mixed case.
COINCIDENCE, CLASS_CHANGE, MIXED_CHANGE, VOWEL_CORRELATION = 0.068, 0.12, 0.32, -0.30
BIN, BINS = 0.05, 1200
#: Fixed values: -2 ln of the chance of each letter (column) after each letter (row) in the words of Python's language reference, smoothed.
PAIRS = """
97688a9a6ca46498c45489ba8b
5a893aba64c4a969c7784bbb5c
4b7a4ab56c75a94ac7836bbbac
78962aba3cc7a96ac9585bbb8c
7a5577998cc764978445a8968c
5baa57ba3cb7a93ac5964bbb9c
6a9a3a865cc6958ac6674bbbbc
4baa1aba5cc9a95ac897abbbac
7868668a9ca77348c844a8baba
8b9a0aba9ccaa98ac9987bbbbc
7b9a1a9a5cc9a896c8587b8bbc
4b9737ba5cc5a95ac9665aab6c
47aa2aba6cca7954c9776bbbac
5a5459497cc8985ac95489bb9c
867675aa8ca76387c475697bbc
4ba83ab97cb5a956c4859bbb7c
9baa8aba9ccaa99ac9980bbbbc
4a873a7a4cb97659c6567bab7c
7b7a3ab74cb8a966b9436bbb8c
5b9a4ab34cc9a95ac6667bab7c
6778498a6cc56496c544abbbbc
2baa2aba4cca997ac998abbbbc
5baa5ab32cc8a75ac778ababbc
5b3a4ab95ccaa983c985abb9ac
9a8a7aba6cc99572c954aa6bbc
4baa18ba5ccaa98ac988abbb7c
""".split()
KEY_CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: The alphabets among which one is inferred: what choosing the best of them may gain.
ALPHABETS = 5


def _upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), by a logistic approximation that is within 0.0002 near the middle and falls slower far out."""
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(300.0))))


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("double")


def alphabet(s: Column) -> Column:
    """Size of the inferred encoding's alphabet."""
    return (
        F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0).when(s.rlike("^[A-Z2-7]+$"), 32.0).when(s.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36.0).when(s.rlike("^[0-9A-Za-z]+$"), 62.0).otherwise(64.0)
    )


def _kind(c: str) -> str:
    return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s"


#: Chance that a character's kind (lower, upper, digit, separator) follows another's, within ordinary text.
FOLLOWS = {"l": {"l": 0.88, "u": 0.03, "d": 0.03, "s": 0.06}, "u": {"l": 0.4, "u": 0.5, "d": 0.04, "s": 0.06}, "d": {"l": 0.05, "u": 0.05, "d": 0.8, "s": 0.1}, "s": {"l": 0.55, "u": 0.2, "d": 0.15, "s": 0.1}}
MEMBERS = {"l": 26, "u": 26, "d": 10, "s": 4}


def _step(a: str, b: str) -> float:
    """Log of the chance of b after a in ordinary text; a tenth goes to repeating a."""
    words = _kind(a) in "lu" and (_kind(a), _kind(b)) != ("l", "u") and _kind(b) in "lu"
    within = math.exp(-int(PAIRS[ord(a.lower()) - 97][ord(b.lower()) - 97], 36) / 2) if words else 1 / MEMBERS[_kind(b)]
    return math.log(0.9 * FOLLOWS[_kind(a)][_kind(b)] * within + 0.1 * (a == b))


STEPS = " ".join(f"{_step(a, b):.3f}" for a in KEY_CHARACTERS for b in KEY_CHARACTERS)


def pair_p_value(s: Column) -> Column:
    """At most the chance that ordinary text is as unlike words as s; s is of KEY_CHARACTERS."""
    table = F.split(F.lit(STEPS), " ").cast("array<double>")
    at = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(KEY_CHARACTERS), c) - 1)
    pairs = let(at, lambda a: F.zip_with(F.slice(a, F.lit(1), F.length(s) - 1), F.slice(a, F.lit(2), F.length(s) - 1), lambda x, y: F.get(table, x * len(KEY_CHARACTERS) + y)))
    ratio = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) + (F.length(s) - 1) * F.log(alphabet(s)) + math.log(ALPHABETS)
    return F.exp(F.least(F.greatest(ratio, F.lit(-300.0)), F.lit(0.0)))


def p_value(s: Column) -> Column:
    """Fisher's joint p-value that ordinary text looks as random as s; 1 for one repeated character, and for digits alone or with the T and Z of dates and times."""
    n = F.length(s).cast("double")
    a = alphabet(s)
    squares = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
    chi = a / n * squares - n
    expected = a * (1 + (n - 1) * COINCIDENCE) - n
    spread = F.sqrt(2 * (a - 1) + 4 * n * F.greatest(a * COINCIDENCE - 1, F.lit(0.05)))
    p1 = _upper_tail((expected - chi) / spread)
    core = F.regexp_replace(s, "[-_/+]", "")
    steps, changes = F.greatest(F.length(core) - 1.0, F.lit(1.0)), _count(core, "[a-z]+|[A-Z]+|[0-9]+") - 1
    rate = F.when(s.rlike("[a-z]") & s.rlike("[A-Z]"), MIXED_CHANGE).otherwise(CLASS_CHANGE)
    p2 = _upper_tail((changes - 0.5 - steps * rate) / F.sqrt(steps * rate * (1 - rate)))
    vowels = n - F.length(F.regexp_replace(s, "[aeiouyAEIOUY]", ""))
    share = F.greatest(F.lit(0.02), F.least(F.lit(0.98), vowels / n))
    turns = _count(s, "[aeiouyAEIOUY]+|[^aeiouyAEIOUY]+") - 1
    r = 1 - turns / ((n - 1) * 2 * share * (1 - share))
    p3 = _upper_tail((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)) - VOWEL_CORRELATION) * F.sqrt(n))
    p2 = F.when(changes < 1, 1.0).otherwise(p2)
    half = -(F.log(p1) + F.log(p2) + F.log(p3) + F.log(pair_p_value(s)))
    joint = let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6))
    one = F.replace(s, F.substring(s, 1, 1), F.lit("")) == ""
    return F.when(one | s.rlike("^[-0-9+/_TZ]+$"), 1.0).otherwise(F.least(joint, F.lit(1.0)))


def scan(docs: DataFrame) -> DataFrame:
    """row (docs' columns in one struct, so that none can clash), assign, access, hex (start, end) and runs (start, end, p); null texts count as empty."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(own.alias("row"), text_or_empty().alias("text"))
    assign = F.filter(find(F.col("text"), ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    df = df.select("row", "text", bare(assign).alias("assign"), bare(find(F.col("text"), ACCESS, F.col("text").contains("AKIA"))).alias("access"), bare(find(F.col("text"), HEX)).alias("hex"))
    runs = apart(find(F.col("text"), RUN), F.col("text"), F.concat(*KINDS))
    judged = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), p_value(x["hit"]).alias("p")))
    return df.select("row", *KINDS, judged.alias("runs"))


def discovery_cut(scanned: DataFrame, level: float = 0.01) -> tuple[float, float]:
    """(cut, mean length): a run is a discovery if p * mean length / its length is at most cut.

    The step-up rule on bins of -log10: the largest bin edge t with m * t <= level * (runs at or below t).
    """
    runs = scanned.where(F.size("runs") > 0).select(F.explode("runs").alias("x")).select(F.col("x.p").alias("p"), (F.col("x.end") - F.col("x.start")).alias("n"))
    m, mean = runs.agg(F.count("*"), F.avg("n")).first()
    if not m:
        return 0.0, 1.0
    weighed = F.least(F.col("p") * mean / F.col("n"), F.lit(1.0))
    bins = runs.groupBy(F.least(F.floor(-F.log10(F.greatest(weighed, F.lit(1e-100))) / BIN), F.lit(BINS)).alias("b")).count().collect()
    seen, best = 0, 0.0
    for b, n in sorted(((r["b"], r["count"]) for r in bins), reverse=True):
        seen += n
        edge = 10 ** (-BIN * b)
        if edge * m <= level * seen:
            best = edge
    return best, float(mean)


def scan_secrets(docs: DataFrame, level: float = 0.01, columns: list[str] | None = None) -> DataFrame:
    """row (docs' columns, or those named), assign, access, hex, random (start, end); null and empty texts have no spans.

    Reads the texts once; the scanned table is written to the shared folder before the false-discovery cut is set
    over all its runs.
    """
    scanned = scan(docs)
    if columns is not None:
        scanned = scanned.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in columns]))
    scanned = cut(scanned, "secrets")
    limit, mean = discovery_cut(scanned, level)
    return scanned.select("row", *KINDS, bare(F.filter("runs", lambda x: x["p"] * mean / (x["end"] - x["start"]) <= limit)).alias("random"))


def find_secrets(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans; one row for each row of docs."""
    found = scan_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), level, ["doc_id"])
    kinds = [(k, F.col(k)) for k in [*KINDS, "random"]]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k, _ in kinds]
    return found.select("row.doc_id", *counts, F.sha2(joined(ranked(kinds[: len(KINDS)])), 256).alias("base_sha256"), joined(ranked(kinds)).alias("spans"))


def redact_secrets(docs: DataFrame, level: float = 0.01, mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with every span of text replaced by mask (overlapping spans by one), and n_chars (where there is one) to match.

    A null text stays null. Columns may have any names.
    """
    found = scan_secrets(docs, level)
    every = F.array_sort(F.concat(*[*KINDS, "random"]))
    text = F.when(F.col("row.text").isNotNull(), masked(F.col("row.text"), F.col("every"), lambda _: F.lit(mask)))
    done = found.select("row", every.alias("every")).select("row", (F.size("every") > 0).alias("some"), text.alias("text"))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("some"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
