"""PII: base patterns, and weak supervision for what they miss.

Base kinds (email, ip, card, phone) are patterns with checks. Further candidates (spelled-out mail addresses, bare phone
and identity numbers, account numbers, names after a form of address) are judged by weak supervision: a regex, a
gazetteer and a context labeler each vote yes, no or nothing on every candidate of every text. Votes are counted
by pattern; expectation-maximisation on the counts estimates how reliable each labeler is and, for each
vote pattern, how likely it means personal data. These probabilities train the final span classifier, a logistic
regression on the candidate's own features, which decides. What goes to the driver is a table of counts whose size
is fixed by the numbers of kinds, votes and feature values.

Everything on the documents is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .spans import apart, bare, chunks, find, joined, let, part, ranked

#: The base patterns, possessive and anchored at the start of a run: the same matches, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Only runs of 14 to 19 digits match, and those whole; a run of another length matches nowhere inside.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A character without which a kind has no match.
MARKS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_OK = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

#: Candidates of weak supervision, most specific first.
CANDIDATES = {
    "mail_words": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "number": r"(?<![A-Za-z0-9.+-])\(?[0-9]{2,4}\)?[\x20-][0-9]{2,4}[\x20-][0-9]{3,5}(?![A-Za-z0-9.-])",
    "name": r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra|Señor|Señora)\.?\x20[A-Z][a-z]{1,30}+(?:\x20[A-Z][a-z]{1,30}+)?+",
}
#: Gazetteers and context cues.
FIRST_NAMES = "anna ben carl carla carlos clara david elena emma eva felix frank george hans helen ines jack james jan jean john jose juan julia karl klaus laura lena leon lucas lucia luis maria marie mark martin mary max michael miguel nina olga oscar paul pedro peter pierre robert rosa sara simon sofia sophie susan thomas tom victor walter".split()
COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
DOMAIN_ENDS = "com org net edu de fr es uk it".split()
AREA_CODES = "555 800 888 877 212 030 040 089 069".split()
CUES = r"(?i)(?:phone|mobile|cell|call|tel|fax|contact|reach|e-?mail|write\x20to|ssn|social|iban|account|konto|cuenta|compte|name|nombre|nom|signed|dear|telefon|handy|t[eé]l[eé]fono?|t[eé]l[eé]phone)[^A-Za-z]{0,4}$"
COUNTER_CUES = r"(?i)(?:isbn|version|page|pages|figure|table|chapter|vol|no|nr|year|price|total|room|\$|€|£|%)[^A-Za-z]{0,4}$"
BEFORE = 28
LABELERS = ("regex", "gazetteer", "context")
FEATURES = ("mail_words", "account", "number", "name", "strict", "listed", "cue", "counter_cue", "digits", "parts")
MAX_VALUE = 4  # features are small integers, so that patterns of them can be counted


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    turned = F.reverse(digits)
    value = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: _doubled(F.substring(turned, i, F.lit(1)).cast("int"), i % 2 == 0))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans by kind; matches that fail their check are dropped."""
    found = {k: find(text, p, text.contains(MARKS[k]) if k in MARKS else None) for k, p in BASE.items()}
    found["ip"] = F.filter(found["ip"], lambda x: x["hit"].rlike(IP_OK))
    found["card"] = F.filter(found["card"], lambda x: luhn(_digits(x["hit"])))
    found["phone"] = F.filter(found["phone"], lambda x: F.length(_digits(x["hit"])).between(10, 15))
    return found


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _among(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


def judged(kind: str, x: Column, pieces: Column) -> Column:
    """start, end, kind, the three votes (0 no, 1 nothing, 2 yes) and the features of a candidate; pieces: its text's chunks."""
    hit = x["hit"]
    digits, before = _digits(hit), part(pieces, F.greatest(x["start"] - BEFORE, F.lit(0)), x["start"])
    if kind == "mail_words":
        strict, loose = hit.rlike(r"^[A-Za-z]"), hit.rlike(r"^[0-9]+\x20?[\[(]")
        listed, unlisted = _among(F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1)), DOMAIN_ENDS), F.lit(False)
    elif kind == "account":
        size = F.length(F.regexp_replace(hit, " ", ""))
        strict, loose = size.between(15, 34), ~size.between(15, 34)
        listed = _among(F.substring(hit, 1, 2), COUNTRIES)
        unlisted = ~listed
    elif kind == "number":
        strict, loose = hit.rlike(r"^(?:\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"), F.length(digits) < 8
        listed, unlisted = _among(F.substring(digits, 1, 3), AREA_CODES) | hit.contains("555"), hit.rlike(r"^(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-")
    else:
        strict, loose = hit.rlike(r"\x20[A-Z][a-z]+\x20[A-Z][a-z]+$"), hit.rlike(r"\x20[A-Z][a-z]$")
        word = F.lower(F.regexp_extract(hit, r"^[^\x20]+\x20([A-Za-z]+)", 1))
        listed, unlisted = _among(word, FIRST_NAMES), F.length(word) > 14
    cue, counter = before.rlike(CUES), before.rlike(COUNTER_CUES)
    numbers = [F.lit(int(k == kind)) for k in CANDIDATES]
    numbers += [strict.cast("int"), listed.cast("int"), cue.cast("int"), counter.cast("int"), F.least(F.floor(F.length(digits) / 4), F.lit(MAX_VALUE)).cast("int"), F.least(F.size(F.split(hit, "[ -]")), F.lit(MAX_VALUE)).cast("int")]
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"),
        F.array(_vote(strict, loose), _vote(listed, unlisted), _vote(cue, counter)).alias("votes"), F.array(*numbers).alias("x"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans (start, end) by kind, and found: the judged candidates outside base spans and more specific candidates."""
    text = F.col("text")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    df = df.select("doc_id", "text", *[bare(c).alias(k) for k, c in base_spans(text).items()])
    taken = list(BASE)
    for kind, pattern in CANDIDATES.items():
        df = df.withColumn(f"c_{kind}", find(text, pattern))
        df = df.withColumn(f"c_{kind}", apart(F.col(f"c_{kind}"), text, F.concat(*[F.col(k) if k in BASE else bare(F.col(k)) for k in taken])))
        taken.append(f"c_{kind}")
    some = F.greatest(*[F.size(f"c_{kind}") for kind in CANDIDATES]) > 0
    found = let(chunks(text), lambda pieces: F.concat(*[F.transform(f"c_{kind}", _judge(kind, pieces)) for kind in CANDIDATES]))
    return df.select("doc_id", *BASE, F.when(some, found).alias("found"))


def _judge(kind: str, pieces: Column):
    return lambda x: judged(kind, x, pieces)


@dataclass
class SpanModel:
    weights: np.ndarray
    bias: float
    reliability: np.ndarray  # labelers x classes x votes

    def accepts(self, x: Column) -> Column:
        total = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            total = total + F.lit(float(w)) * F.element_at(x, i + 1)
        return total > 0


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(probability of class 1 for each vote pattern, reliabilities) from patterns (n x labelers, 0 no, 1 nothing, 2 yes) and their counts.

    Priors, worth four votes a cell at the likeliest, keep every labeler on the right side of chance.
    """
    prior = np.array([[3.0, 2.0, 0.5], [0.5, 2.0, 3.0]])
    p = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.05, 0.95)
    rel = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        for k in range(votes.shape[1]):
            for c, w in ((0, counts * (1 - p)), (1, counts * p)):
                cell = np.bincount(votes[:, k], w, minlength=3) + prior[c]
                rel[k, c] = cell / cell.sum()
        share = (counts @ p + 1) / (counts.sum() + 2)
        odds = np.log(share / (1 - share)) + sum(np.log(rel[k, 1, votes[:, k]] / rel[k, 0, votes[:, k]]) for k in range(votes.shape[1]))
        p = 1 / (1 + np.exp(-odds))
    return p, rel


def fit_spans(scanned: DataFrame) -> SpanModel:
    """The span classifier, from the counts of all candidates' vote and feature patterns."""
    rows = scanned.where(F.size("found") > 0).select(F.explode("found").alias("c")).groupBy(F.col("c.votes").alias("votes"), F.col("c.x").alias("x")).count().collect()
    rows = sorted(rows, key=lambda r: (list(r["votes"]), list(r["x"])))
    if not rows:
        return SpanModel(np.zeros(len(FEATURES)), -1.0, np.zeros((len(LABELERS), 2, 3)))
    votes, x, n = np.array([r["votes"] for r in rows]), np.array([r["x"] for r in rows], float), np.array([r["count"] for r in rows], float)
    p, rel = expectation_maximisation(votes, n)
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), 1e-2 * np.eye(a.shape[1])
    scale = n / n.sum() * min(n.sum(), 1e4)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (scale * np.maximum(q * (1 - q), 1e-4))[:, None]) + ridge
        w += np.clip(np.linalg.solve(h, a.T @ (scale * (p - q)) - ridge @ w), -3, 3)
    return SpanModel(np.round(w[:-1], 9), round(float(w[-1]), 9), rel)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans; one row for each row of docs.

    Null and empty texts have no spans. The scan is written to the shared folder, so the texts are read once; the
    classifier is fitted on the counts of all texts' candidates.
    """
    scanned = cut(scan(docs), "personal")
    model = fit_spans(scanned)
    more = F.filter(F.coalesce("found", F.array().cast(scanned.schema["found"].dataType)), lambda c: model.accepts(c["x"]))
    df = scanned.select("doc_id", *BASE, more.alias("more"))
    base = [(k, F.col(k)) for k in BASE]
    every = base + [(k, F.filter("more", _of(k))) for k in CANDIDATES]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.size("more").cast("long").alias("n_more"), F.sha2(joined(ranked(base)), 256).alias("base_sha256"), joined(ranked(every)).alias("spans"))


def _of(kind: str):
    return lambda c: c["kind"] == kind
