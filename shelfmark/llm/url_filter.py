"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams of both.

Host and path are read from the url's text; the longest fitting rule decides, and where none fits the model does. Digits are
masked before n-grams are cut, so a number says that it is one and no more. Features and scores are DataFrame expressions throughout. The model is fitted on the driver from the buckets of a
small labelled table of urls (a bounded sample), and comes back as one constant array of weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SIZES = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Words of the built-in labelled table. Unwanted ones stand in the host (of paths that say nothing) or in the path (of hosts that say nothing), wanted ones likewise.
UNWANTED = ("casino", "poker", "slots", "bets", "betting", "jackpot", "pills", "pharma", "viagra", "cheap-meds", "adult", "porn", "xxx", "escort", "spam", "linkfarm", "ads", "adserver", "track", "tracker", "clickbait", "loans", "payday", "warez", "torrent", "free-win", "cheap-pills", "free-bets")
WANTED = ("news", "library", "school", "museum", "weather", "recipes", "garden", "science", "history", "forum", "travel", "health", "sports", "music", "books", "city", "council", "university", "research", "journal", "photo", "maps", "transit", "archive", "theatre", "cinema", "village", "market", "river", "mountain")
#: Made-up names, every pair of these syllables and as many threes, on either side: unknown letters are no sign of an unwanted host or path.
SYLLABLES = ("ba", "ko", "mi", "ren", "tor", "lin", "sa", "vel", "dan", "pu", "gra", "est", "ing", "the", "on", "wh", "er", "sch")
ENDS = ("example.com", "example.org", "example.net", "test")
#: Paths that say nothing, and how a word stands in a path.
PATHS = ("/", "/en/1024", "/article/77.html", "/index")
#: What may stand around a word in a host, which says nothing; each url has one, by hash.
AROUND = (("", ""), ("", "-online"), ("best", ""), ("my-", "-guide"))
IN_PATH = ("/{}", "/{}.html", "/en/{}/12", "/a/{}-online/index.html")


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest fitting rule's text and action, null if none fits."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, action = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.action)).otherwise(action)
    return text, action


def buckets(host: Column, path: Column) -> Column:
    """Bucket numbers (from 1) of the n-grams of host and path, each with marks at its ends."""
    masked = lambda x: F.translate(x, "123456789", "000000000")
    parts = [_grams(mark, F.concat(F.lit("^"), masked(value), F.lit("$")), n) for mark, value in (("h", host), ("p", path)) for n in SIZES]
    return F.when((host != "") | (path != ""), F.concat(*parts)).otherwise(F.array().cast("array<int>"))


def _grams(mark: str, value: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(value) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: (F.pmod(F.xxhash64(F.concat(F.lit(mark), F.substring(value, i, F.lit(n)))), F.lit(BUCKETS)) + 1).cast("int"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label (1: unwanted).

    A word is put into a host in front of each end and path, and into each form of path behind hosts that say nothing: plain
    ones, wanted ones and made-up ones, the same for either label. The label is the word's, wherever it stands.
    """
    n = len(SYLLABLES)
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
    made = tuple(SYLLABLES[i] + SYLLABLES[j] for i, j in pairs) + tuple(SYLLABLES[i] + SYLLABLES[j] + SYLLABLES[(5 * i + 7 * j) % n] for i, j in pairs)

    def words(values: tuple[str, ...], label: int) -> Column:
        return F.transform(F.split(F.lit(",".join(values)), ","), lambda w: F.struct(w.alias("w"), F.lit(label).alias("label")))

    rows = spark.range(1).select(F.explode(F.concat(words(UNWANTED, 1), words(WANTED, 0), words(made, 2))).alias("x")).select("x.w", "x.label")
    hosts = F.explode(F.array(*[F.struct(F.lit(sub).alias("sub"), F.lit(end).alias("end"), F.lit(path).alias("path")) for sub in ("", "www.", "m.") for end in ENDS for path in PATHS]))
    # The made-up names are many: a sixth of the forms, by hash, will do for each.
    some = (F.col("label") < 2) | (F.pmod(F.xxhash64("url"), F.lit(6)) == 0)
    around = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND]), (F.pmod(F.xxhash64("w", "h"), F.lit(len(AROUND))) + 1).cast("int"))
    by_host = rows.select("w", "label", hosts.alias("h")).withColumn("x", around).select(F.concat(F.lit("https://"), "h.sub", "x.a", "w", "x.b", F.lit("."), "h.end", "h.path").alias("url"), "label").where(some)
    # The neutral hosts of a word: some of the others, picked by hash, so that no host goes with a label.
    neutral = F.split(F.lit(",".join((*WANTED, *made, *("www", "m", "a", "shop", "my")))), ",")
    pick = lambda k: F.element_at(neutral, (F.pmod(F.xxhash64("w", F.lit(k)), F.lit(len(WANTED) + len(made) + 5)) + 1).cast("int"))
    paths = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(form.split("{}")[0]).alias("a"), F.lit(form.split("{}")[1]).alias("b"), pick(k).alias("host"), F.lit(ENDS[k % len(ENDS)]).alias("end")) for k, form in enumerate(IN_PATH * 3)]))
    by_path = rows.select("w", "label", paths.alias("p")).select(F.concat(F.lit("https://"), "p.host", F.lit("."), "p.end", "p.a", "w", "p.b").alias("url"), "label").where(some)
    return by_host.union(by_path).select("url", (F.col("label") % 2).alias("label"))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    empty: float = -5.0  # log-odds without a host and a path: the prior's

    def log_odds(self, grams: Column) -> Column:
        table = F.split(F.lit(",".join(repr(float(x)) for x in self.weights)), ",").cast("array<double>")
        total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.element_at(table, b)) / F.sqrt(F.size(grams).cast("double")) + F.lit(self.bias)
        return F.when(F.size(grams) > 0, total).otherwise(self.empty)


def fit_urls(labelled: DataFrame, max_labelled: int = 20_000, rounds: int = 80, l2: float = 6e-5, max_wrong: float = 0.01, prior: float = 0.15) -> UrlModel:
    """Logistic regression from labelled (url, label 0/1); the max_labelled rows with the least hashes are used.

    Labels are weighed as if a share prior of all urls were unwanted. A trial fit without a third of the hosts sets the margin:
    at most max_wrong of their wanted urls may be blocked.
    Without rows, or with one label only, every url is allowed.
    """
    chosen = labelled.where("label is not null").select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled)
    host, path = url_parts(F.col("url"))
    rows = chosen.select("url", "label", host.alias("host"), path.alias("path"))
    rows = rows.select("url", "label", (F.pmod(F.xxhash64("host"), F.lit(3)) == 0).alias("aside"), buckets(F.col("host"), F.col("path")).alias("b")).orderBy("url", "label").collect()
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(BUCKETS), -5.0)
    size = np.array([len(r["b"]) for r in rows])
    col = np.concatenate([np.array(r["b"]) - 1 for r in rows])
    row = np.repeat(np.arange(len(y)), size)
    value = 1 / np.sqrt(size)[row]
    aside = np.array([r["aside"] for r in rows])
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum())
    # The bias is the prior's, so that n-grams which no labelled url has say nothing either way.
    bias = float(np.log(prior / (1 - prior)))
    w = _descend(y, row, col, value, np.where(aside, 0.0, weight), bias, rounds, l2)
    new = np.sort((np.bincount(row, value * w[col], minlength=len(y)) + bias)[aside & (y == 0)])
    margin = max(0.0, float(new[int((1 - max_wrong) * (len(new) - 1))])) if len(new) else 0.0
    w = _descend(y, row, col, value, weight, bias, rounds, l2)
    return UrlModel(np.round(w, 6), round(bias - margin, 6), bias)


_fitted: list[UrlModel] = []


def builtin_model(spark: SparkSession) -> UrlModel:
    """The model of the built-in labelled table, fitted once a process: the table and so the model are always the same."""
    if not _fitted:
        _fitted.append(fit_urls(labelled_urls(spark)))
    return _fitted[0]


def _descend(y: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, weight: np.ndarray, bias: float, rounds: int, l2: float) -> np.ndarray:
    w, m, v = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    weight = weight / weight.sum()
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[col], minlength=len(y)) + bias, -30, 30)))
        g = np.bincount(col, value * ((p - y) * weight)[row], minlength=BUCKETS) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def judge_urls(pages: DataFrame, model: UrlModel, rules: tuple[Rule, ...] = RULES, cutoff: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds; one row for each row of pages, no shuffle.

    Null urls and urls without :// have an empty host and path, fit no rule and are judged by the model's
    prior alone. Only url and page_id are read.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"), model.log_odds(buckets(F.col("host"), F.col("path"))).alias("log_odds"))
    verdict = F.coalesce("action", F.when(F.col("log_odds") > cutoff, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "log_odds")
