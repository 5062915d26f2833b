"""Full-text search: an index of tokens, and queries with AND, OR, NOT, phrases, prefixes, columns, NEAR and first-token.

A query is parsed to a small tree on the driver and becomes one boolean expression over a document's folded texts, so a
search is a scan with a filter and no shuffle. Tokens are the maximal runs of letters and digits, so words, phrases,
prefixes and first tokens are patterns with the runs' edges; only NEAR makes token arrays. For many searches over a
large corpus, write_index keeps the tokens as rows (id, field, pos, token) in folders by token, and search_index answers the same
queries from the few postings that a query names. refresh_index replaces the postings of changed documents.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import col, let, search_tokens, without_accents


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    first: bool = False


@dataclass(frozen=True)
class Both:
    kind: str  # and, or, not
    left: object
    right: object


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


_LEX = re.compile(r'\s*(?:(?P<str>"(?:[^"]|"")*")|(?P<word>[\w]+)|(?P<sym>[()*^:,+]))')


def parse(query: str):
    """The tree of a query; QuerySyntaxError where the grammar has no reading (a-b, what?, '' among them)."""
    items, at, text = [], 0, query.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QuerySyntaxError(query)
        items.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    if not items:
        raise QuerySyntaxError(query)
    pos = 0

    def peek(k: int = 0):
        return items[pos + k] if pos + k < len(items) else (None, None)

    def take(value: str | None = None):
        nonlocal pos
        got = peek()
        if got[0] is None or (value is not None and got[1] != value):
            raise QuerySyntaxError(query)
        pos += 1
        return got

    def plain(item) -> tuple[str, ...]:
        raw = item[1][1:-1].replace('""', '"') if item[0] == "str" else item[1]
        return tuple(t for t in re.split(r"[\W_]+", raw.lower()) if t)

    def phrase(column: str | None, first: bool) -> Phrase:
        got = take()
        if got[0] not in ("str", "word") or got in (("word", "AND"), ("word", "OR"), ("word", "NOT")):
            raise QuerySyntaxError(query)
        words = plain(got)
        while peek()[1] == "+":
            take()
            words += plain(take())
        prefix = peek()[1] == "*"
        if prefix:
            take()
        return Phrase(words, prefix, column, first)

    def primary():
        if peek()[1] == "(":
            take()
            inner = either()
            take(")")
            return inner
        if peek() == ("word", "NEAR") and peek(1)[1] == "(":
            take()
            take("(")
            found, distance = [], 10
            while peek()[1] not in (")", ",", None):
                found.append(phrase(None, False))
            if peek()[1] == ",":
                take()
                distance = int(take()[1])
            take(")")
            return Near(tuple(found), distance)
        column = None
        if peek()[0] == "word" and peek(1)[1] == ":":
            column = take()[1]
            take(":")
        first = peek()[1] == "^"
        if first:
            take()
        return phrase(column, first)

    def run():
        left = primary()
        while peek()[0] is not None and peek()[1] not in (")", "AND", "OR", "NOT"):
            left = Both("and", left, primary())
        return left

    def negation():
        left = run()
        while peek() == ("word", "NOT"):
            take()
            left = Both("not", left, run())
        return left

    def both():
        left = negation()
        while peek() == ("word", "AND"):
            take()
            left = Both("and", left, negation())
        return left

    def either():
        left = both()
        while peek() == ("word", "OR"):
            take()
            left = Both("or", left, both())
        return left

    out = either()
    if peek()[0] is not None:
        raise QuerySyntaxError(query)
    return out


def _starts(tokens: Column, p: Phrase) -> Column:
    """Positions (from 0) where the phrase begins in tokens."""
    last = len(p.words) - 1

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, word in enumerate(p.words):
            token = F.get(tokens, (i + k).cast("int"))
            ok = ok & F.coalesce(token.startswith(_plain(word)) if p.prefix and k == last else token == _plain(word), F.lit(False))
        return ok

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), here)


EDGE = r"[\p{L}\p{N}]"
GAP = r"[^\p{L}\p{N}]+"


def folded(c: Column | str) -> Column:
    """The text that search patterns run on: lower case, no accents."""
    return without_accents(F.lower(F.coalesce(col(c), F.lit(""))))


def _plain(word: str) -> str:
    """A query word as folded text has it."""
    return "".join(x for x in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(x)) if _latin(word) else word.lower()


def _latin(word: str) -> bool:
    return all(ord(x) < 0x1F00 for x in word)


def _in(text: Column, p: Phrase) -> Column:
    if not p.words:
        return F.lit(False)
    words = GAP.join(_plain(w) for w in p.words)
    before = f"^(?:{GAP})?" if p.first else f"(?<!{EDGE})"
    return text.rlike(before + words + ("" if p.prefix else f"(?!{EDGE})"))


def _near(text: Column, n: Near) -> Column:
    """Whether an occurrence of the first phrase has one of each other phrase within distance tokens, on either side."""

    def body(s: Column) -> Column:
        def around(i: Column) -> Column:
            fits = F.lit(True)
            for k, p in enumerate(n.phrases[1:], 1):
                fits = fits & _within(i, s[f"h{k}"], len(n.phrases[0].words), len(p.words), n.distance)
            return fits

        return F.exists(s["h0"], around)

    tokens = F.filter(F.split(text, GAP), lambda t: t != "")
    return let(tokens, lambda t: let(F.struct(*[_starts(t, p).alias(f"h{k}") for k, p in enumerate(n.phrases)]), body))


def _within(i: Column, heads: Column, size_i: int, size_j: int, distance: int) -> Column:
    return F.exists(heads, lambda j: F.when(j >= i, j - (i + size_i)).otherwise(i - (j + size_j)) <= distance)


def matches(query: str, fields: dict[str, Column]) -> Column:
    """Whether a document, given by its fields' folded texts, matches the query."""
    tree, names = parse(query), list(fields)

    def build(node, s: Column) -> Column:
        if isinstance(node, Phrase) and node.column is not None and node.column not in fields:
            raise QuerySyntaxError(f"no such column: {node.column}")
        if isinstance(node, Phrase | Near):
            own = [node.column] if isinstance(node, Phrase) and node.column else names
            out = F.lit(False)
            for f in own:
                out = out | (_in(s[f], node) if isinstance(node, Phrase) else _near(s[f], node))
            return out
        left, right = build(node.left, s), build(node.right, s)
        return {"and": left & right, "or": left | right, "not": left & ~right}[node.kind]

    return let(F.struct(*[c.alias(f) for f, c in fields.items()]), lambda s: build(tree, s))


def search(df: DataFrame, query: str, fields: list[str], key: str, newest: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that match, by ascending key; an empty query gives the newest rows instead."""
    if not query.strip():
        out = df.orderBy(F.col(newest).desc_nulls_last(), key) if newest else df.orderBy(key)
    else:
        out = df.where(matches(query, {f: folded(f) for f in fields})).orderBy(key)
    return out if limit is None else out.limit(limit)


def search_any(df: DataFrame, terms: list[str], fields: list[str], key: str, limit: int) -> DataFrame:
    """Rows with any of the terms; nothing if there are none or they aren't words."""
    try:
        return search(df, " OR ".join(terms), fields, key, limit=limit) if terms else df.limit(0)
    except QuerySyntaxError:
        return df.limit(0)


def token_table(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """key, field, pos, token: the inverted index as rows."""
    out = None
    for f in fields:
        part = df.select(key, F.lit(f).alias("field"), F.posexplode(search_tokens(f)).alias("pos", "token"))
        out = part if out is None else out.union(part)
    return out


def token_counts(df: DataFrame, field: str) -> DataFrame:
    """token, docs, n: in how many rows and how often each token of a field stands. Counted before the shuffle, whatever the number of rows."""
    marked = let(F.array_sort(search_tokens(field)), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("token"), F.when(x == F.get(t, i - 1), 0).otherwise(1).alias("first"))))
    return df.select(F.explode(marked).alias("x")).groupBy("x.token").agg(F.sum("x.first").cast("long").alias("docs"), F.count("*").alias("n"))


def refresh_index(index: DataFrame, changed: DataFrame, key: str, *fields: str) -> DataFrame:
    """index with the postings of changed documents replaced; a document whose fields are all empty only loses its own."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(token_table(changed, key, *fields))


BUCKETS = 256


def _bucket(token: Column) -> Column:
    """The folder of a token: by its first letters, so that a prefix of two letters or more reads one folder, too."""
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(BUCKETS)).cast("int")


def write_index(index: DataFrame, path: str) -> None:
    """Write postings into folders by token, sorted inside, so that a search reads the folders and row groups of its own words."""
    out = index.withColumn("bucket", _bucket(F.col("token")))
    out.repartition("bucket", F.pmod(F.xxhash64("token"), F.lit(16))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").mode("overwrite").parquet(path)


def _postings(index: DataFrame, key: str, p: Phrase) -> DataFrame:
    """key, field, pos of each occurrence of a phrase."""
    if not p.words:
        return index.select(key, "field", "pos").limit(0)
    out = None
    for k, word in enumerate(p.words):
        w = _plain(word)
        is_prefix = p.prefix and k == len(p.words) - 1
        rows = index.where(F.col("token").startswith(w) if is_prefix else F.col("token") == w)
        if "bucket" in index.columns and (not is_prefix or len(w) >= 2):
            rows = rows.where(F.col("bucket") == _bucket(F.lit(w)))
        rows = rows.select(key, "field", (F.col("pos") - k).alias("pos"))
        out = rows if out is None else out.join(rows, [key, "field", "pos"], "left_semi")
    if p.column is not None:
        out = out.where(F.col("field") == p.column)
    return out.where("pos = 0") if p.first else out


def search_index(index: DataFrame, query: str, key: str, fields: list[str]) -> DataFrame:
    """key of the documents that match a query, from the postings of its words alone; the same answers as search()."""
    tree = parse(query)

    def near(n: Near) -> DataFrame:
        first = _postings(index, key, n.phrases[0]).withColumnRenamed("pos", "i").distinct()
        size_i = len(n.phrases[0].words)
        for p in n.phrases[1:]:
            other = _postings(index, key, p).withColumnRenamed("pos", "j")
            gap = F.when(F.col("j") >= F.col("i"), F.col("j") - (F.col("i") + size_i)).otherwise(F.col("i") - (F.col("j") + len(p.words)))
            first = first.join(other, [key, "field"]).where(gap <= n.distance).select(key, "field", "i").distinct()
        return first.select(key).distinct()

    def keys(node) -> DataFrame:
        if isinstance(node, Phrase):
            if node.column is not None and node.column not in fields:
                raise QuerySyntaxError(f"no such column: {node.column}")
            return _postings(index, key, node).select(key).distinct()
        if isinstance(node, Near):
            return near(node)
        left, right = keys(node.left), keys(node.right)
        if node.kind == "or":
            return left.union(right).distinct()
        return left.join(right, key, "left_semi" if node.kind == "and" else "left_anti")

    return keys(tree)


def and_ids(index: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """Keys whose rows in the index have all tokens."""
    want = sorted(set(tokens))
    return index.where(F.col("token").isin(*want)).groupBy(key).agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(want)).select(key)
