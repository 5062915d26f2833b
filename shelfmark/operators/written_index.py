"""A search index kept in a folder: written once, refreshed by document, and searched by reading only the folders of a query's words.

    postings/version=V/bucket=B/   id, field, token, pos (all positions of the token there, an array), sorted by token
    replaced/version=V/            id of the documents that version V brings anew (0: the first write, no rows)

A bucket is a token's first two letters, hashed, so that a word or a prefix of two letters and more is in one. A posting holds if its
version is the last that its document was written in; so a refresh only adds: the tokens of the changed documents go into a
new version's folders, in the buckets that they have tokens of, and nothing else is read or written. The list of ids, written last in
one step, is what makes a version count; a refresh that fails before it changes no answer. ``compacted`` writes what holds to a new place.

A search is one read and one shuffle by document, of the postings of its words only. Phrases, NEAR and first tokens are worked out from
a document's position arrays. A frequent token's postings are dealt over all files of its bucket by document, so no task has all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from shelfmark.functions.text import let, search_tokens
from shelfmark.operators.search import BUCKETS, Both, Near, Phrase, QuerySyntaxError, _bucket, _plain, _within, parse
from shelfmark.operators.versions import claim, numbers, present

#: Files that a bucket's postings are dealt over.
SLOTS = 16


@dataclass(frozen=True)
class WrittenIndex:
    spark: SparkSession
    path: str
    fields: tuple[str, ...]


def postings(df: DataFrame, key: str, fields: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """id, field, token, pos, bucket: a row for each token of each field, dealt by bucket and slot; the only shuffle."""
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields]))
    rows = df.select(F.col(f"`{key}`").alias("id"), texts.alias("x")).select("id", "x.field", F.posexplode(search_tokens("x.text")).alias("at", "token"))
    rows = rows.withColumns({"bucket": _bucket(F.col("token")), "slot": F.pmod(F.xxhash64("id", "token"), F.lit(slots))})
    rows = rows.repartition("bucket", "slot").groupBy("bucket", "slot", "id", "field", "token").agg(F.sort_array(F.collect_list("at")).alias("pos"))
    return rows.select("id", "field", "token", "pos", "bucket")


def _write(rows: DataFrame, path: str, version: int) -> None:
    rows.sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings/version={version}")


def create_index(df: DataFrame, path: str, key: str, *fields: str) -> WrittenIndex:
    """Write the index of df (key unique) at path."""
    _write(postings(df, key, fields), path, 0)
    df.select(F.col(f"`{key}`").alias("id")).limit(0).write.mode("overwrite").parquet(f"{path}/replaced/version=0")
    return WrittenIndex(df.sparkSession, path, fields)


def refresh(index: WrittenIndex, changed: DataFrame, key: str) -> int:
    """Bring in the documents of changed (key unique) as they are now; those without any text lose their postings. Returns the version.

    Each refresh has a number of its own, also beside others that run; of two that bring the same document the larger number counts.
    """
    version = claim(index.spark, f"{index.path}/claims")
    _write(postings(changed, key, index.fields), index.path, version)
    changed.select(F.col(f"`{key}`").alias("id")).write.mode("overwrite").parquet(f"{index.path}/replaced/version={version}")
    return version


def holding(index: WrittenIndex, only: Column | None = None) -> DataFrame:
    """id, field, token, pos, bucket of the postings that hold; only: a condition on them, which reaches the scan."""
    spark, versions = index.spark, numbers(index.spark, f"{index.path}/replaced", "version=")
    paths = [f"{index.path}/postings/version={v}" for v in sorted(versions)]
    # A version of emptied documents has no postings, and so no folder of any bucket.
    paths = [p for p in paths if present(spark, f"{p}/bucket=*")]
    schema = spark.read.parquet(f"{index.path}/replaced/version=0").schema
    if not paths:
        return spark.createDataFrame([], schema.add("field", "string").add("token", "string").add("pos", ArrayType(IntegerType())).add("bucket", IntegerType()))
    rows = spark.read.option("basePath", f"{index.path}/postings").parquet(*paths)
    rows = rows if only is None else rows.where(only)
    if max(versions) > 0:
        newest = spark.read.parquet(f"{index.path}/replaced").groupBy("id").agg(F.max("version").alias("newest"))
        rows = rows.join(newest, "id", "left").where(F.coalesce("newest", F.lit(0)) == F.col("version"))
    return rows.select("id", "field", "token", "pos", "bucket")


def compacted(index: WrittenIndex, path: str) -> WrittenIndex:
    """A new index at path of the postings that hold; the old one stays for whoever reads it."""
    rows = holding(index).withColumn("slot", F.pmod(F.xxhash64("id", "token"), F.lit(SLOTS)))
    _write(rows.repartition("bucket", "slot").drop("slot"), path, 0)
    index.spark.read.parquet(f"{index.path}/replaced/version=0").write.mode("overwrite").parquet(f"{path}/replaced/version=0")
    return WrittenIndex(index.spark, path, index.fields)


def _leaves(node) -> list[Phrase | Near]:
    return [node] if isinstance(node, Phrase | Near) else [*_leaves(node.left), *_leaves(node.right)]


def _phrases(leaf: Phrase | Near) -> tuple[Phrase, ...]:
    return leaf.phrases if isinstance(leaf, Near) else (leaf,)


def _words(p: Phrase) -> list[tuple[str, bool]]:
    """The phrase's words, and whether a prefix is meant."""
    return [(_plain(w), p.prefix and k == len(p.words) - 1) for k, w in enumerate(p.words)]


def search(index: WrittenIndex, query: str) -> DataFrame:
    """id of the documents that match; the same answers as a scan of the texts. Every match has a word of the query that isn't negated, so postings suffice."""
    tree = parse(query)
    leaves = list(dict.fromkeys(_leaves(tree)))
    for p in leaves:
        if isinstance(p, Phrase) and p.column is not None and p.column not in index.fields:
            raise QuerySyntaxError(f"no such column: {p.column}")
    words = list(dict.fromkeys(w for leaf in leaves for p in _phrases(leaf) for w in _words(p)))
    means = [F.col("token").startswith(w) if prefix else F.col("token") == w for w, prefix in words]
    only = F.lit(False)
    for m in means:
        only = only | m
    if words and all(len(w) >= 2 or not prefix for w, prefix in words):
        only = only & F.col("bucket").isin(*[_bucket(F.lit(w)) for w, _ in words])
    own = lambda f, k: F.flatten(F.collect_list(F.when(means[k] & (F.col("field") == f), F.col("pos"))))
    found = holding(index, only).groupBy("id").agg(*[F.struct(*[own(f, k).alias(f"w{k}") for k in range(len(words))]).alias(f"f{i}") for i, f in enumerate(index.fields)] if words else [F.lit(0).alias("f0")])

    def starts(s: Column, p: Phrase) -> Column:
        """Positions at which the phrase begins."""
        if not p.words:
            return F.array().cast("array<int>")
        at = [s[f"w{words.index(w)}"] for w in _words(p)]

        def here(i: Column) -> Column:
            ok = i == 0 if p.first else F.lit(True)
            for k, more in enumerate(at[1:], 1):
                ok = ok & F.array_contains(more, (i + k).cast("int"))
            return ok

        return F.filter(at[0], here)

    def near(s: Column, n: Near) -> Column:
        def body(h: Column) -> Column:
            def around(i: Column) -> Column:
                fits = F.lit(True)
                for k, p in enumerate(n.phrases[1:], 1):
                    fits = fits & _within(i, h[f"h{k}"], len(n.phrases[0].words), len(p.words), n.distance)
                return fits

            return F.exists(h["h0"], around)

        return let(F.struct(*[starts(s, p).alias(f"h{k}") for k, p in enumerate(n.phrases)]), body)

    def holds(node) -> Column:
        if isinstance(node, Both):
            left, right = holds(node.left), holds(node.right)
            return {"and": left & right, "or": left | right, "not": left & ~right}[node.kind]
        out = F.lit(False)
        for i, f in enumerate(index.fields):
            if words and (isinstance(node, Near) or node.column in (None, f)):
                s = F.col(f"f{i}")
                out = out | (near(s, node) if isinstance(node, Near) else F.size(starts(s, node)) > 0)
        return out

    return found.where(holds(tree)).select("id")


__all__ = ["BUCKETS", "WrittenIndex", "compacted", "create_index", "holding", "postings", "refresh", "search"]
