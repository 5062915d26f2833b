"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: 64 bits; a bit is 1 if it is set in over half the hashes (XXH64, seed 42) of the text's word shingles,
repeats included. Two fingerprints within ``max_bits`` differ in at most max_bits of ``blocks`` blocks, so they agree
on some choice of blocks - max_bits blocks. Every choice is a join key; a join on it, with the Hamming distance in
the join's condition, finds every link.

Equal fingerprints are one node from the start, so exact copies cost nothing beyond their own row. A key that more
than ``crowd`` different fingerprints share isn't joined pair by pair: each of its members instead meets, as one row
per bit outside the key, the fingerprints that differ from it in that bit. Members that meet at a common
neighbour differ in at most two bits, and two that differ in one or two bits do meet, so for max_bits = 2 the links'
components are the same and the work stays linear in the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart_keys, cut, flat, id_text, map_arrow, row_key, slices, text_or_empty, unused
from .components import connected_components
from .textnum import normalised, word_bounds

BITS, SEED = 64, 42


def fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text; a text without words has 0."""
    buf, off = flat(texts)
    starts, ends, first = word_bounds(buf, off)
    out = np.zeros(len(texts), np.uint64)
    n = np.diff(first)
    if not len(starts):
        return out
    norm, s, e = normalised(buf, starts, ends, first)
    data = norm.tobytes()
    n_sh = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    base = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n_sh)[:-1]]), n_sh)
    lo = np.arange(n_sh.sum()) + base
    hi = np.minimum(lo + shingle, np.repeat(first[1:], n_sh)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(s[lo].tolist(), e[hi].tolist(), strict=True)), np.uint64, len(lo))
    has = np.flatnonzero(n_sh)
    at = np.concatenate([[0], np.cumsum(n_sh)[:-1]])[has]
    for bit in range(BITS):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at)
        out[has] |= (2 * ones > n_sh[has]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprints(part.column(1), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(fp)], names=["doc_id", "k1", "k2", "fp"])

    return map_arrow(id_text(docs).select("doc_id", "text", *row_key()), run, "doc_id long, k1 long, k2 long, fp long")


def block_keys(fp: Column, blocks: int, max_bits: int) -> list[tuple[int, int, Column]]:
    """(number, mask of the bits outside, key) of each choice of blocks - max_bits blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    out = []
    for i, kept in enumerate(combinations(masks, blocks - max_bits)):
        mask = sum(kept)
        out.append((i, (1 << BITS) - 1 - mask, fp.bitwiseAND(F.lit(_signed(mask)))))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(nodes: DataFrame, max_bits: int = 2, blocks: int = 5, crowd: int = 48) -> DataFrame:
    """u, v: links between nodes (node long, fp long, different fps) that together connect all fps within max_bits.

    Pairs within max_bits under keys of at most crowd fps; under larger keys, for max_bits <= 2, stars over
    common neighbours; for other max_bits the larger keys' pairs too.
    """
    keys = block_keys(F.col("fp"), blocks, max_bits)
    keyed = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), key.alias("key")) for i, _, key in keys])).alias("b")).select("node", "fp", "b.c", "b.key")
    groups = apart_keys(keyed, ["c", "key"], F.count("*").alias("n")).where("n > 1")
    keyed = cut(keyed.join(groups, ["c", "key"]), "blocks")
    few, many = keyed.where(F.col("n") <= crowd) if max_bits <= 2 else keyed, keyed.where(F.col("n") > crowd)
    a, b = few.select("c", "key", F.col("fp").alias("f"), F.col("node").alias("u")), few.select("c", "key", F.col("fp").alias("g"), F.col("node").alias("v"))
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_bits
    pairs = a.join(b, (a.c == b.c) & (a.key == b.key) & (F.col("f") < F.col("g")) & near).select("u", "v")
    if max_bits > 2:
        return pairs
    # The stars don't need the key: a common neighbour is common whatever key found the group.
    crowded = many.select("node", "fp").distinct()
    flips = F.lit([0, *(_signed(1 << b) for b in range(BITS))]) if max_bits == 2 else F.lit([0])
    met = crowded.select("node", "fp", F.explode(flips).alias("flip")).select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    if not many.limit(1).count():
        return pairs
    centre = apart_keys(met, ["at"], F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = met.join(centre, "at").where("node <> v").select(F.col("node").alias("u"), "v")
    return pairs.union(stars)


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 5, crowd: int = 48) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, part, k1, k2, one row for each row of docs.

    component_id is the least doc_id reachable over links of fingerprints that differ in at most max_bits bits, null if
    all of them are null; part is the component itself, also where repeated doc_ids give two components the same
    least one. Null and empty texts have fingerprint zero and link like any other. Repeated rows are rows of their own.
    """
    rows = cut(with_fingerprints(docs, shingle), "fingerprints")
    own = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    # The least doc_id numbers a fingerprint, unless it is null or stands under several; then the fingerprint does itself.
    plain = not own.groupBy("least").agg(F.count("*").alias("n")).where("least is null or n > 1").limit(1).count()
    own = own.withColumn("node", F.col("least") if plain else F.col("fp"))
    parts = connected_components(fingerprint_links(own.select("node", "fp"), max_bits, blocks, crowd))
    of = own.join(parts, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("part"))
    if plain:
        of = of.select("fp", "part", F.col("part").alias("component_id"))
    else:
        of = of.join(of.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("fp", "part", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "part", "k1", "k2")


def keep_one_of_each(docs: DataFrame, **params) -> DataFrame:
    """docs without all but one row of each SimHash group: the row with the least doc_id (ties: the least text hash).

    All columns of docs are kept. Of fully identical rows one is kept.
    """
    return keep_first(docs, simhash_groups(docs, **params))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The first row of docs in each part of groups (doc_id, part, k1, k2); of fully identical rows one."""
    groups = cut(groups, "groups")
    k1, k2 = unused(docs, "k1"), unused(docs, "k2")
    first = groups.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("k1"), F.col("k2"))).alias("s")).select(F.col("s.k1").alias(k1), F.col("s.k2").alias(k2))
    own = row_key("doc_id", text_or_empty())
    kept = docs.select("*", own[0].alias(k1), own[1].alias(k2)).join(first, [k1, k2], "left_semi")
    # Only fully identical rows share a key; where there are none, rows needn't be compared again.
    if groups.groupBy("k1", "k2").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([k1, k2])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
