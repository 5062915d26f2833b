"""Near copies by verified similarity: SimHash blocks as candidate search, exact Jaccard similarity of word shingles.

Texts whose words are equal (A-Z lower-cased, one space between) are one node. Two nodes are linked if the Jaccard
similarity of their sets of word shingles is at least ``share``. SimHash of the sets is cut into blocks, each of which is a join key, and
the Hamming distance of GUARD further bits stands in the join's condition. A bit differs for two sets of similarity s with probability
p = acos(2 s / (1 + s)) / pi at most, 0.15 at 0.8: op8's 64 bits would need blocks 3 bits wide for that. So SimHash is as long as the table
asks for: a block has about log2(n / LOAD) bits, so that chance puts LOAD of n texts under one of its values, and there are so many blocks that
all of them miss a pair at ``share`` with probability MISS (41 of 8 bits for 46,000 texts, 60 of 10 for 231,000, 170 of 16 for ten million; keys a text
grow as n ** 0.24). The guard loses one pair at ``share`` in a million or fewer. Pairs that come out of the join have their sets compared.

Nodes with much company under pairs of blocks (a family of copies, texts that share much of a passage) don't meet each other that way, as what comes
out would grow with the family's square. They first meet the members with the most company under LEADS blocks (of a family of copies, the text
that they were made of), so that a family becomes one component. What is left in different components meets under all blocks all the same, so that no
link is lost, with sketches in the join beside the guards: 511 minima, seven bits of each. Only pairs whose sketches agree as pairs of similarity ``share``
do, less 5 standard deviations (which loses one in 3e6), come out of it, each once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart_keys, bounded_broadcast, cut, flat, id_text, map_arrow, release, row_key, slices
from .components import connected_components
from .simhash import keep_first
from .textnum import hash_ranges, mix, normalised, window_hash, windows_inside, word_bounds
from .vectors import list_array

#: Minima in a sketch (seven bits of each, seven to a long), and how many standard deviations below its mean two sketches' agreement may be.
LANES, SLACK = 511, 5.0
#: Bits of SimHash that stand beside the blocks in the join; how many texts a block's value has by chance; how likely all blocks may miss a pair at share.
GUARD, LOAD, MISS = 384, 256, 3e-6
#: Blocks under which crowded nodes look for leaders.
LEADS = 16


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node of each text, hashes of all shingles, where each text's begin); a text under width words is one shingle."""
    buf, off = flat(texts)
    starts, ends, first = word_bounds(buf, off)
    n = np.diff(first)
    if len(starts):
        norm, s, e = normalised(buf, starts, ends, first)
        data = norm.tobytes()
    else:
        norm, s, e, data = np.zeros(0, np.uint8), starts, ends, b""
    node = np.array([xxhash.xxh64_intdigest(data[s[a] : e[b - 1]] if b > a else b"") for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.uint64)
    count = np.maximum(n - width + 1, 1)
    at = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    long = np.repeat(n >= width, count)
    h = np.repeat(node, count)
    if long.any():
        windows = window_hash(hash_ranges(norm, s, e), width)
        h[long] = windows[windows_inside(first, width, len(s))[: len(windows)]]
    return node, h, at


def blocks_for(n: int, share: float) -> tuple[int, int]:
    """(bits in a block, number of blocks) for n texts: chance puts about LOAD of them under a block's value, and a pair at share is missed by all blocks with probability MISS."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / LOAD)))
    return bits, math.ceil(math.log(MISS) / math.log1p(-((1 - bit_differs(share)) ** bits)))


def bit_differs(share: float) -> float:
    """How likely a bit of SimHash differs for two sets of that Jaccard similarity, at most: the angle between sets of equal size, over pi."""
    return math.acos(2 * share / (1 + share)) / math.pi


def simhash_bits(h: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """bits booleans for each set of hashes: whether the weights that a set's hashes have for the bit sum up to more than nothing.

    A weight is one of -15, -13 .. 15, four bits of a hash, as with two weights sets of four or five shingles differ in more bits than their angle says.
    """
    rng = np.random.default_rng(20)
    i = np.arange(1 << 16, dtype=np.uint64)
    lanes = (i & np.uint64(15)) | (i >> np.uint64(4) & np.uint64(15)) << np.uint64(16) | (i >> np.uint64(8) & np.uint64(15)) << np.uint64(32) | (i >> np.uint64(12)) << np.uint64(48)
    n = np.diff(np.append(at, len(h)))
    # Sums of up to 4096 weights fit into a lane of 16 bits.
    pieces = -(-n // 4096)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cuts = np.repeat(at, pieces) + 4096 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    out = np.zeros((len(at), -(-bits // 8) * 8), bool)
    for k in range(0, bits, 8):
        flip, times = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        top = (((h ^ flip) * (times | np.uint64(1))) >> np.uint64(32)).astype(np.uint32).view(np.uint16).reshape(-1, 2)
        for j in (0, 1):
            sums = np.add.reduceat(lanes[top[:, j]], cuts).view(np.uint16).reshape(-1, 4).astype(np.int64)
            out[:, k + 4 * j : k + 4 * j + 4] = 2 * np.add.reduceat(sums, first, axis=0) > 15 * n[:, None]
    return out[:, :bits]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def distinct_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text without repeats, and where each text's begin."""
    sets = [np.unique(x) for x in np.split(h, at[1:])]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]]).astype(np.int64)


def with_blocks(docs: DataFrame, width: int, bits: int, blocks: int) -> DataFrame:
    """doc_id, k1, k2, node, keys (a SimHash's blocks, with their numbers above their bits), guard (GUARD further bits); one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                node, h, at = shingles(part.column(1), width)
                made = simhash_bits(*distinct_sets(h, at), GUARD + bits * blocks)
                guard = np.packbits(made[:, :GUARD], axis=1).view(np.int64)
                values = made[:, GUARD:].reshape(len(at), blocks, bits) @ (1 << np.arange(bits, dtype=np.int64))
                keys = values + (np.arange(blocks, dtype=np.int64) << bits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), _signed(node), list_array(keys), list_array(guard)], names=["doc_id", "k1", "k2", "node", "keys", "guard"])

    return map_arrow(id_text(docs).select("doc_id", "text", *row_key()), run, "doc_id long, k1 long, k2 long, node long, keys array<long>, guard array<long>")


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """LANES / 7 longs for each text: seven bits of the least of its shingles' hashes under each of LANES functions, in a byte each."""
    rng = np.random.default_rng(21)
    out = np.zeros((len(at), LANES // 7, 8), np.uint8)
    for lane in range(LANES):
        flip, times = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        out[:, lane // 7, lane % 7] = mix(np.minimum.reduceat((h ^ flip) * (times | np.uint64(1)), at)) & np.uint64(0x7F)
    return out.reshape(len(at), -1).view(np.int64)


def differing(a: str, b: str) -> Column:
    """In how many lanes two sketches differ: the bytes that aren't zero in the exclusive or, seven at a time (no sum carries into the next byte)."""
    filled, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + F.bit_count((x + filled).bitwiseAND(high)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, sketch: bool = False) -> DataFrame:
    """node, shingles (distinct hashes), sketch (if asked for, else null) of the nodes in wanted (node, k1, k2: one of the node's rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, h, at = shingles(part.column(1), width)
                sets = [np.unique(x) for x in np.split(h, at[1:])]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(sets)))
                made = list_array(sketches(h, at)) if sketch else pa.nulls(len(at), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, made], names=["node", "shingles", "sketch"])

    wanted = cut(wanted.select("node", "k1", "k2"), "wanted")
    rows = id_text(docs).select("text", *row_key()).join(bounded_broadcast(wanted, 500_000), ["k1", "k2"]).select("node", "text")
    return map_arrow(rows, run, "node long, shingles array<long>, sketch array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, docs: DataFrame, own: DataFrame, width: int, share: float) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of at least share; own: node, k1, k2."""
    pairs = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    named = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = cut(shingle_sets(docs, own.join(named, "node", "left_semi"), width), "sets")
    # Both sides of both joins are plain tables, so that Spark can split the pairs of a hub.
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"{s}_set"))
    pairs = pairs.join(side("u"), "u").join(side("v"), "v")
    a, b = F.size("u_set"), F.size("v_set")
    both = F.size(F.array_intersect("u_set", "v_set"))
    alike = F.when(F.least(a, b) < share * F.greatest(a, b) - 1e-9, False).otherwise(both >= share * (a + b - both) - 1e-9)
    return pairs.where(alike).select("u", "v")


def crowds(own: DataFrame, n: int, bits: int, blocks: int, crowd: int) -> DataFrame:
    """node, company of the nodes (of n in own) that share pairs of blocks with more than crowd others beyond twice what chance brings."""
    pairs = [F.get("keys", F.lit(i)) * F.lit(1 << 31) + F.get("keys", F.lit(i + 1)) for i in range(0, blocks - 1, 2)]
    rows = own.select("node", F.explode(F.array(*pairs)).alias("key"))
    groups = apart_keys(rows, ["key"], F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, "key").groupBy("node").agg(F.sum(F.col("n") - 1).alias("company")).where(F.col("company") > crowd + 2 * len(pairs) * n / 4**bits)


def leader_pairs(crowded: DataFrame) -> DataFrame:
    """u, v: each of the crowded (node, company, keys) with the leader of each of its first LEADS blocks, the one with the most company."""
    many = crowded.select("node", "company", F.explode(F.slice("keys", 1, LEADS)).alias("key"))
    leads = apart_keys(many, ["key"], F.max(F.struct("company", "node"))["node"].alias("u"))
    return many.join(leads, "key").select("u", F.col("node").alias("v")).where("u <> v").distinct()


def guards(column: str = "guard") -> list[Column]:
    """The longs of a guard as columns, which compare faster than lists."""
    return [F.get(column, F.lit(i)).alias(f"g{i}") for i in range(GUARD // 64)]


def guards_agree(share: float) -> Column:
    """Whether the Hamming distance of u's and v's guards is what sets of similarity share have, or up to SLACK (and a bit for the skew of small counts) deviations more."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"u_g{i}").bitwiseXOR(F.col(f"v_g{i}"))) for i in range(GUARD // 64)])
    p = bit_differs(share)
    return apart <= GUARD * p + (SLACK + 0.2) * (GUARD * p * (1 - p)) ** 0.5


def sides(keyed: DataFrame) -> list[DataFrame]:
    """keyed (key and more) twice, with u_ and v_ before all names but the key's."""
    return [keyed.select("key", *[F.col(c).alias(f"{x}_{c}") for c in keyed.columns if c != "key"]) for x in "uv"]


def block_pairs(own: DataFrame, share: float) -> DataFrame:
    """u, v: nodes of own (node, keys, guard, crowded) that share a block and whose guards agree; none of them if both are crowded. Pairs repeat."""
    u, v = sides(own.select(F.explode("keys").alias("key"), "node", "crowded", *guards()))
    pairs = u.join(v, "key").where((F.col("u_node") < F.col("v_node")) & ~(F.col("u_crowded") & F.col("v_crowded")) & guards_agree(share))
    return pairs.select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))


def crowded_pairs(crowded: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """u, v: nodes of different parts of crowded (node, part, keys, guard) that share a block, and whose sizes, guards and sketches (in sets) agree; each pair once."""
    marked = crowded.select("node", "part", "keys", *guards()).join(sets.select("node", F.size("shingles").alias("n"), "sketch"), "node")
    u, v = sides(cut(marked.select("*", F.explode("keys").alias("key")), "crowded"))
    near = F.least("u_n", "v_n") >= share * F.greatest("u_n", "v_n") - 1e-9
    # A pair meets under the first block that it shares, and under no other.
    once = F.get(F.array_intersect("u_keys", "v_keys"), F.lit(0)) == F.col("key")
    alike = LANES - differing("u_sketch", "v_sketch") >= LANES * share - SLACK * (LANES * share * (1 - share)) ** 0.5
    return u.join(v, "key").where((F.col("u_part") < F.col("v_part")) & near & guards_agree(share) & once & alike).select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))


def near_copy_groups(docs: DataFrame, width: int = 5, share: float = 0.8, crowd: int = 48) -> DataFrame:
    """doc_id, k1, k2, part (the component), one row for each row of docs. Null and empty texts are one node."""
    n = docs.count()
    bits, blocks = blocks_for(n, share)
    marked = cut(with_blocks(docs, width, bits, blocks), "blocks")
    own = cut(marked.groupBy("node").agg(F.min(F.struct(F.col("k1"), F.col("k2"), F.col("keys"), F.col("guard"))).alias("s")).select("node", "s.*"), "nodes")
    many = cut(crowds(own, n, bits, blocks, crowd), "crowds")
    release(docs.sparkSession)
    links, more = None, None
    if many.limit(1).count():
        # Families first: what their leaders join needn't meet pair by pair under any block.
        many = cut(own.join(many, "node"), "many")
        links = cut(similar(leader_pairs(many), docs, own, width, share), "links")
        parts = connected_components(links)
        many = cut(many.join(parts, "node", "left").select("node", "k1", "k2", "keys", "guard", F.coalesce("component", "node").alias("part"), F.lit(True).alias("crowded")), "many")
        release(docs.sparkSession)
        sets = cut(shingle_sets(docs, many, width, sketch=True), "sets")
        more = crowded_pairs(many, sets, share)
        placed = own.join(many.select("node", "crowded"), "node", "left").select("node", "keys", "guard", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    else:
        placed = own.select("node", "keys", "guard", F.lit(False).alias("crowded"))
    pairs = block_pairs(placed, share)
    found = similar(pairs if more is None else pairs.union(more), docs, own, width, share)
    release(docs.sparkSession)
    parts = cut(connected_components(found if links is None else links.union(found)), "parts")
    release(docs.sparkSession)
    of = own.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    return marked.join(of, "node").select("doc_id", "k1", "k2", "part")


def keep_one_of_near_copies(docs: DataFrame, **params) -> DataFrame:
    """docs without all but one row of each group of near copies: the row with the least doc_id (ties: the least text hash)."""
    return keep_first(docs, near_copy_groups(docs, **params))
