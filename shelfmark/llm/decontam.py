"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Containment is the share of a test item's distinct word shingles that occur in a document. Items are partitioned by
their number of distinct shingles (powers of two). In a partition whose largest item has u shingles, the sketch of an
item is its b least shingle hashes, b = u - ceil(t * u) + 1: a document that holds a share t of the item misses too few
shingles to miss all b, so no match can be lost. A document is hashed once, whole; against a long document the
Jaccard similarity that matches containment t is so small that bands of one minimum are all that LSH could use, and
each minimum is such a band. Items that meet a document in any band are verified, shingle by shingle, on the bytes.

The items are a stated query set: they go to the executors in blocks of at most ``block_items`` items and
``block_bytes`` bytes, one pass over the documents for each block. One block is one map-only pass. With more, each block's pairs
are written before the next block is built and its broadcast is given up, so the driver and the executors hold one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filter_rows, flat, id_text, map_arrow, row_key, slices, text_or_empty, unused
from .textnum import U, normalised, window_hash, windows_inside, word_bounds, hash_ranges

SCHEMA = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


@dataclass
class Items:
    """A block of items, ready for search."""

    ids: list[int | None]
    shingles: list[dict[bytes, None]]
    widths: list[int]  # of all items' shingles: the width asked for, and those of shorter items
    sketch: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by width: sorted hashes, their items, a filter on low bits
    all_hashes: dict[int, np.ndarray]


def shingle_sets(text: str, width: int) -> dict[bytes, None]:
    """Distinct shingles of lower-cased words; a text with fewer words has its whole sequence; without words none."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return {}
    w = min(width, len(words))
    return dict.fromkeys(b" ".join(words[i : i + w]) for i in range(len(words) - w + 1))


def _hashes(shingles: list[bytes], width: int) -> np.ndarray:
    buf, off = flat(pa.array(shingles, pa.large_binary()))
    s, e, first = word_bounds(buf, off)
    return window_hash(hash_ranges(buf, s, e), width)[first[:-1]] if len(s) else np.zeros(0, np.uint64)


def prepare(rows: list[tuple[int | None, str]], width: int, share: float) -> Items:
    ids, sets = [], []
    for item_id, text in rows:
        if own := shingle_sets(text or "", width):
            ids.append(item_id)
            sets.append(own)
    largest: dict[int, int] = {}
    for s in sets:
        k = len(s).bit_length()
        largest[k] = max(largest.get(k, 0), len(s))
    bands = {k: u - math.ceil(share * u - 1e-9) + 1 for k, u in largest.items()}
    by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
    every: dict[int, list[np.ndarray]] = {}
    for n, s in enumerate(sets):
        w = next(iter(s)).count(b" ") + 1
        h = _hashes(list(s), w)
        by_width.setdefault(w, []).append((np.sort(h)[: bands[len(s).bit_length()]], n))
        every.setdefault(w, []).append(h)
    sketch = {}
    for w, parts in by_width.items():
        h, item = np.concatenate([x for x, _ in parts]), np.concatenate([np.full(len(x), n) for x, n in parts])
        order = np.argsort(h, kind="stable")
        low = np.zeros(1 << 18, bool)
        low[(h & U(0x3FFFF)).astype(np.int64)] = True
        sketch[w] = (h[order], item[order], low)
    return Items(ids, sets, sorted(by_width), sketch, {w: np.sort(np.concatenate(x)) for w, x in every.items()})


def matches(texts: pa.Array, items: Items, share: float) -> Iterator[tuple[int, int, int, int]]:
    """(text number, item number, shingles of the item, found) of each pair with containment >= share."""
    buf, off = flat(texts)
    starts, ends, first = word_bounds(buf, off)
    if not len(starts):
        return
    buf, starts, ends = normalised(buf, starts, ends, first)
    h1 = hash_ranges(buf, starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    for w in items.widths:
        h = window_hash(h1, w)
        if not len(h):
            continue
        keys, item, low = items.sketch[w]
        inside = windows_inside(first, w, len(h1))[: len(h)]
        at = np.flatnonzero(low[(h & U(0x3FFFF)).astype(np.int64)] & inside)
        lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            continue
        met = np.unique(np.stack([np.repeat(doc[at], hi - lo), item[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])]], axis=1), axis=0)
        for d in np.unique(met[:, 0]):
            a, b = first[d], first[d + 1] - w + 1
            known = items.all_hashes[w]
            pos = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
            hits = np.flatnonzero(known[pos] == h[a:b]) + a
            have = {buf[starts[i] : ends[i + w - 1]].tobytes() for i in hits}
            for n in met[met[:, 0] == d, 1]:
                own = items.shingles[n]
                found = sum(s in have for s in own)
                if found >= share * len(own) - 1e-9:
                    yield int(d), int(n), len(own), found


def item_blocks(items: DataFrame, width: int, share: float, block_items: int, block_bytes: int) -> list[Callable[[], Items]]:
    """One loader for each block of items; blocks are dealt by hash, so each is about n / blocks items."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil(size / block_bytes))

    def load(k: int) -> Items:
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        return prepare(sorted(((r.item_id, r.text) for r in own.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), width, share)

    return [lambda k=k: load(k) for k in range(blocks)]


def find_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment: every pair with containment >= share.

    Items of fewer than width words count as one shingle, their whole sequence; items and documents without words
    match nothing. Rows of docs or items that repeat give repeated pairs. No pairs: an empty result.
    """
    blocks, out = item_blocks(items, width, share, block_items, block_bytes), None
    for load in blocks:
        part, sent = _block_pairs(id_text(docs).withColumn("k2", F.lit(0).cast("long")), load, share)
        part = part.drop("k2")
        if len(blocks) > 1:
            part = cut(part, "contaminated")
            sent.unpersist()
        out = part if out is None else out.union(part)
    return out


def _block_pairs(keyed: DataFrame, load: Callable[[], Items], share: float):
    """(the pairs of keyed (doc_id, text, k2) and a block's items, the block's broadcast)."""
    sent = keyed.sparkSession.sparkContext.broadcast(load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch):
                ids, k2 = part.column(0).to_pylist(), part.column(2).to_pylist()
                rows = [(ids[d], own.ids[n], size, found, found / size, k2[d]) for d, n, size, found in matches(part.column(1), own, share)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (*(pa.int64(),) * 4, pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_found", "containment", "k2"])

    return map_arrow(keyed, run, SCHEMA + ", k2 long"), sent


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """docs, all columns, without the rows that hold an item: one map-only pass, or with several blocks of items one pass each and one anti join.

    Null and empty texts hold no item and stay, items without words are held by nothing, repeated rows go or stay together.
    """
    blocks = item_blocks(items, width, share, block_items, block_bytes)
    if len(blocks) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(blocks[0]())

        def clean(texts: pa.Array) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[d for d, *_ in matches(texts, sent.value, share)]] = False
            return keep

        return filter_rows(docs, clean)
    gone = None
    for load in blocks:
        part, sent = _block_pairs(id_text(docs).select("doc_id", "text", row_key()[1]), load, share)
        part = cut(part.select(F.coalesce("doc_id", F.lit(-1)).alias("k1"), "k2").distinct(), "contaminated")
        sent.unpersist()
        gone = part if gone is None else gone.union(part)
    k1, k2 = unused(docs, "k1"), unused(docs, "k2")
    own = row_key("doc_id", text_or_empty())
    kept = docs.select("*", own[0].alias(k1), own[1].alias(k2)).join(gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2)), [k1, k2], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark
), widths AS (SELECT DISTINCT least(5, len(w)) AS k FROM words WHERE side = 'i' AND len(w) > 0),
item_shingles AS (
  SELECT DISTINCT id AS item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
  FROM (SELECT id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM words WHERE side = 'i' AND len(w) > 0)
), doc_shingles AS (
  SELECT DISTINCT id AS doc_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, widths WHERE side = 'd' AND len(w) >= k)
), sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY 1),
found AS (SELECT doc_id, item_id, count(*) AS f FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, f AS n_found, f / n AS containment FROM found JOIN sizes USING (item_id) WHERE 10 * f >= 8 * n
"""
