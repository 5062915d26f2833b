"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of two hashed ones, of the lower-cased word and of its first bytes (inflected forms
share them). Filters of widths 1, 2 and 3 run over all words of the text, each is max-pooled over the whole text,
and a logistic layer reads the pools. Because a filter is linear, each bucket's share of each filter is tabled once
after training, so scoring is gathers and sums.

Training is on the driver, on a bounded sample of labelled texts. A quarter of the sample is set aside to calibrate a
threshold for each language; a text's language is guessed from its own function words, never from a column. Scores are
shifted so that every language's threshold stands at the same public score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, flat, id_text, map_arrow, row_key, slices
from .textnum import LOWER, U, hash_ranges, word_bounds

WORD_BITS, PREFIX_BITS, PREFIX_BYTES = 15, 13, 4
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
SLOTS = [(w, j) for w in WIDTHS for j in range(w)]
THRESHOLD = 0.7
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "it", "with", "as"),
    "de": ("der", "die", "und", "den", "das", "ist", "von", "ein", "eine", "zu", "auf", "sich"),
    "fr": ("le", "la", "les", "des", "et", "une", "dans", "qui", "pour", "pas", "du", "au"),
    "es": ("el", "los", "las", "una", "por", "con", "su", "para", "del", "como", "lo", "y"),
}
LANGS = tuple(FUNCTION_WORDS)


@dataclass
class Words:
    """A batch of texts as bucket numbers."""

    word: np.ndarray
    prefix: np.ndarray
    first: np.ndarray
    lang: np.ndarray


def _lang_table() -> np.ndarray:
    table = np.full(1 << 16, -1, np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        buf = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        table[(hash_ranges(buf, starts, ends) & U(0xFFFF)).astype(np.int64)] = i
    return table


def read_words(texts: pa.Array) -> Words:
    buf, off = flat(texts)
    buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, off)
    h = hash_ranges(buf, starts, ends)
    p = hash_ranges(buf, starts, np.minimum(ends, starts + PREFIX_BYTES))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    said = _lang_table()[(h & U(0xFFFF)).astype(np.int64)].astype(np.int64)
    known = said >= 0
    votes = np.bincount(doc[known] * len(LANGS) + said[known], minlength=len(texts) * len(LANGS)).reshape(len(texts), len(LANGS))
    lang = np.where(votes.max(1, initial=0) > 0, votes.argmax(1) if votes.size else 0, len(LANGS))
    return Words((h >> U(64 - WORD_BITS)).astype(np.int32), (p >> U(64 - PREFIX_BITS)).astype(np.int32), first, lang)


@dataclass
class Model:
    words: np.ndarray  # 2^WORD_BITS x (slots * FILTERS): each bucket's share of each filter at each place
    prefixes: np.ndarray
    bias: np.ndarray  # widths x FILTERS
    head: np.ndarray
    offset: float
    thresholds: np.ndarray  # log-odds by language, the last for an unknown one

    def pools(self, t: Words) -> np.ndarray:
        """widths * FILTERS maxima for each text; zeros for a text without words."""
        n = np.diff(t.first)
        out = np.zeros((len(n), len(WIDTHS) * FILTERS), np.float32)
        if not len(t.word):
            return out
        has = np.flatnonzero(n)
        at = t.first[:-1][has]
        left = np.repeat(t.first[1:], n) - np.arange(len(t.word))
        for k, width in enumerate(WIDTHS):
            sums = np.broadcast_to(self.bias[k], (len(t.word), FILTERS)).copy()
            for j in range(width):
                s = SLOTS.index((width, j)) * FILTERS
                part = self.words[t.word, s : s + FILTERS] + self.prefixes[t.prefix, s : s + FILTERS]
                if j:
                    shifted = np.zeros_like(sums)
                    shifted[:-j] = part[j:]
                    shifted[left <= j] = 0
                    sums += shifted
                else:
                    sums += part
            out[has, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(sums, at, axis=0)
        return out

    def log_odds(self, t: Words) -> np.ndarray:
        return (np.maximum(self.pools(t), 0).astype(np.float64) * self.head).sum(1) + self.offset  # row by row: the same in any batch

    def score(self, texts: pa.Array) -> np.ndarray:
        t = read_words(texts)
        z = self.log_odds(t) - self.thresholds[t.lang] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _take(t: Words, docs: np.ndarray) -> Words:
    n = np.diff(t.first)[docs]
    at = np.concatenate([np.arange(t.first[d], t.first[d + 1]) for d in docs]) if len(docs) else np.zeros(0, np.int64)
    return Words(t.word[at], t.prefix[at], np.concatenate([[0], np.cumsum(n)]), t.lang[docs])


def _log_odds_of_buckets(bucket: np.ndarray, first: np.ndarray, docs: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of label 1 for the texts (of docs) that hold each bucket: where the embeddings start. Text by text, so that no array is longer than a text."""
    pos, neg = np.zeros(size), np.zeros(size)
    for d in docs:
        (pos if y[d] else neg)[np.unique(bucket[first[d] : first[d + 1]])] += 1
    n_pos, n_neg = y[docs].sum(), (1 - y[docs]).sum()
    return np.clip(np.log((pos + 0.2) / (n_pos + 0.4)) - np.log((neg + 0.2 * (1 + n_neg / max(n_pos, 1))) / (n_neg + 0.4)), -3, 3)


def fit(all_words: Words, y: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.03, seed: int = 5) -> Model:
    """Train on texts in the order given; every fourth is set aside for the thresholds."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 4 == 3
    train, t, ty = np.flatnonzero(~aside), all_words, y
    train_y = y[train]
    e1, e2 = rng.normal(0, 0.05, (1 << WORD_BITS, DIM)).astype(np.float32), rng.normal(0, 0.05, (1 << PREFIX_BITS, DIM)).astype(np.float32)
    e1[:, 0], e2[:, 0] = 0.5 * _log_odds_of_buckets(t.word, t.first, train, y, len(e1)), 0.5 * _log_odds_of_buckets(t.prefix, t.first, train, y, len(e2))
    w = rng.normal(0, 0.3, (len(SLOTS), DIM, FILTERS)).astype(np.float32)
    w[:, 0, :] = np.abs(w[:, 0, :]) + 0.3
    b = np.full((len(WIDTHS), FILTERS), -0.5, np.float32)
    head = np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
    offset = -2.0
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", w), ("b", b), ("head", head))}
    g1, g2 = np.full(len(e1), 1e-3, np.float32), np.full(len(e2), 1e-3, np.float32)
    step, weight = 0, float(np.clip((1 - train_y).sum() / max(train_y.sum(), 1), 1, 4))
    off_m = off_v = 0.0

    def adam(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = state[name]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(len(train))
        for lo in range(0, len(order), batch):
            docs = train[order[lo : lo + batch]]
            docs = docs[np.diff(t.first)[docs] > 0]
            if not len(docs):
                continue
            step += 1
            s = _take(t, docs)
            e = e1[s.word] + e2[s.prefix]
            padded = np.concatenate([e, np.zeros((max(WIDTHS), DIM), np.float32)])
            left = np.repeat(s.first[1:], np.diff(s.first)) - np.arange(len(e))
            pool, place = np.zeros((len(docs), len(WIDTHS), FILTERS), np.float32), np.zeros((len(docs), len(WIDTHS), FILTERS), np.int64)
            for k, width in enumerate(WIDTHS):
                sums = np.broadcast_to(b[k], (len(e), FILTERS)).copy()
                for j in range(width):
                    here = padded[j : j + len(e)] @ w[SLOTS.index((width, j))]
                    here[left <= j] = 0
                    sums += here
                for i in range(len(docs)):
                    seg = sums[s.first[i] : s.first[i + 1]]
                    at = seg.argmax(0)
                    place[i, k], pool[i, k] = at + s.first[i], seg[at, np.arange(FILTERS)]
            act = np.maximum(pool, 0).reshape(len(docs), -1)
            p = 1 / (1 + np.exp(-np.clip(act @ head + offset, -30, 30)))
            yy = ty[docs]
            err = ((p - yy) * np.where(yy == 1, weight, 1.0) / len(docs)).astype(np.float32)
            g_pool = (err[:, None] * head[None, :] * (act > 0)).reshape(pool.shape)
            g_w, g_b = np.zeros_like(w), g_pool.sum(0)
            rows1, rows2, grads = [], [], []
            for k, width in enumerate(WIDTHS):
                for j in range(width):
                    n, at = SLOTS.index((width, j)), place[:, k] + j
                    g = np.where(left[place[:, k]] > j, g_pool[:, k], 0)
                    g_w[n] = np.einsum("dfe,df->ef", padded[at], g)
                    ok = g != 0
                    rows1.append(s.word[at[ok]])
                    rows2.append(s.prefix[at[ok]])
                    grads.append(g[ok][:, None] * w[n].T[np.nonzero(ok)[1]])
            adam("w", w, g_w + 1e-4 * w)
            adam("b", b, g_b)
            adam("head", head, act.T @ err + 1e-4 * head)
            off_m, off_v = off_m * 0.9 + 0.1 * err.sum(), off_v * 0.99 + 0.01 * err.sum() ** 2
            offset -= rate * (off_m / (1 - 0.9**step)) / (np.sqrt(off_v / (1 - 0.99**step)) + 1e-6)
            grad = np.concatenate(grads)
            for table, seen, rows in ((e1, g1, np.concatenate(rows1)), (e2, g2, np.concatenate(rows2))):
                if len(rows):
                    own, inv = np.unique(rows, return_inverse=True)
                    total = np.zeros((len(own), DIM), np.float32)
                    np.add.at(total, inv, grad)
                    seen[own] += (total**2).mean(1)
                    table[own] -= rate * total / np.sqrt(seen[own])[:, None]
    flat_w = w.transpose(1, 0, 2).reshape(DIM, -1)
    model = Model((e1 @ flat_w).astype(np.float32), (e2 @ flat_w).astype(np.float32), b, head, float(offset), np.zeros(len(LANGS) + 1))
    held = np.flatnonzero(aside)
    z = [model.log_odds(_take(all_words, held[i : i + 100])) for i in range(0, len(held), 100)]
    model.thresholds = calibrate(np.concatenate(z) if z else np.zeros(0), y[held], all_words.lang[held])
    return model


def _labelled_words(max_words: int):
    """Rows of text, label, order, k2 as bucket numbers; texts of more than max_words words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                t = read_words(part.column(0))
                lists = [pa.ListArray.from_arrays(pa.array(t.first.astype(np.int32)), pa.array(x)) for x in (t.word, t.prefix)]
                out = pa.RecordBatch.from_arrays([*lists, pa.array(t.lang.astype(np.int32)), part.column(1), part.column(2), part.column(3)], names=["word", "prefix", "lang", "label", "order", "k2"])
                yield out.filter(pa.array(np.diff(t.first) <= max_words))

    return run


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, end to end, and where each list begins."""
    n = np.array([len(x) for part in column.chunks for x in part], np.int64)
    values = [part.flatten().to_numpy() for part in column.chunks]
    return np.concatenate(values) if values else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(n)])


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds with the fewest errors, midway between neighbours; of equal ones that with the widest gap."""
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([np.cumsum((1 - ys)[::-1])[::-1], [0]])
    low, high = np.concatenate([[zs[0] - 1], zs]), np.concatenate([zs, [zs[-1] + 1]])
    at = np.flatnonzero(errors == errors.min())
    best = at[np.argmax((high - low)[at])]
    return float((low[best] + high[best]) / 2)


def calibrate(z: np.ndarray, y: np.ndarray, lang: np.ndarray, least: int = 12) -> np.ndarray:
    """A threshold by language; the overall one where a language has fewer than least texts of a label."""
    common = best_cut(z, y) if len(z) and 0 < y.sum() < len(y) else 0.0
    out = np.full(len(LANGS) + 1, common)
    for i in range(len(LANGS)):
        own = lang == i
        if min(y[own].sum(), (1 - y[own]).sum()) >= least:
            out[i] = best_cut(z[own], y[own])
    return out


def held_out_fold(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text, mod 3, is 1; a null id counts as ''."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(0)) % 3 == 1


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, max_words: int = 4000) -> Model | None:
    """Train from a bounded sample of the labelled rows outside the held-out fold.

    The sample: the max_labelled labels with the least (hash of the doc_id, doc_id, label), and of their texts those of at most
    max_words words, so reruns and repeated doc_ids or labels give the same model. Executors turn the words into
    bucket numbers; the driver gets at most 8 * max_labelled * max_words bytes of them. None if there are under 40 such rows or only one label.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out_fold(F.col("doc_id")))
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"), F.xxhash64(F.col("doc_id").cast("long")).alias("order"))
    chosen = F.broadcast(chosen.orderBy("order", "doc_id", "label").limit(max_labelled))
    rows = id_text(docs).join(chosen, "doc_id").select("text", "label", "order", row_key()[1])
    rows = map_arrow(rows, _labelled_words(max_words), "word array<int>, prefix array<int>, lang int, label int, `order` long, k2 long")
    rows = rows.orderBy("order", "label", "k2").limit(max_labelled).toArrow()
    y = rows.column("label").to_numpy().astype(float)
    if len(y) < 40 or y.min() == y.max():
        return None
    (word, first), (prefix, _), lang = _joined(rows.column("word")), _joined(rows.column("prefix")), rows.column("lang").to_numpy().astype(np.int64)
    del rows
    pa.default_memory_pool().release_unused()
    return fit(Words(word, prefix, first, lang), y)


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, k1, k2 for each row of docs; predicted is 1 where score >= 0.7.

    Null and empty texts get a score like any other (that of no words). Without a model every score is 0.
    The model's size is fixed by its parameters (about 8 MB), so it is sent to every executor. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                score = m.score(part.column(1)) if m else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score.astype(float)), pa.array((score >= THRESHOLD).astype(np.int32)), part.column(3), part.column(4)],
                    names=["doc_id", "held_out", "score", "predicted", "k1", "k2"],
                )

    rows = id_text(docs).select("doc_id", "text", held_out_fold(F.col("doc_id")).alias("held_out"), *row_key())
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int, k1 long, k2 long")


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows whose score is threshold or more; without a model all stay. No shuffle.

    Null texts are scored as empty ones, repeated rows each alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(texts: pa.Array) -> np.ndarray:
        return sent.value.score(texts) < threshold if sent.value else np.ones(len(texts), bool)

    return filter_rows(docs, clean)
