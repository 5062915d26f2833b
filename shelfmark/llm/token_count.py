"""Token counts with the whole-token shortcut.

Offline, a vocabulary is searched for the strings that certainly encode alone as one token: the tokenizer itself
is asked for each of them, as a pre-token, and only those that come back as exactly one token are kept. At
run time a proven pre-token counts as one, and only the rest is merged.

The byte-level pattern joins a single space to what follows it, so a text whose spaces each stand before a non-space is cut
at its spaces: the pieces' pre-tokens are the text's. Proven pieces are counted; the others, joined by spaces again, are
merged together. Merging is by byte-pair ranks, once it is proven that a rank is the place in the tokenizer's list of
merges; else, and for texts with special tokens' strings with characters on which Unicode tables may differ or with a very long run of white space, it
is the library's. A tokenizer that isn't byte-level BPE is the library's altogether. Counts are the library's in every
case, and nothing is remembered between texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, slices

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which Unicode tables of different age or library may disagree: such texts go to the library whole.
ODD = "[\x1c-\x1f\x85\u180e\U00010000-\U0010ffff]"
#: A run of white space from which on a text is the library's: tiktoken's regex overflows its stack at about a million.
LONG_GAP = 100_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def resolve(vocabulary: str) -> str:
    """A vocabulary's place: a path as it is, a bare name from the installed public tokenizers."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


def proven_whole(tokenizer, spec: dict) -> frozenset[str]:
    """Vocabulary strings that the tokenizer, asked offline, encodes alone as one token and that are one pre-token."""
    import regex

    letters = {v: k for k, v in _byte_letters().items()}
    one = regex.compile(PATTERN)
    found = []
    for piece in spec["model"]["vocab"]:
        try:
            text = bytes(letters[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        m = one.match(text)
        if m and m.end() == len(text):
            found.append(text)
    encoded = tokenizer.encode_batch(found, add_special_tokens=False)
    return frozenset(t for t, e in zip(found, encoded, strict=True) if len(e.ids) == 1)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counting:
    """Counts tokens as the library does; made once per worker and vocabulary."""

    def __init__(self, path: str):
        self.path, self.fast = path, False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = lambda texts: [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if self.fast:
            import regex

            self.odd = re.compile(ODD).search
            self.long_gap = re.compile(r"\s{%d}" % LONG_GAP).search
            proven = proven_whole(self.tokenizer, spec)
            self.proven = len(proven)
            self.alone = proven
            gaps = [chr(c) for c in range(0x10000) if c not in range(0xD800, 0xE000) and regex.match(r"\s", chr(c))]
            self.gaps = tuple(" " + c for c in gaps)
            self.after_space = frozenset(t[1:] for t in proven if t[0] == " " and len(t) > 1 and t[1] not in gaps)
            self.merged = self._merger(spec)

    def _merger(self, spec: dict):
        """Counts of texts by byte-pair ranks if ids are proven to be ranks, else the library's."""
        letters = {v: k for k, v in _byte_letters().items()}
        vocab, special = spec["model"]["vocab"], set(self.special)
        plain = {k: i for k, i in vocab.items() if k not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [plain.get(a + b, -1) for a, b in merges]
        in_order = all(x < y for x, y in zip(ids, ids[1:], strict=False)) and (not ids or ids[0] >= 0)
        if not in_order or len(plain) != len(ids) + 256 or any(c not in letters for k in plain for c in k):
            return lambda texts: sum(self.whole(texts))
        import tiktoken

        ranks = {bytes(letters[c] for c in k): i for k, i in plain.items()}
        encode = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: sum(len(encode(t)) for t in texts)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.fast:
            return self.whole(texts)
        out = [0] * len(texts)
        every = "".join(texts)  # screened together first: few batches have anything to look for
        special, odd, gaps = [s for s in self.special if s in every], self.odd(every), [g for g in self.gaps if g in every]
        slow = [i for i, t in enumerate(texts) if any(s in t for s in special) or (odd and self.odd(t)) or (len(t) >= LONG_GAP and self.long_gap(t))]
        for i, n in zip(slow, self.whole([texts[i] for i in slow]) if slow else [], strict=True):
            out[i] = n
        skip, known = set(slow), self.after_space
        for i, t in enumerate(texts):
            if i in skip:
                continue
            if t.endswith(" ") or any(g in t for g in gaps):
                out[i] = self.merged([t])
                continue
            head, *pieces = t.split(" ")
            rest = [p for p in pieces if p not in known]
            out[i] = len(pieces) - len(rest)
            if rest:
                out[i] += self.merged([" " + " ".join(rest)])
            if head:
                out[i] += 1 if head in self.alone else self.merged([head])
        return out


@lru_cache(maxsize=4)
def counting(path: str) -> Counting:
    return Counting(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row for each row of docs.

    Null and empty texts have 0 bytes and 0 tokens. Map-only: no shuffle, memory bounded by a batch's slice.
    vocabulary: a tokenizer file's path (reachable on every executor) or the name of an installed public one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counting(resolve(vocabulary))
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                n = tool.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return map_arrow(id_text(docs), run, SCHEMA)
