import pytest

from shelfmark.llm.token_count import counting, resolve, token_counts


def library(name, texts):
    path = resolve(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, messy, texts, nothing, name):
    odd = ["<|endoftext|> twice <|endoftext|>", "it's  we'll\n\n tabs\t\t end  ", "a\x1cb\x85c\u180ed", "𝒳𝒴 😀😀 \u200b zero", "1234567 ½ Ⅷ", "\u3000全角 葱油饼", " lead", "trail ", "a  b", "a \n b", "a\n b\n\n c", "x\u00a0 y \u00a0z", "'s 's it's 't", " ", "  ", "\n", "a\t b \tc"]
    df = messy.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    every = [t or "" for _, t, _ in texts] + odd
    got = token_counts(df, name, limit=20).collect()
    want = library(name, every)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len(t.encode()), n) for t, n in zip(every, want, strict=True))
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert token_counts(nothing, name).count() == 0


def test_proof_covers_most_of_the_vocabulary():
    c = counting(resolve("byte_bpe_50k.json"))
    assert c.fast and c.proven > 40_000
    assert c.counts(["the the"]) == [2]


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, "byte_bpe_50k.json").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert [got[r.doc_id] for r in rows] == library("byte_bpe_50k.json", [r.text for r in rows])


def test_cut_at_spaces_equals_the_library(texts):
    import random

    rng = random.Random(3)
    made = ["".join(rng.choice([" ", " ", "\n", "\t", "\u00a0", "a", "B", "é", "1", "'s", ".", "!!", "葱"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    c = counting(resolve("byte_bpe_50k.json"))
    assert c.counts(made) == library("byte_bpe_50k.json", made)


def test_very_long_white_space_equals_the_library(spark):
    texts = ["\n" * 1_000_000 + "x", " " * 1_200_000, "a" + "\n" * 99_999 + "b c", "plain text"]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "byte_bpe_50k.json").collect()}
    assert [got[i] for i in range(len(texts))] == library("byte_bpe_50k.json", texts)
