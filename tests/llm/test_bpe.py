import hashlib
import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import bpe

PATH = bpe.vocabulary_path()


def whole(own, text):
    e = own.library.encode(text, add_special_tokens=False)
    return " ".join(map(str, e.ids)), own.library.decode(e.ids, skip_special_tokens=False)


def test_pieces_equal_the_library():
    own, rng = bpe.Encoder(PATH, kept=50), random.Random(1)
    letters = [*"abthe '’.,;:!?éÉσΣİ12 ̸́ß“” \x1f\x85\n", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "Tion", "ÇA"]
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert own.encode(text) == whole(own, text), text


@pytest.mark.parametrize("leaf", [1, 7, 40])
def test_concatenated_texts_equal_the_library(leaf):
    """Halved wherever it falls: inside words, marks, special tokens, letters with accents of their own and white space."""
    own, rng = bpe.Encoder(PATH, leaf=leaf, kept=500), random.Random(leaf)
    words = ["the", "Quick", "naïve", "e\u0301a\u0302", "it's", "don't,", "...", "a.b", "12345", "<|endoftext|>", "x<|startoftext|>y", "<|endof", "text|>", "’", "σΣ", "internationalisation", "İ", "!?"]
    blanks = [" ", "  ", "\n", "\t \r\n", "\x1f", "\u3000", "", "\x85"]
    for _ in range(1200):
        text = "".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(1, 60)))
        assert own.encode(text) == whole(own, text), text
    assert own.joins > 1200


def test_documents_table_is_joined_and_equals_the_library(spark):
    """The whole table at this size: the query's hashes are those of the library's ids and decoded text, and long texts are joined."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    own = bpe.Encoder(PATH)
    for r in bpe.op9_bpe(spark, sf).collect():
        e = own.library.encode(texts[r.doc_id] or "", add_special_tokens=False)
        assert r.n_tokens == len(e.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    for t in texts.values():
        own.encode(t)
    assert own.joins == sum(inner_nodes(len(t or ""), own.leaf) for t in texts.values()) > 50


def inner_nodes(n, leaf):
    return 0 if n <= leaf else 1 + inner_nodes(n // 2, leaf) + inner_nodes(n - n // 2, leaf)


def test_joins_grow_their_windows():
    own = bpe.Encoder(PATH, leaf=64)
    text = "start " + "word" * 40 + " middle " + "!?" * 50 + " " * 200 + "end"
    assert own.encode(text) == whole(own, text) and own.joins > 4


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError, match="tree concatenation"):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"model": {**spec["model"], "end_of_word_suffix": None}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        (tmp_path / "v.json").write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError, match="tree concatenation"):
            bpe.Encoder(str(tmp_path / "v.json"))


@pytest.mark.parametrize("leaf", [3, 8, 64])
def test_concatenated_units_equal_the_library(leaf):
    own, rng = bpe.Encoder(PATH, leaf=leaf), random.Random(leaf)
    kinds = (["th", "e", "an", "ing", "a", "aa", "é", "1", "!!", "'s", "<|endoftext|>"], ["a", "b", "t", "h", "e"], ["a"], ["!", "-"])
    for i in range(1500):
        text = "".join(rng.choice(kinds[i % 4]) for _ in range(rng.randint(1, 150)))
        assert own.encode(text) == whole(own, text), text


def test_very_long_unsplit_text():
    own = bpe.Encoder(PATH)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij") for _ in range(60_000))
    assert own.encode(text) == whole(own, text)


def test_documents(spark):
    texts = [None, "", " \n\t", "Hello, world!", "Hello, world!", "x" * 9000, "naïve <|endoftext|> it's", "ΣΑΣ"]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, digest=True).collect()}
    plain = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    own = bpe.Encoder(PATH)
    for i, t in enumerate(texts):
        ids, decoded = whole(own, t or "")
        assert got[i].n_tokens == len(ids.split())
        assert got[i].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert " ".join(map(str, plain[i].ids)) == ids and plain[i].decoded == decoded == bpe.decode(plain[i].ids)
    assert bpe.encode_documents(docs.where(F.lit(False)), digest=True).count() == 0


def test_spread_documents(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefth") for _ in range(3000))
    texts = ["short one", f"Some words {long}, and {long[:700]}!!! more", long * 3, f"<|endoftext|>{long}<|endoftext|> é{long[:301]}", "'s" * 900, "x" * 299, "x" * 300, None, f"{long}\n{long}", "é̸" * 800]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, digest=True, keep=("source",), part=300).collect())
    own, want = bpe.Encoder(PATH), []
    for i, t in enumerate([*texts, texts[2]]):
        ids, decoded = whole(own, t or "")
        want.append((i, f"s{i}", len(ids.split()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == want
    plain = {r.doc_id: r for r in bpe.encode_documents(docs, part=300).collect()}
    assert all(" ".join(map(str, plain[i].ids)) == whole(own, t or "")[0] for i, t in enumerate(texts))
