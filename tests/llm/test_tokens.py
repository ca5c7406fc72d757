"""Token counts and the codec against the tokenizers library."""

import hashlib
import random
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from genospark.llm import bpe_codec, token_counts  # noqa: E402
from genospark.llm.bpe import BpeModel  # noqa: E402

BYTES, WORDS = public_tokenizers.path(token_counts.VOCABULARY), public_tokenizers.path(bpe_codec.VOCABULARY)
ODD = [
    "", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>X<|endoftext|>", "<|endoftext", "ΣΑΣ ΟΔΟΣ", "İstanbul", "x\x1cy\x1dz\x1f \x85", "a" * 3000, "é" * 999 + " \n\n  \t x", "don't I'LL they're",
    "数字 123 ４５ Ⅷ", "　 x  ", "ﬁ ｆｕｌｌ", "ẞ ẞ", "é ́", "﻿ hi", "🏡🏡 👩‍👩‍👧", "!!!???...", "tab\tsep",
]


def texts():
    rng = random.Random(4)
    letters = "abcdeABCDE éüñß 0123 \n\t.,'!?-_<|>"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]


def test_counts():
    library, own = tokenizers.Tokenizer.from_file(BYTES), token_counts.TokenCounter(BYTES)
    for text in texts():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert own.count(None) == 0


def test_codec():
    library, own = tokenizers.Tokenizer.from_file(WORDS), bpe_codec.BpeCodec(WORDS)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        plain = library.decode(ids, skip_special_tokens=False)
        assert own.decode(ids) == plain
        assert own.digests(text) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())
    assert own.encode(None) == []


def test_forced_boundaries_change_nothing():
    own = bpe_codec.BpeCodec(WORDS)
    for word in ("retitioning", "zqxjk", "öçüß", "a" * 200, "xqzv" * 50):
        data = word.encode()
        whole = own.model.symbols(data)
        own.model.merge(whole)
        assert own.encode_word(word) == [i for i in whole if i >= 0]
        assert b"".join(own.fragments(data)) == data


def test_merge_counts_symbols():
    model = BpeModel(BYTES)
    ids = model.symbols(b"hello world")
    merges = model.merge(ids)
    assert len([i for i in ids if i >= 0]) == 11 - merges


def test_frames(spark):
    rows = [(1, "hello world", "x", 5), (1, "hello world", "x", 5), (2, None, None, 1), (3, "", "", None), (4, "q " * 2000, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, over_limit int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, BYTES).collect()}
    assert got[2] == got[3] == (0, 0, False) and got[4][2] is True and got[1][0] == 11
    coded = bpe_codec.encode_digests(docs, WORDS)
    assert coded.count() == 5 and coded.columns == ["doc_id", "text", "over_limit", "n_tokens", "ids_sha256", "decoded_sha256"]
    both = docs.select("doc_id", bpe_codec.encoded("text", WORDS).alias("ids")).withColumn("text", bpe_codec.decoded("ids", WORDS)).where("doc_id = 1").first()
    assert both["text"] == "hello</w> world</w>" and len(both["ids"]) == 2
    none = docs.limit(0)
    assert token_counts.count_tokens(none, BYTES).count() == 0 and bpe_codec.encode_digests(none, WORDS).count() == 0
