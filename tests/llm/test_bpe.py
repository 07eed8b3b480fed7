"""BPE encoding and decoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from commitscope.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


ODD = [
    "", " ", "Hello, World!", "It's we'RE they'll I'd 'S", "naïve café ÉCOLE ñandú", "é Å ẛ̣", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endoftext", "123 4567 3.14 1e9",
    "日本語のテキスト 中文", "İstanbul İ Σίσυφος ΣΑΣ", "a\x00b \x1c \x1d\x85   ​ ﻿", "tab\tnew\nline\r\n\x0b\x0c", "🙂👩‍👩‍👧‍👦 🇩🇪", "x" * 3000, "ab" * 700 + "c" * 900, "#*$%&|<> !!! --- ___", "ﬁ ﬀ Ǆ ǅ ß ẞ",
    " nbsp ", "word.\nword,word;word", "don''t ''s '' ' s", "क्षत्रिय हिन्दी", "Ωμέγα ТЕКСТ", "²³¼ ⅷ ٣٤",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    ((ids, back),) = bpe.Coder(PATH).code([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert back.decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_random_texts(library):
    rng = random.Random(11)
    pools = ["abcdefghij'", "aeiouthnrs ", "0123456789.,", "ÀÉÎõüßçñ ", "αβγδΣς ", "的一是不了 ", " \t\n 'sST", "<|>endoftextstartoftext"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    coder = bpe.Coder(PATH)
    for text, (ids, back) in zip(texts, coder.code(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert back.decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_speculation_is_verified_and_exact_merging_agrees():
    model = bpe.Bpe(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    found, failing = model.encode_words(words)
    assert found == model.merge_all(words)
    assert 0 < failing < len(words)


def test_query(spark, data, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = bpe.op8_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id] or "")


def test_odd_rows(spark, documents, library):
    docs = documents([(1, None), (2, ""), (3, "twice"), (3, "twice"), (None, "null id"), (4, "long text " * 50_000)], ids="x", n_tokens="y")
    got = bpe.digests(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[:3] == [(0, 2), (1, 0), (2, 0)]
    assert len(got) == 6 and {r.n_tokens for r in got if r.doc_id == 4} == {100_000}
    whole = {r.doc_id: r.decoded for r in bpe.encode(docs, PATH).collect()}
    assert whole[1] == whole[2] == "" and whole[3] == library.decode(library.encode("twice", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.digests(documents([]), PATH).count() == 0


def test_small_cache_gives_the_same(monkeypatch):
    texts = [" ".join(f"word{k * j % 97}" for j in range(50)) for k in range(60)]
    want = [ids.tolist() for ids, _ in bpe.Coder(PATH).code(texts)]
    monkeypatch.setattr(bpe, "CACHE", 40)
    monkeypatch.setattr(bpe, "SLICE", 500)
    assert [ids.tolist() for ids, _ in bpe.Coder(PATH).code(texts)] == want


def test_byte_level_encoder_of_packing():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    for text in [*ODD, "a  b   c\n\n d 　 e", " leading", "trailing  "]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
