"""Token counts against the tokenizers library on whole texts."""

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from millrace.llm import token_counts as module
from millrace.llm.token_counts import PreTokens, op12_token_counts, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  \n\t ", "It begins here.", "a" * 3000, "ab ab ab ab " * 400, "été 日本語 😀 naïve", "x\n\n  y \x00 z  ", "<|endoftext|>",
    "one <|endoftext|> two<|endoftext|><|endoftext|>  three", "<|endoftext", "don't we'll I've  it's\x1c\x1d a\x85b c 　d", "࢏౜ letters࢏ ࢏",
    " ".join(f"word{i % 977}x{i}" for i in range(20_000)), "It begins here.", "\ttabs\tand  spaces   end   ", "👩‍👩‍👧 é ﻿ ٣٤ ½",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_equals_the_library(spark, library):
    rows = [(None if i % 5 == 3 else i // 2, t, 1, 2, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes int, chunk string")
    found = [tuple(r) for r in token_counts(docs, FILE, 20).collect()]
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 20))
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert token_counts(docs.limit(0), FILE).collect() == []


def test_query_equals_the_library(spark, library):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_tokens, r.over_limit) for r in op12_token_counts(spark, data).collect()}
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    assert found == {i: (n, n > 1024) for i, n in want.items()}


def test_each_pre_token_is_counted_once(monkeypatch, library):
    split = PreTokens(open(FILE, "rb").read())
    words, word, doc, times, special = split.frequencies(["b a a b<|endoftext|> a", "", " a b"])
    assert len(words) == len(set(words))
    assert [(words[w], d, n) for w, d, n in zip(word, doc, times, strict=True)] == [("b", 0, 1), (" a", 0, 3), (" a", 2, 1), (" b", 0, 1), (" b", 2, 1)]
    assert special.tolist() == [1, 0, 0]
    monkeypatch.setattr(module, "AT_ONCE", 2)
    assert split.counts([b" a", b" unbelievably", "日本".encode()]).tolist() == [len(library.encode(x).ids) for x in (" a", " unbelievably", "日本")]


def test_splits_all_characters_as_the_library(library):
    split = PreTokens(open(FILE, "rb").read())
    for c in [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x20000, 3), *range(0xE0000, 0xE0200)]:
        text = f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}1 .{chr(c)}"
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert [p for part in split.parts(text) for p in split.pieces(part)] == want, hex(c)


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        PreTokens(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    assert isinstance(PreTokens(open(FILE, "rb").read()).special, regex.Pattern)
