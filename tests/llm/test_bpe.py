import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nestfold.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe(PATH)


def texts():
    r = random.Random(4)
    odd = "  \n\t\x1c\x85\xa0abzéßΣσ日٣½²'stI'm.,!😀ÉİＡé"
    out = ["", "   ", "a</w>b", "</w>", "<|endoftext|>x <|startoftext|>", "it's 's 'LL", "aaaaaaaaaaaaaaa !!!!!!!!!", "ΟΔΟΣ Σ", "x" * 5000]
    out += ["".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    return out + ["".join(r.choice("aeinorsth") for _ in range(r.randint(1, 30))) for _ in range(3000)]


def test_ids_and_decoding_equal_library(lib, coder):
    t = texts()
    ids, begins, decoded = coder.encode(t)
    want = lib.encode_batch(t, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])] == [w.ids for w in want]
    assert decoded == [lib.decode(w.ids, skip_special_tokens=False) for w in want]


def test_repeated_merges_by_rank():
    """Every string over two letters gives the ids of merging by rank, with rules that overlap."""
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "b"), ("ab", "a"), ("aa", "ab"), ("bb", "a"), ("aba", "bb")]
    vocab = {t: i for i, t in enumerate(["a", "b", *[x + y for x, y in merges]])}
    table = bpe.MergeTable(vocab, merges, word_end="")

    def plain(word):
        parts = list(word)
        while True:
            ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not ranked:
                return [vocab[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 13):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> i & 1] for i in range(n))
            assert table.encode(word) == plain(word), word


def test_operator_nulls_repeats_and_empty(spark, docs_of, lib):
    rows = [(1, None), (2, ""), (3, "Hello WORLD 42"), (3, "Hello WORLD 42"), (None, "x")]
    got = bpe.encode_documents(docs_of(rows), PATH).collect()
    assert len(got) == 5
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in got)[1] == (1, [], "")
    hello = [r for r in got if r.doc_id == 3]
    assert hello[0] == hello[1] and hello[0].ids == lib.encode("Hello WORLD 42", add_special_tokens=False).ids
    assert bpe.encode_documents(docs_of([]), PATH).collect() == []


def test_query_digests(spark, sf, lib):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.queries()["op5_bpe_codec"](spark, sf).collect():
        e = lib.encode(text[r.doc_id] or "", add_special_tokens=False)
        assert r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
