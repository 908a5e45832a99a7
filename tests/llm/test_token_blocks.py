import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nestfold.llm import token_blocks as tb

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", " a\n\n b \n", "it's 's I'll", "<|endoftext|>x", "é ß\x1c\x85١٣½²😀", "日本 x_y  --", "\t\ta", "Ends with blanks   "]


@pytest.mark.parametrize("n", [0, 1, 7, 127, 128, 129, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32 - 1])
def test_pack_round_trip_and_random_access(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::40] = 2**32 - 1
    data = tb.pack(ids)
    assert (tb.unpack(data) == ids).all()
    assert (tb.unpack(data, n // 3, n // 2 + 1) == ids[n // 3 : n // 2 + 1]).all()


def test_outliers_are_exceptions_not_width():
    ids = np.full(128, 5, np.uint32)
    ids[3] = 2**31
    assert len(tb.pack(ids)) < 60


def test_encoder_equals_library():
    lib = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    letters = list(" \n\t abzéß'stmdrevl.,-1٣½日😀\x1c ")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    got = list(tb.Encoder(PATH, cache_words=50).encode(texts))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want


def test_documents_read_back(spark, docs_of, monkeypatch):
    monkeypatch.setattr(tb, "SEGMENT_TOKENS", 50)
    lib = Tokenizer.from_file(PATH)
    texts = [*ODD, None, "long word " * 3000, "same", "same"]
    rows = [(i * 3 % len(texts), t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in tb.token_blocks(docs_of(rows), PATH).collect()}
    start = 0
    for d, t in sorted(rows):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_null_ids_ties_and_empty_table(spark, docs_of):
    rows = tb.token_blocks(docs_of([(None, "a"), (2, "b"), (2, "b"), (2, None)]), PATH).collect()
    assert sorted((r.start, r.n_tokens) for r in rows)[0] == (0, 2)
    assert len(rows) == 4 and [r.doc_id for r in rows].count(2) == 3
    assert tb.token_blocks(docs_of([]), PATH).collect() == []
