import random
import re

import numpy as np
import pytest

from nestfold.llm import chars, ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def joined(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_jaccard_join(df, **kw).collect()}


def near_copies(r, n, edits=6):
    base = [r.choice("abcdefghij") + str(r.randint(0, 50)) for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(150)] = str(r.random())
        out.append(" ".join(w))
    return out


def test_equals_brute_force_with_hot_group_and_edge_cases(spark, docs_of, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", 60)  # the large cluster is verified in blocks
    r = random.Random(5)
    texts = near_copies(r, 260) + [" ".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(120)]
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"), (9005, "one two"), (9006, "ONE  two"), (9007, "é É")]
    assert joined(docs_of(docs), k=4, num=85, den=100) == brute(docs, 4, 85, 100)


def test_frequent_tokens_go_through_combinations(spark, docs_of):
    """A group far above the noise of its buckets: its tokens are frequent, the links are the same."""
    r = random.Random(6)
    docs = list(enumerate(near_copies(r, 150, edits=5)))
    s = [np.unique(x) for x in nj.shingle_sets([t for _, t in docs], 5)]
    counts = np.bincount((np.concatenate(s) >> np.uint64(64 - nj.BUCKET_BITS)).astype(int), minlength=1 << nj.BUCKET_BITS)
    levels = np.where(counts > 8, 3, 0).astype(np.uint8)
    assert any(len(nj.index_keys(x, levels, 80, 100)[2]) for x in s)
    assert joined(docs_of(docs)) == brute(docs, 5, 80, 100)


def test_similar_sets_share_an_index_key():
    """Prefixes, extensions and combinations never miss a similar pair, whatever the levels."""
    r = np.random.default_rng(8)
    for trial in range(300):
        n = int(r.integers(2, 120))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = a.copy()
        b[r.integers(0, len(b), int(len(b) * 0.08))] = r.integers(0, 1 << 63, int(len(b) * 0.08), dtype=np.uint64)
        b = np.unique(b)
        common = len(np.intersect1d(a, b))
        if len(a) < 2 or len(b) < 2 or common * 100 < 85 * (len(a) + len(b) - common):
            continue
        levels = (r.random(1 << nj.BUCKET_BITS) < (0, 0.3, 0.9, 1)[trial % 4]).astype(np.uint8)
        x, y = (nj.index_keys(s, levels, 85, 100) for s in (a, b))
        assert len(np.intersect1d(x[0], y[0])) or len(np.intersect1d(x[2], y[2]))
        single = np.intersect1d(np.concatenate(x[:2]), np.concatenate(y[:2]))
        assert len(single) >= max(x[3], y[3])


def test_shared_keeps_exactly_the_keys_of_two_sets():
    import pyarrow as pa

    r = np.random.default_rng(2)
    rows = sorted(zip(r.integers(0, 60, 400).tolist(), r.integers(0, 9, 400).tolist()))
    cuts = sorted(r.integers(0, 400, 30).tolist())
    batches = []
    for a, b in zip([0, *cuts], [*cuts, 400]):
        part = rows[a:b]
        if part:
            batches.append(pa.RecordBatch.from_arrays([pa.array([p[0] for p in part]), pa.array([0] * len(part), pa.int32()), pa.array([p[1] for p in part])], names=["key", "meta", "sid"]))
    got = [(k, s) for x in nj._shared(iter(batches)) for k, s in zip(x.column(0).to_pylist(), x.column(2).to_pylist())]
    want = sorted({p for p in rows if len({q[1] for q in rows if q[0] == p[0]}) > 1})
    assert got == want


def test_hash_of_long_text_equals_hash_of_short_one(monkeypatch):
    cps, offsets = chars.codepoints(["alpha beta " * 40])
    starts, ends = nj.ascii_words(cps, offsets)
    short = chars.hash_spans(cps, starts, ends)
    monkeypatch.setattr(chars, "SLAB", 16)
    assert (chars.hash_spans(cps, starts, ends) == short).all()


def test_null_ids_and_empty_table(spark, docs_of):
    rows = nj.ngram_jaccard_join(docs_of([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (4, 4), (4, 4)]
    assert nj.ngram_jaccard_join(docs_of([])).collect() == []


@pytest.mark.parametrize("n", range(1, 400))
def test_levels_of_similar_sizes_are_neighbours(n):
    for num, den in ((85, 100), (80, 100)):
        m = n * den // num
        assert nj.size_level(m, num, den) - nj.size_level(n, num, den) <= 1
