import random
import re
import zlib
from collections import Counter

import pytest

from nestfold.llm import spelling


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, every=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(spark, docs, **kw):
    rows = spelling.spelling_forms(docs, **kw).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def edits(r, word, letters):
    i = r.randrange(len(word) + 1)
    return r.choice([word[:i] + word[i + 1 :], word[:i] + r.choice(letters) + word[i + 1 :], word[:i] + r.choice(letters) + word[i:]])


def test_listed_grams_meet_for_every_edit():
    """Two words at distance one share a listed gram at the positions that the join compares."""
    r = random.Random(5)
    for _ in range(20000):
        letters = r.choice(["ab", "abc", "abcdefgh"])
        word = "".join(r.choice(letters) for _ in range(r.randrange(5, 12)))
        other = edits(r, word, letters)
        if len(other) < 5 or other == word:
            continue
        pool = [(spelling.OPEN + w + spelling.CLOSE)[i : i + q] for w in (word, other, "aabab") for q in (2, 3) for i in range(len(w))]
        some = {g: r.randrange(9) for g in pool if r.random() < 0.5}
        often = {g: n for g, n in some.items() if len(g) == 2 or g[:2] in some}
        short, long = sorted((word, other), key=len)
        a, b = set(spelling.listed_grams(short, often)), set(spelling.listed_grams(long, often))
        step = len(long) - len(short)
        assert a & b or {(p + step, g) for p, g in a} & b, (short, long, often)


@pytest.mark.parametrize("block", [spelling.LIST_BLOCK, 8])
def test_equals_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(spelling, "LIST_BLOCK", block)
    r = random.Random(1)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randrange(5, 9))) for _ in range(60)] + ["naïve÷", "Straße", "ÀÉÎõü"]
    rows = []
    for d in range(300):
        words = [r.choice(base) for _ in range(30)]
        words = [edits(r, w, "abcdeé") if r.random() < 0.3 else w for w in words]
        rows.append((d, " ".join(w.upper() if r.random() < 0.2 else w for w in words)))
    rows += [(None, "abcabc abcabd abcabc abcabc"), (900, None), (901, ""), (902, "1 2 ,.;"), (903, "longword" * 4000), (904, "longword" * 4000), (905, "longword" * 4000)]
    rows += [(5, "repeated rows repeated")] * 4
    want = brute(rows)
    assert any(v[0] for v in want.values()) and any(v[3] > 5 for v in want.values())
    assert got(spark, docs_of(rows)) == want


def test_chains_end_at_their_root(spark, docs_of):
    counts = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 48, "cccccc": 4, "ccccccc": 7}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    found = got(spark, docs_of(rows), every=1 << 33)
    assert found == brute(rows, every=1 << 33)
    assert found["aaaaaa"][:2] == ("aaaaab", "aabbbb") and found["cccccc"] == (None, "cccccc", 4, 1, None)


def test_empty(spark, docs_of):
    assert got(spark, docs_of([])) == {} and got(spark, docs_of([(1, None)])) == {}


def test_bounded_dictionary(spark):
    words = spark.range(5000).selectExpr("concat('w', translate(hex(id), '0123456789ABCDEF', 'abcdefghijklmnop'), 'xyz') word", "3L n")
    often = spelling.frequent_grams(words)
    assert all(len(g) in (2, 3, 4) for g in often) and max(Counter(map(len, often)).values()) <= spelling.FREQUENT
