import hashlib

import numpy as np
import pytest

from nestfold.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, error long, code string"


def brute(rows, scale=1024, n_parts=4, entries=256, rounds=4):
    """Python integers throughout."""
    kept = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // n_parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(n_parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    best = lambda x, book: min((far(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            took = {}
            for _, v, _ in kept:
                took.setdefault(best(part(v, p), book)[1], []).append(part(v, p))
            new.append([[sum(c) // len(took[j]) for c in zip(*took[j])] if j in took else e for j, e in enumerate(book)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        found = [best(part(v, p), books[p]) for p in range(n_parts)]
        coded.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, e in coded:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, label, c, e in coded), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in vc.vector_codes(df, **kw).collect()), key=str)


def test_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), np.round(r.normal(size=8), 2).tolist(), int(i) % 3 if i % 5 else None) for i in range(120)]
    rows += [(500 + i, rows[7][1], 1) for i in range(60)]  # a hot group of copies
    rows += [(7, rows[7][1], 1), (7, [0.5] * 8, 2), (None, [0.25] * 8, 2)]
    rows += [(700, None, 1), (701, [], 1), (702, [1.0] * 7 + [None], 1), (703, [float("nan")] + [1.0] * 7, 1), (704, [float("-inf")] + [1.0] * 7, 1)]
    assert got(spark, rows, entries=20) == brute(rows, entries=20)


def test_ties_few_rows_and_unused_entries(spark):
    rows = [(1, [0.0, 0.0, 0.0, 0.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1), (3, [-0.0005, 0.5, 1.0, -2.0], None)]
    assert got(spark, rows) == brute(rows)


def test_large_components_need_limbs(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=4) * 2e4).tolist(), 0) for i in range(40)]
    assert got(spark, rows, entries=8) == brute(rows, entries=8)
    with pytest.raises(ValueError, match="too large"):
        got(spark, [(1, [1e9] * 4, 0)])
    with pytest.raises(ValueError, match="one length"):
        got(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)])


@pytest.mark.parametrize("bits", [None, 3, 11])
@pytest.mark.parametrize("size", [10, 1 << 20, 1 << 28])
def test_limb_products_are_exact(bits, size):
    r = np.random.default_rng(size)
    x, y = r.integers(-size, size + 1, (9, 16)), r.integers(-size, size + 1, (7, 16))
    x[0], y[0] = -size, size
    want = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in y] for u in x]
    assert vc.limb_dot(x, y, bits).tolist() == want
    for part in vc.limbs(x, bits or vc.limb_bits(16)):
        assert np.abs(part).max() <= 1 << (bits or vc.limb_bits(16))
    assert 16 << (2 * vc.limb_bits(16)) <= 1 << 53


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
