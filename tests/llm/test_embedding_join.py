import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.llm import embedding_join as ej


def brute(rows, c):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {i: (0, i, True) for i, _ in rows}
    ids = [i for i, _ in ok]
    unit = [v / np.abs(v).max() for _, v in ok]
    unit = [v / np.linalg.norm(v) for v in unit]
    link = {i: [j for j, w in zip(ids, unit) if j != i and len(w) == len(v) and w @ v >= c] for i, v in zip(ids, unit)}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(link[i]), min(seen), min(seen) == i)
    return out


def joined(spark, rows, c, **kw):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rep int, weight int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ej.embedding_range_join(df, c, **kw).collect()}


@pytest.mark.parametrize("c", [0.9, 0.999])
def test_equals_brute_force_over_cells_and_blocks(spark, monkeypatch, c):
    monkeypatch.setattr(ej, "CELL_BLOCK", 90)  # hot cells meet block by block
    monkeypatch.setattr(ej, "CHUNK_VISITS", 100)  # and their visitors in chunks
    r = np.random.default_rng(3)
    x = r.normal(size=(260, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7].tolist()) for i in range(120)]  # exact copies
    rows += [(2000 + i, (x[5] + r.normal(size=3) * 0.03).tolist()) for i in range(200)]  # a large near group
    rows += [(3000, None), (3001, []), (3002, [0.0, 0.0, 0.0]), (3003, [1.0, None, 2.0]), (3004, [float("nan"), 1.0, 1.0]), (3005, [float("inf"), 1.0, 1.0])]
    rows += [(3006, [1e-200, 0.0, 0.0]), (3007, [1e200, 0.0, 0.0]), (3008, [1.0, 1.0]), (3009, [1.0, 1.01]), (3010, [-0.0, 0.0, 5.0]), (3011, [0.0, 0.0, 5.0])]
    assert joined(spark, rows, c, cell_rows=40) == brute(rows, c)


@pytest.mark.parametrize("least", [ej.LEAST_GAP, 0.0])
def test_pivots_that_differ_in_the_last_bits(spark, monkeypatch, least):
    monkeypatch.setattr(ej, "LEAST_GAP", least)
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 8)) * 0.15
    x[:, 0] += 1
    first = [w.id for w in spark.range(600).orderBy(F.xxhash64("id"), "id").limit(2).collect()]  # the two pivots
    x[first[0]] = [1.0] + [0.0] * 7
    x[first[1]] = [1.0, 5e-9] + [0.0] * 6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert joined(spark, rows, 0.9, cell_rows=300) == brute(rows, 0.9)


def test_threshold_is_decided_in_double_precision(spark):
    a = np.array([1.0, 0.0])
    rows = [(i, a.tolist()) for i in range(1)]
    for n, gap in enumerate((-1e-9, 1e-9), 1):
        cos = 0.9 + gap
        rows.append((n, [cos, float(np.sqrt(1 - cos * cos)) * (1 if n == 1 else -1)]))
    assert joined(spark, rows, 0.9) == brute(rows, 0.9) == {0: (1, 0, True), 1: (0, 1, True), 2: (1, 0, False)}


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = ej.embedding_range_join(df).collect()
    assert sorted((r.vec_id or -1, r.n_links if r.n_links is not None else -1) for r in rows) == [(-1, -1), (5, 1), (5, 1)]
    assert ej.embedding_range_join(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
