import zlib

import numpy as np
from pyspark.sql import functions as F

from nestfold.llm import toxicity as tx


def test_machine_adds_pairs():
    m = tx.Machine(np.array([3, 8]), -2.0, np.array([0.5, 0.25]), np.array([[1.0, 2.0], [3.0, -1.0]]))
    got = m.score(3, np.array([0, 1, 1]), np.array([0, 0, 1]))
    raw = np.array([-1.5, -1.25 + (1 * 3 + 2 * -1), -2.0])
    assert np.allclose(got, 1 / (1 + np.exp(-raw)))


def corpus(n=400):
    """Insults are toxic alone; two harmless words are toxic only together."""
    r = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        words = ["w" + "abcdefghij"[r.integers(10)] * 3 + str(r.integers(9)) for _ in range(30)]
        kind = i % 4
        if kind == 0:
            words[r.integers(30)] = "Grobian"
        elif kind == 1:
            words[3] = "marsh"
        elif kind == 2:
            words[9] = "people"
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind == 0)))
    return docs, labels


def test_held_out_accuracy_and_contract(spark, docs_of):
    docs, labels = corpus()
    lab = spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs_of(docs + [(9001, None), (9002, ""), (9002, "")]), lab).collect()}
    truth = dict(labels)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert all(got[d].predicted == t for d, t in truth.items())
    assert got[9001].score == got[9002].score < 0.5


def test_pair_of_evenly_spread_words(spark, docs_of):
    r = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(800):
        words = ["w" + "abcdefghij"[r.integers(10)] * 3 + "klmnopqrst"[r.integers(10)] for _ in range(8)]
        words += ["marsh"] * (i % 4 in (1, 3)) + ["people"] * (i % 4 in (2, 3))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 in (1, 2))))
    got = {x.doc_id: x for x in tx.toxicity(docs_of(docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert sum(got[d].predicted == t for d, t in labels if got[d].held_out) >= 0.95 * sum(x.held_out for x in got.values())


def test_rare_class_is_sampled_whole(spark, docs_of):
    docs, labels = corpus(2400)
    toxic = {d for d, t in labels if t}
    keep = set(sorted(toxic)[:48])
    docs = [x for x in docs if x[0] not in toxic - keep]
    lab = spark.createDataFrame([x for x in labels if x[0] not in toxic - keep], "doc_id long, toxic int")
    sample, ratio = tx.labelled_sample(lab, 200)
    train = {d for d in keep if zlib.crc32(str(d).encode()) % 5}
    assert {x.doc_id for x in sample.where("toxic = 1").collect()} == train and sample.count() == 200 and ratio > 1
    got = {x.doc_id: x.toxic_score for x in tx.score(docs_of(docs), tx.fit(docs_of(docs), lab, limit=200)).collect()}
    assert {d for d, v in got.items() if v >= 0.5} == keep


def test_few_toxic_rows_are_learned(spark, docs_of):
    docs, labels = corpus(44)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {x.doc_id: x.score for x in tx.toxicity(docs_of(docs), lab).collect()}
    assert all((scores[d] >= 0.5) == bool(t) for d, t in labels)


def test_held_out_labels_do_not_matter(spark, docs_of):
    docs, labels = corpus(200)
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    frames = [spark.createDataFrame([(d, t if not (flip and out(d)) else 1 - t) for d, t in labels], "doc_id long, toxic int") for flip in (False, True)]
    a, b = ({r.doc_id: r.score for r in tx.toxicity(docs_of(docs), f).collect()} for f in frames)
    assert a == b


def test_without_labels_and_empty(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        rows = tx.toxicity(docs_of([(1, "a b"), (None, "x")]), labels).collect()
        assert [r.predicted for r in rows] == [0, 0] and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert tx.toxicity(docs_of([]), none).collect() == []


def test_rejecting_keeps_columns(spark, docs_of):
    docs, labels = corpus(200)
    df = docs_of(docs)
    kept = tx.reject_toxic(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, t in labels if not t}
    assert kept.where(F.col("component_id") != 5).count() == 0


def test_null_texts_stay_under_a_toxic_majority(spark):
    docs = spark.createDataFrame([(i, "bad insult here" if i % 4 else "fine words") for i in range(200)] + [(999, None), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = [r.doc_id for r in tx.reject_toxic(docs, labels).collect()]
    assert 999 in kept and None in kept and all(i is None or i == 999 or i % 4 == 0 for i in kept)
