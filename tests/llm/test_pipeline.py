import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from nestfold.llm import common, secret_scan

from test_ngram_join import brute


def test_components_equal_brute_force(spark):
    import random

    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (None, 3)] + [(900, 1000 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few toxic documents to learn from
    docs = common.table(spark, sf, "documents")
    before = docs.columns
    kept = docs
    sizes = [docs.count()]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = {r.doc_id: r.text for r in kept.collect()}
        kept = common.stored(stage(spark, kept, sf), name)
        assert kept.columns == before
        texts[name] = {r.doc_id: r.text for r in kept.collect()}
        assert set(texts[name]) <= set(given)
        sizes.append(len(texts[name]))
        if name == "near_copies":
            want = brute(list(given.items()), 5, 80, 100)
            assert set(texts[name]) == {d for d, (_, c) in want.items() if c == d}
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    changed = [d for d, t in texts["secrets"].items() if t != texts["benchmark"][d]]
    assert changed and all(secret_scan.REPLACEMENT in texts["secrets"][d] for d in changed)
    last = corpus_pipeline.encode_tokens(spark, kept, sf).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(last) == sizes[-1]
    for r in last:
        assert r.ids == lib.encode(texts["secrets"][r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
