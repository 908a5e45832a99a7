import re

from nestfold.llm import decontaminate as dc

ITEM = "{a} has {n} apples and gives {m} apples to {b} while {k} birds watch from the old wooden fence near {c}."
ITEMS = [
    (1, ITEM.format(a="Tom Becker", n=3, m=2, b="Anna", k=3, c="Rome")),
    (2, "tiny"),
    (3, None),
    (4, "Every morning the train from Oslo leaves at 7 hours sharp with 120 people"),
    (5, "only five small plain words"),
    (None, "an item without an id that nobody can report at all"),
]


def filled(**kw):
    return "Intro words here. " + ITEM.format(**kw) + " More text follows."


def found(spark, docs_of, docs, items=ITEMS):
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, pos int, hash long")
    return {(r.doc_id, r.item_id): (r.covered, r.item_tokens, r.slots, r.changed) for r in dc.contaminated(docs_of(docs), bench).collect()}


def test_copies_reparameterised_and_clean(spark, docs_of):
    docs = [
        (10, filled(a="Ann Lee", n=5, m=4, b="Bob", k=5, c="Paris")),
        (11, filled(a="Tom Becker", n=3, m=2, b="Anna", k=3, c="Rome").lower()),
        (12, "the old wooden fence near Rome stands there"),
        (13, None),
        (14, ""),
        (None, filled(a="Tom", n=3, m=2, b="Anna", k=3, c="Rome")),
        (15, "he said that Every morning the train from Bergen Town leaves at 9 hours sharp with 80 people today"),
        (16, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"),
        (17, "word " * 20000 + ITEMS[3][1]),
        (18, "We need ONLY five, small: plain words!"),
        (18, "We need ONLY five, small: plain words!"),
    ]
    got = found(spark, docs_of, docs)
    assert set(got) == {(10, 1), (11, 1), (15, 4), (17, 4), (18, 5)}
    assert got[10, 1][3] > 0 and got[17, 4][3] == 0
    assert got[17, 4][0] == got[17, 4][1]


def test_slots_must_agree(spark, docs_of):
    item = "alpha 1 beta 2 gamma 1 delta 2 epsilon 1 zeta 2 eta 1 theta 2 iota 1 kappa"
    same = "alpha 8 beta 9 gamma 8 delta 9 epsilon 8 zeta 9 eta 8 theta 9 iota 8 kappa"
    mixed = "alpha 4 beta 5 gamma 6 delta 7 epsilon 8 zeta 9 eta 10 theta 11 iota 12 kappa"
    merged = "alpha 8 beta 8 gamma 8 delta 8 epsilon 8 zeta 8 eta 8 theta 8 iota 8 kappa"
    assert set(found(spark, docs_of, [(1, same), (2, mixed), (3, merged)], [(1, item)])) == {(1, 1)}


def test_names_that_open_a_sentence_are_slots(spark, docs_of):
    items = [
        (1, "Maria bought 12 red pens at the shop."),
        (2, "Tom has 3 apples. Anna has 5 pears. Bob has 4 plums. How many do they have?"),
    ]
    docs = [
        (1, "Peter bought 15 red pens at the shop."),
        (2, "An exercise: Lea has 7 apples. Jim has 2 pears. Max has 9 plums. How many do they have?"),
        (3, "he said that Peter bought 15 red pens at the shop."),
        (4, "Lea has 7 apples. Jim has 2 pears and likes the shop."),
    ]
    got = found(spark, docs_of, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 1)}
    assert got[1, 1] == (8, 8, 2, 2)


def test_short_items_unspaced_scripts_and_long_passages(spark, docs_of):
    plain = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uv'[i // 100]}" for i in range(200)]
    items = [
        (1, "12 kg plus 3 kg equals 15 kg"),
        (2, "What is 12 + 35?"),
        (3, "小明有三个苹果，他吃了一个。"),
        (4, " ".join(plain)),
        (5, " ".join(x + " 7" for x in plain[::-1])),
    ]
    docs = [
        (1, "so 12 kg plus 3 kg equals 15 kg here"),
        (2, "Asked: what is 12 + 35? Nobody knew."),
        (3, "题目：小明有三个苹果，他吃了一个。答案"),
        (4, "before it " + " ".join(plain[40:135]) + " after it"),
        (5, "before it " + " ".join(plain[40:53]) + " after it"),
        (6, "before it " + " ".join(plain[40:52]) + " after it"),
        (7, "before it " + " ".join(x + " 9" for x in plain[100:50:-1]) + " after it"),
        (8, "What is 13 + 35? 小明有苹果"),
    ]
    got = found(spark, docs_of, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (7, 5)}
    assert got[1, 1] == (8, 8, 0, 0) and got[4, 4][:2] == (95, 200) and got[7, 5][:2] == (100, 400)


def test_equals_brute_force_on_the_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    texts = {r.doc_id: f" {plain(r.text)} " for r in docs.select("doc_id", "text").collect()}
    want = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if f" {plain(r.text)} " in t}
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    assert got == want


def test_filter_keeps_columns_and_empty_tables(spark, docs_of):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs_of([(1, ITEMS[3][1]), (2, "clean"), (None, ITEMS[3][1]), (3, None)])
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3]
    assert dc.contaminated(docs_of([]), bench).collect() == []
    assert dc.contaminated(df, bench.where("false")).collect() == []


def test_short_items_are_frames_of_whole_sentences(spark):
    items = [(1, "Compute 12 * 7 - 3 and explain"), (2, "What is 12 + 35?"), (3, "the"), (4, "12 kg plus 3 kg equals 15 kg"), (5, "Solve it: x + 3 = 3"), (6, "7")]
    docs = [
        (10, "Some text. Compute 45 * 9 - 8 and explain. More text."),
        (11, "Compute 45 + 9 - 8 and explain."),
        (12, "First, compute 45 * 9 - 8 and explain why."),
        (13, "hello\nwhat is 4 + 8?\nbye"),
        (14, "what is 4 - 8?"),
        (15, "see the river"),
        (16, "A line.\nThe\nanother line"),
        (17, "20 kg plus 4 kg equals 24 kg"),
        (18, "Solve it: x + 5 = 5"),
        (19, "Solve it: x + 5 = 6"),
        (20, "7"),
        (21, None),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect())
    assert got == [(10, 1), (16, 3), (18, 5)]
