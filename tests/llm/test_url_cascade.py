import re

from nestfold.llm import queries, url_cascade as uc


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, default)


URLS = [
    None, "", "no scheme", "http://EXAMPLE.org/es/x", "https://m.example.org/en/1?x#y", "http://example.org/en/2", "x://fr.com/fr/", "http://a.b.com/de/#z", "ftp://org", "http://notexample.org/es/",
    "http://org/", "http://xorg/", "://com/fr/a?b://c", "http://ÄB.com/fr/ü\n2", "http://" + "a." * 3000 + "com/de/" + "x" * 20000, "http://a.com?/fr/", "http://a.com#/fr/", "http://..org/", "http://a.com/FR/",
]


def test_contract_rules(spark):
    df = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(URLS)] + [(3, URLS[3], "k", "r"), (None, URLS[4], "k", "r")], "page_id long, url string, key string, rule string")
    rows = uc.judge_urls(df, queries.URL_RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        want = plain(URLS[r.page_id] if r.page_id is not None else URLS[4], queries.URL_RULES)
        assert (r.host, r.path, r.rule, r.verdict) == want


def test_cascade_is_exact_on_its_universe(spark):
    """Many listed keys and more unlisted ones: several levels, no wrong answer."""
    universe = spark.range(6000).selectExpr("concat('h', id, '.com/') as key")
    listed = universe.where("crc32(key) % 7 = 0")
    n = listed.count()
    levels = uc.build(listed, universe, n, 6000)
    assert len(levels) >= 2
    wrong = universe.withColumn("said", uc.member(levels, universe["key"])).where("said <> (crc32(key) % 7 = 0)")
    assert wrong.count() == 0


def test_many_rules_equal_plain_judging(spark):
    rules = [(f"h{i}.net", "/" if i % 3 else "/a/", "block" if i % 2 else "allow") for i in range(150)] + [("net", "/", "block")]
    urls = [f"http://{s}h{i}.net/{p}" for i in range(200) for s in ("", "www.") for p in ("", "a/b", "b")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in uc.judge_urls(df, rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], rules)


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in uc.judge_urls(df, [], default="block").collect()] == [(None, "block")]
    assert uc.judge_urls(df.where("false"), queries.URL_RULES).collect() == []
