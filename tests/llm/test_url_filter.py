"""URL rules against a plain model."""

import random
import re

from roadloom.llm import url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("b.com", "", "block"), ("net", "/x", "allow"), ("net", "/x", "block"), (None, "/", "block")]


def model(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_judge(spark):
    rng = random.Random(2)
    urls = ["", None, "no scheme", "HTTP://A.B.COM", "http://org", "http://org/", "x://a://org/y", "http://.org/", "http://é.org/É?x", "http://exAmple.ORG/es/ü#f",
            "http://a\nb.org/\n", "http://xexample.org/es/1", "http://example.org:80/es/", "http://" + "a." * 400 + "com/de/" + "z" * 5000]
    urls += ["".join(rng.choice(["http://", "com", "org", ".", "/", "example", "es", "de/", "fr/", "en/1", "?", "#", "B", "net", "/x"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = [(i % 300, u, 1, 2) for i, u in enumerate(urls)] + [(None, "http://a.org/", 1, 2)] * 3 + [(5, "http://a.com/de/", 1, 2)] * 20
    pages = spark.createDataFrame(rows, "page_id long, url string, host int, verdict int")
    rules = url_filter.rules_table(spark, RULES)
    got = url_filter.judge(pages, rules).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, u, *model(u)) for i, u, *_ in rows), key=repr)
    kept = url_filter.allowed_pages(pages, rules)
    assert kept.columns == pages.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if model(r[1])[-1] == "allow"), key=repr)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def test_joined_by_shuffle_gives_the_same(spark):
    pages = spark.createDataFrame([(i, f"http://a{i % 7}.example.org/{'es' if i % 3 else 'en'}/1") for i in range(200)], "page_id long, url string")
    rules = url_filter.rules_table(spark, RULES)
    plain = sorted(map(tuple, url_filter.judge(pages, rules).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, url_filter.judge(pages, rules).collect())) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_rules_of_many_shapes(spark):
    """The plan does not grow with the rules: 2,000 pairs of label count and path length."""
    import time

    rng = random.Random(4)
    rules = [(".".join(["a", "b", "c", "d", "e"][:labels] + ["com"]), "/" + "x" * n, rng.choice(["allow", "block"])) for labels in range(5) for n in range(400)]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = [f"http://{'z.' * (i % 3)}{'.'.join(['a', 'b', 'c', 'd', 'e'][: i % 5] + ['com'])}/{'x' * (i % 420)}y" for i in range(250)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    size = lambda r: len(url_filter.judge(pages, r)._jdf.queryExecution().optimizedPlan().toString())
    assert size(frame) == size(spark.createDataFrame(rules[:5], "host string, path string, verdict string"))
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, frame).collect()}
    assert time.time() - began < 15
    listed = {h + p: v for h, p, v in rules}
    for i, u in enumerate(urls):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fits = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: (len(r), r), default=None)
        assert got[i] == (best, listed[best] if best else "allow")


def test_short_prefixes_alone_decide_the_join(spark, monkeypatch):
    """With prefixes of one digit most candidates are wrong, and all of these are refused."""
    monkeypatch.setattr(url_filter, "PREFIX_DIGITS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame([(i, f"http://h{i % 40}.org/{i % 9}/x") for i in range(300)], "page_id long, url string")
        rules = spark.createDataFrame([(f"h{i}.org", f"/{i % 9}", "block") for i in range(0, 40, 2)], "host string, path string, verdict string")
        judged = url_filter.judge(pages, rules)
        conditions = [line for line in judged._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in line]
        assert len(conditions) == 2 and all("_full" not in line for line in conditions)
        got = {r.page_id: r.verdict for r in judged.collect()}
        assert got == {i: "block" if i % 40 % 2 == 0 and i % 9 == i % 40 % 9 else "allow" for i in range(300)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/", "x", 2), (2, None, "y", 3)], "page_id long, url string, _blocked string, _salt int")
    kept = url_filter.allowed_pages(pages, url_filter.rules_table(spark, RULES))
    assert [tuple(r) for r in kept.collect()] == [(2, None, "y", 3)]
