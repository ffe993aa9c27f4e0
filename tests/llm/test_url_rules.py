import random
from itertools import combinations

from sitespec.llm.url_rules import BASE, RuleIndex, TokenRule, filter_urls, mine_rules, rule_of, url_host, url_path, url_tokens

SCHEMA = "page_id long, url string, host string, verdict int"


def test_parts_and_base_rules(evaluate):
    cases = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "x://sub.www.example.com/en/1": ("sub.www.example.com", "/en/1", "www.example.com/en/"),
        "http://example.com/de": ("example.com", "/de", "com/"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "http://a.net/es/://b.com/": ("a.net", "/es/://b.com/", "net/es/"),
        "http://net/fr/": ("net", "/fr/", "net/fr/"),
        "http://example.com?x=/en/": ("example.com", "", None),
        "http://ÄB.net/fr": ("Äb.net", "/fr", None),
        "no scheme": ("", "", None), "": ("", "", None), None: ("", "", None), "://": ("", "", None), "a\nb://c\nd/e": ("c\nd", "/e", None),
    }
    urls = [(u,) for u in cases]
    assert evaluate(url_host, urls, ["string"]) == [c[0] for c in cases.values()]
    assert evaluate(url_path, urls, ["string"]) == [c[1] for c in cases.values()]
    found = evaluate(lambda u: rule_of(url_host(u), url_path(u))["rule"], urls, ["string"])
    assert found == [c[2] for c in cases.values()]
    assert len({r.text for r in BASE}) == 5


def test_tokens(evaluate):
    urls = [("https://m.a.com/en/42.html?page=2&ref=x#t",), (None,), ("x",), ("http://a.com/1/2/b",)]
    assert evaluate(url_tokens, urls, ["string"]) == [
        ["host:m", "host:a", "host:com", "path:en", "path:0", "ending:html", "key:page", "key:ref"], [], [],
        ["host:a", "host:com", "path:0", "path:b"],
    ]


def brute_rules(rows, support, confidence):
    """All combinations of the tokens, counted one by one."""
    tokens = sorted({t for ts, _ in rows for t in ts})
    found = {}
    for size in range(1, len(tokens) + 1):
        for some in combinations(tokens, size):
            held = [v for ts, v in rows if set(some) <= set(ts)]
            for verdict in set(held):
                n = held.count(verdict)
                everywhere = sum(v == verdict for _, v in rows) / len(rows)
                if n >= support * len(rows) and n >= confidence * len(held) and n / len(held) > everywhere:
                    found[frozenset(some), verdict] = (n / len(held), n / len(rows))
    return {
        k: v for k, v in found.items()
        if not any(found.get((k[0] - {t}, k[1]), (0,))[0] >= v[0] for t in k[0])
    }


def test_mined_rules_and_index_are_those_of_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.sample("abcdef", rng.randrange(5)),) for _ in range(150)]
    rows = [(t, "block" if ("a" in t and "b" in t) or rng.random() < 0.1 else "allow") for (t,) in rows]
    got = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.7)
    want = brute_rules(rows, 0.02, 0.7)
    assert {(r.tokens, r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in got} == {
        k: (round(c, 9), round(s, 9)) for k, (c, s) in want.items()
    } and got
    index = RuleIndex(got)
    for tokens, _ in rows:
        assert index.best(tokens) == min((r for r in got if r.tokens <= set(tokens)), key=lambda r: r.rank, default=None)
    assert index.best(None) is None


def test_ties_between_rules():
    rules = [TokenRule(frozenset(t), v, 0.9, 0.1) for t, v in (("a", "allow"), ("b", "block"), ("bc", "allow"))]
    index = RuleIndex(rules)
    assert index.best(["a", "b"]).verdict == "block" and index.best(["a", "b", "c"]).text == "b c"


def test_pages(spark):
    rows = [(i, f"http://bad.com/x/{i}" if i % 2 else f"http://w{i}.com/en/{i}", "h", 1) for i in range(60)]
    rows += [(100, "http://bad.org/x/1", "h", 1), (101, "http://good.org/1", "h", 1), (None, None, None, None), (7, "", None, None)]
    rows += [(102, "http://bad.org/x/1", "h", 1)] * 2 + [(103, "http://a.org/" + "s/" * 50_000, "h", 1)]
    pages = spark.createDataFrame(rows, SCHEMA)
    labelled = pages.filter("page_id < 60").selectExpr("url", "CASE WHEN url LIKE '%bad%' THEN 'block' ELSE 'allow' END AS verdict")
    got = {}
    for r in filter_urls(pages, labelled=labelled).collect():
        got.setdefault(r.page_id, []).append((r.host, r.rule, r.verdict, r.mined_rule))
    assert got[1] == [("bad.com", "com/", "allow", None)]
    assert got[100] == [("bad.org", None, "block", "host:bad")]
    assert got[101][0][2] == "allow" and got[None] == [("", None, "allow", None)]
    assert len(got[102]) == 2 and len(got[7]) == 2 and got[103][0][2] == "allow"
    assert filter_urls(pages.limit(0)).collect() == []
    assert [r.verdict for r in filter_urls(pages.filter("page_id = 101"), labelled=labelled.limit(0)).collect()] == ["allow"]


def test_whole_table(spark, sf_dir):
    from sitespec.llm.queries import op13_url_filter

    rows = op13_url_filter(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.verdict in ("allow", "block") for r in rows)
    assert all(r.mined_rule is None for r in rows if r.rule)


def test_urls_of_many_tokens_are_mined_whole(spark):
    rng = random.Random(5)
    rows = [[t for t in "abcdefghijklm" if rng.random() < 0.8] for _ in range(120)]
    rows = [(t, "block" if {"l", "m"} <= set(t) or rng.random() < 0.05 else "allow") for t in rows]
    got = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.3, 0.7)
    want = brute_rules(rows, 0.3, 0.7)
    assert {(r.tokens, r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in got} == {
        k: (round(c, 9), round(s, 9)) for k, (c, s) in want.items()
    }
    assert any({"l", "m"} <= r.tokens for r in got)


def test_tokens_that_come_together_do_not_multiply(spark):
    long = [f"k{i}" for i in range(40)]
    rows = [([*long[: i % 41], "bad"], "block") for i in range(82)] + [(long[: i % 41], "allow") for i in range(82)]
    got = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.8)
    assert [(r.tokens, r.verdict, r.confidence) for r in got] == [({"bad"}, "block", 1.0)]
