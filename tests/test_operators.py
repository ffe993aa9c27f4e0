import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitespec import as_pages
from sitespec.functions import json_text as J
from sitespec.operators import crawl as C
from sitespec.operators import endpoints as E
from sitespec.operators import pages as P
from sitespec.operators import ranking, routes as R

LINKED = "domain string, path string, status_code int, links array<string>"


def walk(spark, rows, **kw):
    done = C.crawl(spark.createDataFrame(rows, LINKED), **kw)
    got = sorted((r.domain, r.crawl_rank, r.path, r.depth) for r in done.pages.collect())
    return got, sorted((r.domain, r.path, r.status_code) for r in done.skipped.collect())


def test_crawl_levels_cycles_failures_and_budget(spark):
    rows = [
        ("a", "/", 200, ["/y", "/x", "/404", "/gone", "/"]), ("a", "/x", 200, ["/", "/deep"]), ("a", "/y", 200, ["/x"]),
        ("a", "/404", 404, ["/hidden"]), ("a", "/hidden", 200, []), ("a", "/deep", 200, ["/deep", "/y"]),
        ("b", "/", 500, ["/z"]), ("b", "/z", 200, []), ("c", "/only", 200, []),
    ]
    full, skipped = walk(spark, rows)
    assert full == [("a", 1, "/", 0), ("a", 2, "/x", 1), ("a", 3, "/y", 1), ("a", 4, "/deep", 2)]
    assert skipped == [("a", "/404", 404), ("a", "/gone", None), ("b", "/", 500), ("c", "/", None)]
    # Failed pages use no budget, and the budget cuts inside a level by path.
    assert walk(spark, rows, max_page=2)[0] == full[:2]
    assert walk(spark, rows, max_page=3)[0] == full[:3]
    assert walk(spark, rows, max_depth=1)[0] == full[:3]


def test_crawl_stops_early_once_budgets_are_full(spark):
    chain = [("a", "/" if i == 0 else f"/{i}", 200, [f"/{i + 1}"]) for i in range(12)]
    done = C.crawl(spark.createDataFrame(chain, LINKED), 3)
    assert done.levels == 3 and done.pages.count() == 3


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_number_within_equals_row_number_on_a_hot_group(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("domain"),
        F.sha2(F.col("id").cast("string"), 256).alias("key"),
    )
    got = ranking.number_within(df, ["domain"], ["key"], "n", "size")
    w = Window.partitionBy("domain")
    want = df.withColumn("n", F.row_number().over(w.orderBy("key")).cast("bigint")).withColumn(
        "size", F.count(F.lit(1)).over(w)
    )
    assert got.exceptAll(want).count() == 0 and got.count() == 5000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_join_per_domain_equals_plain_join(spark):
    df = spark.range(1000).select(F.concat(F.lit("d"), F.col("id") % 7).alias("domain"), F.col("id").alias("path"))
    small = spark.createDataFrame([("d1",), ("d3",)], "domain string")
    got = ranking.join_per_domain(df, small, "left_anti", F.col("path"))
    want = df.join(small, "domain", "left_anti")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def script_pages(spark, *texts, domain="d"):
    rows = [(domain, f"/js/{i}.js", i, 200, "application/javascript", t) for i, t in enumerate(texts)]
    return as_pages(spark.createDataFrame(
        rows, "domain string, path string, page_id bigint, status_code int, content_type string, text string"))


def test_last_call_wins_at_the_place_of_the_first(spark):
    pages = script_pages(spark, "one = fetch('a.php')\ntwo = fetch('b.php')", "get = fetch('a.php?x')")
    got = E.api_candidates(P.call_sites(pages)).orderBy("crawl_rank", "line_no").collect()
    assert [(r.url, r.method, r.function_purpose, r.crawl_rank, r.line_no) for r in got] == [
        ("/api/a.php", "GET", "get", 0, 1), ("/api/b.php", "POST", "two", 0, 2)]


def test_confidence_scores(evaluate):
    fn = lambda p, r, live: E.confidence(p, r, live)
    cases = [([], [], False), (["a"], [], False), (["a"], ["b"], False), ([], [], True), ([], ["b"], True), (["a"], ["b"], True)]
    got = evaluate(fn, cases, ["array<string>", "array<string>", "boolean"])
    assert [g["score"] for g in got] == [40, 55, 70, 60, 75, 90]
    assert got[5]["reasons"] == [E.REASON_FOUND, E.REASON_PAYLOAD, E.REASON_READS, E.REASON_LIVE]
    assert got[4]["reasons"] == [E.REASON_FOUND, E.REASON_READS, E.REASON_LIVE]


def test_mock_payload(evaluate):
    cases = [("POST", ["user_id", "amount", "name", "phoneNumber"]), ("GET", ["a"]), ("POST", [])]
    got = [json.loads(t) for t in evaluate(J.mock_payload, cases, ["string", "array<string>"])]
    assert got == [{"user_id": "1234567890", "amount": 1000, "name": "test_data", "phoneNumber": "1234567890"}, {}, {}]


SAMPLES = [
    ("application/json", '{"k": 69}', '{"k":69}', True), ("text/json; x", '[{"a":1},2]', '{"a":1}', True),
    ("application/json", "[]", "[]", True), ("application/json", "7", "7", False), ("application/json", "null", "null", False),
    ("application/json", "[null, 1]", "null", False), ("application/json", "[[1],2]", "[1]", True),
    ("application/json", "oops", '{"error":"Failed to parse returned JSON string"}', True),
    ("application/json", '"a connection_error b"', '"a connection_error b"', False),
    ("application/json", '{"connection_error": 1}', '{"connection_error":1}', False),
    ("application/json", '[["connection_error"]]', '["connection_error"]', False),
    ("application/json", "true", "true", False), ("failed", 'say "x"', '{"raw_non_json_sample":"say \\"x\\""}', True),
]


def test_response_samples(evaluate):
    got = evaluate(J.response_sample, [s[:2] for s in SAMPLES], ["string", "string"])
    assert got == [s[2] for s in SAMPLES]
    assert evaluate(J.sample_verified, [(s[2],) for s in SAMPLES], ["string"]) == [s[3] for s in SAMPLES]
    long = evaluate(J.response_sample, [("text/html", "x" * 900)], ["string", "string"])[0]
    assert len(json.loads(long)["raw_non_json_sample"]) == 200


def test_verify_takes_the_last_response_and_full_urls(spark):
    found = E.endpoints(E.api_candidates(P.call_sites(script_pages(spark, "fetch('/a')\nfetch('/b')\nfetch('/c')"))))
    responses = spark.createDataFrame(
        [(1, "d", "/a", "POST", 200, "application/json", "7"), (2, "d", "https://d/a", "POST", 500, "failed", "x"),
         (3, "d", "/b", "GET", 200, "text/html", "x"), (4, "d", "/c", "POST", 200, "application/json", "null")],
        "response_id bigint, domain string, url string, method string, status_code int, content_type string, body string")
    checked = E.verify(found, responses)
    got = {r.url: (r.live_verified, r.live_ok, r.live_content_type, r.confidence.score) for r in checked.collect()}
    assert got == {"/a": (True, False, "failed", 60), "/b": (False, False, None, 40), "/c": (False, False, "application/json", 40)}
    assert [(r.path, r.stage) for r in E.verify_warnings(checked).collect()] == [("/c", "api")]


def test_unique_pages_keeps_the_lowest_page_id(spark):
    rows = [("d", "/x", 9, "late"), ("d", "/x", 2, "early"), ("d", "/y", 5, "y")]
    df = spark.createDataFrame(rows, "domain string, path string, page_id bigint, title string")
    assert sorted(r.title for r in P.unique_pages(df).collect()) == ["early", "y"]


def routes_frame(spark, rows):
    return spark.createDataFrame(
        rows, "domain string, path string, file string, type string, format string, title string, "
              "section int, crawl_rank bigint, line_no int")


def tree_text(lines, domain):
    rows = lines.filter(F.col("domain") == domain).orderBy("section", "line_no").collect()
    return "\n".join(r.line for r in rows)


def test_tree_lines(spark):
    table = routes_frame(spark, [
        ("d", "/b/", "index.html", "html", ".html", "B", 0, 1, 0), ("d", "/a/", "index.html", "html", ".html", "", 0, 2, 0),
        ("d", "/api/x", "x", "json", ".php", None, 1, 1, 1), ("d", "/api/x", "x", "json", ".json", None, 0, 3, 0),
        ("d", "/api/w", "w", "json", ".php", None, 1, 1, 2), ("e", "/s.css", "s.css", "css", ".css", None, 0, 1, 0)])
    lines = R.tree_lines(spark.createDataFrame([("d",), ("e",), ("f",)], "domain string"), table)
    assert tree_text(lines, "d") == (
        "📂 d (Enterprise Frontend Map Layout)\n├── /a/\n└── /b/  📌 (B)\n\n"
        "⚙️ Simulated Backend API Endpoint Tree\n├── /api/w\n└── /api/x")
    assert tree_text(lines, "e").endswith("└── /s.css\n\n⚙️ Simulated Backend API Endpoint Tree\n└── [No API Endpoints Captured]")
    assert tree_text(lines, "f").count("\n") == 3


def test_page_and_endpoint_routes(spark):
    pages = spark.createDataFrame(
        [("d", "/", "text/html", "T", 1), ("d", "/a.html", "", None, 2), ("d", "/x.JSON", "application/json", None, 3),
         ("d", "/plain", "text/plain", None, 4), ("d", "/.htaccess", "text/plain", None, 5), ("d", "/dir/", "image/x", None, 6)],
        "domain string, path string, content_type string, title string, crawl_rank int")
    got = [(r.path, r.file, r.type, r.format, r.title) for r in R.page_routes(pages).orderBy("crawl_rank").collect()]
    assert got == [
        ("/", "index.html", "html", ".html", "T"), ("/a.html/", "index.html", "html", ".html", None),
        ("/x.JSON", "x.JSON", "json", ".json", None), ("/plain", "plain", "unknown", "", None),
        ("/.htaccess", ".htaccess", "unknown", "", None), ("/dir/", "/dir/", "unknown", "", None)]
    found = spark.createDataFrame([("d", "/api/", 1, 1), ("d", "/api/x.JS", 1, 2), ("d", "", 1, 3)],
                                  "domain string, url string, crawl_rank int, line_no int")
    got = [(r.path, r.file, r.format) for r in R.endpoint_routes(found).orderBy("line_no").collect()]
    assert got == [("/api/", "index.php", ".php"), ("/api/x.JS", "x.JS", ".js"), ("", "index.php", ".php")]


def test_bad_links_are_dropped_alone(spark):
    text = '<a href="http://[bad/x">1</a><a href="/ok">2</a><script>location="//[worse/y"</script>'
    df = spark.createDataFrame([("https://d/p", text)], "url string, html string")
    row = P.page_links(as_pages(df)).collect()[0]
    assert row.links == ["/ok"] and sorted(row.bad_links) == ["[bad", "[worse"]


@pytest.mark.parametrize("links", [["/a", "/b"], []])
def test_discovered_links_need_no_shuffle(spark, links):
    html = "".join(f"<a href='{link}'>" for link in links)
    df = as_pages(spark.createDataFrame([("https://d/", html)], "url string, html string"))
    linked = P.page_links(df)
    assert P.discovered_links(linked).collect()[0].paths == links
    assert [r.dst_path for r in P.explode_links(linked).collect()] == links
    assert "Exchange" not in P.extract_links(df)._jdf.queryExecution().executedPlan().toString()


def test_responses_without_id_count(spark):
    from sitespec.operators.endpoints import latest_responses
    from sitespec.schemas import RESPONSE_SCHEMA

    rows = [
        (None, "d", "https://d/api/u", "POST", 200, "application/json", "{}"),
        (None, "d", "https://d/api/v", "GET", 500, "text/html", "no id"),
        (7, "d", "https://d/api/v", "GET", 200, "text/html", "seven"),
        (None, "d", "https://d/api/u", "POST", 200, "application/json", "{}"),
    ]
    got = {r.full_url: r.body for r in latest_responses(spark.createDataFrame(rows, RESPONSE_SCHEMA)).collect()}
    assert got == {"https://d/api/u": "{}", "https://d/api/v": "seven"}


def test_pages_without_id_count(spark):
    rows = [("d", "/", None, "a"), ("d", "/", 4, "b"), ("d", "/x", None, "c"), ("d", "/x", None, "c")]
    from sitespec.operators.pages import unique_pages

    got = unique_pages(spark.createDataFrame(rows, "domain string, path string, page_id long, title string")).collect()
    assert sorted((r.path, r.page_id, r.title) for r in got) == [("/", 4, "b"), ("/x", None, "c")]


def test_nothing_is_skipped_after_a_full_budget(spark):
    from sitespec.operators.crawl import crawl

    rows = [
        ("a", "/", 200, ["/a", "/b", "/c"]), ("a", "/a", 200, []), ("a", "/c", 404, []),
        ("b", "/", 200, ["/a", "/b", "/c"]), ("b", "/b", 200, []), ("c", "/", 200, ["/x"]),
    ]
    linked = spark.createDataFrame(rows, "domain string, path string, status_code int, links array<string>")
    got = crawl(linked, max_page=2)
    assert sorted((r.domain, r.path) for r in got.pages.collect()) == [("a", "/"), ("a", "/a"), ("b", "/"), ("b", "/b"), ("c", "/")]
    assert sorted((r.domain, r.path) for r in got.skipped.collect()) == [("b", "/a"), ("c", "/x")]


def test_scripts_with_many_calls_and_keys(spark):
    import time

    from sitespec.operators.pages import call_sites

    def script(calls):
        lines = [f"const v{i} = data.key{i};" for i in range(calls)]
        lines += [f"async function f{i}() {{ const r = await apiCall('/r{i}', 'POST'); form.append('k{i}', 1); }}" for i in range(calls)]
        return "\n".join(lines)

    schema = "domain string, path string, page_id long, content_type string, text string"

    def seconds(calls):
        page = spark.createDataFrame([("d", "/a.js", 1, "application/javascript", script(calls))], schema)
        start = time.time()
        assert call_sites(page).count() == calls
        call_sites(page).write.format("noop").mode("overwrite").save()
        return time.time() - start

    seconds(10)
    assert seconds(800) < 60


def test_samples_keep_the_documents_own_values(spark):
    from pyspark.sql import functions as F

    rows = [
        ('{"a":1, "a":2}', '{"a":1,"a":2}'), ('{"x": 1.0, "y": 1e400, "z": 12345678901234567890123456789}', '{"x":1.0,"y":1e400,"z":12345678901234567890123456789}'),
        ('["s t", 2]', '"s t"'), ("[2.50]", "2.50"), ("[null]", "null"), ("{'a':1}", J.BROKEN_JSON), ("1] [2", J.BROKEN_JSON), ('{"a":1} x', J.BROKEN_JSON),
    ]
    df = spark.createDataFrame(rows, "body string, want string")
    got = df.select("body", "want", J.response_sample(F.lit("text/json"), F.col("body")).alias("got"))
    assert [r for r in got.collect() if r.got != r.want] == []
    long = spark.range(1).select(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 20_500_000), F.lit('"}')).alias("b"))
    assert long.select(F.length(J.response_sample(F.lit("text/json"), F.col("b"))).alias("n")).first().n == 20_500_008


def test_the_plan_of_a_crawl_does_not_grow_with_its_levels(spark):
    """A chain of pages: what was tried is one scan, however many levels there are."""
    chain = [("d", f"/{n}" if n else "/", 200, [f"/{n + 1}"]) for n in range(12)]
    done = C.crawl(spark.createDataFrame(chain, LINKED))
    assert done.levels == 13 and [r.path for r in done.skipped.collect()] == ["/12"]
    assert done.skipped._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
