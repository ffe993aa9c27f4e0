import pytest
from pyspark.sql import functions as F

from sitespec import as_pages, inspect, load_pages, load_responses
from sitespec.operators import pages as P
from sitespec.plans.settings import page_budget, stages
from sitespec.sources import derived, ok_only, skipped
from sitespec.streaming import stream_call_sites, stream_links, stream_pages, stream_titles

ALL = ["api", "assets", "crawler", "explorer", "html", "javascript", "routes"]


def test_budgets():
    assert [page_budget(p, "all") for p in ("fast", "balanced", "deep")] == [15, 100, 500]
    assert page_budget("fast", 42) == 42
    for profile, pages in (("slow", "all"), ("fast", 0), ("fast", -1), ("fast", "ten"), ("fast", True), ("fast", 1.5)):
        with pytest.raises(ValueError):
            page_budget(profile, pages)


def test_stages():
    assert stages("all_data") == ALL
    assert stages("api_spec") == ["api", "crawler", "html", "javascript"]
    assert stages("explorer_visual") == ["api", "crawler", "explorer", "html", "javascript", "routes"]
    assert stages(["cloning", "html", "html"]) == ["assets", "crawler", "html"]
    assert stages("explorer") == ["api", "crawler", "explorer", "javascript", "routes"]
    for bad in ("nope", [], 3, ["html", "nope"]):
        with pytest.raises(ValueError):
            stages(bad)


PAGE = "domain string, path string, page_id bigint, status_code int, content_type string, text string"


@pytest.fixture(scope="module")
def site(spark):
    home = '<title>Home</title><a href="/b">b</a><script src="app.js"></script><img src="/i.png"><a href="//[x/">x</a>'
    return as_pages(spark.createDataFrame(
        [("d", "/", 1, 200, "text/html", home), ("d", "/b", 2, 200, "", "<a href='/gone'>"),
         ("d", "/app.js", 3, 200, "application/javascript", "location.href = '/c';\nfunction f() { fetch('u.php') }"),
         ("d", "/c", 4, 200, "text/html", ""), ("d", "/i.png", 5, 200, "image/png", ""), ("d", "/alone", 6, 200, "text/html", ""),
         ("e", "/x", 7, 200, "text/html", "")], PAGE))


def test_inspect_everything(spark, site):
    responses = spark.createDataFrame(
        [(1, "d", "/api/u.php", "POST", 200, "application/json", "{}")],
        "response_id bigint, domain string, url string, method string, status_code int, content_type string, body string")
    result = inspect(site, responses)
    assert result.actions_run == ALL
    pages = [(r.path, r.depth, r.title) for r in result.pages.orderBy("crawl_rank").collect()]
    assert pages == [("/", 0, "Home"), ("/app.js", 1, None), ("/b", 1, "Untitled Page"), ("/i.png", 1, None), ("/c", 2, "Untitled Page")]
    counts = {r.domain: r for r in result.summary.collect()}
    d = counts["d"]
    assert (d.pages_crawled, d.routes, d.endpoints, d.endpoints_verified, d.assets_saved, d.warnings) == (5, 6, 1, 1, 1, 1)
    assert counts["e"].pages_crawled == 0
    assert sorted((r.domain, r.path) for r in result.skipped.collect()) == [("d", "/gone"), ("e", "/")]
    total = result.summary.groupBy().sum("pages_crawled", "html_titles", "assets_saved", "endpoints", "endpoints_verified", "routes")
    assert [n for stage in ("crawler", "html", "assets", "api", "routes") for k, n in result.stages[stage].items() if k != "levels"] == list(total.first())
    assert result.stages["crawler"]["levels"] == 3 and result.stages["javascript"] == {"call_sites": 1}
    assert result.edges.count() == 5
    assert result.api_spec().count() == 3 and result.manifest().count() == 5
    assert result.report("markdown").filter(F.col("domain") == "d").count() == 17
    assert result.explorer_visual().filter(F.col("domain") == "e").count() == 4


def test_inspect_parts(spark, site, sf_dir):
    responses = derived.responses(spark, sf_dir)
    quick = inspect(site, responses, actions="api_spec", profile="fast", domain="https://d/")
    assert [r.domain for r in quick.summary.collect()] == ["d"]
    assert quick.endpoints.filter("live_verified").count() == 0 and quick.routes is None
    with pytest.raises(ValueError):
        quick.explorer()
    clone = inspect(site, actions="cloning", max_page=2)
    assert clone.endpoints is None and clone.pages.count() == 2
    bare = inspect(site, actions="explorer", domain="d")
    assert bare.pages.filter("title is not null").count() == 0
    for bad in ({"domain": ""}, {"actions": "nope"}, {"profile": "slow"}, {"max_page": 0}):
        with pytest.raises(ValueError):
            inspect(site, **bad)


def test_sources(spark, tmp_path, sf_dir):
    pages = load_pages(spark, f"{sf_dir}/pages.parquet")
    assert pages.count() == 50 and skipped(pages).count() == 0
    raw = spark.createDataFrame([("https://D.e/x?q", bytearray(b"a\xffb"), "Text/CSS", None, 3)],
                                "url string, content binary, content_type string, headers map<string,string>, page_id int")
    row = as_pages(raw).collect()[0]
    assert (row.domain, row.path, row.text, row.content_type, row.status_code) == ("D.e", "/x", "ab", "text/css", 200)
    assert ok_only(as_pages(raw)).count() == 1
    derived.responses(spark, sf_dir).limit(3).write.json(str(tmp_path / "r"))
    assert load_responses(spark, str(tmp_path / "r"), "json").count() == 3


def test_snapshots_as_a_stream(spark, sf_dir):
    schema = "page_id bigint, url string, html string"
    pages = as_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    stream = stream_pages(spark, f"{sf_dir}/page*.parquet", schema)
    for name, frame, want in (
        ("links", stream_links(stream), P.extract_links(pages).count()),
        ("titles", stream_titles(stream), 50),
        ("calls", stream_call_sites(stream), P.call_sites(pages).count()),
    ):
        query = frame.writeStream.format("memory").queryName(f"s_{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert spark.table(f"s_{name}").count() == want


def test_plans_stay_in_the_jvm(spark, sf_dir):
    pages = as_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    facts = P.page_facts(pages)
    for frame in (facts, P.extract_links(pages), P.call_sites(pages), P.titles(pages)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan and "Cartesian" not in plan
    # The page is tokenised once, and no later column carries its text.
    assert facts._jdf.queryExecution().executedPlan().toString().count("<(?:!--") == 1
    assert "text" not in facts.columns
    # A count of pages reads neither text nor URL beyond the key.
    plan = P.page_kinds(pages).select("page_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint>" in plan


def test_report_of_any_actions(spark):
    import pytest

    from sitespec import as_pages, inspect

    rows = [("d", "/", "<title>t</title><a href='/a'>x</a>"), ("d", "/a", "<p>a</p>")]
    pages = as_pages(spark.createDataFrame(rows, "domain string, path string, text string"))
    for actions in ("cloning", ["html"]):
        result = inspect(pages, actions=actions)
        assert any("# Inspection Report" in r.line for r in result.report("markdown").collect())
        with pytest.raises(ValueError, match="unknown report format"):
            result.report("xml")
    assert sorted((r.local_path, r.text) for r in result.clone(pages).collect()) == [("a/index.html", "<p>a</p>"), ("index.html", rows[0][2])]
    assert result.report("json").count() > 3


def test_stage_counts_without_pages(spark, site):
    assert inspect(site.limit(0)).stages == {
        "crawler": {"pages_crawled": 0, "levels": 1}, "html": {"html_titles": 0}, "assets": {"assets_saved": 0},
        "javascript": {"call_sites": 0}, "api": {"endpoints": 0, "endpoints_verified": 0}, "routes": {"routes": 0}}
    assert sorted(inspect(site, actions="cloning").stages) == ["assets", "crawler", "html"]
