import json

import pytest
from pyspark.sql import functions as F

from sitespec import as_pages
from sitespec.operators import endpoints as E, pages as P, routes as R
from sitespec.sinks import (
    api_spec_lines, clone_files, clone_manifest, clone_warnings, explorer_lines, local_path, report_json_lines,
    report_lines, report_markdown_lines, write_lines,
)

SCRIPT = """const API_BASE_URL = '/v1';
function go() { fetch("a.php"); const p = { user_id: 1 }; use(result.userInfo, data.x); }
"quote \\" and <tag>"; z = fetch('b.php')"""


@pytest.fixture(scope="module")
def parts(spark):
    rows = [("d", "/", 1, 200, "text/html", "<title>\"Home\" & ü</title>"),
            ("d", "/m.js", 2, 200, "application/javascript", SCRIPT),
            ("d", "/s.css", 3, 200, "text/css", "x"), ("e", "/", 4, 200, "text/html", "")]
    pages = as_pages(spark.createDataFrame(
        rows, "domain string, path string, page_id bigint, status_code int, content_type string, text string"))
    facts = P.page_facts(pages).withColumnRenamed("page_id", "crawl_rank").cache()
    found = E.endpoints(E.api_candidates(P.explode_calls(facts))).cache()
    warnings = spark.createDataFrame([("d", "/q", "api", "odd")], "domain string, path string, stage string, message string")
    return facts, found, R.routes(facts, found), warnings


def document(lines, domain):
    rows = lines.filter(F.col("domain") == domain).orderBy("section", "line_no").collect()
    return "\n".join(r.line for r in rows)


def test_api_spec_document(parts):
    spec = json.loads(document(api_spec_lines(parts[1]), "d"))
    assert list(spec) == ["/v1/a.php", "/v1/b.php"]
    entry = spec["/v1/a.php"]
    assert entry["guessed_payload_keys"] == ["user_id"] and entry["live_response_sample"] is None
    assert entry["extracted_response_schema_from_js"]["userInfo"]["id"] == "TYPE_NUMBER"
    assert entry["extracted_response_schema_from_js"]["x"] == "TYPE_UNKNOWN_DETERMINED_BY_JS"
    assert entry["confidence"] == {"score": 70, "reasons": [E.REASON_FOUND, E.REASON_PAYLOAD, E.REASON_READS]}
    assert spec["/v1/b.php"]["raw_js_context"].startswith('"quote \\" and <tag>"')
    assert document(api_spec_lines(parts[1]), "e") == ""


def test_explorer_document(parts):
    facts, _, table, _ = parts
    doc = json.loads(document(explorer_lines(facts.select("domain").distinct(), table), "d"))
    assert doc["domain"] == "d" and [r["path"] for r in doc["website_routes"]] == [
        "/", "/m.js", "/s.css", "/v1/a.php", "/v1/b.php"]
    assert doc["website_routes"][0]["title"] == '"Home" & ü' and "title" not in doc["website_routes"][1]


def test_reports(parts):
    facts, found, table, warnings = parts
    counts = R.summary(facts, found, warnings)
    tree = R.tree_lines(facts.select("domain").distinct(), table)
    doc = json.loads(document(report_json_lines(counts, found, table, tree, warnings, ["html", "api"]), "d"))
    assert (doc["pages_crawled"], doc["assets_saved"], doc["actions_run"]) == (3, 1, ["api", "html"])
    assert len(doc["api_spec"]) == 2 and len(doc["routes"]) == 5 and doc["routes"][1]["title"] is None
    assert doc["explorer_visual"][0].startswith("📂 d") and doc["warnings"] == ["api: /q: odd"]
    text = document(report_markdown_lines(counts, found, warnings, ["html", "api"]), "d")
    assert text.split("\n")[:12] == [
        "# Inspection Report -- d", "", "- Pages crawled: 3", "- Routes discovered: 5", "- API endpoints reconstructed: 2",
        "- Static assets: 1", "- Actions run: api, html", "", "## API Spec", "", "### `POST /v1/a.php`", "- Purpose: p"]
    assert text.endswith("- Confidence: 55\n\n## Warnings\n- api: /q: odd")
    empty = document(report_markdown_lines(counts, found, warnings, ["html"]), "e")
    assert "## Warnings" not in empty and "###" not in empty
    with pytest.raises(ValueError):
        report_lines("xml", counts, found, table, tree, warnings, [])


def test_write_lines(parts, spark, tmp_path):
    facts, _, table, _ = parts
    lines = explorer_lines(facts.select("domain").distinct(), table)
    write_lines(lines, str(tmp_path / "docs"), folders=True)
    files = sorted((tmp_path / "docs" / "domain=d").glob("part-*"))
    doc = json.loads("".join(f.read_text(encoding="utf-8") for f in files))
    assert len(doc["website_routes"]) == 5
    write_lines(lines, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == lines.count()


def test_local_path(evaluate):
    cases = [
        (("/", "text/html"), "index.html"), (("//", "x"), "index.html"), (("/a", "text/html"), "a/index.html"),
        (("/a/", "text/html"), "a/index.html"), (("/a.php", "text/html"), "a.php"), (("/s", "text/javascript"), "s.js"),
        (("/s.js", "text/javascript"), "s.js"), (("/s", "text/css"), "s.css"), (("/i//b/./c.png", "image/png"), "i/b/c.png"),
        (("/x/.html", "text/html"), "x/index.html"), (("/a.b/c", "TEXT/HTML"), "a.b/c/index.html"),
        (("/s/", "application/javascript"), "s/.js"), (("/a/../b.css", "text/css"), "a/../b.css"), (("/q?x.y", "text/html"), "q/index.html"),
    ]
    assert evaluate(local_path, [c for c, _ in cases], ["string"] * 2) == [w for _, w in cases]


def test_manifest_last_page_wins_and_stays_inside(spark):
    pages = spark.createDataFrame(
        [("d", "/a", "text/html", 1, "first"), ("d", "/a/", "text/html", 2, "second"), ("d", "/../up.css", "text/css", 3, "bad")],
        "domain string, path string, content_type string, crawl_rank int, text string")
    names = clone_manifest(pages)
    assert [(r.local_path, r.path) for r in names.collect()] == [("a/index.html", "/a/")]
    assert [r.text for r in clone_files(pages, names).collect()] == ["second"]
    assert [r.path for r in clone_warnings(pages).collect()] == ["/../up.css"]


def test_one_text_for_each_cloned_file(spark):
    pages = spark.createDataFrame([("d", "/a", 2, "new"), ("d", "/a", 1, "old"), ("d", "/a", None, "none")], "domain string, path string, page_id long, text string")
    names = spark.createDataFrame([("d", "a/index.html", "/a", 3)], "domain string, local_path string, path string, crawl_rank int")
    assert [r.text for r in clone_files(pages, names).collect()] == ["old"]


def test_no_local_folder_on_a_cluster():
    import pytest

    from sitespec.schemas import shared_folder

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
