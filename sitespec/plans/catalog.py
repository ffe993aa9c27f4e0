"""Every registered query, over whole tables or inputs that Spark derives from them.

Arrays and structs are shown as text, so that results can be compared by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitespec.functions import html, javascript as js, urls
from sitespec.functions.json_text import response_sample, sample_verified, schema_json
from sitespec.functions.navigation import js_nav_links
from sitespec.functions.paths import posix_dirname, route_root
from sitespec.functions.strings import decode_text
from sitespec.operators import calls as calling
from sitespec.operators import crawl as crawling
from sitespec.operators import endpoints as api
from sitespec.operators import pages as ops
from sitespec.operators import routes as routing
from sitespec.plans.inspect import inspect
from sitespec.plans.settings import stages
from sitespec.schemas import materialize, shared_folder
from sitespec.sinks import (
    api_spec_lines, clone_files, clone_manifest, explorer_lines, local_path, report_json_lines, report_markdown_lines,
)
from sitespec.sinks.clone_writer import clone_round_trip
from sitespec.sources import as_pages, load_pages, ok_only, skipped, spread
from sitespec.sources import derived
from sitespec.sources.app_scripts import app_scripts

Query = Callable[[SparkSession, str], DataFrame]


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The test tables are files of one split each.
    return load_pages(spark, f"{sf_dir}/pages.parquet", partitions=_tasks(spark))


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pages(spread(derived.site_pages(spark, sf_dir), _tasks(spark)))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The files come out of an aggregation whose few output bytes would be parsed by few tasks.
    files = derived.js_files(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    return as_pages(files)


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Like the scripts, few bytes with much to parse.
    return as_pages(app_scripts(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.call_sites(_scripts(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.endpoints(api.api_candidates(_calls(spark, sf_dir)))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified endpoints, written once: most queries use them more than once."""
    return materialize(api.verify(_found(spark, sf_dir), derived.responses(spark, sf_dir)), "verified")


def _text(array: Column | str) -> Column:
    return F.array_join(array, ",")


# Pages --------------------------------------------------------------------


def page_titles(spark, sf_dir):
    return ops.titles(_snapshots(spark, sf_dir)).select("page_id", "title")


def site_titles(spark, sf_dir):
    return ops.titles(_site(spark, sf_dir)).select("page_id", "title")


def _edges(linked: DataFrame) -> DataFrame:
    source = F.col("path").alias("src_path")
    return ops.unfold(linked.select("page_id", "domain", source, F.explode_outer("links").alias("dst_path")))


def link_edges(spark, sf_dir):
    return _edges(ops.page_links(_snapshots(spark, sf_dir)))


def site_links(spark, sf_dir):
    return _edges(ops.page_links(_site(spark, sf_dir)))


def discovered_links(spark, sf_dir):
    return ops.page_links(_snapshots(spark, sf_dir)).select("page_id", _text("links").alias("paths"))


def links_per_domain(spark, sf_dir):
    return ops.links_per_domain(ops.page_links(_snapshots(spark, sf_dir)))


def js_nav(spark, sf_dir):
    pages = _site(spark, sf_dir).unionByName(_scripts(spark, sf_dir))
    return ops.unfold(pages.select("domain", "page_id", F.explode_outer(js_nav_links(F.col("text"))).alias("link")))


def page_kinds(spark, sf_dir):
    return ops.page_kinds(_site(spark, sf_dir)).select("page_id", "is_html", "is_javascript", "is_static_asset")


def asset_counts(spark, sf_dir):
    return routing.asset_counts(_site(spark, sf_dir))


def status_counts(spark, sf_dir):
    pages = _site(spark, sf_dir)
    good = ok_only(pages).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("ok"))
    rest = skipped(pages).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("skipped"))
    return good.unionByName(rest)


def url_parts(spark, sf_dir):
    url = F.col("url")
    return _snapshots(spark, sf_dir).select(
        "page_id", urls.url_netloc(url).alias("netloc"), urls.url_path(url).alias("url_path"),
        urls.url_ext(F.col("path")).alias("ext"), urls.url_basename(F.col("path")).alias("basename"),
        posix_dirname(F.col("path")).alias("dirname"), urls.clean_domain(url).alias("cleaned"),
    )


def page_routes(spark, sf_dir):
    pages = _site(spark, sf_dir).withColumn("crawl_rank", F.col("page_id")).withColumn(
        "title", F.when(html.is_html(F.col("content_type"), F.col("path")), html.html_title(F.col("text")))
    )
    return routing.page_routes(pages).select(
        F.col("crawl_rank").alias("page_id"), "domain", "path", "file", "type", "format", "title"
    )


def local_paths(spark, sf_dir):
    return _site(spark, sf_dir).select(
        "page_id", local_path(F.col("path"), F.col("content_type")).alias("local_path")
    )


def manifest(spark, sf_dir):
    pages = _site(spark, sf_dir).withColumn("crawl_rank", F.col("page_id"))
    return clone_manifest(pages)


def _clone(spark, sf_dir):
    """The files of the clone of all sites, one text a file."""
    keys = ops.unique_pages(_site(spark, sf_dir).select("domain", "path", "page_id", "content_type"))
    names = materialize(clone_manifest(keys.withColumnRenamed("page_id", "crawl_rank")), "manifest")
    winners = names.select("domain", "path", F.col("crawl_rank").alias("page_id"))
    texts = _site(spark, sf_dir).join(winners, ["domain", "path", "page_id"], "left_semi")
    return clone_files(texts, names)


def clone_sizes(spark, sf_dir):
    return _clone(spark, sf_dir).groupBy("domain").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("characters")
    )


def clone_on_disk(spark, sf_dir):
    """The clone written as files and read back, in parts: bytes and hashes under the names on disk."""
    folder = f"{shared_folder(spark).rstrip('/')}/sitespec-{uuid.uuid4().hex}/clone"
    return clone_round_trip(materialize(_clone(spark, sf_dir), "clone_files"), folder)


def decoded_bytes(spark, sf_dir):
    """Texts of all snapshots as bytes, damaged by bytes that are not UTF-8 beside a genuine U+FFFD, and decoded."""
    bad = F.array(*[F.lit(bytearray(b)) for b in (b"\xff", b"\xe2\x82", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80")])
    text, cut = F.col("text"), F.pmod("page_id", F.lit(40)).cast("int")
    piece = F.get(bad, F.pmod("page_id", F.lit(5)).cast("int"))
    head, tail = F.encode(F.substr(text, F.lit(1), cut), "UTF-8"), F.encode(F.substr(text, cut + 1), "UTF-8")
    damaged = F.concat(piece, head, F.lit(bytearray("\ufffd".encode())), piece, tail, piece)
    pages = _snapshots(spark, sf_dir).select("page_id", decode_text(damaged).alias("decoded"))
    return pages.select("page_id", F.length("decoded").alias("characters"), F.md5("decoded").alias("md5"))


# Scripts ------------------------------------------------------------------


def script_facts(spark, sf_dir):
    text = F.col("text")
    return _scripts(spark, sf_dir).select(
        "page_id", js.api_base_url(text).alias("base"), js.payload_format(text).alias("format"),
        route_root(F.col("path"), js.api_base_url(text)).alias("root"),
        _text(js.response_keys(text)).alias("response_keys"),
    )


def call_sites(spark, sf_dir):
    return _calls(spark, sf_dir).select(
        "domain", "file_path", "line_no", "endpoint_literal", "method", "function_purpose",
        "expected_payload_format", "raw_js_context",
    )


def resolved_routes(spark, sf_dir):
    return _calls(spark, sf_dir).select("domain", "file_path", "line_no", "endpoint_literal", "url")


def payload_keys(spark, sf_dir):
    return _calls(spark, sf_dir).select(
        "domain", "file_path", "line_no", _text("guessed_payload_keys").alias("payload_keys")
    )


def response_schema(spark, sf_dir):
    pairs = F.transform("response_schema", lambda e: F.concat(e.key, F.lit(":"), e.kind))
    return _calls(spark, sf_dir).select("domain", "file_path", "line_no", _text(pairs).alias("schema"))


def api_candidates(spark, sf_dir):
    return api.api_candidates(_calls(spark, sf_dir)).select(
        "domain", "url", "method", "function_purpose", "raw_js_context", "crawl_rank", "line_no",
        _text("guessed_payload_keys").alias("payload_keys"),
    )


def endpoint_confidence(spark, sf_dir):
    return _found(spark, sf_dir).select(
        "domain", "url", "method", F.col("confidence.score").alias("score"),
        F.array_join("confidence.reasons", "; ").alias("reasons"),
    )


def mock_payloads(spark, sf_dir):
    return api.probe_plan(_found(spark, sf_dir)).select("domain", "url", "full_url", "method", "payload")


def response_samples(spark, sf_dir):
    last = api.latest_responses(derived.responses(spark, sf_dir))
    sample = response_sample(F.col("content_type"), F.col("body"))
    return last.select("domain", "full_url", "method", "status_code", sample.alias("sample")).withColumn(
        "verified", sample_verified(F.col("sample"))
    )


def verify_endpoints(spark, sf_dir):
    return _verified(spark, sf_dir).select(
        "domain", "url", "method", "live_verified", "live_ok", "live_response_sample", "live_content_type",
        F.col("confidence.score").alias("score"),
    )


def verify_warnings(spark, sf_dir):
    return api.verify_warnings(_verified(spark, sf_dir))


# Calls of any name --------------------------------------------------------


def masked_scripts(spark, sf_dir):
    return calling.masked_scripts(_apps(spark, sf_dir)).select("domain", "file_path", "masked")


def masked_scopes(spark, sf_dir):
    return calling.masked_scopes(_apps(spark, sf_dir))


def call_functions(spark, sf_dir):
    return calling.call_functions(calling.code_calls(_apps(spark, sf_dir)))


def wrapper_calls(spark, sf_dir):
    return calling.wrapper_calls(calling.code_calls(_apps(spark, sf_dir)))


def call_styles(spark, sf_dir):
    return calling.call_styles(calling.code_calls(_apps(spark, sf_dir))).withColumn("keys", _text("keys"))


# Crawl --------------------------------------------------------------------


def _linked(spark, sf_dir):
    linked = ops.page_links(_site(spark, sf_dir), "status_code").drop("bad_links")
    return materialize(ops.unique_pages(linked), "linked")


def _crawl(max_page: int | None = None, max_depth: int | None = None) -> Query:
    def run(spark, sf_dir):
        return crawling.crawl(_linked(spark, sf_dir), max_page, max_depth).pages.select(
            "domain", "path", "depth", "crawl_rank"
        )

    return run


def crawl_skipped(spark, sf_dir):
    return crawling.crawl(_linked(spark, sf_dir)).skipped.select("domain", "path", "depth", "status_code")


def crawl_skipped_budget(spark, sf_dir):
    found = crawling.crawl(_linked(spark, sf_dir), max_page=20)
    return found.skipped.select("domain", "path", "depth", "status_code")


# Sites --------------------------------------------------------------------


def _good_pages(spark, sf_dir):
    """Good pages of the sites and all scripts, in order of page number; written once."""
    pages = ok_only(_site(spark, sf_dir)).unionByName(_scripts(spark, sf_dir))
    titled = ops.titles(pages, "content_type").drop("url")
    return materialize(ops.unique_pages(titled).withColumnRenamed("page_id", "crawl_rank"), "titled")


def _routes(spark, sf_dir):
    return materialize(routing.routes(_good_pages(spark, sf_dir), _found(spark, sf_dir)), "routes")


def all_routes(spark, sf_dir):
    return routing.number_routes(_routes(spark, sf_dir))


def explorer_tree(spark, sf_dir):
    table = _routes(spark, sf_dir)
    return routing.tree_lines(table.select("domain").distinct(), table)


def explorer_json(spark, sf_dir):
    table = _routes(spark, sf_dir)
    return explorer_lines(table.select("domain").distinct(), table)


def api_spec_json(spark, sf_dir):
    return api_spec_lines(_verified(spark, sf_dir))


def _report_parts(spark, sf_dir):
    pages = _good_pages(spark, sf_dir)
    found = _verified(spark, sf_dir)
    warnings = api.verify_warnings(found)
    return routing.summary(pages, found, warnings), found, routing.routes(pages, found), warnings


def site_summary(spark, sf_dir):
    return _report_parts(spark, sf_dir)[0]


def report_markdown(spark, sf_dir):
    counts, found, _, warnings = _report_parts(spark, sf_dir)
    return report_markdown_lines(counts, found, warnings, stages("all_data"))


def report_json(spark, sf_dir):
    counts, found, table, warnings = _report_parts(spark, sf_dir)
    tree = routing.tree_lines(counts.select("domain"), table)
    return report_json_lines(counts, found, table, tree, warnings, stages("all_data"))


def inspect_summary(spark, sf_dir):
    return inspect(_site(spark, sf_dir), derived.responses(spark, sf_dir), profile="deep").summary


def inspect_endpoints(spark, sf_dir):
    found = inspect(_site(spark, sf_dir), actions="api_spec", profile="balanced").endpoints
    return found.select(
        "domain", "url", "method", "function_purpose", _text("guessed_payload_keys").alias("payload_keys"),
        schema_json(F.col("response_schema")).alias("schema"), F.col("confidence.score").alias("score"),
    )


QUERIES: dict[str, Query] = {
    "page_titles": page_titles,
    "site_titles": site_titles,
    "link_edges": link_edges,
    "site_links": site_links,
    "discovered_links": discovered_links,
    "links_per_domain": links_per_domain,
    "js_nav_links": js_nav,
    "page_kinds": page_kinds,
    "asset_counts": asset_counts,
    "status_counts": status_counts,
    "url_parts": url_parts,
    "page_routes": page_routes,
    "local_paths": local_paths,
    "clone_manifest": manifest,
    "clone_sizes": clone_sizes,
    "clone_on_disk": clone_on_disk,
    "decoded_bytes": decoded_bytes,
    "script_facts": script_facts,
    "call_sites": call_sites,
    "resolved_routes": resolved_routes,
    "payload_keys": payload_keys,
    "response_schema": response_schema,
    "api_candidates": api_candidates,
    "endpoint_confidence": endpoint_confidence,
    "mock_payloads": mock_payloads,
    "response_samples": response_samples,
    "verify_endpoints": verify_endpoints,
    "verify_warnings": verify_warnings,
    "masked_scripts": masked_scripts,
    "masked_scopes": masked_scopes,
    "call_functions": call_functions,
    "wrapper_calls": wrapper_calls,
    "call_styles": call_styles,
    "crawl_full": _crawl(),
    "crawl_budget": _crawl(max_page=100),
    "crawl_depth": _crawl(max_depth=3),
    "crawl_skipped": crawl_skipped,
    "crawl_skipped_budget": crawl_skipped_budget,
    "all_routes": all_routes,
    "explorer_tree": explorer_tree,
    "explorer_json": explorer_json,
    "api_spec_json": api_spec_json,
    "site_summary": site_summary,
    "report_markdown": report_markdown,
    "report_json": report_json,
    "inspect_summary": inspect_summary,
    "inspect_endpoints": inspect_endpoints,
}
