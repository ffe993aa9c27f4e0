"""Route table, route tree, counts per site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitespec.functions import html
from sitespec.functions.urls import html_route_path, url_basename, url_ext
from sitespec.operators.ranking import number_within

ORDER = ("section", "crawl_rank", "line_no", "path")

# Texts of the route tree.
TREE_HEAD = ("📂 ", " (Enterprise Frontend Map Layout)")
API_HEAD = "⚙️ Simulated Backend API Endpoint Tree"
NO_API = "└── [No API Endpoints Captured]"
BRANCH, LAST_BRANCH = "├── ", "└── "
TITLE_MARK = ("  📌 (", ")")


def page_routes(pages: DataFrame) -> DataFrame:
    """Routes of crawled pages: HTML pages as folders, others as files."""
    path, ext = F.col("path"), url_ext(F.col("path"))
    is_html = html.is_html(F.col("content_type"), path)
    return pages.select(
        "domain",
        F.when(is_html, html_route_path(path)).otherwise(path).alias("path"),
        F.when(is_html, F.lit("index.html"))
        .otherwise(F.coalesce(F.nullif(url_basename(path), F.lit("")), path)).alias("file"),
        F.when(is_html, F.lit("html")).when(ext == "", F.lit("unknown"))
        .otherwise(F.regexp_replace(ext, r"^\.+", "")).alias("type"),
        F.when(is_html, F.lit(".html")).otherwise(ext).alias("format"),
        F.when(is_html, F.col("title")).alias("title"),
        F.lit(0).alias("section"), F.col("crawl_rank").cast("bigint").alias("crawl_rank"), F.lit(0).alias("line_no"),
    )


def endpoint_routes(found: DataFrame) -> DataFrame:
    url = F.col("url")
    return found.select(
        "domain",
        url.alias("path"),
        F.coalesce(F.nullif(url_basename(url), F.lit("")), F.lit("index.php")).alias("file"),
        F.lit("json").alias("type"),
        F.coalesce(F.nullif(url_ext(url), F.lit("")), F.lit(".php")).alias("format"),
        F.lit(None).cast("string").alias("title"),
        F.lit(1).alias("section"), F.col("crawl_rank").cast("bigint").alias("crawl_rank"), "line_no",
    )


def routes(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages in crawl order, then endpoints; duplicates are kept.

    ``ORDER`` names the columns that put the rows of a domain in order.
    """
    return page_routes(pages).unionByName(endpoint_routes(found))


def number_routes(table: DataFrame) -> DataFrame:
    """Replace the order columns by one ``ordinal`` per domain, from 1."""
    numbered = number_within(table, ["domain"], list(ORDER), "ordinal")
    return numbered.select("domain", "path", "file", "type", "format", "title", "ordinal")


def frontend_routes(table: DataFrame) -> DataFrame:
    return table.filter(F.col("type") != "json")


def api_routes(table: DataFrame) -> DataFrame:
    return table.filter(F.col("type") == "json")


def tree_lines(domains: DataFrame, table: DataFrame) -> DataFrame:
    """Route tree of every domain as ordered lines: ``(domain, section, line_no, line)``.

    A tree is the lines of its domain in order of section and line number; it is
    never put together in one row, since one site may hold most of the routes.
    ``table`` is read twice, so pass a written one.
    """
    listed = frontend_routes(table).select(
        "domain", F.lit(1).alias("part"), "path", "section", "crawl_rank", "line_no", "title"
    )
    apis = api_routes(table).select("domain", "path").distinct().select(
        "domain", F.lit(4).alias("part"), "path", F.lit(0).alias("section"),
        F.lit(0).cast("bigint").alias("crawl_rank"), F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("title"),
    )
    items = number_within(
        listed.unionByName(apis), ["domain", "part"], ["path", "section", "crawl_rank", "line_no"], "n", "size"
    )
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(TITLE_MARK[0]), "title", F.lit(TITLE_MARK[1])))
    connector = F.when(F.col("n") == F.col("size"), F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH))
    body = items.select(
        "domain", F.col("part").alias("section"), F.col("n").alias("line_no"),
        F.concat(connector, "path", F.coalesce(title, F.lit(""))).alias("line"),
    )
    fixed = domains.select("domain").distinct().select(
        "domain",
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("section"),
                    F.concat(F.lit(TREE_HEAD[0]), "domain", F.lit(TREE_HEAD[1])).alias("line"),
                ),
                F.struct(F.lit(2).alias("section"), F.lit("").alias("line")),
                F.struct(F.lit(3).alias("section"), F.lit(API_HEAD).alias("line")),
            )
        ),
    )
    empty = (
        domains.select("domain").distinct()
        .join(items.filter(F.col("part") == 4).select("domain").distinct(), "domain", "left_anti")
        .select("domain", F.lit(4).alias("section"), F.lit(NO_API).alias("line"))
    )
    heads = fixed.unionByName(empty).select("domain", "section", F.lit(1).cast("bigint").alias("line_no"), "line")
    return body.unionByName(heads)


def asset_counts(pages: DataFrame) -> DataFrame:
    asset = html.is_static_asset(F.col("content_type"), F.col("path"))
    return pages.groupBy("domain").agg(F.count_if(asset).alias("assets_saved"))


def summary(
    pages: DataFrame, found: DataFrame, warnings: DataFrame, domains: DataFrame | None = None
) -> DataFrame:
    """Counts of the result, one row per domain; ``domains`` adds those without any page.

    Each frame gives its own counts; their union is summed by one shuffle that
    carries one row per domain and task.
    """
    asset = html.is_static_asset(F.col("content_type"), F.col("path"))
    names = (
        "pages_crawled", "html_titles", "routes", "endpoints", "endpoints_verified", "assets_saved", "warnings"
    )

    def ones(df: DataFrame, **counted) -> DataFrame:
        return df.select(
            "domain", *[counted.get(n, F.lit(0)).cast("bigint").alias(n) for n in names]
        )

    one = F.lit(1)
    parts = [
        ones(pages, pages_crawled=one, routes=one, assets_saved=asset, html_titles=F.col("title").isNotNull()),
        ones(found, endpoints=one, routes=one, endpoints_verified=F.col("live_verified")),
        ones(warnings, warnings=one),
    ]
    if domains is not None:
        parts.append(ones(domains))
    return reduce(DataFrame.unionByName, parts).groupBy("domain").agg(*[F.sum(n).alias(n) for n in names])
