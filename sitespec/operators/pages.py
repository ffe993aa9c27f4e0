"""One parse per page: title, links and call sites, with the page text left behind.

Everything is computed inside the row. The result is narrow, so later shuffles
never carry page bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.functions import html, javascript as js
from sitespec.functions.navigation import js_nav_links
from sitespec.functions.paths import route_root
from sitespec.functions.strings import built_once, strip
from sitespec.functions.urls import bad_netloc, reject_link, resolve_reference, same_domain, split_reference


def html_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(html.is_html(F.col("content_type"), F.col("path")))


def javascript_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(html.is_javascript(F.col("content_type"), F.col("path")))


def static_asset_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(html.is_static_asset(F.col("content_type"), F.col("path")))


def page_kinds(pages: DataFrame) -> DataFrame:
    """Three independent flags: a page may be HTML and JavaScript at once."""
    ct, path = F.col("content_type"), F.col("path")
    return pages.select(
        "domain", "path", "page_id",
        html.is_html(ct, path).alias("is_html"),
        html.is_javascript(ct, path).alias("is_javascript"),
        html.is_static_asset(ct, path).alias("is_static_asset"),
    )


def titles(pages: DataFrame, *keep: str) -> DataFrame:
    """Title of every HTML page; NULL for other pages."""
    title = F.when(html.is_html(F.col("content_type"), F.col("path")), _title("tokens"))
    keys = ("domain", "path", "url", "page_id", *keep)
    tokens = pages.select(*{*keys, "content_type"}, _tokens("text").alias("tokens"))
    return tokens.select(*keys, title.alias("title"))


@built_once
def _tokens(text: str) -> Column:
    return html.html_tokens(F.col(text))


@built_once
def _title(tokens: str) -> Column:
    return html.token_title(F.col(tokens))


@built_once
def _references(tokens: str, text: str) -> Column:
    """Split references of the links that may be followed, duplicates removed."""
    raw = F.concat(html.tag_links(F.col(tokens)), js_nav_links(F.col(text)))
    followed = F.filter(F.transform(raw, strip), lambda v: ~reject_link(v))
    return F.transform(F.array_distinct(followed), split_reference)


@built_once
def _same_site_paths(references: str, domain: str, path: str) -> Column:
    site = F.col(domain)
    usable = F.filter(F.col(references), lambda r: ~bad_netloc(r.netloc))
    targets = F.transform(usable, lambda r: resolve_reference(r, F.lit("https"), site, F.col(path)))
    same = F.filter(targets, lambda t: same_domain(t.netloc, site))
    return F.sort_array(F.array_distinct(F.transform(same, lambda t: t.path)))


@built_once
def _bad_links(references: str) -> Column:
    return F.transform(F.filter(F.col(references), lambda r: bad_netloc(r.netloc)), lambda r: r.netloc)


def page_links(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per page with the sorted distinct same-site paths it links to.

    HTML links and script navigation strings are looked for in pages of any type.
    ``bad_links`` holds the hosts of links that are not valid URLs.
    """
    keys = ("domain", "path", "page_id", *keep)
    tokens = pages.select(*keys, "text", _tokens("text").alias("tokens"))
    refs = tokens.select(*keys, _references("tokens", "text").alias("references"))
    return refs.select(
        *keys,
        _same_site_paths("references", "domain", "path").alias("links"),
        _bad_links("references").alias("bad_links"),
    )


def explode_links(linked: DataFrame) -> DataFrame:
    """Rows of ``page_links`` to one row per link. Links are already distinct within a page."""
    return unfold(linked.select("domain", F.col("path").alias("src_path"), F.explode_outer("links").alias("dst_path")))


def unfold(exploded: DataFrame) -> DataFrame:
    """Drop the NULL rows of ``explode_outer`` or ``inline_outer``, told by the last column.

    The plain generators make the optimizer add a filter on the size of the array
    and push it below, which would compute the array, here a whole parse, twice.
    """
    return exploded.filter(F.col(exploded.columns[-1]).isNotNull())


def extract_links(pages: DataFrame) -> DataFrame:
    """``edges(domain, src_path, dst_path)``; no shuffle."""
    return explode_links(page_links(pages))


def discovered_links(linked: DataFrame) -> DataFrame:
    """Source page to its set of paths: already a column of ``page_links``."""
    return linked.select("domain", "path", F.col("links").alias("paths"))


def links_per_domain(linked: DataFrame) -> DataFrame:
    """Pages, links and pages without links by domain; counts are added up before the shuffle."""
    n = F.size("links")
    return linked.groupBy("domain").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(n.cast("bigint")).alias("links"),
        F.count_if(n == 0).alias("pages_without_links"),
    )


@built_once
def _calls(text: str, root: str, lines: str, keys: str, reading: str) -> Column:
    return js.call_site_array(*[F.col(c) for c in (text, root, lines, keys, reading)])


@built_once
def _root(path: str, text: str) -> Column:
    return route_root(F.col(path), js.api_base_url(F.col(text)))


def _script_facts(pages: DataFrame, *keep: str) -> DataFrame:
    """File-level facts and the call sites of each script, next to the kept columns."""
    text = F.col("text")
    facts = pages.select(
        *keep,
        "text",
        js.payload_format(text).alias("expected_payload_format"),
        js.response_keys(text).alias("js_response_reading_keys"),
        js.js_lines(text).alias("lines"),
        _root("path", "text").alias("root"),
    ).withColumn("reading", js.reading_text(F.col("lines")))
    calls = _calls("text", "root", "lines", "js_response_reading_keys", "reading")
    return facts.select(*keep, "expected_payload_format", "js_response_reading_keys", calls.alias("calls"))


def call_sites(pages: DataFrame) -> DataFrame:
    """One row per backend call in a script page; the rest of the page is not carried along."""
    scripts = javascript_pages(pages).filter(js.call_line(F.col("text")))
    return explode_calls(_script_facts(scripts, "domain", "path", "page_id").withColumnRenamed("page_id", "crawl_rank"))


def explode_calls(facts: DataFrame) -> DataFrame:
    """Rows with a ``calls`` array to one row per call site."""
    return unfold(
        facts.select(
            "domain", F.col("path").alias("file_path"), "crawl_rank", "expected_payload_format",
            "js_response_reading_keys", F.inline_outer("calls"),
        )
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """Everything the later stages need from a page, in one pass over its text.

    One row per page: kind flags, title, links, call sites. The token array
    serves both the title and the links.
    """
    ct, path, text = F.col("content_type"), F.col("path"), F.col("text")
    keys = ("domain", "path", "url", "page_id", "status_code", "content_type")
    is_script = html.is_javascript(ct, path) & js.call_line(text)
    tokens = pages.select(*keys, "text", _tokens("text").alias("tokens"))
    refs = tokens.select(
        *keys,
        F.when(html.is_html(ct, path), _title("tokens")).alias("title"),
        F.when(is_script, text).alias("script"),
        _references("tokens", "text").alias("references"),
    )
    linked = refs.select(
        *keys, "title", F.col("script").alias("text"),
        _same_site_paths("references", "domain", "path").alias("links"),
        _bad_links("references").alias("bad_links"),
    )
    return _script_facts(linked, *keys, "title", "links", "bad_links")


def unique_pages(facts: DataFrame) -> DataFrame:
    """One row per ``(domain, path)``, the one with the lowest ``page_id``; rows without one come last.

    Ties are settled by a hash of the row, so the order is never NULL.

    Partial aggregation keeps one row per key and task before the shuffle, so a
    page captured very often does not gather in one place. Call it on narrow rows.
    """
    rest = [c for c in facts.columns if c not in ("domain", "path")]
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64(*rest).alias("row"))
    best = facts.groupBy("domain", "path").agg(F.min_by(F.struct(*rest), order).alias("row"))
    return best.select("domain", "path", "row.*").select(*facts.columns)
