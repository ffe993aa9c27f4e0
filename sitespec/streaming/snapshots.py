"""New page snapshots as a stream.

Titles, links and call sites keep no state between rows, so the batch operators
work on a stream as they are. The crawl and everything after it stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitespec.operators.pages import call_sites, extract_links, titles
from sitespec.sources import as_pages


def stream_pages(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Snapshots that arrive as files in a folder."""
    return as_pages(spark.readStream.schema(schema).format(fmt).options(**options).load(path))


def stream_titles(pages: DataFrame) -> DataFrame:
    return titles(pages)


def stream_links(pages: DataFrame) -> DataFrame:
    """One row per page and linked path, distinct within each snapshot."""
    return extract_links(pages)


def stream_call_sites(pages: DataFrame) -> DataFrame:
    return call_sites(pages)
