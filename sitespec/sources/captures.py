"""Scans of captured pages and responses. Nothing here sends a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitespec.functions.html import norm_content_type
from sitespec.functions.strings import decode_text
from sitespec.functions.urls import page_url, url_netloc, url_path
from sitespec.schemas import RESPONSE_SCHEMA


def as_pages(df: DataFrame) -> DataFrame:
    """Bring a table of snapshots to the ``pages`` columns.

    Needs ``text`` (or ``html``, or binary ``content``), and ``url`` or ``domain``
    and ``path``; each side is made from the other. ``status_code`` defaults to 200 and
    ``content_type`` to ``text/html`` where the table has no such column.
    """
    have = set(df.columns)
    if "text" in have:
        text = F.col("text")
    elif "html" in have:
        text = F.col("html")
    else:
        text = decode_text(F.col("content"))
    url = F.col("url") if "url" in have else page_url(F.col("domain"), F.col("path"))
    path = F.col("path") if "path" in have else F.coalesce(F.nullif(url_path(url), F.lit("")), F.lit("/"))
    return df.select(
        (F.col("domain") if "domain" in have else url_netloc(url)).alias("domain"),
        path.alias("path"),
        url.alias("url"),
        (F.col("page_id").cast("bigint") if "page_id" in have else F.xxhash64(url, text)).alias("page_id"),
        (F.col("status_code").cast("int") if "status_code" in have else F.lit(200)).alias("status_code"),
        (norm_content_type(F.col("content_type")) if "content_type" in have else F.lit("text/html")).alias(
            "content_type"
        ),
        F.coalesce(text, F.lit("")).alias("text"),
        (F.col("headers") if "headers" in have else F.lit(None).cast("map<string,string>")).alias("headers"),
    )


def spread(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of a scan out to ``partitions`` tasks; without a number the scan stays as it is.

    Parsing is the costly part, and a small file that can't be split is one task. A number shuffles the page texts
    once; scans of many splits (``spark.sql.files.maxPartitionBytes``) don't need one.
    """
    return scan if partitions is None else scan.repartition(partitions)


def load_pages(spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None) -> DataFrame:
    """Page snapshots from a folder of files; see ``spread`` for ``partitions``."""
    return as_pages(spread(spark.read.format(fmt).load(path), partitions))


def load_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured API responses; missing columns read as NULL."""
    raw = spark.read.schema(RESPONSE_SCHEMA).format(fmt).load(path)
    return raw.withColumn("content_type", norm_content_type(F.col("content_type")))


def ok_only(pages: DataFrame) -> DataFrame:
    """Only pages that answered with status 200 are looked at."""
    return pages.filter(F.col("status_code") == 200)


def skipped(pages: DataFrame) -> DataFrame:
    """The pages that ``ok_only`` leaves out."""
    return pages.filter(F.col("status_code").isNull() | (F.col("status_code") != 200)).select(
        "domain", "path", "url", "status_code"
    )
