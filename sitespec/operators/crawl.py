"""Breadth-first crawl of every site at once, as an iterative join over captured pages."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitespec.operators.ranking import join_per_domain, number_within
from sitespec.schemas import materialize, shared_folder


@dataclass(frozen=True)
class Crawl:
    """``pages(domain, path, depth, crawl_rank)`` and what was tried without success."""

    pages: DataFrame
    skipped: DataFrame
    levels: int


def _nodes(linked: DataFrame) -> DataFrame:
    """Pages by key; only good pages keep their links.

    Hash-partitioned and sorted once: the cache keeps both properties, so no level
    shuffles or sorts the pages again.
    """
    partitions = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return linked.select(
        "domain", "path", "status_code", F.when(F.col("status_code") == 200, F.col("links")).alias("links")
    ).repartition(partitions, "domain", "path").sortWithinPartitions("domain", "path")


def crawl(
    linked: DataFrame, max_page: int | None = None, max_depth: int | None = None, seed: str = "/"
) -> Crawl:
    """Follow links from ``seed`` in every domain until nothing new turns up.

    ``linked`` holds one row per ``(domain, path)`` with ``status_code`` and
    ``links``. A path without a captured page counts as failed: it is visited,
    yields no links and uses no budget. ``max_page`` bounds the good pages of
    each domain, nearest first and by path within a depth.

    Each level is one job that writes the next frontier to the shared folder;
    the good pages keep their hash partitioning in the cache and are not
    shuffled again. Domains that have reached their budget leave the frontier.
    """
    nodes = _nodes(linked).persist()
    try:
        tried, depths = _levels(nodes, max_page, max_depth, seed)
    finally:
        nodes.unpersist()

    good = tried.filter(F.col("links").isNotNull()).select("domain", "path", "depth")
    pages = number_within(good, ["domain"], ["depth", "path"], "crawl_rank")
    missed = tried.filter(F.col("links").isNull()).select("domain", "path", "depth", "status_code")
    if max_page is not None:
        pages = pages.filter(F.col("crawl_rank") <= max_page)
        # A site with a full budget stops at its last good page: what comes after it is never tried.
        last = pages.filter(F.col("crawl_rank") == max_page).select("domain", F.struct("depth", "path").alias("_last"))
        before = join_per_domain(missed, last, "left", F.col("path"))
        missed = before.filter(F.col("_last").isNull() | (F.struct("depth", "path") < F.col("_last"))).drop("_last")
    return Crawl(pages, missed, depths)


def _levels(nodes: DataFrame, max_page: int | None, max_depth: int | None, seed: str) -> tuple[DataFrame, int]:
    """The tried paths of all depths with the links of the good ones, and the number of depths.

    Each depth is a folder below one in the shared folder. What was tried so far is one scan of them, so the plan of
    a level does not grow with its depth.
    """
    spark = nodes.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/sitespec-{uuid.uuid4().hex}"

    def look_up(frontier: DataFrame, depth: int) -> DataFrame:
        found = frontier.join(nodes, ["domain", "path"], "left")
        named = found.select("domain", "path", F.lit(depth).alias("depth"), "status_code", "links")
        return materialize(named, f"level{depth}", folder)

    def tried(depths: int) -> DataFrame:
        return spark.read.schema(level.schema).parquet(*[f"{folder}/level{depth}" for depth in range(depths)])

    level = look_up(nodes.select("domain").distinct().withColumn("path", F.lit(seed)), 0)
    depths = 1
    while max_depth is None or depths <= max_depth:
        open_pages = level.filter(F.col("links").isNotNull())
        if max_page is not None:
            good = tried(depths).filter(F.col("links").isNotNull())
            full = good.groupBy("domain").count().filter(F.col("count") >= max_page).select("domain")
            open_pages = join_per_domain(open_pages, full, "left_anti", F.col("path"))
        fresh = (
            open_pages.select("domain", F.explode("links").alias("path"))
            .distinct()
            .join(tried(depths).select("domain", "path"), ["domain", "path"], "left_anti")
        )
        found = look_up(fresh, depths)
        if found.isEmpty():
            break
        level, depths = found, depths + 1
    return tried(depths), depths
