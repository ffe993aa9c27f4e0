"""Throughput on replicated snapshots: ``$BENCH_COPIES`` copies of ``pages`` with new hosts.

A third of all copies go to one host. The copies are written once to a fresh
temporary folder as many files, so that the scan is parallel.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sitespec import load_pages
from sitespec.operators import pages as ops


def main() -> None:
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("BENCH_COPIES", "40"))
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sitespec-scale")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(4 * cpus)).config("spark.checkpoint.dir", f"{work}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    pages = spark.read.parquet(f"{source}/pages.parquet")
    host = F.when(F.col("copy") % 3 == 0, F.lit("https://hot.example/")).otherwise(
        F.concat(F.lit("https://h"), F.col("copy"), F.lit("."))
    )
    (
        pages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .select(
            (F.col("page_id") * copies + F.col("copy")).alias("page_id"),
            F.concat(host, F.regexp_replace("url", "^https?://", "")).alias("url"),
            "html",
        )
        .repartition(16 * cpus).write.parquet(f"{work}/pages")
    )
    snapshots = load_pages(spark, f"{work}/pages")
    facts = spark.read.parquet(f"{work}/pages").agg(F.count(F.lit(1)), F.sum(F.length("html"))).first()
    jobs = {
        "page_titles": lambda: ops.titles(snapshots),
        "link_edges": lambda: ops.extract_links(snapshots),
        "links_per_domain": lambda: ops.links_per_domain(ops.page_links(snapshots)),
        "page_facts": lambda: ops.page_facts(snapshots),
        "unique_facts": lambda: ops.unique_pages(ops.page_facts(snapshots)),
    }
    seconds = {}
    for name, job in jobs.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 2)
    print(json.dumps({
        "pages": facts[0], "megabytes": round(facts[1] / 1e6), "cpus": cpus, "runs": runs, "seconds": seconds,
        "pages_per_second": {k: round(facts[0] / v) for k, v in seconds.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
