"""Fixed input schemas, and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PAGE_SCHEMA = (
    "page_id bigint, url string, status_code int, content_type string, text string, headers map<string,string>"
)
RESPONSE_SCHEMA = (
    "response_id bigint, domain string, url string, method string, status_code int, content_type string, body string"
)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one is made only in local mode where none is named, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sitespec-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The table cuts the lineage, survives lost executors, carries sizes that let
    joins pick a strategy, and is read column by column afterwards.
    """
    spark = df.sparkSession
    target = f"{folder or shared_folder(spark).rstrip('/') + '/sitespec-' + uuid.uuid4().hex}/{name}"
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
